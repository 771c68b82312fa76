"""From raw documents to packed training sequences: language ID, line dedup, near-dedup, mixing, packing."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywarden.llm import langid, linededup, mixing, neardup, packing
from tallywarden.llm.queries import vocabulary
from tallywarden.llm.shared import stored
from tallywarden.sources.tables import table


def _apart(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns in one, so that no name of theirs meets an operator's."""
    return docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("row"), "doc_id", "text")


def _together(rows: DataFrame, docs: DataFrame, **changed) -> DataFrame:
    return rows.select(*[changed.get(c, F.col("text") if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Learn from the labelled rows; documents without a language go.

    These are the ones without text or letter, and those that noise explains better, by odds of 20 to 1, than both the
    best mixture of languages and the letters of all documents, labelled or not, do, if the text's own letters are as even as
    chance makes them. So languages without labels, code and other scripts stay, and texts with fewer than 150 letters. If no row has a label nothing is known of languages, and all texts with a letter stay.
    """
    model = langid.learn(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = langid.identify(_apart(docs), model, gain="gain", letters=langid.learn_letters(docs))
    known = found.where((F.col("lang_pred") != langid.NONE) & (F.col("gain") > -math.log(langid.NOISE_ODDS)))
    return _together(known, docs)


def line_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Repeated runs of lines go, every one of 50 words or more; so do documents that consisted of nothing else.

    n_chars, where it is a column, is the length of what is left.
    """
    left = linededup.dedupe(_apart(docs), passage=linededup.LONG_WORDS).where("lines_removed = 0 OR length(trim(text)) > 0")
    changed = {}
    if "n_chars" in docs.columns:
        length = F.when(F.col("lines_removed") > 0, F.char_length("text")).otherwise(F.col("row.n_chars"))
        changed["n_chars"] = length.cast(docs.schema["n_chars"].dataType)
    return _together(left, docs, **changed)


def near_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five words, Jaccard 0.8 or more."""
    return neardup.representatives(docs, width=5, percent=80, overlap=neardup.OVERLAP_80)


def mix(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order of the mix."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens with their ids."""
    return packing.pack(docs, vocabulary())


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources to target weights", mix),
    ("packing", pack),
]
#: The first and last stages learn and tokenize: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages in order over ``documents``; each result is written before the next stage reads it."""
    docs = table(spark, folder, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, folder), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, folder)
