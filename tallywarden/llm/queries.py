"""The queries of this folder's operators over the given tables, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywarden.llm import ann, binary, decontam, extract, hardneg, langid, linededup, mixing, neardup, packing, sql, token_counts, topk, trie
from tallywarden.session import new_folder
from tallywarden.sources.tables import table


def vocabulary() -> str:
    """The word BPE file of the public tokenizers on this machine; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_ann(spark: SparkSession, folder: str) -> DataFrame:
    """The 10 nearest vectors of every hundredth vector."""
    vectors = table(spark, folder, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 100 = 0"), k=10, factor=1.0)


def op2_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every sentence of every document, in whole-document encodings."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return token_counts.count(table(spark, folder, "documents"), path, public_tokenizers.PATTERN, section_end=token_counts.SENTENCE, rule="most").drop("field")


def op3_html(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    texts = extract.main_text(table(spark, folder, "pages"))
    return texts.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op4_neardup(spark: SparkSession, folder: str) -> DataFrame:
    """Component of every document under Jaccard 0.85 of 5-word shingles."""
    return neardup.near_duplicates(table(spark, folder, "documents"))


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    pieces = packing.pack(table(spark, folder, "documents"), vocabulary())
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op6_langid(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document; a quarter of the documents teaches nothing."""
    docs = table(spark, folder, "documents").withColumn("held_out", langid.held_out(F.col("doc_id")))
    model = langid.learn(docs.where("NOT held_out AND doc_id IS NOT NULL"))
    return langid.identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op7_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 highest inner products of every twentieth vector."""
    vectors = table(spark, folder, "embeddings")
    return topk.highest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op8_binary(spark: SparkSession, folder: str) -> DataFrame:
    """All documents, written as token-id files and read back."""
    files = new_folder(spark, "token-ids")
    binary.write_ids(table(spark, folder, "documents"), files, vocabulary())
    return binary.read_ids(spark, files).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """How many words of each document a mix of 150 % of all words takes."""
    return mixing.schedule(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_linededup(spark: SparkSession, folder: str) -> DataFrame:
    """All documents without repeated chunks of lines."""
    return linededup.dedupe(table(spark, folder, "documents")).select("doc_id", "text", "lines_removed")


def op11_hardneg(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every fiftieth vector; the labels of every seventh are moved by one."""
    vectors = table(spark, folder, "embeddings")
    vectors = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hardneg.hard_negatives(vectors, vectors.where("vec_id % 50 = 0"))


def op12_decontam(spark: SparkSession, folder: str) -> DataFrame:
    """Which words of every document stand in windows of ten words of benchmark items."""
    found = decontam.scan(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", decontam.digest(F.col("items")).alias("items_sha256"), "contaminated")


def op13_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Every prefix of the conversations, which open like the first conversation of their twenty."""
    return trie.trie(trie.rebuilt(trie.turns(table(spark, folder, "conversations"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ann, op2_tokens, op3_html, op4_neardup, op5_packing, op6_langid, op7_topk, op8_binary, op9_mixing, op10_linededup, op11_hardneg, op12_decontam, op13_trie)}


def oracle() -> dict[str, str]:
    return {"op1_ann": sql.NEAREST, "op3_html": sql.PAGES, "op4_neardup": sql.NEAR, "op7_topk": sql.HIGHEST, "op9_mixing": sql.MIXING, "op10_linededup": sql.LINES, "op11_hardneg": sql.NEGATIVES, "op12_decontam": sql.LEAKS, "op13_trie": sql.PREFIXES}
