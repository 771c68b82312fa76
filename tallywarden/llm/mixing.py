"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywarden.llm.shared import WORD, stored

#: Rows of one source that one window sums up, and rows of one slice of virtual time.
CHUNK_ROWS, SLICE_ROWS = 20_000, 5_000
#: Slices of virtual time at most: one row of sums each. Only beyond 2^22 * 5000 rows does a slice hold more.
SLICES = 1 << 22


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, limit: int = 2) -> DataFrame:
    """Source, source_size, target from rows (source, size).

    Sources by code point, null last, take ``weights`` in turn and divide ``share`` of all sizes. A
    target stops at ``limit`` times its source's size and the excess goes to the others by weight:
    that is one level for all, below which lie the capped sources, found from running sums over
    one row per source.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    total = F.sum("source_size").over(Window.partitionBy())
    rows = per.withColumn("w", weight).withColumn("cap", F.col("source_size") * float(limit)).withColumn("budget", total * share)
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    rows = rows.withColumn("k", F.row_number().over(order))
    capped = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = rows.withColumn("level", (F.col("budget") - capped) / open_weight)
    fits = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct("k", "level"))
    rows = rows.withColumn("first", F.min(fits).over(Window.partitionBy()))
    target = F.when(F.col("k") >= F.col("first.k"), F.col("first.level") * F.col("w")).otherwise(F.col("cap"))
    return rows.select("source", "source_size", target.alias("target"))


def schedule(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, limit: int = 2, text: str = "text", seed: str = "mix") -> DataFrame:
    """How often the mix takes each document: one row per input row, in no order.

    Columns: doc_id, source, size (words of the whole text, null: 0), source_size, target, virtual
    (finish time of the first copy), copies (0 to ``limit``), taken (size x copies).

    Documents of a source stand in the order of an MD5 of seed, doc_id and text, and copy r of a document
    finishes at (r x source size + sizes up to it) / target. All copies are ranked by finish time
    and taken until the budget, ``share`` of all sizes, is used up; so every source is served at the
    pace of its target. Running sums are taken in chunks of the order whose number grows with the
    rows, so a source with a third of all rows is many tasks; the cut is found in one slice of
    virtual time, which holds an even part of the budget by construction.

    Rows that agree in doc_id, source and text are alike and may swap places: only they share a place in the
    order, so rows without doc_id, or all under one, are spread like others. A null source is a source. Sources are
    weighed in one task, with a row of sums for each. Nothing to take (no words, no rows): copies 0. Other
    columns are not read.
    """
    rows = stored(docs.select("doc_id", "source", word_count(F.col(text)).alias("size"), _key(seed, text).alias("key")), "mix-sizes")
    chunks, about, slices, cut, last, at = _plan(rows, weights, share, limit)
    out = at.withColumn("copies", _copies(slices, cut, last, limit)).withColumn("virtual", F.col("finish")[0])
    return out.select("doc_id", "source", "size", "source_size", "target", "virtual", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def _key(seed: str, text: str) -> Column:
    said = F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")))
    return F.md5(F.concat(F.lit(seed), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), said))


def _chunked(rows: DataFrame, chunks: int) -> DataFrame:
    """Add the place of a row: its source without nulls (s0, s1) and its chunk of the source's order."""
    place = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    return rows.withColumns({"s0": F.coalesce("source", F.lit("")), "s1": F.col("source").isNull(), "chunk": F.floor(place * chunks / F.lit(1 << 32))})


def _finished(rows: DataFrame, about: DataFrame, limit: int) -> DataFrame:
    """Add source_size, target and the finish times of a row's copies: one exchange by source and chunk."""
    place = ["s0", "s1", "chunk"]
    running = F.sum("size").over(Window.partitionBy(*place).orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    at = rows.withColumn("within", running).join(about, place)
    finish = [F.try_divide((F.col("source_size") * r + F.col("base") + F.col("within")).cast("double"), F.col("target")) for r in range(limit)]
    return at.withColumn("finish", F.array(*finish)).drop(*place, "within", "base")


def _plan(rows: DataFrame, weights: Sequence[int], share: float, limit: int):
    """From stored (doc_id, source, size, key): what is needed to place any row, and where the budget ends."""
    count = rows.count()
    chunks, slices = max(1, count // CHUNK_ROWS), min(SLICES, max(64, count // SLICE_ROWS))
    chunked = _chunked(rows, chunks)
    sums = chunked.groupBy("s0", "s1", "chunk").agg(F.sum("size").alias("n"))
    base = F.sum("n").over(Window.partitionBy("s0", "s1").orderBy("chunk")) - F.col("n")
    goals = targets(rows, weights, share, limit)
    goals = goals.select(F.coalesce("source", F.lit("")).alias("s0"), F.col("source").isNull().alias("s1"), "source_size", "target")
    about = stored(sums.withColumn("base", base).drop("n").join(goals, ["s0", "s1"]), "mix-chunks")
    at = stored(_finished(chunked, about, limit), "mix-finish")

    copies = at.select("size", "key", "doc_id", F.posexplode("finish").alias("round", "v")).where("size > 0 AND v IS NOT NULL")
    copies = copies.withColumn("slice", _slice(F.col("v"), slices))
    per_slice = copies.groupBy("slice").agg(F.sum("size").alias("n")).withColumn("upto", F.sum("n").over(Window.orderBy("slice")))
    budget = (rows.agg(F.sum("size")).first()[0] or 0) * share
    cut, last = per_slice.where(F.col("upto") > budget).orderBy("slice").first(), None
    order = [F.col("v"), F.col("key"), F.col("doc_id"), F.col("round")]
    if cut:  # one slice holds the copy at which the budget ends
        upto = F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) + (cut.upto - cut.n)
        last = copies.where(F.col("slice") == cut.slice).withColumn("upto", upto).where(F.col("upto") <= budget).orderBy(F.desc("upto"), *[c.desc() for c in order]).first()
    return chunks, about, slices, cut, last, at


def _copies(slices: int, cut, last, limit: int) -> Column:
    """Copies of a row (size, key, doc_id, finish) that come before the end of the budget."""

    def taken(v: Column, r: int) -> Column:
        if not cut:
            return F.lit(True)
        before = _slice(v, slices) < cut.slice
        if not last:
            return before
        same = F.col("doc_id").eqNullSafe(F.lit(last.doc_id))
        earlier = F.col("doc_id").isNull() & F.lit(last.doc_id is not None) | F.coalesce(F.col("doc_id") < F.lit(last.doc_id), F.lit(False))
        tie = (v == last.v) & ((F.col("key") < last.key) | (F.col("key") == last.key) & (earlier | same & F.lit(r <= last["round"])))
        return before | (_slice(v, slices) == cut.slice) & ((v < last.v) | tie)

    return sum(F.when(F.col("size") > 0, F.coalesce(taken(F.col("finish")[r], r), F.lit(False)).cast("int")).otherwise(0) for r in range(limit))


def _slice(v: Column, slices: int) -> Column:
    return F.floor(F.least(v, F.lit(4.0)) * slices)


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, limit: int = 2, text: str = "text", seed: str = "mix") -> DataFrame:
    """The mix itself: every column of ``docs``, a row per copy taken, range-sorted by finish time.

    See ``schedule`` for what is taken. Documents without words are not in the mix. Texts move twice:
    to the chunks of their sources' orders, and to their places in the mix.
    """
    parts = ["doc_id", "source", word_count(F.col(text)).alias("size"), _key(seed, text).alias("key")]
    chunks, about, slices, cut, last, _ = _plan(stored(docs.select(*parts), "mix-sizes"), weights, share, limit)
    rows = _finished(_chunked(docs.select(F.struct("*").alias("row"), *parts), chunks), about, limit)
    times = F.slice("finish", F.lit(1), F.col("copies"))
    taken = rows.withColumn("copies", _copies(slices, cut, last, limit)).where("copies > 0").select("row", F.explode(times).alias("virtual"))
    return taken.orderBy("virtual").select("row.*")
