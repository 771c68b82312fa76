"""Removing repeated runs of lines: content-defined chunks, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywarden.llm.shared import WORD, shuffled, stored

#: A line of so many words is a chunk of its own.
LONG_WORDS = 50
#: First hex digits that make a boundary: 8 of 16, so every second line ends a chunk on average.
BOUNDARY = "01234567"


def _once(df: DataFrame, kept: list[str], *made: Column) -> DataFrame:
    """Add array columns to the ``kept`` ones behind a generator, so that no later lambda computes them per element."""
    value = F.struct(*made)
    return df.select(*kept, F.explode(F.array(value)).alias("once")).select(*kept, "once.*")


def _chunks(rows: DataFrame) -> DataFrame:
    """``chunks`` (first line from 1, number of lines, hash, whether it counts) of (id, th, text)."""

    def line(x: Column) -> Column:
        words = F.regexp_count(x, F.lit(WORD))
        return F.struct(F.md5(x).alias("h"), (words >= LONG_WORDS).alias("long"), (words > 0).alias("full"))

    def last(now: Column, before: Column) -> Column:
        """Does a chunk end with this line? A hash of its and the former line's hashes says."""
        rolled = F.md5(F.concat(F.coalesce(before.h, F.lit("")), now.h))
        return F.struct((now.long | F.substring(rolled, 1, 1).isin(*BOUNDARY)).alias("ends"), now.long.alias("long"))

    own = ["id", "th"]
    rows = _once(rows, own, F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), line).alias("info"))
    nothing = F.expr("array(cast(null as struct<h:string,long:boolean,full:boolean>))")
    before = F.concat(nothing, F.slice("info", F.lit(1), F.size("info") - 1))
    rows = _once(rows, [*own, "info"], F.zip_with("info", before, last).alias("marks"))
    after = F.concat(F.transform(F.slice("marks", F.lit(2), F.size("marks")), lambda m: m.long), F.array(F.lit(True)))
    ends = F.zip_with("marks", after, lambda m, next_long: m.ends | next_long)
    ends = F.filter(F.transform(ends, lambda e, i: F.when(e, i + 1)), lambda i: i.isNotNull())
    rows = _once(rows, [*own, "info"], ends.alias("ends"))
    starts = F.concat(F.array(F.lit(1)), F.transform(F.slice("ends", F.lit(1), F.size("ends") - 1), lambda e: e + 1))

    def chunk(first: Column, end: Column) -> Column:
        part = F.slice("info", first, end - first + 1)
        counts = F.exists(part, lambda x: x.long) | (F.size(F.filter(part, lambda x: x.full)) >= 2)
        return F.struct(first.alias("first"), (end - first + 1).alias("n"), F.xxhash64(F.transform(part, lambda x: x.h)).alias("h"), counts.alias("counts"))

    return rows.select(*own, F.zip_with(starts, "ends", chunk).alias("chunks"))


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.col("doc_id").alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))


def _same_row(a: str, b: str) -> list[Column]:
    return [F.col(f"{a}id").eqNullSafe(F.col(f"{b}id")), F.col(f"{a}th") == F.col(f"{b}th")]


def _passages(docs: DataFrame, words: int) -> DataFrame:
    """Runs (id, th, first, n, h) of (id, th, text): from every line with words the shortest with so many words, and up to it.

    Together they cover any run of lines with at least so many words, whatever stands around it.
    Lines without words count for nothing. Where both are one run, it is made once.
    """

    def line(x: Column) -> Column:
        return F.struct(F.xxhash64(x).alias("h"), F.regexp_count(x, F.lit(WORD)).alias("words"))

    rows = docs.where("text IS NOT NULL").select("id", "th", F.transform(F.split("text", "\n", -1), line).alias("info"))
    rows = rows.groupBy("id", "th").agg(F.first("info").alias("info")).select("id", "th", F.posexplode("info").alias("i", "line"))
    rows = rows.select("id", "th", (F.col("i") + 1).alias("i"), "line.h", F.col("line.words").cast("long").alias("words")).where("words > 0")
    own = Window.partitionBy("id", "th")
    rows = rows.withColumn("end", F.sum("words").over(own.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("start", F.col("end") - F.col("words"))
    ahead, back = own.orderBy("start").rangeBetween(0, words - 1), own.orderBy("end").rangeBetween(1 - words, 0)
    rows = rows.withColumns({"to": F.max("i").over(ahead), "upto": F.max("end").over(ahead), "ahead": F.collect_list("h").over(ahead)})
    rows = rows.withColumns({"from": F.min("i").over(back), "since": F.min("start").over(back), "back": F.collect_list("h").over(back)})

    def run(first: Column, end: Column, hashes: Column) -> Column:
        return F.struct(first.cast("int").alias("first"), (end - first + 1).cast("int").alias("n"), F.xxhash64(hashes).alias("h"))

    forth = F.when(F.col("upto") - F.col("start") >= words, run(F.col("i"), F.col("to"), F.col("ahead")))
    # With fewer words before this line it is also the run forth from its first line.
    up = F.when(F.col("start") - F.col("since") >= words, run(F.col("from"), F.col("i"), F.col("back")))
    return rows.select("id", "th", F.explode(F.array(forth, up)).alias("c")).where("c IS NOT NULL").select("id", "th", "c.*")


def removals(docs: DataFrame, text: str = "text", passage: int | None = None) -> DataFrame:
    """Which lines go: rows (r_id, r_th, gone), gone the line numbers (from 1) of a document.

    Lines are joined to chunks whose ends depend on two neighbouring lines only (a line of 50 words
    or more is a chunk of its own), so an insertion moves no later boundary. A chunk counts if it
    holds two lines with words, or such a long line. Of the chunks with equal bytes the first stays,
    by doc_id (null last), then text hash, then place. Hashes only find candidates: their texts are
    then grouped by their bytes.

    With ``passage`` those lines go too that stand in any run of so many words or more whose lines
    with words stood before, in the same order and with equal bytes: such a run needs no chunk
    ends within it. A run that overlaps the one that stays is not a second one.
    """
    chunks = _chunks(_keyed(docs, text))
    found = chunks.select("id", "th", F.explode("chunks").alias("c")).where("c.counts").select("id", "th", "c.first", "c.n", "c.h")
    kind = ["passage"] if passage else []
    if passage:
        runs = _passages(_keyed(docs, text), passage).withColumn("passage", F.lit(True))
        found = found.withColumn("passage", F.lit(False)).unionByName(runs)
    found = stored(found, "line-chunks")
    again = found.groupBy("h").agg(F.count("*").alias("times")).where("times > 1").select("h")
    wanted = found.join(shuffled(again), "h").groupBy("id", "th").agg(F.collect_set(F.struct("first", "n", "h", *kind)).alias("wanted"))
    wanted = wanted.select(F.col("id").alias("w_id"), F.col("th").alias("w_th"), "wanted")
    texts = _keyed(docs, text).join(shuffled(wanted), [*_same_row("", "w_")])
    texts = _once(texts, ["id", "th", "wanted"], F.split("text", "\n", -1).alias("lines"))

    def piece(c: Column) -> Column:
        part = F.slice("lines", c["first"], c["n"])
        same = F.array_join(part, "\n")
        if passage:  # runs overlap: their digests are compared, or every text would be stored many times
            same = F.when(c["passage"], F.sha2(F.array_join(F.filter(part, lambda x: x.rlike(WORD)), "\n"), 256)).otherwise(same)
        return F.struct(*[c[k].alias(k) for k in ("first", "n", "h", *kind)], same.alias("bytes"))

    # All pieces of a text are cut before it is taken apart, or every piece's row would carry all lines.
    texts = _once(texts, ["id", "th"], F.transform("wanted", piece).alias("pieces"))
    pieces = texts.select("id", "th", F.explode("pieces").alias("c")).select("id", "th", "c.*").distinct()
    pieces = stored(pieces, "line-repeats")
    place = F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("th"), F.col("first"))
    if not passage:
        kept = pieces.groupBy("h", "bytes").agg(F.min(place).alias("kept"))
        gone = pieces.join(shuffled(kept), ["h", "bytes"]).where(~place.eqNullSafe(F.col("kept")))
        lines = F.flatten(F.collect_list(F.sequence("first", F.col("first") + F.col("n") - 1)))
    else:
        kept = pieces.groupBy("h", *kind, "bytes").agg(F.min(F.struct(place.alias("at"), "n")).alias("kept"))
        gone = pieces.join(shuffled(kept), ["h", *kind, "bytes"]).where(~place.eqNullSafe(F.col("kept.at")))
        here = F.col("id").eqNullSafe(F.col("kept.at.id")) & (F.col("th") == F.col("kept.at.th"))
        gone = gone.where(~(F.col("passage") & here & (F.col("first") < F.col("kept.at.first") + F.col("kept.n"))))
        lines = F.array_distinct(F.flatten(F.collect_set(F.sequence("first", F.col("first") + F.col("n") - 1))))
    return gone.groupBy("id", "th").agg(lines.alias("gone")).select(F.col("id").alias("r_id"), F.col("th").alias("r_th"), "gone")


def dedupe(docs: DataFrame, text: str = "text", passage: int | None = None) -> DataFrame:
    """Every row and column of ``docs``, its text without repeated chunks, and ``lines_removed``.

    With ``passage`` also without any repeated run of lines of so many words or more (``removals``).

    Rows with equal doc_id and text are one document and keep the same lines. A null text stays
    null, an empty one empty; a document whose lines all stand elsewhere first becomes empty. A
    column that is called lines_removed already is replaced.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64(text).alias("th"))
    rows = rows.join(shuffled(removals(docs, text, passage)), _same_row("", "r_"), "left").select("row", "gone")
    rows = _once(rows, ["row", "gone"], F.when(F.col("gone").isNotNull(), F.split(f"row.{text}", "\n", -1)).alias("lines"))
    stay = F.array_except(F.sequence(F.lit(1), F.size("lines")), "gone")  # by hash, in order
    rows = _once(rows, ["row", "gone", "lines"], F.when(F.col("gone").isNotNull(), stay).alias("stay"))
    left = F.array_join(F.transform("stay", lambda i: F.element_at("lines", i)), "\n")
    rows = rows.withColumn("left", F.when(F.col("gone").isNotNull(), left).otherwise(F.col(f"row.{text}")))
    kept = [F.col("left").alias(text) if c == text else F.col(f"row.`{c}`") for c in docs.columns if c != "lines_removed"]
    return rows.select(*kept, F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("lines_removed"))
