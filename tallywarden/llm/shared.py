"""Small helpers that the operators of this folder share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywarden.session import new_folder

#: Bytes of text that one step inside a task holds as arrays; a longer text is a step of its own.
STEP_BYTES = 6_000_000
#: A node of a graph is a hub if it has more than so many edges, and than this share of all: at most 2 x ``HUBS`` nodes are.
HUB_ROWS, HUBS = 1000, 10_000
#: What separates words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back: lineage ends, executors may go."""
    spark = df.sparkSession
    folder = new_folder(spark, name)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def shuffled(side: DataFrame) -> DataFrame:
    """One side of a join that grows with the data: it is sorted and merged, never sent everywhere on a guess of its size.

    Spark guesses from the bytes of the stored files and the types of the columns read: packed numbers count as packed, a list
    as one value. So 32 values a row look like one, before and after an explode, and adaptive execution keeps a broadcast once planned.
    """
    return side.hint("merge")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_steps(batch: pa.RecordBatch, column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts hold about ``limit`` bytes at most."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    steps = np.cumsum(lengths) // limit
    cuts = [0, *(np.flatnonzero(np.diff(steps)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def lone_steps(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The same, but a longer text is always alone in its run."""
    for step in text_steps(batch, column, limit):
        lengths = pc.fill_null(pc.binary_length(step.column(column)), 0).to_numpy(zero_copy_only=False)
        long = np.flatnonzero(lengths > limit)
        cuts = np.unique(np.concatenate([[0, step.num_rows], long, long + 1])).tolist()
        for a, b in zip(cuts, cuts[1:]):
            yield step.slice(a, b - a)


def strings(column: pa.Array) -> pa.Array:
    """Texts without nulls, copied to an array of their own: some string kernels misread a slice's offsets."""
    return pc.fill_null(column.cast(pa.large_string()), "").take(pa.array(np.arange(len(column))))


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of every text in one array, and where each text's words end and begin in it."""
    lists = pc.ascii_split_whitespace(texts)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    words = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    full = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    if not full.all():  # texts that begin or end with white space
        offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
        words = words.filter(pa.array(full))
    return words, offsets


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of every run, one run after the other."""
    ends = np.cumsum(lengths)
    if not len(ends):
        return np.zeros(0, np.int64)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1])


def components(edges: DataFrame, name: str = "links") -> DataFrame:
    """Connected components of undirected edges (a, b): rows (node, label), label the smallest node.

    Alternating large-star and small-star steps, until every component is a star around its smallest
    node: each row is sent to one neighbour of its node, so a node with very many neighbours costs
    rows in proportion and no list is gathered. The rows of such a node stay where they are, and what they
    need to know of it is sent to them: there are 20,000 of these nodes at most. Every round is written to the shared folder. Nodes
    are longs; edges with a null end or a = b are ignored.
    """

    def told(rows: DataFrame, least: DataFrame, most: int) -> DataFrame:
        """Join rows with one row (a, m, n) per node, n the rows of the node."""
        hubs = least.where(F.col("n") > most).select("a", "m")
        own = rows.join(F.broadcast(hubs.select("a")), "a", "left_anti").join(shuffled(least.select("a", "m")), "a")
        return own.unionByName(rows.join(F.broadcast(hubs), "a"))

    two = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    while not _stars(two):
        most = max(HUB_ROWS, two.count() // HUBS)  # the count comes from the files' footers
        both = two.unionAll(two.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
        large = told(both, least, most).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        floor = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        steps = F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))
        two = stored(told(large, floor, most).select(steps.alias("e")).select("e.*").where("a <> b").distinct(), name)
    return two.select(F.col("a").alias("node"), F.col("b").alias("label")).unionAll(two.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def _stars(two: DataFrame) -> bool:
    """Has every node one smaller neighbour, which itself has none?"""
    if not two.groupBy("a").count().where("count > 1").isEmpty():
        return False
    return two.select("b").distinct().join(shuffled(two.select(F.col("a").alias("b"))), "b", "left_semi").isEmpty()
