"""Nearest vectors by vantage-point trees, one tree per shard."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywarden.llm.shared import parts, stored

#: Components beyond this are divided by a power of two while distances are taken, so that no square leaves a double.
SQUARED = 2.0**450
#: Vectors of a shard on average, and of a leaf at most.
SHARD, LEAF = 16_384, 256


class Tree:
    """A vantage-point tree: each node splits its vectors by their distance to one of them.

    Vectors within the median distance go inside, the others outside; equal distances stay inside.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors, self.leaf = ids[order], vectors[order], leaf
        self.squares = np.einsum("ij,ij->i", self.vectors, self.vectors)
        self.root = self._grow(np.arange(len(ids)))

    def _distances(self, row: int, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(((self.vectors[rows] - self.vectors[row]) ** 2).sum(axis=1))

    def _grow(self, rows: np.ndarray):
        """Grown with an explicit list, so that equal vectors cannot exhaust the stack."""
        root: list = [None]
        todo = [(rows, root, 0)]
        while todo:
            rows, place, at = todo.pop()
            if len(rows) <= self.leaf:
                place[at] = rows
                continue
            far = self._distances(rows[0], rows)
            vantage = rows[far.argmax()]  # a corner separates better than the middle
            away = self._distances(vantage, rows)
            radius = float(np.median(away))
            inside = away <= radius
            if inside.all():  # most vectors stand at the same distance
                place[at] = rows
                continue
            node = [vantage, radius, None, None]
            place[at] = node
            todo += [(rows[inside], node, 2), (rows[~inside], node, 3)]
        return root[0]

    def search(self, queries: np.ndarray, query_ids: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest ids and distances per query (where there are fewer: distance inf), nearest first.

        All queries walk the tree together, the side that holds a query first. The other side is at
        least |distance to the vantage point - radius| away; it is left out if that exceeds the k-th
        distance so far, divided by ``factor``. With factor 1 nothing nearer is ever left out.
        """
        n = len(queries)
        best = np.full((n, k), np.inf)
        found = np.full((n, k), -1, np.int64)
        norms = np.einsum("ij,ij->i", queries, queries)
        tops: list = [(self.root, np.arange(n), np.zeros(n))]
        self.compared = 0
        while tops:
            node, who, least = tops.pop()
            keep = least <= best[who, -1] * (1 + 1e-9) / factor + 1e-12  # rounding must not prune
            who = who[keep]
            if not len(who):
                continue
            if isinstance(node, np.ndarray):
                self._leaf(node, queries, query_ids, norms, who, best, found)
                continue
            vantage, radius, inner, outer = node
            away = np.sqrt(((queries[who] - self.vectors[vantage]) ** 2).sum(axis=1))
            gap = np.abs(away - radius)
            zero = np.zeros(len(who))
            inside = away <= radius
            # Depth first: what is pushed last is searched first.
            tops.append((outer, who[inside], gap[inside]))
            tops.append((inner, who[~inside], gap[~inside]))
            tops.append((outer, who[~inside], zero[~inside]))
            tops.append((inner, who[inside], zero[inside]))
        return found, best

    def _leaf(self, rows, queries, query_ids, norms, who, best, found) -> None:
        self.compared += len(rows) * len(who)
        squares = norms[who][:, None] + self.squares[rows] - 2 * queries[who] @ self.vectors[rows].T
        scale = norms[who][:, None] + self.squares[rows]
        limit = best[who, -1] ** 2
        near = (squares <= np.where(np.isfinite(limit), limit, np.inf)[:, None] + 1e-9 * scale) & (self.ids[rows] != query_ids[who][:, None])
        for i in np.flatnonzero(near.any(axis=1)):
            q, some = who[i], rows[near[i]]
            exact = np.cumsum((self.vectors[some] - queries[q]) ** 2, axis=1)[:, -1]  # summed from left to right
            distance = np.concatenate([best[q], np.sqrt(exact)])
            ids = np.concatenate([found[q], self.ids[some]])
            order = np.lexsort((ids, distance))[: best.shape[1]]
            best[q], found[q] = distance[order], ids[order]


def usable(vector: F.Column) -> F.Column:
    """Vectors that take part: no null, no null or non-finite component, not zero."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & whole & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, factor: float = 1.0, id: str = "vec_id", vector: str = "embedding", shard: int = SHARD, leaf: int = LEAF) -> DataFrame:
    """Rows query_id, rank, vec_id, score: for each row of ``queries`` its k nearest rows of ``vectors``.

    Score is the Euclidean distance in double precision; ties go to the smaller id, and a row with
    the query's own id is no candidate. Rows are dealt to shards of about ``shard`` by a hash of id and
    vector, each shard grows a vantage-point tree, and every query visits every tree: the vectors
    move once, a query once per shard, and queries stream through a finished tree in batches. A
    subtree is left out if its least distance by the triangle inequality exceeds
    (k-th distance so far) / ``factor``. Factor 1 is exact search; a larger factor looks at less and may
    miss neighbours.

    Null ids, and null, zero, empty or non-finite vectors take no part; with fewer candidates than
    k all are returned; empty tables give no rows. Vectors of another length than a query's are no
    candidates of it. Repeated rows of ``vectors`` are candidates each, repeated rows of ``queries`` are one query; an
    id with unlike vectors is several queries, each with ranks of its own. Other columns are not read.
    """
    if factor < 1:
        raise ValueError("factor below 1")
    spark = vectors.sparkSession

    def rows(df: DataFrame) -> DataFrame:
        double = F.col(vector).cast("array<double>")
        return df.select(F.col(id).cast("long").alias("id"), double.alias("v")).where(F.col("id").isNotNull() & usable(F.col("v"))).withColumn("dim", F.size("v"))

    data = rows(vectors)
    asked = stored(rows(queries).dropDuplicates(["id", "v"]).withColumn("key", F.monotonically_increasing_id()), "queries")
    widest = F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))
    count, most = data.agg(F.count("*"), widest).first()
    most = max(most or 0.0, asked.agg(widest).first()[0] or 0.0)
    unit = 1.0 if most < SQUARED else 2.0 ** (math.frexp(most)[1] - 450)
    if unit > 1:
        data, asked = (df.withColumn("v", F.transform("v", lambda x: x / unit)) for df in (data, asked))
    shards = max(1, -(-count // shard))
    data = data.select("dim", F.pmod(F.xxhash64("id", "v"), F.lit(shards)).alias("shard"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("key"), "id", "v")
    asked = asked.select("dim", F.explode(F.expr(f"sequence(0L, {shards - 1}L)")).alias("shard"), F.lit(1).alias("kind"), "key", "id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, place = None, None
        ids: list[np.ndarray] = []
        found: list[np.ndarray] = []
        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in ("dim", "shard", "kind")]
            cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
            edges = [0, *cuts.tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                dim, shard_now, kind = (int(c[a]) for c in columns)
                piece = batch.slice(a, b - a)
                own = piece.column("id").to_numpy()
                grid = piece.column("v").flatten().to_numpy().reshape(len(own), dim)
                if (dim, shard_now) != place:
                    tree, place, ids, found = None, (dim, shard_now), [], []
                if kind == 0:
                    ids.append(own)
                    found.append(grid)
                    continue
                if tree is None and ids:
                    tree = Tree(np.concatenate(ids), np.concatenate(found), leaf)
                    ids, found = [], []
                if tree is None:
                    continue
                keys = piece.column("key").to_numpy()
                for i in range(0, len(own), 1024):
                    got, far = tree.search(grid[i : i + 1024], own[i : i + 1024], k, factor)
                    real = np.isfinite(far).ravel()
                    who = [pa.array(np.repeat(x[i : i + 1024], k)[real]) for x in (keys, own)]
                    yield pa.RecordBatch.from_arrays([*who, pa.array(got.ravel()[real]), pa.array(far.ravel()[real])], ["key", "query_id", "vec_id", "score"])

    keys = ["dim", "shard"]
    dealt = data.unionAll(asked).repartition(min(shards, 64 * parts(spark)), *keys).sortWithinPartitions(*keys, "kind")
    some = dealt.mapInArrow(run, "key long, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("key").orderBy("score", "vec_id"))
    return some.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", (F.col("score") * unit).alias("score"))
