"""Exact highest inner products: a Voronoi join with bounds from summaries of the cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywarden.llm.shared import parts, stored

#: Queries per pivot, and the fewest and most pivots.
PER_PIVOT, PIVOTS = 256, (8, 256)
#: Data vectors that a task holds at once, and queries that it scores at once.
BLOCK, STEP = 16_384, 256
#: Numbers that such a block holds at most, which makes blocks of long vectors shorter.
BLOCK_NUMBERS = 1 << 23
#: Sums of products below these are exact in doubles and in longs, with a bit to spare.
IN_DOUBLE, IN_LONG = 2.0**52, 2.0**62


def quantised(vector: Column, scale: float, id: Column) -> Column:
    """floor(scale * x) of each component; null without id, and if a component is null or not finite.

    A component that no long can hold is an error that names the row.
    """
    v = vector.cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(v, lambda x: F.floor(x * scale).cast("long"))
    fits = F.forall(v, lambda x: F.abs(x) * scale < float(1 << 63))
    error = F.raise_error(F.concat(F.lit("a component of vector "), id.cast("string"), F.lit(" leaves a long after scaling")))
    return F.when((F.size(v) > 0) & finite & id.isNotNull(), F.when(fits, whole).otherwise(error.cast("array<long>")))


def _grid(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), dim)


def _most(grid: np.ndarray) -> np.ndarray:
    return np.abs(grid).max(axis=1, initial=0).astype(np.float64)


def products(a: np.ndarray, b: np.ndarray, asked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: in doubles where they fit, else in longs, else in Python's integers.

    A product that leaves a long is an error, but for a query's own id, which is no candidate.
    """
    most = _most(b) * max(_most(a).max(initial=0), 1) * a.shape[1]
    if most.max(initial=0) < IN_DOUBLE:
        return a.astype(np.float64) @ b.T.astype(np.float64)
    out = np.zeros((len(a), len(b)), np.int64)
    at = np.flatnonzero(most < IN_DOUBLE)
    out[:, at] = (a.astype(np.float64) @ b[at].T.astype(np.float64)).astype(np.int64)
    at = np.flatnonzero((most >= IN_DOUBLE) & (most < IN_LONG))
    out[:, at] = a.astype(np.int64) @ b[at].T.astype(np.int64)
    for j in np.flatnonzero(most >= IN_LONG).tolist():
        exact = [0 if q == ids[j] else x for q, x in zip(asked.tolist(), (a.astype(object) @ b[j].astype(object)).tolist())]
        for q, x in zip(asked.tolist(), exact):
            if not -(1 << 63) < x < 1 << 63:
                raise ValueError(f"the inner product of query {q} and vector {ids[j]} leaves a long")
        out[:, j] = exact
    return out


def _assign(rows: DataFrame, pivots: np.ndarray, dim: int) -> DataFrame:
    """Add the nearest pivot, the distance to it and the norm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.einsum("ij,ij->i", pivots, pivots)
        for batch in batches:
            grid = _grid(batch.column("v"), dim).astype(np.float64)
            cell = (own - 2 * grid @ pivots.T).argmin(axis=1)
            away = np.sqrt(((grid - pivots[cell]) ** 2).sum(axis=1))
            norm = np.sqrt((grid**2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(away), pa.array(norm)], [*batch.schema.names, "cell", "away", "norm"])

    own = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{own}, cell long, away double, norm double")


def _nearest_per_cell(data: DataFrame, k: int) -> DataFrame:
    """The k ids of each cell that are nearest to its pivot; a task sends k per cell at most."""

    def least(ids: np.ndarray, away: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(away, kind="stable")
        first = np.sort(np.unique(ids[order], return_index=True)[1])[:k]
        return ids[order][first], away[order][first]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            ids, cell, away = (batch.column(c).to_numpy() for c in ("id", "cell", "away"))
            for c in np.unique(cell).tolist():
                old = held.get(c, (ids[:0], away[:0]))
                held[c] = least(np.concatenate([old[0], ids[cell == c]]), np.concatenate([old[1], away[cell == c]]))
        for c, (ids, away) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([c] * len(ids), pa.int64()), pa.array(ids), pa.array(away)], ["cell", "id", "away"])

    some = data.select("id", "cell", "away").mapInArrow(run, "cell long, id long, away double").groupBy("cell", "id").agg(F.min("away").alias("away"))
    rank = F.row_number().over(Window.partitionBy("cell").orderBy("away", "id"))
    return some.withColumn("rank", rank).where(F.col("rank") <= k).select("cell", "id", "away")


def highest(vectors: DataFrame, queries: DataFrame, k: int = 20, id: str = "vec_id", vector: str = "embedding", scale: float = 64.0) -> DataFrame:
    """Rows query_id, rank, vec_id, score: the k rows of ``vectors`` with the highest inner product.

    Components are floor(scale * x), scores whole numbers, ties go to the smaller id, a row with the
    query's own id is no candidate. Pivots are some of the data vectors (by a hash of their ids), and
    data and queries belong to the nearest pivot's cell. For the queries of a cell, a score with x in
    cell c lies within (reach of the cell) x (distance of x to its pivot) of a known middle; the k
    nearest of every cell to its pivot give a least k-th score, and only vectors whose upper bound
    reaches it are sent to that group of queries. A group's data is cut into blocks and its queries
    stream through each, so no task holds more than a block, however full a cell is.

    Pivots, two numbers per pair of cells and k + 1 distances per cell are gathered: at most 256 pivots.
    Null ids, null or empty vectors and those with null or non-finite components take no part; every other vector
    does, zero ones too: scores are exact, and a component or a score that leaves a long is an error that names the
    row. Only vectors of a query's length are its candidates, whatever the length. Repeated rows of ``vectors`` are candidates each,
    repeated rows of ``queries`` are one query; an id with unlike vectors is several queries, each with ranks of its own.
    Fewer candidates than k: all. Empty tables: no rows. Other columns are not read.
    """
    spark = vectors.sparkSession

    def rows(df: DataFrame) -> DataFrame:
        return df.select(F.col(id).cast("long").alias("id"), quantised(F.col(vector), scale, F.col(id)).alias("v")).where("id IS NOT NULL AND v IS NOT NULL").withColumn("dim", F.size("v"))

    data = rows(vectors)
    asked = stored(rows(queries).dropDuplicates(["id", "v"]).withColumn("key", F.monotonically_increasing_id()), "queries")
    most = F.max(F.array_max(F.transform("v", lambda x: F.abs(x)))).alias("most")
    top = max([r.most or 0 for r in (data.agg(most).first(), asked.agg(most).first())])
    if top < 1 << 31:  # half the bytes to move
        data, asked = (df.withColumn("v", F.col("v").cast("array<int>")) for df in (data, asked))
    out = None
    for dim, n in sorted((r.dim, r.n) for r in asked.groupBy("dim").agg(F.count("*").alias("n")).collect()):
        found = _join(data.where(F.col("dim") == dim).drop("dim"), asked.where(F.col("dim") == dim).drop("dim"), n, dim, k)
        if found is not None:
            out = found if out is None else out.unionAll(found)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _join(data: DataFrame, asked: DataFrame, queries: int, dim: int, k: int) -> DataFrame | None:
    kind = data.schema["v"].dataType.simpleString()
    held = max(STEP, min(BLOCK, BLOCK_NUMBERS // dim))
    many = min(max(PIVOTS[0], queries // PER_PIVOT), PIVOTS[1])
    chosen = data.orderBy(F.xxhash64("id"), "id").limit(many).select("v").collect()
    if not chosen:
        return None
    pivots = np.unique(np.array([r.v for r in chosen], np.float64), axis=0)
    data, asked = stored(_assign(data, pivots, dim), "cells"), stored(_assign(asked, pivots, dim), "query-cells")
    cells = len(pivots)
    near = _nearest_per_cell(data, k + 1).collect()
    near_cell, near_id, near_away = (np.array([r[c] for r in near]) for c in ("cell", "id", "away"))
    reach, norm = np.full(cells, -1.0), np.zeros(cells)
    for r in asked.groupBy("cell").agg(F.max("away").alias("away"), F.max("norm").alias("norm")).collect():
        reach[r.cell], norm[r.cell] = r.away, r.norm
    middle = pivots @ pivots.T
    slack = reach[:, None] * np.sqrt(np.diag(middle))[None, :]
    rounding = norm[:, None] * np.sqrt(np.diag(middle))[None, :]  # of a distance, relative to its ends
    enough = np.full(cells, -np.inf)  # a score that the k-th best of each query of a group reaches
    for g in range(cells):
        least = middle[g, near_cell] - slack[g, near_cell] - norm[g] * near_away * (1 + 1e-9)
        order = np.argsort(-least)
        first = np.sort(np.unique(near_id[order], return_index=True)[1])
        if len(first) > k:  # one id may be the query's own
            enough[g] = least[order][first[k]]
    # x of cell c matters to group g if its distance to the pivot is no less than this.
    with np.errstate(all="ignore"):
        bound = (enough[:, None] - middle - slack - 1e-6 * (1 + np.abs(middle) + slack + rounding)) / np.where(norm > 0, norm, np.nan)[:, None]
    bound = np.where(np.isnan(bound), -np.inf, bound) - 1e-6
    bound[reach < 0] = np.inf  # no queries

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = batch.column("away").to_numpy()[None, :] * (1 + 1e-9) >= bound[:, batch.column("cell").to_numpy()]
            who, group = np.nonzero(hit.T)
            ends = np.concatenate([[0], np.cumsum(np.bincount(who, minlength=batch.num_rows))])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(group))], ["id", "v", "groups"])

    sent = stored(data.select("id", "v", "cell", "away").mapInArrow(needed, f"id long, v {kind}, groups array<long>"), "needed")
    counts = {r.grp: r.n for r in sent.select(F.explode("groups").alias("grp")).groupBy("grp").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    blocks = F.element_at(F.create_map(*[F.lit(x) for g, n in counts.items() for x in (g, -(-n // held))]), F.col("grp"))
    spread = sent.select(F.explode("groups").alias("grp"), "id", "v").withColumn("block", F.pmod(F.xxhash64("id", "v"), blocks))
    spread = spread.select("grp", "block", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("key"), "id", "v")
    asked = asked.select(F.col("cell").alias("grp"), "key", "id", "v").withColumn("blocks", blocks).where("blocks IS NOT NULL")
    asked = asked.select("grp", F.explode(F.expr("sequence(0L, blocks - 1L)")).alias("block"), F.lit(1).alias("kind"), "key", "id", "v")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, ids, grids = None, [], []
        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in ("grp", "block", "kind")]
            cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
            edges = [0, *cuts.tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                now, kind = (int(columns[0][a]), int(columns[1][a])), int(columns[2][a])
                if now != place:
                    place, ids, grids = now, [], []
                own, grid = batch.column("id").slice(a, b - a).to_numpy(), _grid(batch.column("v").slice(a, b - a), dim)
                if kind == 0:
                    ids.append(own)
                    grids.append(grid)
                elif ids:
                    if len(ids) > 1:
                        ids, grids = [np.concatenate(ids)], [np.concatenate(grids)]
                    keys = batch.column("key").slice(a, b - a).to_numpy()
                    for i in range(0, len(own), STEP):
                        yield _best(keys[i : i + STEP], own[i : i + STEP], grid[i : i + STEP], ids[0], grids[0], k)

    dealt = spread.unionAll(asked).repartition(parts(sent.sparkSession), "grp", "block").sortWithinPartitions("grp", "block", "kind")
    return dealt.mapInArrow(solve, "key long, query_id long, vec_id long, score long")


def _best(keys: np.ndarray, asked: np.ndarray, queries: np.ndarray, ids: np.ndarray, grid: np.ndarray, k: int) -> pa.RecordBatch:
    scores = products(queries, grid, asked, ids)
    lowest = -np.inf if scores.dtype == np.float64 else np.iinfo(np.int64).min
    for q in np.flatnonzero(np.isin(asked, ids)):
        scores[q, ids == asked[q]] = lowest
    place, who, which, points = [], [], [], []
    part = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.full(len(asked), lowest)
    for q in range(len(asked)):
        at = np.flatnonzero((scores[q] >= part[q]) & (scores[q] > lowest))
        at = at[np.lexsort((ids[at], -scores[q][at]))[:k]]
        place.append(np.full(len(at), keys[q]))
        who.append(np.full(len(at), asked[q]))
        which.append(ids[at])
        points.append(scores[q][at])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (place, who, which, points)], ["key", "query_id", "vec_id", "score"])
