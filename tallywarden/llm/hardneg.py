"""Hard negatives by coordinate pruning: length buckets with sorted coordinate lists, exact scores of what is left."""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywarden.llm.shared import parts, stored
from tallywarden.llm.topk import products, quantised

#: Rows of a shard on average, and numbers that it holds at most, which makes shards of long vectors shorter.
SHARD_ROWS, SHARD_NUMBERS = 16_384, 1 << 22
#: A bucket holds so many vectors at most, and none shorter than this share of its longest.
BUCKET_ROWS, BUCKET_SHARE = 2048, 0.9
#: Coordinates whose feasible ranges are intersected: those where the anchor is largest.
FOCUS = 3
#: If the narrowest range holds more than this share of a bucket, the whole bucket is scored at once.
MOST = 0.25
#: Anchors that walk through the buckets together.
STEP = 256


class Buckets:
    """Vectors of one length in numbers, longest first, cut into buckets by Euclidean length.

    Each bucket holds its unit vectors and, per coordinate, their values in ascending order with the rows they belong to.
    """

    def __init__(self, ids: np.ndarray, grid: np.ndarray) -> None:
        norms = np.sqrt((grid.astype(np.float64) ** 2).sum(axis=1))
        order = np.lexsort((ids, -norms))
        self.ids, self.grid, self.norms, self.rows = ids[order], grid[order], norms[order], order
        self.cuts = [0]
        for i in range(1, len(ids)):
            if i - self.cuts[-1] >= BUCKET_ROWS or self.norms[i] < BUCKET_SHARE * self.norms[self.cuts[-1]]:
                self.cuts.append(i)
        self.cuts.append(len(ids))
        self.lists: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.scored = 0

    def _sorted(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit vectors of a bucket, and per coordinate the rows in order of their values and these values."""
        if k not in self.lists:
            part = slice(self.cuts[k], self.cuts[k + 1])
            unit = self.grid[part] / np.where(self.norms[part] > 0, self.norms[part], 1)[:, None]
            order = np.argsort(unit, axis=0, kind="stable")
            self.lists[k] = unit, order.astype(np.int32), np.take_along_axis(unit, order, axis=0)
        return self.lists[k]

    def search(self, anchors: np.ndarray, anchor_ids: np.ndarray, floors: np.ndarray, take: Callable[[int, np.ndarray, np.ndarray], float]) -> None:
        """Hand every row that reaches an anchor's floor to ``take`` (anchor, rows, scores), bucket by bucket.

        ``take`` returns the anchor's new floor, which may rise but not fall. An inner product of at least the
        floor means a cosine of at least c = floor / (length of the anchor x greatest length of the bucket). Where c > 1 the bucket
        has nothing. Else a row's angle to axis f differs from the anchor's by arccos(c) at most, which gives the range of
        its unit vector's value there: rows of the narrowest such range are looked up in its sorted list and must lie in the
        ranges of the other focus coordinates as well. What passes is scored exactly; rows below the floor may be among it.
        """
        long = np.sqrt((anchors.astype(np.float64) ** 2).sum(axis=1))
        unit = anchors / np.where(long > 0, long, 1)[:, None]
        focus = np.argsort(-np.abs(unit), axis=1, kind="stable")[:, :FOCUS]
        floors = floors.copy()
        for k in range(len(self.cuts) - 1):
            a, b = self.cuts[k], self.cuts[k + 1]
            top = long * self.norms[a]
            live = np.flatnonzero(floors <= top * (1 + 1e-9) + 1e-9)
            if not len(live):
                if (floors > 0).all():  # later buckets are shorter
                    return
                continue
            whole, some = [], []
            for i in live.tolist():
                if floors[i] <= 0 or top[i] <= 0:  # nothing is known of an angle
                    whole.append(i)
                    continue
                rows = self._feasible(k, unit[i], focus[i], min(1.0, floors[i] / top[i]))
                if rows is None:
                    whole.append(i)
                elif len(rows):
                    some.append((i, rows))
            for i, rows in some:
                score = products(anchors[i : i + 1], self.grid[a + rows], anchor_ids[i : i + 1], self.ids[a + rows])[0]
                self.scored += len(rows)
                floors[i] = take(i, a + rows, score)
            if whole:
                scores = products(anchors[whole], self.grid[a:b], anchor_ids[whole], self.ids[a:b])
                self.scored += len(whole) * (b - a)
                for i, score in zip(whole, scores):
                    floors[i] = take(i, np.arange(a, b), score)

    def _feasible(self, k: int, unit: np.ndarray, focus: np.ndarray, cosine: float) -> np.ndarray | None:
        """Rows of a bucket inside all feasible ranges; None where these tell too little apart."""
        own, order, values = self._sorted(k)
        angle, reach = np.arccos(np.clip(unit[focus], -1, 1)), np.arccos(cosine)
        least = np.cos(np.minimum(np.pi, angle + reach)) - 1e-7  # rounding must not prune
        most = np.cos(np.maximum(0, angle - reach)) + 1e-7
        spans = [(int(np.searchsorted(values[:, f], x, "left")), int(np.searchsorted(values[:, f], y, "right"))) for f, x, y in zip(focus, least, most)]
        n = min(range(len(spans)), key=lambda j: spans[j][1] - spans[j][0])
        first, last = spans[n]
        if last - first > MOST * len(own):
            return None
        rows = order[first:last, focus[n]]
        for j, f in enumerate(focus):
            if j != n:
                rows = rows[(own[rows, f] >= least[j]) & (own[rows, f] <= most[j])]
        return np.sort(rows).astype(np.int64)


class Best:
    """The k best (score, id) so far, the smaller id first among equal scores."""

    def __init__(self, k: int) -> None:
        self.k, self.held = k, []

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        if len(ids) > self.k:
            at = np.lexsort((ids, -scores))[: self.k]
            ids, scores = ids[at], scores[at]
        self.held = heapq.nsmallest(self.k, [*self.held, *zip((-int(s) for s in scores), ids.tolist())])

    def floor(self, low: float) -> float:
        return max(low, -self.held[-1][0]) if len(self.held) == self.k else low


def _shards(rows: DataFrame) -> DataFrame:
    """Rows with ``shard``: ranges of (numbers, label, length), dealt evenly whatever repeats."""
    n, numbers = rows.agg(F.count("*"), F.sum("dim")).first()
    many = max(1, -(-n // SHARD_ROWS), -(-(numbers or 0) // SHARD_NUMBERS))
    dealt = rows.repartitionByRange(many, "dim", "label", "norm", F.xxhash64("id", "v"), "id")
    return stored(dealt.withColumn("shard", F.spark_partition_id()), "length-shards")


def hard_negatives(
    vectors: DataFrame,
    anchors: DataFrame,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    scale: float = 256.0,
) -> DataFrame:
    """Rows anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Scores are inner products of floor(scale * x), whole numbers. A row of ``anchors`` has as positives the
    ``positives`` best other rows of ``vectors`` with its label, and for each of these the ``negatives`` best rows with
    another label and low x positive_score <= 100 x negative_score <= high x positive_score. Ties go to the smaller id.

    ``vectors`` are cut into shards by (label, length), one row per shard of ranges and greatest lengths (about one per
    16,384 vectors) is gathered and sent with the anchors: for positives an anchor goes to the shards of its label, for
    negatives to those whose longest vector can reach its least wanted score. In a shard, length buckets
    with sorted coordinate lists leave out what cannot reach the floor (``Buckets``), which rises with what is found. Anchors stream
    through a shard, so no task holds more than one shard, however many rows share a label or a vector.

    Null ids and labels, null or empty vectors and those with null or non-finite components take no part, zero
    vectors do. Rows with equal id, label and vector are one row. Rows with the anchor's own id are neither its
    positives nor its negatives. An id with unlike vectors or labels is several rows, and several anchors under one id, each
    with results of its own. Only vectors of the anchor's length in numbers take part. Fewer candidates than asked for: all.
    A positive without a negative in its range has no row, so has any with a score below zero.
    A component or a score that leaves a long is an error that names the row. Empty tables give no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    if positives < 1 or negatives < 1 or not 0 <= low <= high:
        raise ValueError("positives and negatives must be 1 or more, 0 <= low <= high")

    def rows(df: DataFrame) -> DataFrame:
        plain = df.select(F.col(id).cast("long").alias("id"), F.col(label).cast("string").alias("label"), quantised(F.col(vector), scale, F.col(id)).alias("v"))
        plain = plain.where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").dropDuplicates()
        norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
        return plain.withColumn("dim", F.size("v")).withColumn("norm", norm)

    data = _shards(stored(rows(vectors), "negative-rows"))
    asked = stored(rows(anchors).withColumn("key", F.monotonically_increasing_id()), "anchors")
    place = F.struct("dim", "label")
    ranges = data.groupBy("shard").agg(F.min(place).alias("least"), F.max(place).alias("most"), F.max("norm").alias("norm")).orderBy("shard").collect()
    if not ranges:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    numbers = np.array([r.shard for r in ranges])
    least, most = [tuple(r.least) for r in ranges], [tuple(r.most) for r in ranges]
    longest = np.array([r.norm for r in ranges])
    dims = np.array([[a[0], b[0]] for a, b in zip(least, most)])
    single = np.array([a == b for a, b in zip(least, most)])

    def same_label(dim: int, label: str, norm: float, floor: float) -> np.ndarray:
        return numbers[bisect_left(most, (dim, label)) : bisect_right(least, (dim, label))]

    def other_labels(dim: int, label: str, norm: float, floor: float) -> np.ndarray:
        hit = (dims[:, 0] <= dim) & (dims[:, 1] >= dim) & (longest * norm * (1 + 1e-9) + 1e-9 >= floor)
        hit[bisect_left(most, (dim, label)) : bisect_right(least, (dim, label))] &= ~single[bisect_left(most, (dim, label)) : bisect_right(least, (dim, label))]
        return numbers[hit]

    asked_first = asked.select("key", "id", "label", "v", "dim", "norm", F.expr("array(cast(null as struct<id:long,score:long>))").alias("found"))
    hits = _solved(data, len(ranges), _dealt(asked_first, same_label), _positives(positives), "key long, id long, score long", by_label=True)
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "id"))
    best = hits.withColumn("rank", rank).where(F.col("rank") <= positives)
    best = best.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("found"))  # ``positives`` at most
    best = best.select("key", F.transform("found", lambda x: F.struct(x.id.alias("id"), x.score.alias("score"))).alias("found"))
    second = stored(asked.join(best, "key").select("key", "id", "label", "v", "dim", "norm", "found"), "positives")
    schema = "key long, nth int, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    found = _solved(data, len(ranges), _dealt(second, other_labels, low), _negatives(negatives, low, high), schema, by_label=False)
    rank = F.row_number().over(Window.partitionBy("key", "nth").orderBy(F.desc("negative_score"), "negative_id"))
    found = found.withColumn("rank", rank).where(F.col("rank") <= negatives)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


_ANCHOR = "key long, id long, label string, v array<long>, dim int, norm double, found array<struct<id:long,score:long>>"


def _dealt(asked: DataFrame, wanted: Callable[[int, str, float, float], np.ndarray], low: int = 0) -> DataFrame:
    """Anchors once per shard that ``wanted`` names for them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("found").to_pylist()
            floors = [min((x["score"] * low / 100 for x in f if x and x["score"] >= 0), default=np.inf) for f in found]
            places = [wanted(*row) for row in zip(*[batch.column(c).to_pylist() for c in ("dim", "label", "norm")], floors)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.list_(pa.int32()))], [*batch.schema.names, "shards"])

    dealt = asked.mapInArrow(run, f"{_ANCHOR}, shards array<int>")
    return dealt.select("*", F.explode("shards").alias("shard")).drop("shards")


def _positives(k: int):
    """A search for the k best rows of the anchor's label."""

    def search(index: Buckets, labels: np.ndarray, asked: dict) -> list[tuple]:
        best = [Best(k) for _ in asked["key"]]

        def take(i: int, rows: np.ndarray, scores: np.ndarray) -> float:
            low = best[i].floor(-np.inf)
            at = np.flatnonzero((index.ids[rows] != asked["id"][i]) & (scores >= low))
            best[i].add(index.ids[rows[at]], scores[at])
            return best[i].floor(-np.inf)

        index.search(asked["v"], asked["id"], np.full(len(best), -np.inf), take)
        return [(key, other, -score) for key, b in zip(asked["key"].tolist(), best) for score, other in b.held]

    return search


def _negatives(k: int, low: int, high: int):
    """A search for the k best rows of other labels in the range of each positive's score."""

    def search(index: Buckets, labels: np.ndarray, asked: dict) -> list[tuple]:
        ranges = [[(n, x, -(-low * x["score"] // 100), high * x["score"] // 100) for n, x in enumerate(f) if x["score"] >= 0] for f in asked["found"]]
        best = [[Best(k) for _ in r] for r in ranges]
        codes = {x: c for c, x in enumerate(np.unique(labels).tolist())}
        coded = np.array([codes[x] for x in labels.tolist()])[index.rows]

        def floor(i: int) -> float:
            return min((b.floor(r[2]) for b, r in zip(best[i], ranges[i])), default=np.inf)

        def take(i: int, rows: np.ndarray, scores: np.ndarray) -> float:
            other = (coded[rows] != codes.get(asked["label"][i], -1)) & (index.ids[rows] != asked["id"][i]) & (scores >= floor(i))
            rows, scores = rows[other], scores[other]
            for b, (_, _, least, most) in zip(best[i], ranges[i]):
                at = np.flatnonzero((scores >= b.floor(least)) & (scores <= most))
                if len(at):
                    b.add(index.ids[rows[at]], scores[at])
            return floor(i)

        index.search(asked["v"], asked["id"], np.array([floor(i) for i in range(len(best))], float), take)
        return [
            (key, n, own, x["id"], x["score"], other, -score)
            for key, own, bs, rs in zip(asked["key"].tolist(), asked["id"].tolist(), best, ranges)
            for b, (n, x, _, _) in zip(bs, rs)
            for score, other in b.held
        ]

    return search


def _solved(data: DataFrame, shards: int, dealt: DataFrame, search: Callable, schema: str, by_label: bool) -> DataFrame:
    """Stream the anchors of each shard through its vectors, indexed by length in numbers (and label)."""
    spark = data.sparkSession
    nothing = F.lit(None)
    rows = data.select("shard", F.lit(0).alias("kind"), nothing.cast("long").alias("key"), "id", "label", "v", "dim", F.expr("cast(null as array<struct<id:long,score:long>>)").alias("found"))
    asked = dealt.select("shard", F.lit(1).alias("kind"), "key", "id", "label", "v", "dim", "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, made = None, [], {}
        for batch in batches:
            shard, kind = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
            cuts = np.flatnonzero((shard[1:] != shard[:-1]) | (kind[1:] != kind[:-1])) + 1
            edges = [0, *cuts.tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if shard[a] != place:
                    place, held, made = shard[a], [], {}
                if kind[a] == 0:
                    held.append(batch.slice(a, b - a).select(["id", "label", "v", "dim"]))
                    continue
                if held:
                    made, held = _indexed(held, by_label), []
                for i in range(a, b, STEP):
                    yield from _answers(batch.slice(i, min(STEP, b - i)), made, by_label, search)

    names = [c.strip().split()[0] for c in schema.split(",")]
    kinds = [pa.int32() if c.strip().endswith(" int") else pa.int64() for c in schema.split(",")]

    def _answers(batch: pa.RecordBatch, made: dict, by_label: bool, search: Callable) -> Iterator[pa.RecordBatch]:
        dim, labels = batch.column("dim").to_numpy(), np.array(batch.column("label").to_pylist(), object)
        keys = list(zip(dim.tolist(), labels.tolist())) if by_label else dim.tolist()
        groups: dict = {}
        for i, key in enumerate(keys):
            groups.setdefault(key, []).append(i)
        for key, at in groups.items():
            if key not in made:
                continue
            part = batch.take(pa.array(at))
            asked = {c: part.column(c).to_numpy() for c in ("key", "id")}
            asked |= {"v": _grid(part, int(dim[at[0]])), "label": labels[at].tolist(), "found": part.column("found").to_pylist()}
            out = search(*made[key], asked)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    both = rows.unionAll(asked).repartition(min(max(shards, parts(spark)), 64 * parts(spark)), "shard").sortWithinPartitions("shard", "kind")
    return both.mapInArrow(run, schema)


def _grid(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy().reshape(batch.num_rows, dim)


def _indexed(held: list[pa.RecordBatch], by_label: bool) -> dict:
    """An index per length in numbers, or per that and label, with the labels of its rows."""
    rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    dim, labels = rows.column("dim").to_numpy(), rows.column("label").dictionary_encode()
    codes, names = labels.indices.to_numpy(), np.array(labels.dictionary.to_pylist(), object)
    made = {}
    for d in np.unique(dim).tolist():
        for c in np.unique(codes[dim == d]).tolist() if by_label else [None]:
            at = np.flatnonzero((dim == d) & (codes == c) if by_label else dim == d)
            part = rows.take(pa.array(at))
            index = Buckets(part.column("id").to_numpy(), _grid(part, d))
            made[(d, names[c]) if by_label else d] = index, names[codes[at]]
    return made
