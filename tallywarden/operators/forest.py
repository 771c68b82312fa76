"""Isolation forest (Liu, Ting, Zhou, ICDM 2008): fit on executors, score in Arrow batches.

A fitted forest is a small table: at most trees * (2 * sample_size - 1) nodes, whatever the
size of the training data. It is therefore safe to hold on the driver and to broadcast.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallywarden.schemas import DEFAULT_THRESHOLD, FEATURES, require
from tallywarden.session import cut_lineage

DEFAULT_TREES = 200
DEFAULT_SAMPLE = 256
DEFAULT_SEED = 42

NODE_SCHEMA = (
    "tree int, node int, feature int, threshold double, left int, right int, "
    "size int, path_length double, lo array<double>, hi array<double>"
)
CHILD_TYPES = {"left": "Int32", "right": "Int32"}  # null in leaves
LEAF = -1
_HASH_RANGE = 1 << 31


def average_path(n: float) -> float:
    """c(n): mean path length of an unsuccessful search in a binary search tree of n rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def grow_tree(points: np.ndarray, tree: int, sample_size: int, seed: int) -> pd.DataFrame:
    """One tree as node rows. A row goes left when its value is <= the threshold.

    Each node also carries its box: a point is in it when lo < x <= hi for every feature.
    """
    rng = np.random.default_rng([seed, tree])
    limit = math.ceil(math.log2(max(sample_size, 2)))
    width = points.shape[1]
    nodes: list[list] = []
    open_nodes = [(np.arange(len(points)), 0, np.full(width, -np.inf), np.full(width, np.inf), None, None)]
    while open_nodes:
        rows, depth, lo, hi, parent, side = open_nodes.pop()
        here = len(nodes)
        if parent is not None:
            nodes[parent][side] = here
        sub = points[rows]
        low, high = (sub.min(axis=0), sub.max(axis=0)) if len(rows) else (np.zeros(width), np.zeros(width))
        splittable = np.flatnonzero(high > low)
        if depth >= limit or len(splittable) == 0:
            path = depth + average_path(len(rows))
            nodes.append([tree, here, LEAF, None, None, None, len(rows), path, lo.tolist(), hi.tolist()])
            continue
        feature = int(rng.choice(splittable))
        threshold = float(rng.uniform(low[feature], high[feature]))
        if not low[feature] <= threshold < high[feature]:
            threshold = float(low[feature])
        nodes.append([tree, here, feature, threshold, None, None, len(rows), None, lo.tolist(), hi.tolist()])
        left = sub[:, feature] <= threshold
        left_hi, right_lo = hi.copy(), lo.copy()
        left_hi[feature] = right_lo[feature] = threshold
        open_nodes.append((rows[~left], depth + 1, right_lo, hi, here, 5))
        open_nodes.append((rows[left], depth + 1, lo, left_hi, here, 4))
    return pd.DataFrame(nodes, columns=[part.split()[0] for part in NODE_SCHEMA.split(", ")]).astype(CHILD_TYPES)


@dataclass(frozen=True)
class Forest:
    """A fitted forest: its nodes and what is needed to score with them."""

    nodes: pd.DataFrame
    feature_names: tuple[str, ...]
    sample_size: int
    trees: int
    seed: int

    @property
    def normaliser(self) -> float:
        return average_path(self.sample_size) or 1.0

    def leaves(self) -> pd.DataFrame:
        return self.nodes[self.nodes.feature == LEAF]

    def grids(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Trees as complete binary trees of equal depth: features, thresholds, leaf path lengths.

        A leaf above the last level is passed on to its left child until the last level.
        """
        depth = math.ceil(math.log2(max(self.sample_size, 2)))
        inner = (1 << depth) - 1
        feature = np.zeros((self.trees, inner), np.int64)
        threshold = np.full((self.trees, inner), np.inf)
        path = np.zeros((self.trees, inner + 1))
        for tree, part in self.nodes.groupby("tree"):
            part = part.set_index("node")
            table = part[["feature", "threshold", "left", "right", "path_length"]].astype(float).to_dict("index")
            stack = [(0, 0)]
            while stack:
                node, slot = stack.pop()
                row = table[node]
                if row["feature"] != LEAF:
                    feature[tree, slot], threshold[tree, slot] = int(row["feature"]), row["threshold"]
                    stack += [(int(row["left"]), 2 * slot + 1), (int(row["right"]), 2 * slot + 2)]
                else:
                    while slot < inner:
                        slot = 2 * slot + 1
                    path[tree, slot - inner] = row["path_length"]
        return feature, threshold, path


def fit(
    df: DataFrame,
    features: list[str] = FEATURES,
    row_id: str = "seq",
    trees: int = DEFAULT_TREES,
    sample_size: int = DEFAULT_SAMPLE,
    seed: int = DEFAULT_SEED,
) -> Forest:
    """Fit on a table of any size; every row has the same chance to be in each tree's sample.

    A hash of its id is a row's place in [0, 1). A tree owns a stretch of that range which holds
    a little more rows than its sample, so a row goes to one tree at most per hash; where the trees
    need more than the whole range (small tables), further hashes serve the further trees. Among a tree's
    rows the first ``sample_size`` by another hash are its sample. So about trees * sample_size rows
    move, however large the table, and the sample is the same on every run and after any retry.
    Should a tree get too few rows (ids that are not unique), the stretches are doubled.
    """
    require(df, [*features, row_id], "feature")
    total = df.count()
    if total == 0:
        raise RuntimeError("no training rows")
    sample_size = min(sample_size, total)
    rows = df.select(F.col(row_id).alias("id"), F.array(*[F.col(c).cast("double") for c in features]).alias("x"))
    # Ten deviations more than the sample: fewer rows are out of the question if ids are unique.
    share = (sample_size + 10 * math.sqrt(sample_size) + 30) / total
    while True:
        forest = _fit(rows, features, trees, sample_size, seed, min(1.0, share))
        roots = forest.nodes[forest.nodes.node == 0]
        if len(roots) == trees and (roots["size"] == sample_size).all():
            return forest
        if share >= 1:
            raise RuntimeError("a tree did not get its full sample")
        share *= 2


def tree_rows(rows: DataFrame, trees: int, seed: int, share: float) -> DataFrame:
    """Rows (id, x, tree): each tree gets a ``share`` of all rows, by hashes of their ids."""
    per_hash = min(trees, max(1, int(1 / share)))
    rounds = -(-trees // per_hash)
    place = lambda r: _hashed(F.lit(seed), F.col("id"), r) / F.lit(float(_HASH_RANGE))
    if rounds == 1:
        slot = F.floor(place(F.lit(0)) / share)
        return rows.withColumn("tree", slot.cast("int")).where(F.col("tree") < trees)
    slots = F.transform(F.sequence(F.lit(0), F.lit(rounds - 1)), lambda r: F.struct(r.alias("r"), F.floor(place(r) / share).alias("slot")))
    kept = F.filter(slots, lambda s: (s.slot < per_hash) & (s.r * per_hash + s.slot < trees))
    return rows.select("id", "x", F.explode(F.transform(kept, lambda s: (s.r * per_hash + s.slot).cast("int"))).alias("tree"))


def _fit(rows: DataFrame, features: list[str], trees: int, sample_size: int, seed: int, share: float) -> Forest:
    # The sample is small in bytes but growing trees is work: spread it by number, not by size.
    tasks = min(trees, rows.sparkSession.sparkContext.defaultParallelism)
    per_tree = tree_rows(rows, trees, seed, share).repartition(tasks, "tree")
    draw_order = W.partitionBy("tree").orderBy(F.xxhash64(F.lit(seed + 2), "id", "tree"), "id")
    sample = per_tree.withColumn("draw", F.row_number().over(draw_order)).where(F.col("draw") <= sample_size)

    def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        points = np.vstack(pdf.sort_values("draw")["x"].to_numpy())
        return grow_tree(points, int(key[0]), sample_size, seed)

    # A group is one tree: sample_size rows, never more.
    nodes = sample.groupBy("tree").applyInPandas(grow, NODE_SCHEMA).toPandas()
    nodes = nodes.sort_values(["tree", "node"], ignore_index=True).astype(CHILD_TYPES)
    return Forest(nodes, tuple(features), sample_size, trees, seed)


def _hashed(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(_HASH_RANGE))


def _floats(values) -> list[float]:
    return np.asarray(values, float).tolist()


def save(spark: SparkSession, forest: Forest, path: str) -> None:
    """Nodes and one metadata row, as Parquet."""
    nodes = forest.nodes.assign(lo=forest.nodes.lo.map(_floats), hi=forest.nodes.hi.map(_floats)).astype(object)
    nodes = nodes.where(nodes.notna(), None)
    rows = [tuple(r) for r in nodes.itertuples(index=False)]
    spark.createDataFrame(rows, NODE_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
    meta = [(list(forest.feature_names), forest.sample_size, forest.trees, forest.seed)]
    schema = "feature_names array<string>, sample_size int, trees int, seed int"
    spark.createDataFrame(meta, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/metadata")


def load(spark: SparkSession, path: str) -> Forest:
    """Read a saved forest; a path without one raises FileNotFoundError."""
    try:
        meta = spark.read.parquet(f"{path}/metadata").first()
        nodes = spark.read.parquet(f"{path}/nodes").orderBy("tree", "node").toPandas().astype(CHILD_TYPES)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(f"no forest at {path}") from error
        raise
    return Forest(nodes, tuple(meta.feature_names), meta.sample_size, meta.trees, meta.seed)


def scorer(spark: SparkSession, forest: Forest):
    """A vectorised function of the feature columns, in model order, giving the score."""
    feature, threshold, path = forest.grids()
    normaliser = forest.normaliser
    model = spark.sparkContext.broadcast((feature, threshold, path))

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        feature, threshold, path = model.value
        for batch in batches:
            columns = batch if isinstance(batch, tuple) else (batch,)
            values = np.vstack([c.to_numpy(dtype=float, na_value=np.nan) for c in columns])
            lengths = path_lengths(values, feature, threshold, path)
            result = np.exp2(-(lengths / len(path)) / normaliser)
            result[np.isnan(values).any(axis=0)] = np.nan
            yield pd.Series(result)  # NaN arrives as null

    return score


def path_lengths(values: np.ndarray, feature: np.ndarray, threshold: np.ndarray, path: np.ndarray) -> np.ndarray:
    """Summed path length per row; ``values`` has one line per feature.

    Works tree by tree on blocks that stay in the processor cache.
    """
    rows = values.shape[1]
    total = np.zeros(rows)
    inner = threshold.shape[1]
    depth = inner.bit_length()
    block = 4096
    for start in range(0, rows, block):
        part = np.ascontiguousarray(values[:, start : start + block])
        flat, size = part.ravel(), part.shape[1]
        columns = np.arange(size)
        total_part = total[start : start + block]
        for tree in range(len(path)):
            offset, cuts = feature[tree] * size, threshold[tree]
            slot = np.zeros(size, np.int64)
            for _ in range(depth):
                right = flat.take(offset.take(slot) + columns) > cuts.take(slot)
                slot = 2 * slot + 1 + right
            total_part += path[tree].take(slot - inner)
    return total


def score(df: DataFrame, forest: Forest, column: str = "anomaly_score", feature_order: list[str] | None = None) -> DataFrame:
    """Append the score: 2^(-mean path length / c(sample size)), larger is more anomalous.

    Columns are taken by name in the model's order, or in an explicit order of equal length.
    """
    order = list(feature_order or forest.feature_names)
    if len(order) != len(forest.feature_names):
        raise ValueError(f"feature order has {len(order)} names, the model expects {len(forest.feature_names)}")
    require(df, order, "required feature")
    return _computed_once(df, column, scorer(df.sparkSession, forest)(*[F.col(c).cast("double") for c in order]))


def score_expression(forest: Forest, values: Column) -> Column:
    """The score of an array of feature values in model order, as a column without Python: null if one is null or NaN.

    The trees are one constant of the plan, three arrays of 2^depth numbers each: 200 trees of 256 rows are 1.2 MB,
    whatever the table. A row walks down each tree by position, depth steps of array look-ups.
    """
    feature, threshold, path = forest.grids()
    largest = float(np.finfo(float).max)  # stands for no cut: no finite value is above it
    trees = [{"f": f, "c": [min(x, largest) for x in c], "p": p} for f, c, p in zip(feature.tolist(), threshold.tolist(), path.tolist())]
    known = F.from_json(F.lit(json.dumps(trees)), "array<struct<f:array<int>,c:array<double>,p:array<double>>>")
    levels = F.array(*[F.lit(k) for k in range((threshold.shape[1] + 1).bit_length() - 1)])
    inner = threshold.shape[1]

    def length(total: Column, tree: Column) -> Column:
        def step(slot: Column, level: Column) -> Column:
            right = F.get(values, F.get(tree["f"], slot)) > F.get(tree["c"], slot)
            return slot * 2 + 1 + right.cast("int")

        return total + F.get(tree["p"], F.aggregate(levels, F.lit(0), step) - inner)

    whole = F.size(values) == len(forest.feature_names)
    usable = whole & F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x))
    mean = F.aggregate(known, F.lit(0.0), length) / len(path)
    return F.when(usable, F.pow(F.lit(2.0), -mean / forest.normaliser))


def score_natively(df: DataFrame, forest: Forest, column: str = "anomaly_score") -> DataFrame:
    """As ``score``, all in the JVM: for clusters without Python workers, and plans that must not leave the JVM."""
    require(df, list(forest.feature_names), "required feature")
    values = F.array(*[F.col(c).cast("double") for c in forest.feature_names])
    # The array is made once, behind a generator: a lambda would make it again for every look-up.
    once = df.select("*", F.explode(F.array(values)).alias("_values"))
    return _computed_once(once, column, score_expression(forest, F.col("_values"))).drop("_values")


def score_vector(df: DataFrame, forest: Forest, vector: str = "vector", column: str = "anomaly_score") -> DataFrame:
    """As ``score`` for an array column in model order; a null vector gets a null score."""
    size = len(forest.feature_names)
    parts = [F.get(vector, F.lit(i)) for i in range(size)]
    whole = F.size(vector) == size
    return _computed_once(df, column, scorer(df.sparkSession, forest)(*[F.when(whole, p) for p in parts]))


def _computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that filters on it do not compute a second time.

    A filter on the column would be pushed below a projection together with its expression;
    it stays above a generator, while filters on other columns still go down to the scan.
    """
    kept = [c for c in df.columns if c != name]
    return df.withColumn("_value", value).select(*kept, F.inline(F.array(F.struct(F.col("_value").alias(name)))))


def register_score(spark: SparkSession, forest: Forest, name: str = "anomaly_score") -> None:
    """Make the scorer callable from SQL."""
    spark.udf.register(name, scorer(spark, forest))


def flag(df: DataFrame, threshold: float = DEFAULT_THRESHOLD, score: str = "anomaly_score", column: str = "is_anomaly") -> DataFrame:
    """Flag scores at or above the threshold; a missing score is not an anomaly."""
    known = F.nanvl(F.col(score), F.lit(None).cast("double"))
    return df.withColumn(column, F.coalesce(known >= F.lit(float(threshold)), F.lit(False)))


def contamination_threshold(scored: DataFrame, share: float = 0.01, exact: bool = True, score: str = "anomaly_score") -> DataFrame:
    """The score that the given share of rows reach: one row. ``exact=False`` reads it off a bounded sketch."""
    if not 0 < share < 1:
        raise ValueError("share must be in (0, 1)")
    if not exact:
        return scored.agg(F.percentile_approx(score, F.lit(1 - share), F.lit(100_000)).alias("threshold"))
    value = exact_quantile(scored, score, 1 - share)
    return scored.sparkSession.createDataFrame([(value,)], "threshold double")


def sanity(scored: DataFrame) -> DataFrame:
    """Counts that show whether scores and flags are whole: one row."""
    s = F.col("anomaly_score")
    return scored.agg(
        F.count("*").alias("rows"),
        F.count_if(s.isNull() | F.isnan(s)).alias("missing_scores"),
        F.count_if(F.col("is_anomaly").isNull()).alias("missing_flags"),
        F.count_if((s < 0) | (s > 1)).alias("out_of_range"),
    )


def exact_quantile(df: DataFrame, column: str, share: float) -> float | None:
    """Exact quantile with linear interpolation, for a column of any size; NaN and null are left out.

    Counts rows in equal slices of the value range and goes on inside the slice that holds
    the wanted rank. Only the slice counts reach the driver, and a few passes are enough.
    """
    values = df.select(F.col(column).alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    values = cut_lineage(df.sparkSession, values)  # several passes over one column
    n, low, high = values.agg(F.count("*"), F.min("x"), F.max("x")).first()
    if not n:
        return None
    position = share * (n - 1)
    lower, upper = (_at_rank(values, int(r), low, high) for r in (math.floor(position), math.ceil(position)))
    return lower + (upper - lower) * (position - math.floor(position))


def _at_rank(values: DataFrame, rank: int, low: float, high: float, slices: int = 4096) -> float:
    """The value at a 0-based rank of all values in [low, high]."""
    while low < high:
        inside = values.where((F.col("x") >= F.lit(low)) & (F.col("x") <= F.lit(high)))
        piece = F.least(F.floor((F.col("x") - F.lit(low)) / F.lit(high - low) * slices), F.lit(slices - 1))
        found = inside.groupBy(piece.alias("piece")).agg(
            F.count("*").alias("rows"), F.min("x").alias("low"), F.max("x").alias("high")
        )
        for part in sorted(found.collect(), key=lambda r: r.piece):  # at most ``slices`` rows
            if rank < part.rows:
                low, high = part.low, part.high
                break
            rank -= part.rows
    return low
