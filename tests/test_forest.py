import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywarden.operators import forest as forests
from tallywarden.plans import training
from tallywarden.plans.catalog import fixed_forest
from tallywarden.schemas import FEATURES


@pytest.fixture(scope="module")
def normal(spark):
    points = np.random.default_rng(0).standard_normal((100, 3))
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "seq bigint, f0 double, f1 double, f2 double")


@pytest.fixture(scope="module")
def model(normal):
    return forests.fit(normal, ["f0", "f1", "f2"], trees=20, sample_size=64, seed=1)


def walk(model, point):
    """The score by following every tree from its root."""
    total = 0.0
    for _, tree in model.nodes.groupby("tree"):
        nodes = tree.set_index("node")
        node = nodes.loc[0]
        while node.feature != forests.LEAF:
            node = nodes.loc[node.left if point[int(node.feature)] <= node.threshold else node.right]
        total += node.path_length
    return 2 ** (-(total / model.trees) / model.normaliser)


def test_average_path():
    assert forests.average_path(1) == 0 and forests.average_path(2) == 1
    assert forests.average_path(256) == pytest.approx(2 * (math.log(255) + 0.5772156649) - 2 * 255 / 256)


def test_scores_follow_the_trees(normal, model):
    rows = forests.score(normal, model).collect()
    for r in rows[:25]:
        assert r.anomaly_score == pytest.approx(walk(model, (r.f0, r.f1, r.f2)), abs=1e-12)
    assert all(0 < r.anomaly_score < 1 for r in rows)


def test_boxes_hold_each_row_once_per_tree(normal, model):
    leaves = model.leaves()
    for r in normal.limit(20).collect():
        point = np.array([r.f0, r.f1, r.f2])
        hit = [np.all((np.array(n.lo) < point) & (point <= np.array(n.hi))) for n in leaves.itertuples()]
        assert leaves[hit].groupby("tree").size().tolist() == [1] * model.trees


def test_columns_are_taken_by_name(normal, model, spark):
    shuffled = normal.select("f2", "seq", "f0", "f1")
    a = forests.score(shuffled, model).orderBy("seq").collect()
    b = forests.score_vector(normal.withColumn("vector", F.array("f0", "f1", "f2")), model).orderBy("seq").collect()
    assert [x.anomaly_score for x in a] == [x.anomaly_score for x in b]
    assert not forests.flag(forests.score(shuffled, model), 1e9).where("is_anomaly").count()
    renamed = normal.select("seq", F.col("f0").alias("a"), F.col("f1").alias("b"), F.col("f2").alias("c"))
    c = forests.score(renamed, model, feature_order=["a", "b", "c"]).orderBy("seq").collect()
    assert [x.anomaly_score for x in a] == [x.anomaly_score for x in c]


def test_errors(normal, model, spark, work):
    with pytest.raises(KeyError, match="f1"):
        forests.score(normal.drop("f1"), model)
    with pytest.raises(ValueError):
        forests.score(normal, model, feature_order=["f0"])
    with pytest.raises(RuntimeError):
        forests.fit(normal.where("false"), ["f0"])
    with pytest.raises(FileNotFoundError):
        forests.load(spark, work)


def test_missing_values_get_no_score(spark, model):
    rows = spark.createDataFrame([(0, None, 1.0, 1.0), (1, float("nan"), 1.0, 1.0)], "seq bigint, f0 double, f1 double, f2 double")
    flagged = forests.flag(forests.score(rows, model), 0.0)
    assert [(r.anomaly_score, r.is_anomaly) for r in flagged.collect()] == [(None, False)] * 2


def test_flag_is_at_or_above(spark):
    rows = spark.createDataFrame([(0.44,), (0.45,), (float("nan"),), (None,)], "anomaly_score double")
    assert [r.is_anomaly for r in forests.flag(rows).collect()] == [False, True, False, False]


def test_save_and_load(normal, model, spark, work):
    forests.save(spark, model, work)
    again = forests.load(spark, work)
    assert again.feature_names == model.feature_names and again.normaliser == model.normaliser
    a = forests.score(normal, model).orderBy("seq").collect()
    b = forests.score(normal, again).orderBy("seq").collect()
    assert [x.anomaly_score for x in a] == [x.anomaly_score for x in b]


def test_fit_is_repeatable_and_full(normal, model):
    again = forests.fit(normal.repartition(7), ["f0", "f1", "f2"], trees=20, sample_size=64, seed=1)
    assert again.nodes.equals(model.nodes)
    assert (model.nodes[model.nodes.node == 0]["size"] == 64).all()


def test_fit_samples_large_tables(spark):
    """More rows than the sampling pool: the pool is cut first, every tree still gets its sample."""
    big = spark.range(20000).select(F.col("id").alias("seq"), F.sin("id").alias("x"), F.cos(F.col("id") * 3).alias("y"))
    model = forests.fit(big, ["x", "y"], trees=10, sample_size=32)
    assert (model.nodes[model.nodes.node == 0]["size"] == 32).all()


def test_few_rows(spark):
    rows = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 2.0)], "seq bigint, x double")
    model = forests.fit(rows, ["x"], trees=3, sample_size=256)
    assert model.sample_size == 3 and forests.score(rows, model).where("anomaly_score is null").count() == 0


def test_planted_outliers_rank_first(spark):
    rng = np.random.default_rng(3)
    data = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.standard_normal((2000, 2)))]
    data += [(2000 + i, 12.0 + i, -15.0) for i in range(5)]
    df = spark.createDataFrame(data, "seq bigint, x double, y double")
    model = forests.fit(df, ["x", "y"], trees=100)
    top = forests.score(df, model).orderBy(F.desc("anomaly_score")).limit(20).collect()
    assert {2000, 2001, 2002, 2003, 2004} <= {r.seq for r in top}


def test_exact_quantile(spark):
    values = np.random.default_rng(5).exponential(1.0, 5000).round(3)
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "anomaly_score double")
    for share in (0.01, 0.25, 0.5):
        got = forests.contamination_threshold(df, share, exact=True).first().threshold
        assert got == pytest.approx(np.quantile(values, 1 - share), abs=1e-12)
    assert forests.exact_quantile(df.where("false"), "anomaly_score", 0.5) is None
    near = forests.contamination_threshold(df.where("not isnan(anomaly_score)"), 0.25, exact=False).first().threshold
    assert near == pytest.approx(np.quantile(values, 0.75), abs=0.01)


def test_sql_function(spark, normal, model):
    forests.register_score(spark, model, "forest_score")
    normal.createOrReplaceTempView("normal_points")
    got = spark.sql("SELECT seq, forest_score(f0, f1, f2) AS s FROM normal_points ORDER BY seq").collect()
    want = forests.score(normal, model).orderBy("seq").collect()
    assert [r.s for r in got] == [r.anomaly_score for r in want]


def test_train_from_transactions(tx, spark, work):
    rows = tx([(f"u{i % 5}", 10 + i % 9, i * 13) for i in range(300)])
    model = training.train(rows, work, trees=8, sample_size=32)
    assert model.feature_names == tuple(FEATURES)
    assert forests.load(spark, work).trees == 8


def test_train_wide(spark):
    wide = spark.range(400).select("id", *[F.sin(F.col("id") * (i + 1)).alias(f"V{i + 1}") for i in range(28)], F.col("id").cast("double").alias("Amount"))
    model = training.train_wide(wide, [c for c in wide.columns if c != "id"], "id", trees=5)
    assert len(model.feature_names) == 29


def test_fixed_forest_is_fixed():
    assert fixed_forest().nodes.equals(fixed_forest().nodes)


def test_every_row_can_reach_a_tree(spark):
    """No pool: rows of a large table reach trees from everywhere, and trees share rows by chance only."""
    rows = spark.range(200_000).selectExpr("id", "array(rand(3)) AS x")
    taken = [(r.id, r.tree) for r in forests.tree_rows(rows, 10, 1, 0.01).select("id", "tree").collect()]
    counts = np.bincount([t for _, t in taken], minlength=10)
    assert len(counts) == 10 and (abs(counts - 2000) < 250).all()
    tenths = np.bincount([i // 20_000 for i, _ in taken], minlength=10)
    assert (abs(tenths - 2000) < 250).all()
    assert len({i for i, _ in taken}) == len(taken)  # one hash: a row is in one tree at most
    many = [(r.id, r.tree) for r in forests.tree_rows(rows, 300, 1, 0.01).select("id", "tree").collect()]
    assert (abs(np.bincount([t for _, t in many], minlength=300) - 2000) < 300).all()
    pairs = {t: {i for i, u in many if u == t} for t in (0, 99, 100, 250)}
    assert abs(len(pairs[0] & pairs[100]) - 20) < 25 and abs(len(pairs[99] & pairs[250]) - 20) < 25
    assert forests.tree_rows(rows.limit(50), 7, 1, 1.0).count() == 350


def test_repeated_ids_still_fill_the_trees(spark):
    rows = spark.range(3000).selectExpr("id % 5 AS seq", "cast(id AS double) AS f0")
    model = forests.fit(rows, ["f0"], trees=8, sample_size=64, seed=2)
    assert (model.nodes[model.nodes.node == 0]["size"] == 64).all()
