"""Vector searches against brute force."""

import math

import numpy as np
import pytest
from tests.llm.test_documents import same

from tallywarden.llm import ann, queries, sql, topk

INF, NAN = float("inf"), float("nan")


@pytest.fixture
def vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=6))], None) for i in range(300)]
    rows += [(300 + i, rows[5][1], None) for i in range(40)]  # ties
    rows += [(0, rows[0][1], None), (-100, rows[7][1], "x"), (400, [0.0] * 6, None), (500, None, None), (600, [1.0, None, 0.0, 0.0, 0.0, 0.0], None)]
    rows += [(700, [NAN] * 6, None), (800, [INF, 0.0, 0.0, 0.0, 0.0, 0.0], None), (900, [1.0, 2.0], None), (901, [1.0, 2.5], None), (None, [1.0] * 6, None), (1000, [], None)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")


def real(vectors, zero):
    out = []
    for r in vectors.collect():
        v = r.embedding
        if r.vec_id is None or not v or any(x is None or not math.isfinite(x) for x in v) or (not zero and not any(v)):
            continue
        out.append((r.vec_id, np.array(v, np.float64)))
    return out


def brute(rows, step, k, score, best):
    out = []
    for key, q in rows:
        if key % step:
            continue
        found = sorted((best * score(q, v), other) for other, v in rows if other != key and len(v) == len(q))[:k]
        out += [(key, i + 1, other, best * s) for i, (s, other) in enumerate(found)]
    return sorted(out)


def distance(a, b):
    return float(np.sqrt(np.cumsum((a - b) ** 2)[-1]))


@pytest.mark.parametrize("shard,leaf", [(10_000, 256), (60, 4)])
def test_nearest(vectors, shard, leaf):
    asked = vectors.where("vec_id % 100 = 0").distinct()
    got = sorted(map(tuple, ann.nearest(vectors, asked, k=10, shard=shard, leaf=leaf).collect()))
    want = brute(real(vectors, False), 100, 10, distance, 1)
    assert got == sorted(set(want))


def test_relaxed_search_finds_most(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    asked = rows.where("vec_id % 10 = 0")
    exact = {(r.query_id, r.vec_id) for r in ann.nearest(rows, asked, leaf=16).collect()}
    some = {(r.query_id, r.vec_id) for r in ann.nearest(rows, asked, factor=3.0, leaf=16).collect()}
    assert len(exact) == 500 and len(exact & some) >= 0.9 * len(exact)
    with pytest.raises(ValueError):
        ann.nearest(rows, asked, factor=0.5)


def test_factor_prunes():
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(20, 4)) * 50
    grid = (middles[:, None] + rng.normal(size=(20, 200, 4))).reshape(-1, 4)
    tree = ann.Tree(np.arange(len(grid)), grid, leaf=32)
    found, far = tree.search(grid[::50], np.arange(0, len(grid), 50), 5, 1.0)
    exact, full = tree.compared, len(grid) * 80
    for q, row in zip(range(0, len(grid), 50), found):
        away = np.sqrt(((grid - grid[q]) ** 2).sum(axis=1))
        away[q] = np.inf
        assert row.tolist() == np.lexsort((np.arange(len(grid)), away))[:5].tolist()
    tree.search(grid[::50], np.arange(0, len(grid), 50), 5, 4.0)
    assert tree.compared < exact < full / 4


def test_equal_vectors_make_a_leaf():
    tree = ann.Tree(np.arange(5000), np.ones((5000, 3)), leaf=8)
    found, far = tree.search(np.ones((1, 3)), np.array([3]), 4, 1.0)
    assert found.tolist() == [[0, 1, 2, 4]] and far.tolist() == [[0.0] * 4]


def product(a, b):
    return int((np.floor(64 * a) * np.floor(64 * b)).sum())


@pytest.mark.parametrize("block", [16_384, 16])
def test_highest(vectors, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    asked = vectors.where("vec_id % 20 = 0").distinct()
    got = sorted(map(tuple, topk.highest(vectors, asked, k=20).collect()))
    assert got == sorted(set(brute(real(vectors, True), 20, 20, product, -1)))


def test_highest_replicates_only_what_matters(spark):
    """With separated clusters a group of queries needs few cells."""
    rng = np.random.default_rng(2)
    middles = rng.normal(size=(16, 5)) * 40
    rows = [(i, [float(x) for x in middles[i % 16] + rng.normal(size=5) * 0.1]) for i in range(1600)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.highest(vectors, vectors.where("vec_id % 20 = 0"), k=5).collect()))
    assert got == brute([(i, np.array(v)) for i, v in rows], 20, 5, product, -1)


def test_large_components_stay_exact(spark):
    rows = [(i, [1e6 + i, 2e6 - i / 3, float(i)]) for i in range(60)] + [(99, [1e9, 0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.highest(vectors, vectors.where("vec_id % 20 = 0"), k=3).collect()))
    whole = [(i, [math.floor(64 * x) for x in v]) for i, v in rows]
    want = []
    for key, q in whole:
        if key % 20 == 0:
            found = sorted((-sum(a * b for a, b in zip(q, v)), o) for o, v in whole if o != key)[:3]
            want += [(key, n + 1, o, -s) for n, (s, o) in enumerate(found)]
    assert got == sorted(want)


def exact(rows, step, k):
    want, whole = [], [(i, [math.floor(64 * x) for x in v]) for i, v in rows]
    for key, q in whole:
        if key % step == 0:
            found = sorted((-sum(a * b for a, b in zip(q, v)), o) for o, v in whole if o != key and len(v) == len(q))[:k]
            want += [(key, n + 1, o, -s) for n, (s, o) in enumerate(found)]
    return sorted(want)


def test_long_vectors_take_part(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=513 if i % 3 else 1024))]) for i in range(60)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, topk.highest(vectors, vectors.where("vec_id % 10 = 0"), k=5).collect()))
    assert len(got) == 30 and got == exact(rows, 10, 5)


def test_query_keeps_large_components(spark, work):
    """2^53 needs longs, 2^63 Python's integers; what no long holds is an error that names the row."""
    rows = [(i, [1e6 + i, 2e6 - i / 3, float(i)]) for i in range(60)] + [(99, [1e9, 0.0, 0.0]), (98, [-1e9, 3.0, 7e8]), (97, [1e11, -5e10, -64.0])]
    many = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    many.write.parquet(f"{work}/embeddings.parquet")
    got = sorted(map(tuple, queries.op7_topk(spark, work).collect()))
    assert {99, 98, 97} <= {r[2] for r in exact(rows, 20, 62)} and got == exact(rows, 20, 20)
    assert {r[2] for r in got} >= {99}
    for row, name in (((1001, [1e13, 1e13, 0.0]), "1001"), ((1002, [1e18, 0.0, 0.0]), "1002")):
        more = many.unionAll(spark.createDataFrame([row], many.schema))
        with pytest.raises(Exception, match=name):
            topk.highest(more, more.where("vec_id % 20 = 0"), k=3).collect()


def test_repeated_queries_are_one_query(spark, vectors, duck):
    """A query row that is repeated asks once; unlike vectors under one id are queries each."""
    more = vectors.unionAll(vectors.where("vec_id % 100 = 0")).unionAll(spark.createDataFrame([(100, [3.0] * 6, None)], vectors.schema))
    con = duck(embeddings=more)
    asked = more.where("vec_id % 100 = 0")
    for search, k, text in ((ann.nearest, 10, sql.NEAREST), (topk.highest, 20, sql.HIGHEST.replace("% 20 = 0", "% 100 = 0"))):
        got = search(more, asked, k=k)
        assert same(got, con.sql(text))
        assert got.where("query_id = 200").count() == k and got.where("query_id = 100").count() == 2 * k


def test_huge_components_have_distances(spark):
    rows = [(i, [1e200 * (i + 1), -1e200 / (i + 1), 1e180]) for i in range(30)] + [(40, [1.0, 2.0, 3.0]), (41, [1e308, -1e308, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in ann.nearest(vectors, vectors.where("vec_id % 10 = 0"), k=31).collect()}
    for q in (0, 10, 20, 40):
        scaled = sorted((math.sqrt(sum(((a - b) / 1e200) ** 2 for a, b in zip(dict(rows)[q], v))), i) for i, v in rows if i != q)
        assert [got[q, n + 1][0] for n in range(31)] == [i for _, i in scaled]
        assert [got[q, n + 1][1] for n in range(30)] == pytest.approx([s * 1e200 for s, _ in scaled[:30]], rel=1e-12)


def test_empty_tables(vectors):
    none = vectors.where("false")
    for search in (ann.nearest, topk.highest):
        assert search(none, none).count() == search(vectors, none).count() == search(none, vectors).count() == 0
        assert search(vectors, vectors.where("vec_id = 900")).columns == ["query_id", "rank", "vec_id", "score"]


def test_queries_equal_sql(spark, duck):
    folder = "/root/testdata/sf0.01"
    con = duck(embeddings=spark.read.parquet(f"{folder}/embeddings.parquet"))
    assert same(queries.op1_ann(spark, folder), con.sql(sql.NEAREST))
    assert same(queries.op7_topk(spark, folder), con.sql(sql.HIGHEST))
