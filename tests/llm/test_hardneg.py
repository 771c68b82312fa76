"""Hard negatives against brute force and SQL."""

import math

import numpy as np
import pytest
from tests.llm.test_documents import same

from tallywarden.llm import hardneg, queries, sql

INF, NAN = float("inf"), float("nan")


def brute(rows, step, positives=5, negatives=3, low=50, high=95, scale=256):
    whole = []
    for i, label, v in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = (i, label, tuple(math.floor(scale * float(x)) for x in v))
        if row not in whole:
            whole.append(row)
    out = []
    for i, label, v in whole:
        if i % step:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in whole if j != i and len(w) == len(v)]
        for s, p, _ in sorted(x for x in scored if x[2] == label)[:positives]:
            near = sorted(x for x in scored if x[2] != label and low * -s <= 100 * -x[0] <= high * -s)[:negatives]
            out += [(i, p, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(near)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, label, v, None) for i, label, v in rows], "vec_id long, label int, embedding array<double>, score string")


def answer(df, step, **options):
    return sorted(map(tuple, hardneg.hard_negatives(df, df.where(f"vec_id % {step} = 0"), **options).collect()))


@pytest.fixture(scope="module")
def rows():
    """Clusters of unlike lengths, ties, repeated rows and ids, nulls, other lengths, zero and odd vectors."""
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(6, 8))
    out = [(i, i % 3, [float(x) for x in (middles[i % 6] + 0.3 * rng.normal(size=8)) * (1 + i % 4)]) for i in range(240)]
    out += [(300 + i, i % 2, out[5][2]) for i in range(60)]
    out += [(0, 1, out[0][2]), (0, 0, out[0][2]), (0, 0, out[0][2]), (10, 2, out[9][2])]
    out += [(400, 1, [0.0] * 8), (410, None, out[1][2]), (None, 1, out[1][2]), (420, 1, None), (430, 1, []), (440, 1, [NAN] * 8)]
    out += [(450, 1, [INF] + [0.0] * 7), (460, 1, [None] + [0.0] * 7), (470, 1, [1.0, 2.0]), (471, 1, [1.5, 2.0]), (472, 0, [1.0, 1.1]), (480, 7, [1.0] * 8), (-10, 1, out[7][2])]
    return out


@pytest.mark.parametrize("sizes", [(16_384, 2048), (40, 7)])
def test_equals_brute_force(spark, rows, monkeypatch, sizes):
    monkeypatch.setattr(hardneg, "SHARD_ROWS", sizes[0])
    monkeypatch.setattr(hardneg, "BUCKET_ROWS", sizes[1])
    want = brute(rows, 10)
    assert len(want) > 200 and answer(frame(spark, rows), 10) == want


def test_counts_and_range(spark, rows):
    assert answer(frame(spark, rows), 30, positives=2, negatives=7, low=0, high=100) == brute(rows, 30, 2, 7, 0, 100)
    with pytest.raises(ValueError):
        answer(frame(spark, rows), 30, low=60, high=50)


def test_empty_tables(spark, rows):
    df = frame(spark, rows)
    none = df.where("false")
    for a, b in ((none, none), (df, none), (none, df)):
        found = hardneg.hard_negatives(a, b)
        assert found.count() == 0 and found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_large_components(spark):
    rows = [(i, i % 2, [1e6 + i, 2e6 - i / 3, float(i)]) for i in range(60)] + [(99, 0, [1e7, 3e6, 0.0]), (97, 1, [4e6, 1e6, 1.0])]
    assert answer(frame(spark, rows), 20, low=10, high=100) == brute(rows, 20, low=10, high=100)
    with pytest.raises(Exception, match="1001"):
        answer(frame(spark, [*rows, (1001, 0, [1e18, 0.0, 0.0])]), 20)


def test_ranges_prune():
    """With separated directions a bucket's lists leave few rows, and none that reaches the floor is lost."""
    rng = np.random.default_rng(6)
    middles = np.round(rng.normal(size=(30, 6)) * 1000).astype(np.int64)
    grid = (middles[:, None] + rng.integers(-40, 40, (30, 100, 6))).reshape(-1, 6)
    index = hardneg.Buckets(np.arange(len(grid)), grid)
    scores = grid[::75] @ grid.T
    floors = np.sort(scores, axis=1)[:, -60].astype(float)
    met = [set() for _ in floors]

    def take(i, rows, found):
        met[i] |= set(index.ids[rows[found >= floors[i]]].tolist())
        return floors[i]

    index.search(grid[::75], np.arange(0, len(grid), 75), floors, take)
    assert all(m == set(np.flatnonzero(s >= f).tolist()) for m, s, f in zip(met, scores, floors))
    assert index.scored < len(grid) * len(floors) / 3


def test_query_equals_sql(spark, duck):
    folder = "/root/testdata/sf0.01"
    con = duck(embeddings=spark.read.parquet(f"{folder}/embeddings.parquet"))
    assert same(queries.op11_hardneg(spark, folder), con.sql(sql.NEGATIVES))
