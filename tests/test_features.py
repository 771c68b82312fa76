import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallywarden.operators import features as feats
from tallywarden.operators.ordered import hot_keys, running, trailing_count
from tallywarden.schemas import AMOUNT, COUNT, FEATURES, MEAN, SINCE


def collect(df, *columns):
    return [tuple(r) for r in df.orderBy("seq").select(*columns).collect()]


def brute_force(rows, window):
    """(mean, count, gap) per row, taken in (time, arrival) order per user."""
    out, state = {}, {}
    for i, (user, amount, t) in sorted(enumerate(rows), key=lambda x: (x[1][2], x[0])):
        s = state.setdefault(user, {"n": 0, "sum": 0.0, "times": []})
        gap = t - s["times"][-1] if s["times"] else 0
        s["n"], s["sum"] = s["n"] + 1, s["sum"] + amount
        s["times"].append(t)
        out[i] = (s["sum"] / s["n"], sum(x >= t - window for x in s["times"]), float(gap))
    return [out[i] for i in range(len(rows))]


def test_one_user(tx):
    got = collect(feats.features(tx([("u1", 100, 0), ("u1", 200, 30), ("u1", 50, 150)])), *FEATURES)
    assert got == [(100.0, 100.0, 1, 0.0), (200.0, 150.0, 2, 30.0), (50.0, pytest.approx(350 / 3), 1, 120.0)]


def test_users_are_independent(tx):
    got = collect(feats.features(tx([("u1", 100, 0), ("u2", 300, 10)])), MEAN, COUNT, SINCE)
    assert got == [(100.0, 1, 0.0), (300.0, 1, 0.0)]


def test_window_ends_are_inclusive(tx):
    got = collect(feats.features(tx([("u", 1, 0), ("u", 1, 60), ("u", 1, 120.000001)])), COUNT)
    assert got == [(1,), (2,), (1,)]


def test_half_millisecond_gaps_round_up(tx):
    got = collect(feats.features(tx([("u", 1, 0), ("u", 1, 0.0005), ("u", 1, 0.0009)])), SINCE)
    assert got == [(0.0,), (0.001,), (0.0,)]


@pytest.mark.parametrize("hot_rows", [10**9, 15, 3])
@pytest.mark.parametrize("window", [3, 40])
def test_equals_brute_force_with_ties_and_hot_users(tx, window, hot_rows):
    rng = random.Random(window)
    # u0 holds a third of all rows and most of them share one instant.
    rows = [("u0", rng.randint(1, 99), rng.choice([5, 5, 5, 6, 30])) for _ in range(60)]
    rows += [(f"u{rng.randint(1, 9)}", rng.randint(1, 99), rng.randint(0, 50)) for _ in range(120)]
    rng.shuffle(rows)
    got = collect(feats.features(tx(rows), window, hot_rows=hot_rows), MEAN, COUNT, SINCE)
    want = brute_force(rows, window)
    assert [(c, g) for _, c, g in got] == [(c, g) for _, c, g in want]
    assert [m for m, *_ in got] == pytest.approx([m for m, *_ in want])


def test_hot_keys_are_found(tx):
    rows = tx([("a", 1, i) for i in range(10)] + [("b", 1, i) for i in range(3)])
    assert hot_keys(rows, "user_id", 10) is None
    assert [tuple(r) for r in hot_keys(rows, "user_id", 3).collect()] == [("a", 10)]


def test_hot_rows_are_spread(tx, spark):
    """One user at one instant still lands in several chunks, none of which holds most rows."""
    rows = tx([("a", 1, 7)] * 4000)
    counted = running(rows, "user_id", amount="amount", window_us=10, hot_rows=500)
    assert collect(counted, "run_count", "window_count") == [(i, i) for i in range(1, 4001)]
    sizes = counted.groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert len(sizes) > 1


def test_whole_table_as_one_key(tx):
    rng = random.Random(1)
    rows = [("x", 1, rng.randint(0, 200)) for _ in range(300)]
    got = collect(trailing_count(tx(rows), None, 20 * 1_000_000), "window_count")
    assert [c for (c,) in got] == [c for _, c, _ in brute_force(rows, 20)]


def test_features_use_one_exchange(tx):
    plan = feats.features(tx([("u", 1, 0)]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1


def test_profile_and_ema(tx):
    rows = tx([("a", 10, 0), ("a", 20, 5), ("a", 40, 9), ("b", 7, 3)])
    profile = {r.user_id: (r.tx_count, r.mean_amount) for r in feats.user_profile(rows).collect()}
    assert profile == {"a": (3, pytest.approx(70 / 3)), "b": (1, 7.0)}
    for hot_rows in (10**9, 2):
        ema = {r.user_id: r.ema_amount for r in feats.user_amount_ema(rows, 0.2, hot_rows=hot_rows).collect()}
        assert ema == {"a": pytest.approx(0.2 * 40 + 0.8 * (0.2 * 20 + 0.8 * 10)), "b": pytest.approx(7.0)}


def test_active_users_on_and_between_ticks(tx):
    start = 1_700_000_100_000_000  # a multiple of 300 s
    rows = tx([("a", 1, 0), ("a", 1, 10), ("b", 1, 299), ("c", 1, 300)], start_us=start)
    got = {int(r.tick_ts.timestamp()) - start // 1_000_000: r.active_users for r in feats.active_users(rows).collect()}
    assert got == {0: 1, 300: 3, 600: 1}


def test_training_columns(tx):
    assert feats.training_features(tx([("u", 1, 0)])).columns == ["seq", *FEATURES]
    assert isinstance(feats.training_features(tx([("u", 1, 0)])).toPandas(), pd.DataFrame)
    assert AMOUNT in FEATURES


def test_many_chunks_are_joined_by_a_shuffle(tx, monkeypatch):
    from tallywarden.operators import ordered

    rows = tx([("a", i % 5, i) for i in range(300)] + [("b", 1, i) for i in range(3)])
    want = collect(running(rows, "user_id", amount="amount", window_us=10_000_000, hot_rows=50), "run_count", "run_sum", "window_count")
    monkeypatch.setattr(ordered, "FEW_CHUNKS", 1)
    assert collect(running(rows, "user_id", amount="amount", window_us=10_000_000, hot_rows=50), "run_count", "run_sum", "window_count") == want


@pytest.mark.parametrize("few_keys", [100_000, 7])
def test_small_hot_rows_make_no_more_tasks(tx, spark, monkeypatch, few_keys):
    """Nearly every user is hot: chunks stay a few for each shuffle partition, and a long list of users stays a table."""
    from tallywarden.operators import ordered

    rng = random.Random(2)
    rows = tx([(f"u{rng.randint(0, 199)}", 1, rng.randint(0, 90)) for _ in range(1500)])
    seen, plain = [], ordered._chunked
    monkeypatch.setattr(ordered, "_chunked", lambda *args: seen.append(args[6]) or plain(*args))
    monkeypatch.setattr(ordered, "FEW_KEYS", few_keys)
    want = collect(trailing_count(rows, "user_id", 20_000_000), "window_count")
    assert collect(trailing_count(rows, "user_id", 20_000_000, hot_rows=3), "window_count") == want
    assert seen == [ordered.CHUNKS_EACH * int(spark.conf.get("spark.sql.shuffle.partitions"))]
    hot = hot_keys(rows, "user_id", 3)
    one = hot.select("user_id", F.length("user_id").alias("n"))
    joined = ordered.with_key(rows, one, "user_id", hot)
    assert joined.count() == 1500 and joined.where("n = length(user_id)").count() == rows.join(hot, "user_id").count()
