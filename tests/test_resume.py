import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywarden.operators.features import features, user_profile
from tallywarden.operators.resume import FeatureState
from tallywarden.plans.catalog import fixed_forest, resumed_features, resumed_hot_users
from tallywarden.schemas import AMOUNT, COUNT, FEATURES, MEAN, SINCE
from tallywarden.sources import transactions
from tallywarden.streaming import jobs
from tallywarden.streaming.features import advance


def plain(df):
    return sorted(tuple(r) for r in df.select("seq", "user_id", "us", *FEATURES).collect())


def rows_of(seed, count, users=7):
    """Whole amounts, so that sums are exact in any order; ties in time; one user with a third of all rows."""
    rng = np.random.default_rng(seed)
    seconds = np.sort(rng.integers(0, 900, count))
    return [("hot" if rng.random() < 0.34 else f"u{rng.integers(users)}", int(rng.integers(1, 500)), int(t)) for t in seconds]


@pytest.mark.parametrize("hot_rows,merge_every", [(4_000_000, 16), (20, 2)])
def test_parts_equal_one_pass(tx, spark, work, hot_rows, merge_every):
    """Versions one after the other give the features of all rows at once, also with hot users cut into ranges."""
    whole = tx(rows_of(3, 400)).drop("ts")
    state = FeatureState(spark, work, hot_rows=hot_rows, merge_every=merge_every)
    got = []
    for n, (a, b) in enumerate([(0, 150), (150, 151), (151, 320), (320, 400)]):
        part = state.advance(whole.where(f"seq >= {a} AND seq < {b}"), n)
        assert part.where("is_late").count() == 0 and part.columns == [*whole.columns, *FEATURES, "is_late"]
        got += plain(part)
    assert sorted(got) == plain(features(whole))
    want = user_profile(tx(rows_of(3, 400))).select("user_id", "tx_count", "sum_amount", "mean_amount", "last_ts")
    assert sorted(map(tuple, state.profile().collect())) == sorted(map(tuple, want.collect()))
    assert state.versions() == ((0, 3) if merge_every == 16 else (2, 3))


def test_late_rows_follow_arrival_order(tx, spark, work):
    """The same answers as a queue per user that takes rows as they arrive."""
    rng = np.random.default_rng(5)
    parts = [np.sort(rng.integers(0, 400, 25)) for _ in range(5)]
    state, queue = FeatureState(spark, work, window_seconds=50, merge_every=2), None
    seq = 0
    for n, part in enumerate(parts):
        rows = tx([("u", 10 * n + k, int(t)) for k, t in enumerate(part)], start_us=0).selectExpr(f"seq + {seq} AS seq", "user_id", "amount", "us")
        got = state.advance(rows, n).orderBy("us", "seq").collect()
        means, counts, gaps, late, queue = advance(queue, part.astype(np.int64) * 1_000_000, np.array([float(10 * n + k) for k in range(25)]), 50_000_000)
        assert [r[COUNT] for r in got] == counts.tolist() and [r[SINCE] for r in got] == gaps.tolist()
        assert [r[MEAN] for r in got] == pytest.approx(means.tolist(), rel=1e-13) and [r.is_late for r in got] == late.tolist()
        seq += 25


def test_a_version_can_be_written_again(tx, spark, work):
    whole = tx(rows_of(8, 200)).drop("ts")
    state = FeatureState(spark, work, merge_every=1)
    for n in range(4):
        part = whole.where(f"seq >= {50 * n} AND seq < {50 * n + 50}")
        first = plain(state.advance(part, n))
        assert plain(state.advance(part, n)) == first
    assert sorted(map(tuple, state.profile().collect())) == sorted(map(tuple, user_profile(whole.selectExpr("*", "timestamp_micros(us) AS ts")).collect()))


def test_idle_users_leave_and_start_anew(tx, spark, work):
    state = FeatureState(spark, work, ttl_seconds=600, merge_every=1)
    state.advance(tx([("old", 10, 0), ("old", 10, 5), ("new", 10, 0)]), 0)
    state.advance(tx([("new", 20, 300)]), 1)
    assert state.profile().count() == 2  # not idle for long enough
    state.advance(tx([("new", 30, 700)]), 2)
    assert [r.user_id for r in state.profile().collect()] == ["new"]
    back = {r.user_id: r for r in state.advance(tx([("old", 50, 710), ("new", 40, 710)]), 3).collect()}
    assert (back["old"][MEAN], back["old"][COUNT], back["old"][SINCE]) == (50.0, 1, 0.0)
    assert (back["new"][MEAN], back["new"][SINCE]) == (25.0, 10.0)
    with pytest.raises(ValueError):
        FeatureState(spark, work, window_seconds=60, ttl_seconds=59)


def test_only_its_own_rows_are_read(tx, spark, work):
    """A later version opens the versions since the last merge, and older ones are deleted."""
    state = FeatureState(spark, work, merge_every=3)
    for n in range(9):
        state.advance(tx([(f"u{n % 2}", 10, 100 * n), (f"v{n}", 1, 100 * n)]), n)
        base, newest = state.versions()
        assert newest == n and n - base < 3
    left = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{work}/users")
    names = {f.getPath().getName() for f in left.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(left)}
    assert names == {f"v{n}" for n in range(3, 9)}
    assert state.profile().count() == 11 and state.profile().where("tx_count = 5").count() == 1


@pytest.mark.parametrize("query", [resumed_features, resumed_hot_users])
def test_rows_of_all_parts_stay(tx, spark, work, query):
    """The queries return the rows of every part, long after the state has let go of the first ones."""
    rows = tx([(str(n % 3), 10 + n % 7, n * 9 * 86400) for n in range(4)])  # a part each
    events = rows.selectExpr("seq AS event_id", "ts", "cast(user_id AS bigint) AS user_id", "'view' AS event_type", "amount AS value", "cast(null AS string) AS props")
    events.write.parquet(f"{work}/events.parquet")
    got = query(spark, work).collect()
    want = [(r.seq, r.user_id, r[COUNT], r[SINCE]) for r in features(rows).orderBy("seq").collect()]
    assert sorted((r.seq, r.user_id, r.recent_count, r.secs_since_last) for r in got) == want
    events.where("false").write.parquet(f"{work}/none/events.parquet")
    assert query(spark, f"{work}/none").count() == 0


def test_nothing_yet(tx, spark, work):
    state = FeatureState(spark, work)
    assert state.versions() is None and state.profile().count() == 0
    none = tx([("u", 1, 0)]).where("false")
    assert state.advance(none, 0).count() == 0 and state.profile().count() == 0


def test_hot_user_of_a_batch_is_many_tasks(tx, spark, work):
    """With a third of a batch's rows under one user no task holds more than its share."""
    whole = tx(rows_of(4, 3000)).drop("ts")
    state = FeatureState(spark, work, hot_rows=100)
    state.advance(whole.where("seq < 10"), 0)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = state.advance(whole.where("seq >= 10"), 1)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in got.where("user_id = 'hot'").groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) > 900 and len(sizes) == 4 and max(sizes) < 0.7 * sum(sizes)  # all four tasks of this session
    assert plain(got) == [r for r in plain(features(whole)) if r[0] >= 10]


def message(seq, user, amount, second):
    return (seq, user, json.dumps({"transaction_id": str(seq), "user_id": user, "amount": amount, "timestamp": f"2025-01-24T10:{second // 60:02d}:{second % 60:02d}"}))


def test_scored_stream_over_restarts(spark, work):
    """Batches of a stream, one of them tried again, give the scores of one pass; followers see each row once."""
    state = FeatureState(spark, f"{work}/state", merge_every=2)
    rows = [message(i, "hot" if i % 3 == 0 else f"u{i % 5}", 10 + i % 7, i * 4) for i in range(60)]
    rows[30] = (30, "x", "{broken")

    def run(checkpoint):
        decoded = transactions.transactions(transactions.read_message_files(spark, f"{work}/in"))
        jobs.score_batches(decoded, fixed_forest(), state, f"{work}/scored", checkpoint, 0.5, fill_missing=True).awaitTermination()

    for part in (rows[:20], rows[20:21], rows[21:]):
        spark.createDataFrame(part, "seq bigint, key string, value string").coalesce(1).write.mode("append").parquet(f"{work}/in")
        run(f"{work}/c")
    table = spark.read.schema(jobs.SCORED).parquet(jobs.scored_folders(f"{work}/scored"))
    first = sorted(map(str, table.collect()))
    followed = jobs.follow(spark, jobs.scored_folders(f"{work}/scored"))
    followed.writeStream.format("parquet").option("checkpointLocation", f"{work}/c2").trigger(availableNow=True).start(f"{work}/out").awaitTermination()
    assert spark.read.parquet(f"{work}/out").count() == 60
    raw = spark.createDataFrame(rows, "seq bigint, key string, value string")
    good = transactions.transactions(raw).where("reject_reason IS NULL")
    assert plain(table.where("seq <> 30")) == plain(features(good))
    batch = spark.createDataFrame(rows[21:], raw.schema)
    state.advance(transactions.transactions(batch).where("reject_reason IS NULL"), 2)  # the last batch again
    assert sorted(map(str, spark.read.schema(jobs.SCORED).parquet(jobs.scored_folders(f"{work}/scored")).collect())) == first
    assert state.profile().agg({"tx_count": "sum"}).first()[0] == 59
    assert table.where(f"seq = 30 AND {AMOUNT} = 0").count() == 1
