"""Streams whose state and folders stay bounded, scoring without Python, and the rolling rate over all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywarden.operators import forest as forests, kpis
from tallywarden.operators.features import features
from tallywarden.plans.catalog import fixed_forest
from tallywarden.sources import transactions
from tallywarden.streaming import alerts as keyed, jobs
from tests.test_streaming import message

FIELDS = "seq bigint, t bigint, p bigint, user_id string"


def scored(spark, rows):
    """Anomalies from (seq, event second or None, processing second, user)."""
    df = spark.createDataFrame(rows, FIELDS)
    return df.selectExpr("seq", "user_id", "t * 1000000 AS us", "timestamp_seconds(t) AS ts", "0.9D AS anomaly_score", "seq % 2 = 0 AS is_anomaly", "timestamp_seconds(p) AS processed_ts")


def stage(spark, work, rows):
    df = scored(spark, rows)
    df.coalesce(1).write.mode("append").parquet(f"{work}/scored")
    return spark.readStream.schema(df.schema).parquet(f"{work}/scored")


def minute_rows(spark, path):
    return {int(r.minute.timestamp()) // 60: (r.total_events, r.anomalies) for r in jobs.minutes_so_far(spark, path).collect()}


def test_minutes_close_and_nothing_is_lost(spark, work):
    """Late rows of closed minutes count, a far-future event closes nothing, folders and open minutes stay few."""
    rng = np.random.default_rng(1)
    batches = [[(100 * n + k, 600 * n + int(rng.integers(0, 700)), 600 * n + 800, "u") for k in range(20)] for n in range(12)]
    batches[3] += [(9001, 5, 3000, "u"), (9002, 10**9, 3000, "u"), (9003, None, 3000, "u")]
    for n, batch in enumerate(batches):
        rows = stage(spark, work, batch)
        jobs.minute_stream(rows, f"{work}/m", f"{work}/c", delay_seconds=300, merge_every=4).awaitTermination()
        seen = [r for b in batches[: n + 1] for r in b if r[1] is not None]
        want = {}
        for seq, t, _, _ in seen:
            total, hits = want.get(t // 60, (0, 0))
            want[t // 60] = (total + 1, hits + (seq % 2 == 0))
        assert minute_rows(spark, f"{work}/m") == want
        assert len(jobs._folders(spark, f"{work}/m/open")) <= 3 and len(jobs._folders(spark, f"{work}/m/closed")) <= 11
        open_now = spark.read.parquet(f"{work}/m/open/v{n}")
        assert open_now.where(F.col("minute") < F.timestamp_seconds(F.lit(10**8))).count() <= 13  # minutes of the last batch and the delay
    totals = jobs.totals_so_far(spark, f"{work}/m").first()
    assert totals.total_events == sum(len(b) for b in batches) - 1


def test_a_batch_of_minutes_can_be_tried_again(spark, work):
    for n in range(3):
        rows = stage(spark, work, [(10 * n + k, 400 * n + 60 * k, 5000, "u") for k in range(5)])
        jobs.minute_stream(rows, f"{work}/m", f"{work}/c", delay_seconds=60, merge_every=1).awaitTermination()
    want = minute_rows(spark, f"{work}/m")
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{work}/c/commits/2")
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    files.delete(place, False)
    files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{work}/c/commits/.2.crc"), False)
    jobs.minute_stream(rows, f"{work}/m", f"{work}/c", delay_seconds=60, merge_every=1).awaitTermination()
    assert minute_rows(spark, f"{work}/m") == want and sum(n for n, _ in want.values()) == 15


def keyed_alerts(spark, work, batches, **options):
    """Alerts (seq, count) of batches, each in a run of its own, and rows of state after each."""
    sizes = []
    for rows in batches:
        stream = stage(spark, work, rows).withColumn("is_anomaly", F.lit(True))
        query = keyed.write_keyed_alerts(keyed.keyed_rate_alerts(stream, 2, 60, **options), f"{work}/alerts", f"{work}/c")
        query.awaitTermination()
        sizes.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    return sorted((r.seq, r.window_count) for r in spark.read.schema(keyed._OUT).parquet(f"{work}/alerts").collect()), sizes


def test_keyed_alerts_over_restarts(spark, work):
    """Windows go on over restarts, a wrong clock ages nobody, ties and late anomalies count, silent users leave."""
    batches = [
        [(0, 1000, 1001, "a"), (1, 1010, 1011, "a"), (50, 1000, 1001, "b")],
        [(2, 1015, 1016, "a"), (9, 10**9, 1016, "a")],
        [(3, 1020, 1021, "a"), (4, 1005, 1022, "a"), (5, 1020, 1023, "a"), (51, 1061, 1062, "b"), (52, 1061, 1062, "b")],
        [(6, 9000, 9001, "c")],
        [(7, 9010, 9011, "c")],
        [(8, 9012, 9013, "a"), (10, 9013, 9014, "a"), (11, 9014, 9015, "a")],
    ]
    got, sizes = keyed_alerts(spark, work, batches)
    assert got == [(2, 3), (3, 5), (5, 6), (11, 3)] or got == [(2, 3), (3, 5), (4, 2), (5, 6), (11, 3)]
    assert sizes[4] < sizes[2]  # a and b are gone when the watermark has passed them


def test_keyed_counts_match_a_plain_count():
    rng = np.random.default_rng(2)
    rows = [(int(t), n) for n, t in enumerate(rng.integers(0, 60, 90))]
    old = np.zeros((0, 2), np.int64)
    for a, b in ((0, 30), (30, 31), (31, 90)):
        own = np.array(sorted(rows[a:b]))
        counts, old = keyed.counted(old, own, 10)
        known = sorted(rows[:b])
        for (t, n), c in zip(own.tolist(), counts):
            assert c == sum((t - 10 <= x) and (x, m) <= (t, n) for x, m in known)


def distinct(spark, work, parts, delay):
    """The kept messages' numbers, and rows of state after each run."""
    sizes = []
    for part in parts:
        spark.createDataFrame(part, "seq bigint, key string, value string").coalesce(1).write.mode("append").parquet(f"{work}/in")
        decoded = transactions.transactions(transactions.read_message_files(spark, f"{work}/in"))
        query = transactions.without_repeats(decoded, delay).writeStream.format("parquet").option("checkpointLocation", f"{work}/c").trigger(availableNow=True).start(f"{work}/out")
        query.awaitTermination()
        sizes.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    out = spark.read.schema(decoded.schema).parquet(f"{work}/out")
    assert out.columns == decoded.columns
    return sorted(r.seq for r in out.collect()), sizes


def test_repeats_within_the_delay_go(spark, work):
    """Repeats in one batch and over restarts go, rejected ones and very late ones stay."""
    first = [message(0, "a", 1, 1000), message(1, "a", 1, 1), (2, "a", message(0, "a", 1, 1000)[2]), (3, "x", "{broken"), (4, "x", "{broken")]
    later = [(5, "a", message(1, "a", 1, 1)[2]), message(6, "a", 1, 0)]
    seen, _ = distinct(spark, work, [first, later], 3600)
    assert [s for s in seen if s not in (0, 2)] == [1, 3, 4, 6] and len(seen) == 5  # one of 0 and 2


def test_old_ids_are_forgotten(spark, work):
    parts = [[message(n, "a", 1, n) for n in range(20)], [message(50, "a", 1, 1)], [message(51, "a", 1, 1)], [(52, "a", message(3, "a", 1, 3)[2])]]
    seen, sizes = distinct(spark, work, parts, 0)
    assert sizes[-1] <= 3 and 52 in seen  # its id came too long ago


def test_native_scores_equal_scores(tx, spark):
    rows = features(tx([(f"u{i % 5}", 10 * (i % 13) + 1, 7 * i) for i in range(200)]))
    odd = rows.limit(3).withColumn("transaction_amount", F.lit(None).cast("double")).withColumn("seq", F.col("seq") + 1000)
    odd = odd.unionByName(rows.limit(2).withColumn("transaction_amount", F.lit(float("nan"))).withColumn("seq", F.col("seq") + 2000))
    both = rows.unionByName(odd)
    for forest in (fixed_forest(), fixed_forest(3, 1), fixed_forest(4, 100)):
        want = {r.seq: r.anomaly_score for r in forests.score(both, forest).collect()}
        native = forests.score_natively(both, forest)
        got = {r.seq: r.anomaly_score for r in native.collect()}
        assert native.columns == [*both.columns, "anomaly_score"] and got.keys() == want.keys()
        assert all(got[k] is None if want[k] is None else got[k] == pytest.approx(want[k], abs=1e-14) for k in want)
    plan = native.where("anomaly_score > 0.5")._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan


@pytest.mark.parametrize("parts", [1, 4, 64])
def test_rolling_rate_over_all_rows(spark, parts):
    """Ranges of a few rows, and empty ones, need rows from several ranges before them."""
    rng = np.random.default_rng(parts)
    rows = [(i, int(t), bool(rng.random() < 0.4)) for i, t in enumerate(rng.integers(0, 40, 97))]
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "seq bigint, us bigint, is_anomaly boolean")
        got = {r.seq: (r.position, r.rate) for r in kpis.rolling_rate_all(df).collect()}
        assert kpis.rolling_rate_all(df.where("false")).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    flags = [f for _, _, f in sorted(rows, key=lambda r: (r[1], r[0]))]
    for n, (seq, _, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[0]))):
        part = flags[max(0, n - 9) : n + 1]
        assert got[seq] == (n, pytest.approx(100 * sum(part) / len(part)))
