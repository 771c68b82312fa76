from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tallywarden.operators import history
from tallywarden.operators.history import Store, parse_since, union_live
from tallywarden.schemas import FEATURES, HISTORY, conformance

NOW = datetime(2025, 1, 24, 12, 0, tzinfo=timezone.utc)


@pytest.fixture
def scored(spark):
    """Scored events from (seq, event text, score, flag, processed time)."""

    def build(rows):
        df = spark.createDataFrame(rows, "seq bigint, event string, anomaly_score double, is_anomaly boolean, processed_ts timestamp")
        base = df.select("*", F.col("seq").cast("string").alias("transaction_id"), F.col("processed_ts").alias("ts"))
        return base.withColumns({f: F.lit(1.5) for f in FEATURES})

    return build


def test_round_trip(spark, work, scored):
    store = Store(spark, work)
    event = '{"transaction_id": "k-9", "user_id": "ada", "amount": 80.5, "note": "gift"}'
    store.append(scored([(7, event, 0.875, True, NOW)]))
    record = store.recent(10).select("*", F.to_json("event").alias("e"), F.to_json("features").alias("f")).first()
    assert (record.anomaly_row_id, record.anomaly_score, record.is_anomaly) == (7, 0.875, True)
    assert '"note":"gift"' in record.e and '"amount":80.5' in record.e and FEATURES[0] in record.f
    assert all(ok for *_, ok in conformance(store.recent(10), HISTORY))


def test_absent_store_is_empty(spark, work):
    store = Store(spark, work)
    assert store.recent(5).count() == 0 and store.orphans().count() == 0
    store.init()
    store.init()
    assert store.recent(5).count() == 0


def test_since_is_inclusive(spark, work, scored):
    store = Store(spark, work)
    store.append(scored([(1, "{}", 0.3, False, NOW - timedelta(minutes=90)), (2, "{}", 0.6, True, NOW)]))
    assert [r.anomaly_row_id for r in store.recent(10, NOW - timedelta(minutes=20)).collect()] == [2]
    assert [r.anomaly_row_id for r in store.recent(10, "2025-01-24T10:30:00").collect()] == [2, 1]
    assert [r.anomaly_row_id for r in store.recent(10, "2025-01-24T17:30:00+05:30").collect()] == [2]
    with pytest.raises(ValueError):
        parse_since("yesterday")


def test_limit_order_and_bounds(spark, work, scored):
    store = Store(spark, work)
    store.append(scored([(i, "{}", 0.5, False, NOW + timedelta(seconds=i // 2)) for i in range(10)]))
    assert [r.anomaly_row_id for r in store.recent(3).collect()] == [9, 8, 7]
    assert [r.anomaly_row_id for r in store.recent(5000).collect()] == list(range(9, -1, -1))
    with pytest.raises(ValueError):
        store.recent(0)


def test_large_requests_and_ids_in_two_batches(spark, work, scored):
    store = Store(spark, work)
    store.append(scored([(i, "{}", 0.5, False, NOW + timedelta(seconds=i)) for i in range(1500)]))
    store.append(scored([(3, '{"again": 1}', 0.7, True, NOW + timedelta(days=1))]), 1)
    assert store.recent(1200).count() == 1200
    assert store.recent(5000).count() == 1501
    newest = store.recent(1).select("anomaly_row_id", "anomaly_score", F.to_json("event").alias("e")).collect()
    assert [tuple(r) for r in newest] == [(3, 0.7, '{"again":1}')]


def test_retried_batch_leaves_no_doubles(spark, work, scored):
    store = Store(spark, work)
    store.append(scored([(1, "{}", 0.5, False, NOW)]), 0)
    store.append(scored([(2, "{}", 0.5, False, NOW)]), 1)
    store.append(scored([(2, "{}", 0.5, False, NOW + timedelta(days=1))]), 1)
    assert [store.table(t).count() for t in ("raw_events", "features", "anomalies")] == [2, 2, 2]


def test_orphans_are_found_and_recent_stays_whole(spark, work, scored):
    store = Store(spark, work)
    rows = scored([(i, "{}", 0.5, False, NOW + timedelta(seconds=i)) for i in range(6)])
    store.write(store.frames(rows) | {"raw_events": store.frames(rows.where("seq < 4"))["raw_events"]})
    assert {(r.table_name, r.id) for r in store.orphans().collect()} == {(t, i) for t in ("features", "anomalies") for i in (4, 5)}
    # The two newest have no event: the next two must be found instead.
    assert [r.anomaly_row_id for r in store.recent(2).collect()] == [3, 2]


def test_text_that_is_no_json(spark, work, scored):
    store = Store(spark, work)
    store.append(scored([(1, "oops {", 0.5, False, NOW)]))
    assert store.recent(1).select(F.to_json("event").alias("e")).first().e == '{"raw":"oops {"}'


def test_union_with_live_rows(spark, work, scored):
    store = Store(spark, work)
    store.append(scored([(i, '{"amount": 3}' if i else "{}", 0.5, False, NOW) for i in range(4)]))
    live = scored([(i, "{}", 0.9, True, NOW - timedelta(hours=1)) for i in (10, 11)]).selectExpr(
        "*", "'u' as user_id", "1.0D as amount", "array('r') as explanation"
    )
    both = union_live(store.recent(50), live, rows=4)
    assert [r.seq for r in both.collect()] == [11, 10, 3, 2]
    rows = {r.seq: r for r in union_live(store.recent(50), live, rows=None).collect()}
    assert len(rows) == 6 and rows[0].user_id == "unknown" and rows[0].amount == 0 and rows[1].amount == 3 and rows[0].explanation == []


def test_many_live_rows_are_no_single_task(spark, work, scored):
    """More rows than one task should take are cut through the counts of ranges; the answer is the sorted one."""
    store = Store(spark, work)
    store.append(scored([(i, "{}", 0.5, False, NOW) for i in range(2000)]))
    live = scored([(i, "{}", 0.9, True, NOW - timedelta(seconds=i % 70)) for i in range(2000, 5000)]).selectExpr(
        "*", "'u' as user_id", "1.0D as amount", "array('r') as explanation"
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for rows in (1, 1000, 1001, 3000, 3400, 9000):
            both = union_live(store.recent(3000), live, rows=rows)
            want = [*sorted(range(2000, 5000), key=lambda i: (i % 70, -i)), *range(1999, -1, -1)][:rows]
            assert [r.seq for r in both.collect()] == want
            sizes = [r["count"] for r in both.groupBy(F.spark_partition_id()).count().collect()]
            assert rows <= 1000 or max(sizes) < 2500 and sum(sizes) == len(want)  # four ranges of 5000 rows
        assert history.first_rows(live.where("false"), 2000, F.col("seq")).count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_recent_reads_the_newest_days_only(spark, work, scored, monkeypatch):
    store = Store(spark, work)
    store.append(scored([(i, "{}", 0.5, False, NOW + timedelta(days=i // 10)) for i in range(100)]))
    assert [r.anomaly_row_id for r in store.recent(15).collect()] == list(range(99, 84, -1))
    assert [r.processed_date for r in store.newest_parts(15)] == [(NOW + timedelta(days=n)).date() for n in (9, 8)]
    assert store.part("anomalies", store.newest_parts(15)).count() == 20 and len(store.newest_parts(1000)) == 10
    assert [len(store.newest_parts(50, (NOW + timedelta(days=n)).date())) for n in (0, 7, 20)] == [10, 3, 0]
    assert store.recent(5, NOW + timedelta(days=20)).count() == 0
    monkeypatch.setattr(history, "PARTS", 3)
    assert store.newest_parts(1000) is None and len(store.newest_parts(15)) == 2
    assert [r.anomaly_row_id for r in store.recent(45).collect()] == list(range(99, 54, -1))
    store.append(scored([(i, "{}", 0.5, False, NOW + timedelta(days=i // 10)) for i in range(90, 95)]), 0)  # the batch again, smaller
    assert [r.rows for r in store.newest_parts(5)] == [5]
    store.append(scored([(1, "{}", 0.5, False, NOW)]).where("false"), 0)  # and empty
    assert store.recent(5).count() == 0 and store.table("raw_events").count() == 0


def test_commits_are_merged(spark, work, scored, monkeypatch):
    monkeypatch.setattr(history, "MERGE_EVERY", 3)
    store = Store(spark, work)
    for n in range(9):
        store.append(scored([(n, "{}", 0.1 * n, False, NOW + timedelta(seconds=n))]), n % 7)
    assert sorted(r.anomaly_row_id for r in store.recent(20).collect()) == [2, 3, 4, 5, 6, 7, 8]
    assert len(store._commit_folders()[0]) <= 4 and store.commits().count() == 14  # a day's and an empty row per batch
    assert store.table("features").count() == 7


def test_a_batch_without_commit_is_not_seen(spark, work, scored):
    store = Store(spark, work)
    store.append(scored([(1, "{}", 0.5, False, NOW)]), 0)
    frames = store.frames(scored([(1, "{}", 0.9, True, NOW), (2, "{}", 0.9, True, NOW)]))
    with pytest.raises(Exception):
        store.write(frames | {"anomalies": frames["anomalies"].select(F.raise_error(F.lit("lost")).alias("id"), "processed_date")}, 0)
    assert [store.table(t).count() for t in ("raw_events", "features", "anomalies")] == [1, 1, 1]
    assert store.recent(5).first().anomaly_score == 0.5
    store.write(frames, 0)
    assert [store.table(t).count() for t in ("raw_events", "features", "anomalies")] == [2, 2, 2]
