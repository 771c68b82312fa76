import json

import numpy as np
import pytest

from tallywarden.operators.features import features
from tallywarden.operators.history import Store
from tallywarden.operators.validate import valid_rows
from tallywarden.plans.catalog import fixed_forest
from tallywarden.schemas import COUNT, FEATURES, MEAN, SINCE
from tallywarden.sources import transactions
from tallywarden.streaming import jobs
from tallywarden.streaming.features import advance, features_stream


def message(seq, user, amount, second, **extra):
    stamp = f"2025-01-24T10:{second // 60:02d}:{second % 60:02d}"
    return (seq, user, json.dumps({"transaction_id": str(seq), "user_id": user, "amount": amount, "timestamp": stamp, **extra}))


@pytest.fixture
def feed(spark, work):
    """Adds a file of messages to the stream's folder."""

    def add(rows):
        spark.createDataFrame(rows, "seq bigint, key string, value string").coalesce(1).write.mode("append").parquet(f"{work}/in")

    return add


def run_features(spark, work, window=60):
    decoded = transactions.transactions(transactions.read_message_files(spark, f"{work}/in"))
    out = features_stream(valid_rows(decoded), window, buckets=4)
    writer = out.writeStream.format("parquet").option("checkpointLocation", f"{work}/checkpoint")
    writer.trigger(availableNow=True).start(f"{work}/out").awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{work}/out")


def test_stream_equals_batch_over_restarts(spark, work, feed):
    rows = [message(i, f"u{i % 3}", 10 + i % 7, i * 4) for i in range(40)]
    for part in (rows[:15], rows[15:16], rows[16:]):
        feed(part)
        got = run_features(spark, work)
    raw = spark.createDataFrame(rows, "seq bigint, key string, value string")
    want = features(valid_rows(transactions.transactions(raw)))
    columns = ["seq", "user_id", "us", *FEATURES]
    assert [tuple(r) for r in got.select(columns).orderBy("seq").collect()] == [tuple(r) for r in want.select(columns).orderBy("seq").collect()]
    assert got.where("is_late").count() == 0


def test_late_row_follows_arrival_order(spark, work, feed):
    feed([message(0, "u", 10, 100), message(1, "u", 20, 110)])
    run_features(spark, work)
    feed([message(2, "u", 30, 40)])
    run_features(spark, work)
    feed([message(3, "u", 40, 165)])
    rows = {r.seq: r for r in run_features(spark, work).collect()}
    # The late row sees all that arrived, has a negative gap, and leaves after the rows before it.
    assert (rows[2][MEAN], rows[2][COUNT], rows[2][SINCE], rows[2].is_late) == (20.0, 3, -70.0, True)
    assert (rows[3][COUNT], rows[3][SINCE], rows[3].is_late) == (3, 125.0, False)


def test_advance_matches_a_plain_queue():
    rng = np.random.default_rng(0)
    arrivals = np.concatenate([np.sort(rng.integers(0, 300, 20)) for _ in range(6)])
    queue, want = [], []
    for t in arrivals:
        queue.append(t)
        while queue[0] < t - 50:
            queue.pop(0)
        want.append(len(queue))
    state, got = None, []
    for part in np.split(arrivals, 6):
        _, counts, _, _, state = advance(state, part, np.ones(len(part)), 50)
        got += counts.tolist()
    assert got == want


def test_end_to_end(spark, work, feed):
    """Scored table, history, messages, alerts, figures and live rows from one stream."""
    store = Store(spark, f"{work}/store")
    for part in range(2):
        good = [message(10 * part + i, "u", 500 if i == 7 else 10, 30 * part + i, extra="x") for i in range(8)]
        feed([*good, (10 * part + 8, "u", "{broken")])
        decoded = transactions.transactions(transactions.read_message_files(spark, f"{work}/in"))
        scored = jobs.scored_stream(decoded, fixed_forest(), 0.5, fill_missing=True, buckets=4)
        jobs.write_scored(scored, f"{work}/scored", f"{work}/c-scored").awaitTermination()

        def rows():
            return jobs.follow(spark, f"{work}/scored")

        for query in (
            jobs.persist(rows(), store, f"{work}/c-store"),
            jobs.publish_files(rows(), f"{work}/sent", f"{work}/c-sent"),
            jobs.score_alert_stream(rows(), f"{work}/score-alerts", f"{work}/c-score", 0.5),
            jobs.rate_alert_stream(rows(), f"{work}/global", f"{work}/c-global", 3, 60, "global"),
            jobs.rate_alert_stream(rows(), f"{work}/user", f"{work}/c-user", 3, 60, "user"),
            jobs.minute_stream(rows(), f"{work}/minutes", f"{work}/c-minutes"),
            jobs.live_view(rows(), f"{work}/live", f"{work}/c-live", rows=5),
        ):
            query.awaitTermination()
    table = spark.read.schema(jobs.SCORED).parquet(f"{work}/scored")
    assert table.count() == 18 and store.recent(100).count() == 18
    assert store.orphans().count() == 0
    sent = [json.loads(r.value) for r in spark.read.text(f"{work}/sent").collect()]
    assert len(sent) == 18 and sum(m["event"] is not None and m["event"].get("extra") == "x" for m in sent if m.get("event")) == 16
    flagged = {r.seq for r in table.where("is_anomaly").collect()}
    assert {r.seq for r in spark.read.parquet(f"{work}/score-alerts").collect()} == flagged
    known = table.where("is_anomaly and us is not null").orderBy("us", "seq").collect()
    times = [r.us for r in known]
    want = {r.seq for i, r in enumerate(known) if sum(t >= r.us - 60_000_000 for t in times[: i + 1]) > 3}
    for scope in ("global", "user"):
        got = {r.seq for r in jobs.rate_alerts_so_far(spark, f"{work}/{scope}").collect()}
        assert {seq for seq in got if seq in {r.seq for r in known}} == want
    totals = jobs.totals_so_far(spark, f"{work}/minutes").first()
    assert totals.total_events == 16 and totals.anomalies == len(known)
    assert {r.seq for r in jobs.live_rows_now(spark, f"{work}/live").collect()} == {13, 14, 15, 16, 17}


def test_nothing_yet(spark, work):
    assert jobs.rate_alerts_so_far(spark, work).count() == 0
    assert jobs.minutes_so_far(spark, work).count() == 0
    assert jobs.live_rows_now(spark, work).count() == 0


def test_kafka_options_and_ids(spark):
    assert transactions.kafka_source_options("h:1", max_per_batch=5) == {
        "kafka.bootstrap.servers": "h:1", "subscribe": "transactions", "startingOffsets": "latest", "maxOffsetsPerTrigger": "5",
    }
    assert transactions.kafka_sink_options("h:1")["kafka.acks"] == "all"
    rows = spark.createDataFrame([(0, 3, b"k", b"v"), (1, 3, None, b"v"), (0, 4, b"k", b"v")], "partition int, offset bigint, key binary, value binary")
    got = transactions.kafka_messages(rows).collect()
    assert len({r.seq for r in got}) == 3 and got[0].value == "v" and got[1].key is None
    far = spark.createDataFrame([(4096, 3, b"k", b"v")], rows.schema)
    with pytest.raises(Exception, match="partition 4096"):
        transactions.kafka_messages(far).collect()


def test_csv(spark, work):
    df = spark.createDataFrame([(1, 2.5)], "a bigint, b double")
    transactions.write_csv(df, work)
    assert transactions.read_csv(spark, [f"{work}-none", work], df.schema).collect() == df.collect()
    with pytest.raises(FileNotFoundError):
        transactions.read_csv(spark, f"{work}-none", df.schema)
    transactions.write_csv(df.where("false"), f"{work}-empty")
    with pytest.raises(ValueError):
        transactions.read_csv(spark, f"{work}-empty", df.schema)


def test_replay_takes_the_count_as_given(tx):
    rows = tx([("u", 1, i) for i in range(60)])
    assert [transactions.replay(rows, n).count() for n in (7, 55, 500)] == [7, 55, 60]
    with pytest.raises(ValueError):
        transactions.replay(rows, 0)


def alerts_of(spark, work, batches, **options):
    """Stream batches of (seq, event second or None, processing second) as anomalies of one user; alerts as (seq, count)."""
    for n, rows in enumerate(batches):
        df = spark.createDataFrame([(s, t, p) for s, t, p in rows], "seq bigint, t bigint, p bigint")
        df = df.selectExpr("seq", "'u' AS user_id", "t * 1000000 AS us", "timestamp_seconds(t) AS ts", "0.9D AS anomaly_score", "true AS is_anomaly", "timestamp_seconds(p) AS processed_ts")
        df.coalesce(1).write.mode("append").parquet(f"{work}/scored")
        rows = spark.readStream.schema(df.schema).parquet(f"{work}/scored")
        jobs.rate_alert_stream(rows, f"{work}/alerts", f"{work}/c", 2, 60, "user", **options).awaitTermination()
    return sorted((r.seq, r.window_count) for r in jobs.rate_alerts_so_far(spark, f"{work}/alerts").collect())


def test_alerts_survive_a_far_future_event(spark, work):
    plain = [[(0, 1000, 1001), (1, 1010, 1011)], [(2, 1015, 1016)], [(3, 1020, 1021), (4, 1030, 1031)]]
    want = [(2, 3), (3, 4), (4, 5)]
    assert alerts_of(spark, f"{work}/plain", plain) == want
    odd = [[*plain[0], (9, 10**9, 1012)], *plain[1:]]
    assert alerts_of(spark, f"{work}/odd", odd) == want


def test_late_and_untimed_anomalies_find_their_peers(spark, work):
    batches = [[(0, 1000, 1001), (1, 1010, 1011)], [(2, 1300, 1301)], [(3, 1020, 1302), (4, None, 1305)]]
    assert alerts_of(spark, f"{work}/a", batches) == [(3, 3)]
    assert alerts_of(spark, f"{work}/b", batches, lateness_seconds=0) == []  # the peers are gone by then
