"""Sketches that grow by the day, streams that begin at the newest file, and fields of messages and records."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywarden.operators import conform
from tallywarden.operators.sketch import ScoreSketches, rank_error
from tallywarden.sources import transactions


def scores(spark, values, day):
    return spark.createDataFrame([(float(v),) for v in values], "anomaly_score double").withColumn("ts", F.lit(f"2025-01-{day:02d} 10:00:00").cast("timestamp"))


def test_sketches_of_days_merge(spark, work):
    rng = np.random.default_rng(3)
    days = [rng.beta(2, 5, 20_000), rng.beta(5, 2, 500), rng.beta(2, 2, 8000)]
    sketches = ScoreSketches(spark, work, size=1000)
    assert sketches.threshold().first().threshold is None and sketches.threshold().first().scores == 0
    for n, values in enumerate(days):
        sketches.add(scores(spark, values, n + 1).unionByName(scores(spark, [float("nan")], n + 1)), n)
        whole = np.concatenate(days[: n + 1])
        for share in (0.01, 0.3):
            found = sketches.threshold(share).first()
            assert found.scores == len(whole) and abs((whole >= found.threshold).mean() - share) <= rank_error(1000)
    before = sketches.threshold(0.01).first()
    sketches.add(scores(spark, days[2], 3), 2)  # the day again
    assert sketches.threshold(0.01).first().scores == before.scores
    late = sketches.threshold(0.5, since="2025-01-02").first()
    assert late.scores == 8500 and abs((np.concatenate(days[1:]) >= late.threshold).mean() - 0.5) <= rank_error(1000)
    for bad in (lambda: sketches.threshold(0), lambda: ScoreSketches(spark, work, 7)):
        with pytest.raises(ValueError):
            bad()


def test_a_stream_begins_at_the_newest_file(spark, work):
    """Files from before the first start are left out, those that come while the stream is down are read, once."""

    def add(*numbers):
        spark.createDataFrame([(n, "k", "v") for n in numbers], "seq bigint, key string, value string").coalesce(1).write.mode("append").parquet(f"{work}/in")

    def run():
        rows = transactions.read_new_message_files(spark, f"{work}/in", f"{work}/start")
        writer = rows.writeStream.format("parquet").option("checkpointLocation", f"{work}/c")
        writer.trigger(availableNow=True).start(f"{work}/out").awaitTermination()
        return sorted(r.seq for r in spark.read.schema(rows.schema).parquet(f"{work}/out").collect())

    add(1, 2)
    add(3)
    assert run() == []
    add(4)
    add(5)
    assert run() == [4, 5]
    time.sleep(0.1)
    add(6)
    assert run() == [4, 5, 6] and run() == [4, 5, 6]


def test_a_stream_that_begins_with_an_empty_folder_reads_all(spark, work):
    start = transactions._newest_files(spark, f"{work}/none").first()
    assert start.modified is None and start.names == []


def test_fields_of_events(spark):
    texts = ['{"transaction_id": "a", "user_id": "u", "amount": 1, "timestamp": "t", "more": [1]}', '{"amount": "12.5"}', '{"amount": "x", "user_id": 7}', "{}", "[1]", "5", "{broken", None, '{"amount": null, "timestamp": {"a": 1}}']
    rows = spark.createDataFrame([(t,) for t in texts], "value string")
    got = {r.field: (r.rows, r.present, r.wrong) for r in conform.check_events(rows).collect()}
    assert got == {"(message)": (9, 5, 4), "transaction_id": (9, 1, 0), "user_id": (9, 2, 1), "amount": (9, 3, 1), "timestamp": (9, 2, 1)}
    assert conform.check_events(rows.where("false")).agg(F.sum("rows")).first()[0] == 0


def test_fields_of_records(spark):
    rows = spark.createDataFrame([(1, 0.5, True, '{"user_id": "u", "extra": 1}', '{"a": 1, "b": 2.5}'), (2, None, False, "[]", '{"a": "x"}')], "id bigint, s double, f boolean, e string, x string")
    history = rows.selectExpr("id AS anomaly_row_id", "s AS anomaly_score", "f AS is_anomaly", "current_timestamp() AS processed_timestamp", "try_parse_json(e) AS event", "try_parse_json(x) AS features")
    got = {r.field: (r.present, r.wrong) for r in conform.check_records(history).collect()}
    assert got["anomaly_score"] == (1, 0) and got["event"] == (2, 1) and got["event.user_id"] == (1, 0) and got["features"] == (2, 1)
    other = history.withColumn("anomaly_score", F.col("anomaly_score").cast("string")).drop("is_anomaly")
    got = {r.field: (r.present, r.wrong) for r in conform.check_records(other).collect()}
    assert got["anomaly_score"] == (1, 2) and got["is_anomaly"] == (0, 2)
