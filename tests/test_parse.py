from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tallywarden.functions.parse import iso_or, iso_timestamp, json_or_raw, number

TIMES = [
    "2025-01-24T10:30:00", "2025-01-24 10:30:00.123456+05:30", "2025-01-24", "20250124T103000", "20250124", "2025-W04-5",
    "2025W045T1030Z", "2025-W04", "2025-01-24T10", "2025-01-24T10:30", "2025-01-24T10:30:00,5",
    "2025-01-24T10:30:00.123456789Z", "2025-01-24T10:30:00.1+0530", "2025-01-24T10:30:00-08", "2025", "2025-1-4",
    " 2025-01-24 ", "10:30", "bad", "2025-02-30", "2020-W53-1", "2025-W53-1", "2025-01-24T24:00:00", "2025-01-24T10:61:00",
    "None", "", "2025-01-24T103000.25Z", "2025-01-24x10:30:00", "2025-13-01T00:00:00Z", "1969-12-31T23:59:59.5Z",
    "2025-0124T10:30:00", "2025-01-24T10:3005", "2025-01-24T10:30:00+05:30:15", "20250124T10:30:00", "2025-01-24T1030", "2025-W045",
    "2025W04-5", "2025-01-24T10:30:00+053015", "2025-01-24T1030:00", "2025-01-24T10:30:00+05:3015", "2025-01-24T10Z",
]


def expected(text):
    try:
        moment = datetime.fromisoformat(text)
    except ValueError:
        return None
    moment = moment.replace(tzinfo=timezone.utc) if moment.tzinfo is None else moment
    return round((moment - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds() * 1_000_000)


def test_times(spark):
    df = spark.createDataFrame([(t,) for t in TIMES], "t string")
    got = {r.t: r.us for r in df.select("t", F.unix_micros(iso_timestamp(F.col("t"))).alias("us")).collect()}
    assert got == {t: expected(t) for t in TIMES}


def test_fallback_time(spark):
    df = spark.createDataFrame([("bad",), (None,), ("2025-01-01",)], "t string")
    got = [r.us for r in df.select(F.unix_seconds(iso_or(F.col("t"), F.timestamp_seconds(F.lit(5)))).alias("us")).collect()]
    assert got == [5, 5, 1735689600]


@pytest.mark.parametrize(
    "text, value",
    [("12", 12), (" 12.5 ", 12.5), ("1_000", 1000), ("1e3", 1000), (".5", 0.5), ("-3.", -3), ("12d", None), ("nan", None),
     ("inf", None), ("1e999", None), ("", None), ("1__0", None), ("abc", None), (None, None)],
)
def test_numbers(spark, text, value):
    assert spark.createDataFrame([(text,)], "t string").select(number(F.col("t")).alias("n")).first().n == value


def test_json_or_raw(spark):
    df = spark.createDataFrame([('{"a":1}',), ("{a",), (None,)], "t string")
    assert [r.j for r in df.select(F.to_json(json_or_raw(F.col("t"))).alias("j")).collect()] == ['{"a":1}', '{"raw":"{a"}', None]
