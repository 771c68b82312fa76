import pytest
from pyspark.sql import functions as F

from tallywarden.functions import display as D, explain as E
from tallywarden.functions.message import read_scored_messages, scored_messages, transaction_messages
from tallywarden.schemas import AMOUNT, COUNT, FEATURES, MEAN, SCORED_MESSAGE, SINCE, conformance

NAN = float("nan")


@pytest.mark.parametrize(
    "gap, count, amount, mean, reasons",
    [
        (5.0, 1, 10.0, 10.0, [E.TEXT_GAP_VERY_SMALL]),
        (5.001, 1, 10.0, 10.0, [E.TEXT_GAP_SMALL]),
        (30.0, 1, 10.0, 10.0, [E.TEXT_GAP_SMALL]),
        (3600.0, 1, 10.0, 10.0, [E.TEXT_OTHER]),
        (3600.001, 1, 10.0, 10.0, [E.TEXT_GAP_VERY_LONG]),
        (100.0, 2, 10.0, 10.0, [E.TEXT_OTHER]),
        (100.0, 3, 10.0, 10.0, [E.TEXT_COUNT_ELEVATED]),
        (100.0, 5, 10.0, 10.0, [E.TEXT_COUNT_HIGH]),
        (100.0, 1, 20.0, 10.0, [E.TEXT_OTHER]),
        (100.0, 1, 20.1, 10.0, [E.TEXT_DEVIATION_NOTABLE]),
        (100.0, 1, 40.0, 10.0, [E.TEXT_DEVIATION_NOTABLE]),
        (100.0, 1, 40.1, 10.0, [E.TEXT_DEVIATION_LARGE]),
        (100.0, 1, 4999.0, 0.0, [E.TEXT_OTHER]),
        (100.0, 1, 5000.0, 0.0, [E.TEXT_AMOUNT_LARGE]),
        (100.0, 1, 50000.0, 0.0, [E.TEXT_AMOUNT_VERY_LARGE]),
        (100.0, 1, 60000.0, NAN, [E.TEXT_AMOUNT_VERY_LARGE]),
        (NAN, 1, NAN, 10.0, [E.TEXT_OTHER]),
        (None, None, None, None, [E.TEXT_OTHER]),
        (0.0, 6, 100.0, 10.0, [E.TEXT_GAP_VERY_SMALL, E.TEXT_COUNT_HIGH, E.TEXT_DEVIATION_LARGE]),
    ],
)
def test_reasons(spark, gap, count, amount, mean, reasons):
    schema = f"{AMOUNT} double, {MEAN} double, {COUNT} bigint, {SINCE} double, is_anomaly boolean"
    row = spark.createDataFrame([(amount, mean, count, gap, True), (amount, mean, count, gap, False)], schema)
    assert [r.e for r in row.select(E.explain_flagged().alias("e")).collect()] == [reasons, []]


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first().c


@pytest.mark.parametrize(
    "amount, text",
    [(0.0, "₹0.00"), (999.0, "₹999.00"), (1000.5, "₹1,000.50"), (123456.5, "₹1,23,456.50"), (12345678.125, "₹1,23,45,678.125"),
     (-1234.5, "₹-1,234.50"), (99999.9995, "₹1,00,000.00")],
)
def test_rupees(spark, amount, text):
    assert one(spark, D.rupees(F.lit(amount))) == text


def test_tiers(spark):
    def values(f, *scores):
        return [one(spark, f(F.lit(s))) for s in scores]

    assert values(D.severity, 0.91, 0.9, 0.71, 0.7) == ["CRITICAL", "HIGH", "HIGH", "MEDIUM"]
    assert values(D.rate_risk, 15.0, 14.9, 5.0, 4.9) == ["HIGH", "MED", "MED", "LOW"]
    assert values(D.gauge_risk, 0.32, 0.33, 0.66) == ["LOW RISK", "MEDIUM RISK", "HIGH RISK"]
    assert values(D.gauge_position, -1.0, 0.5, 2.0) == [0.0, 0.5, 1.0]
    assert values(D.gauge_angle, 0.0, 1.0) == [-180.0, 0.0]
    assert values(D.score_tier, 0.7, 0.45, 0.44) == ["high", "medium", "low"]
    assert values(lambda c: D.bar_tier(c, F.lit(3)), 0, 3, 2) == ["none", "peak", "other"]
    assert values(D.order_number, 7, 1234) == ["ORD-007", "ORD-1234"]
    assert one(spark, D.fixed(F.lit(0.125), 2)) == "0.13"


def test_iso_text(spark):
    assert one(spark, D.iso_text(F.timestamp_micros(F.lit(1_700_000_000_000_000)))) == "2023-11-14T22:13:20+00:00"
    assert one(spark, D.iso_text(F.timestamp_micros(F.lit(1_700_000_000_000_450)))) == "2023-11-14T22:13:20.000450+00:00"


def test_messages(tx):
    rows = tx([("u", 5, 0), (None, 6, 1)]).withColumns(
        {
            **{f: F.lit(2.0) for f in FEATURES},
            "event": F.lit('{"user_id": "u", "extra": [1, 2]}'),
            "anomaly_score": F.lit(0.7),
            "is_anomaly": F.lit(True),
            "explanation": F.array(F.lit("why")),
            "processed_ts": F.col("ts"),
        }
    )
    sent = scored_messages(rows)
    back = read_scored_messages(sent)
    assert all(ok for *_, ok in conformance(back, SCORED_MESSAGE))
    first, second = back.orderBy("anomaly_row_id").select("*", F.to_json("event").alias("e")).collect()
    assert first.schema_version == 1 and first.features[FEATURES[0]] == 2.0 and first.explanation == ["why"]
    assert first.e == '{"extra":[1,2],"user_id":"u"}' and second.user_id == ""
    assert sorted(transaction_messages(rows).columns) == ["key", "value"]
