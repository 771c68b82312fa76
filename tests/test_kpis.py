import pytest
from pyspark.sql import functions as F

from tallywarden.operators import kpis
from tallywarden.plans.dashboard import dashboard


@pytest.fixture
def scored(tx):
    rows = tx([("u", 1, i * 20) for i in range(120)])
    flags = {"is_anomaly": F.col("seq") % 4 == 0, "anomaly_score": F.col("seq") / 120, "explanation": F.array(F.lit("a"), F.lit("b"))}
    return rows.withColumns(flags)


def test_totals(scored):
    r = kpis.totals(scored).first()
    assert (r.total_events, r.anomalies, r.anomaly_rate, r.rate_text_1, r.rate_text_2, r.risk) == (120, 30, 25.0, "25.0", "25.00", "HIGH")


def test_empty_table(scored):
    nothing = scored.where("false")
    r = kpis.totals(nothing).first()
    assert (r.total_events, r.anomalies, r.anomaly_rate, r.risk) == (0, 0, 0.0, "LOW")
    newest = kpis.latest_score(nothing).first()
    assert (newest.latest_score, newest.gauge_risk) == (0.0, "LOW RISK")
    assert kpis.recent_minutes(nothing).count() == 0 and kpis.live_buffer(nothing).count() == 0


def test_series(scored):
    minutes = kpis.recent_minutes(scored).orderBy("minute").collect()
    assert len(minutes) == 15 and {m.peak for m in minutes} == {max(m.anomalies for m in minutes)}
    buffer = kpis.live_buffer(scored).orderBy("position").collect()
    assert [r.seq for r in buffer] == list(range(70, 120)) and [r.position for r in buffer] == list(range(50))
    rates = kpis.rolling_rate(scored).orderBy("position").collect()
    flags = [i % 4 == 0 for i in range(70, 120)]
    assert [r.rate for r in rates] == pytest.approx([100 * sum(flags[max(0, i - 9) : i + 1]) / min(i + 1, 10) for i in range(50)])
    spark_rows = kpis.sparkline(scored).orderBy("idx").collect()
    assert [(r.seq, r.idx) for r in spark_rows] == [(100 + i, 1 + i) for i in range(20)]


def test_lists(scored):
    feed = kpis.anomaly_feed(scored).collect()
    assert sorted((r.seq for r in feed), reverse=True) == list(range(116, 79, -4))
    assert {r.reasons for r in feed} == {"a; b"}
    table = {r.seq: r for r in kpis.transaction_table(scored).collect()}
    assert table[119].order_id == "ORD-001" and table[70].order_id == "ORD-050" and table[116].status == "ANOMALY"
    assert [r.seq for r in kpis.anomaly_samples(scored).collect()] == [0, 4, 8, 12, 16]
    assert kpis.anomaly_fraction(scored).first().fraction == 0.25
    assert kpis.latest_score(scored).first().score_text == "0.992"


def test_dashboard(scored):
    assert {name: df.count() for name, df in dashboard(scored).items()} == {
        "totals": 1, "minutes": 15, "latest": 1, "trend": 50, "rate": 50, "sparkline": 20, "feed": 10, "table": 50,
    }
