import pytest
from pyspark.sql import functions as F

from tallywarden.operators import alerts


@pytest.fixture
def scored(tx):
    def build(rows, score=10.0, flag=True):
        return tx(rows).withColumn("anomaly_score", F.lit(score)).withColumn("is_anomaly", F.lit(flag))

    return build


def test_score_alert_without_flag(scored):
    rows = scored([("u", 1, 0)], 5.1, False)
    assert alerts.score_alerts(rows, 5.0).count() == 1
    assert alerts.score_alerts(rows, 5.1).count() == 1
    assert alerts.score_alerts(rows, 5.0, "below").count() == 0
    assert alerts.score_alerts(rows, None).count() == 0
    assert alerts.score_alerts(scored([("u", 1, 0)], float("nan"), True), 0.0).count() == 0


@pytest.mark.parametrize("scope", ["global", "user"])
def test_third_anomaly_raises(scored, scope):
    raised = alerts.rate_alerts(scored([("bob", 1, 0), ("bob", 1, 10), ("bob", 1, 20)]), 2, 60, scope).collect()
    assert [(r.seq, r.window_count, r.alert_key) for r in raised] == [(2, 3, "global" if scope == "global" else "bob")]


@pytest.mark.parametrize("scope", ["global", "user"])
def test_old_anomalies_leave_the_window(scored, scope):
    assert alerts.rate_alerts(scored([("u", 1, 0), ("u", 1, 20), ("u", 1, 40)]), 2, 30, scope).count() == 0


def test_only_flagged_events_count(scored):
    assert alerts.rate_alerts(scored([("u", 1, i) for i in range(9)], flag=False), 2, 60).count() == 0


def test_unknown_user_is_a_key(scored):
    raised = alerts.rate_alerts(scored([(None, 1, 0), (None, 1, 1), ("a", 1, 2)]), 1, 60, "user").collect()
    assert [(r.alert_key, r.seq) for r in raised] == [(alerts.UNKNOWN_USER, 1)]


def test_hot_user_counts_are_whole(scored):
    rows = scored([("hot", 1, i % 7) for i in range(200)] + [("cold", 1, 3)] * 4)
    plain = {(r.seq, r.window_count) for r in alerts.rate_counts(rows, 3, "user").collect()}
    split = {(r.seq, r.window_count) for r in alerts.rate_counts(rows, 3, "user", hot_rows=10).collect()}
    assert plain == split and len(plain) == 204


def test_arguments(scored):
    with pytest.raises(ValueError):
        alerts.score_alerts(scored([("u", 1, 0)]), 1.0, "beyond")
    with pytest.raises(ValueError):
        alerts.rate_counts(scored([("u", 1, 0)]), 60, "country")
