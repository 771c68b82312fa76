"""Alert rules. Each rule takes scored events and returns the events that raise it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywarden.operators.ordered import HOT_ROWS, trailing_count
from tallywarden.schemas import MICROS
from tallywarden.session import cut_lineage

UNKNOWN_USER = "<unknown>"
TRIGGERS = ("above", "below")
SCOPES = ("global", "user")


def score_alerts(scored: DataFrame, threshold: float | None, trigger: str = "above") -> DataFrame:
    """Events at or beyond the threshold, whether flagged or not; no threshold, no alerts."""
    if trigger not in TRIGGERS:
        raise ValueError(f"trigger must be one of {TRIGGERS}")
    if threshold is None:
        return scored.where(F.lit(False))
    score = F.nanvl(F.col("anomaly_score"), F.lit(None).cast("double"))
    return scored.where(score >= threshold if trigger == "above" else score <= threshold)


def rate_counts(
    scored: DataFrame, window_seconds: int = 60, scope: str = "global", user: str = "user_id", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Flagged events with ``alert_key`` and the flagged events in the trailing window.

    An event without a time counts at its processing time. Flagged events are few and are
    looked at several times, so they are stored once instead of scored again.
    """
    if scope not in SCOPES:
        raise ValueError(f"scope must be one of {SCOPES}")
    flagged = scored.where("is_anomaly")
    if "processed_ts" in scored.columns:
        flagged = flagged.withColumn("us", F.coalesce("us", F.unix_micros("processed_ts")))
    flagged = cut_lineage(scored.sparkSession, flagged)
    window_us = int(window_seconds) * MICROS
    if scope == "global":
        return trailing_count(flagged, None, window_us).withColumn("alert_key", F.lit("global"))
    keyed = flagged.withColumn("alert_key", F.coalesce(F.col(user).cast("string"), F.lit(UNKNOWN_USER)))
    return trailing_count(keyed, "alert_key", window_us, hot_rows=hot_rows)


def rate_alerts(
    scored: DataFrame,
    limit: int = 10,
    window_seconds: int = 60,
    scope: str = "global",
    user: str = "user_id",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Flagged events whose trailing window holds more than ``limit`` flagged events."""
    counted = rate_counts(scored, window_seconds, scope, user, hot_rows)
    return counted.where(F.col("window_count") > int(limit))
