"""All figures of a monitoring page from one scored table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallywarden.operators import kpis
from tallywarden.schemas import DEFAULT_THRESHOLD
from tallywarden.session import new_folder


def dashboard(scored: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> dict[str, DataFrame]:
    """Whole-table totals and minutes; the series and lists look at the newest rows only.

    The eight figures read the scored events again and again, so these are stored once.
    """
    spark = scored.sparkSession
    folder = new_folder(spark, "dashboard")
    scored.write.parquet(folder)
    scored = spark.read.schema(scored.schema).parquet(folder)
    return {
        "totals": kpis.totals(scored),
        "minutes": kpis.recent_minutes(scored),
        "latest": kpis.latest_score(scored),
        "trend": kpis.score_trend(scored, threshold),
        "rate": kpis.rolling_rate(scored),
        "sparkline": kpis.sparkline(scored),
        "feed": kpis.anomaly_feed(scored),
        "table": kpis.transaction_table(scored),
    }
