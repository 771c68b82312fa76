"""Totals, series and top lists over scored events (seq, us, ts, anomaly_score, is_anomaly)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallywarden.functions import display as D
from tallywarden.session import cut_lineage

BUFFER_ROWS = 50


def totals(scored: DataFrame) -> DataFrame:
    """Events, anomalies, rate in percent (0 without events), its text and risk tier."""
    counts = scored.agg(F.count("*").alias("total_events"), F.count_if("is_anomaly").alias("anomalies"))
    return with_rate(counts)


def with_rate(counts: DataFrame) -> DataFrame:
    total, hits = F.col("total_events"), F.col("anomalies")
    rate = F.when(total > 0, F.lit(100e0) * hits / total).otherwise(F.lit(0e0))
    return (
        counts.withColumn("anomaly_rate", rate)
        .withColumn("rate_text_1", D.fixed(F.col("anomaly_rate"), 1))
        .withColumn("rate_text_2", D.fixed(F.col("anomaly_rate"), 2))
        .withColumn("risk", D.rate_risk(F.col("anomaly_rate")))
    )


def anomalies_by_minute(scored: DataFrame) -> DataFrame:
    """Anomalies per event-time minute, only minutes that have some."""
    return (
        scored.where("is_anomaly")
        .groupBy(F.date_trunc("minute", "ts").alias("minute"))
        .agg(F.count("*").alias("anomalies"))
    )


def recent_minutes(scored: DataFrame, minutes: int = 15) -> DataFrame:
    """The last minutes with anomalies, their peak and bar tier."""
    last = anomalies_by_minute(scored).orderBy(F.desc("minute")).limit(minutes)
    peak = F.greatest(F.max("anomalies").over(W.partitionBy()), F.lit(1).cast("bigint"))
    return last.withColumn("peak", peak).withColumn("tier", D.bar_tier(F.col("anomalies"), F.col("peak")))


def latest_score(scored: DataFrame) -> DataFrame:
    """Score of the newest event (0 without events), gauge position, angle and risk."""
    newest = scored.agg(F.coalesce(F.max_by("anomaly_score", F.struct("us", "seq")), F.lit(0e0)).alias("latest_score"))
    position = D.gauge_position(F.col("latest_score"))
    return newest.withColumns(
        {
            "score_text": D.fixed(F.col("latest_score"), 3),
            "gauge": position,
            "gauge_angle": D.gauge_angle(position),
            "gauge_risk": D.gauge_risk(position),
        }
    )


def anomaly_fraction(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.count("*").alias("events"),
        F.count_if("is_anomaly").alias("anomalies"),
        F.avg(F.col("is_anomaly").cast("double")).alias("fraction"),
    )


def anomaly_samples(scored: DataFrame, rows: int = 5) -> DataFrame:
    """The first anomalies by arrival."""
    return scored.where("is_anomaly").orderBy("seq").limit(rows)


def first_rows(df: DataFrame, rows: int = 3) -> DataFrame:
    return df.orderBy("seq").limit(rows)


def live_buffer(scored: DataFrame, rows: int = BUFFER_ROWS) -> DataFrame:
    """The newest events with ``position`` 0.. from oldest to newest."""
    newest = scored.orderBy(F.desc("us"), F.desc("seq")).limit(rows)
    # At most ``rows`` rows are left, so one ordered pass over all of them is small.
    return newest.withColumn("position", (F.row_number().over(W.orderBy("us", "seq")) - 1).cast("bigint"))


def sparkline(scored: DataFrame, rows: int = 20) -> DataFrame:
    """Scores, flags as 0/1 and 1-based index of the newest events."""
    return live_buffer(scored, rows).select(
        "seq",
        (F.col("position") + 1).alias("idx"),
        "anomaly_score",
        F.col("is_anomaly").cast("int").alias("anomaly_value"),
    )


def score_trend(scored: DataFrame, threshold: float, rows: int = BUFFER_ROWS) -> DataFrame:
    return live_buffer(scored, rows).select(
        F.col("position").alias("idx"),
        "anomaly_score",
        "is_anomaly",
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts_text"),
        F.lit(float(threshold)).alias("threshold"),
    )


def rolling_rate(scored: DataFrame, window: int = 10, rows: int = BUFFER_ROWS) -> DataFrame:
    """Share of anomalies, in percent, in the last ``window`` rows at each buffer position."""
    trailing = W.orderBy("position").rowsBetween(-(window - 1), W.currentRow)
    rate = F.avg(F.col("is_anomaly").cast("double")).over(trailing) * 100
    return live_buffer(scored, rows).select("seq", "position", rate.alias("rate")).withColumn(
        "rate_text", D.fixed(F.col("rate"), 1)
    )


def rolling_rate_all(scored: DataFrame, window: int = 10) -> DataFrame:
    """The same share at every event, over the last ``window`` events of all, without one task that sees them all.

    Events are range-sorted and numbered through the counts of the ranges; every range gets the ``window`` - 1 events
    before it as well, from however many ranges these come, and is then a window of its own.
    """
    spark = scored.sparkSession
    placed = scored.select("seq", "us", "is_anomaly").repartitionByRange("us", "seq").sortWithinPartitions("us", "seq")
    rows = cut_lineage(spark, placed.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
    counts = {r.part: r.n for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect()}  # one row per range
    if not counts:
        return rows.select("seq", F.lit(0).cast("bigint").alias("position"), F.lit(0e0).alias("rate"))
    starts, total = {}, 0
    for part in sorted(counts):
        starts[part], total = total, total + counts[part]
    base = F.element_at(F.create_map(*[F.lit(x) for part, start in starts.items() for x in (part, start)]), F.col("part"))
    numbered = rows.withColumn("position", base + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    later = F.array(*[F.struct(F.lit(part).alias("part"), F.lit(start).alias("start")) for part, start in starts.items()])
    near = F.filter(later, lambda r: (r.part > F.col("part")) & (r.start - F.col("position") < window))
    # Only the last events of a range are near the start of another one.
    last = F.col("position") >= base + F.element_at(F.create_map(*[F.lit(x) for item in counts.items() for x in item]), F.col("part")) - (window - 1)
    ahead = numbered.where(last).select("seq", "is_anomaly", "position", F.explode(near).alias("to"))
    both = numbered.select("part", "seq", "is_anomaly", "position", F.lit(True).alias("own")).unionByName(
        ahead.select(F.col("to.part").alias("part"), "seq", "is_anomaly", "position", F.lit(False).alias("own"))
    )
    trailing = W.partitionBy("part").orderBy("position").rowsBetween(-(window - 1), W.currentRow)
    rate = F.avg(F.col("is_anomaly").cast("double")).over(trailing) * 100
    return both.withColumn("rate", rate).where("own").select("seq", F.col("position").cast("bigint").alias("position"), "rate")


def anomaly_feed(scored: DataFrame, rows: int = 10, buffer_rows: int | None = BUFFER_ROWS) -> DataFrame:
    """Newest anomalies with severity and texts, from the live buffer or from all events."""
    source = scored if buffer_rows is None else live_buffer(scored, buffer_rows)
    newest = source.where("is_anomaly").orderBy(F.desc("us"), F.desc("seq")).limit(rows)
    return newest.select(
        "seq",
        "user_id",
        D.severity(F.col("anomaly_score")).alias("severity"),
        D.fixed(F.col("anomaly_score"), 4).alias("score_text"),
        D.rupees(F.col("amount")).alias("amount_text"),
        F.array_join("explanation", "; ").alias("reasons"),
        F.date_format("ts", "HH:mm:ss").alias("time_text"),
    )


def transaction_table(scored: DataFrame, rows: int = BUFFER_ROWS) -> DataFrame:
    """The buffer newest first, as display text."""
    return live_buffer(scored, rows).select(
        "seq",
        D.order_number(F.row_number().over(W.orderBy(F.desc("position")))).alias("order_id"),
        "user_id",
        D.rupees(F.col("amount")).alias("amount_text"),
        D.fixed(F.col("anomaly_score"), 4).alias("score_text"),
        D.score_tier(F.col("anomaly_score")).alias("score_tier"),
        D.status(F.col("is_anomaly")).alias("status"),
    )
