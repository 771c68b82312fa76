"""The four behavioural features of a transaction, and per-user summaries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywarden.operators.ordered import HOT_ROWS, running
from tallywarden.schemas import AMOUNT, COUNT, DEFAULT_WINDOW_SECONDS, FEATURES, MEAN, MICROS, SINCE


def seconds_from_micros(us: Column) -> Column:
    """Whole-number rounding to milliseconds, half up, so that every engine agrees."""
    return F.floor((us + F.lit(500)) / F.lit(1e3)) / F.lit(1e3)


def features(
    tx: DataFrame,
    window_seconds: int = DEFAULT_WINDOW_SECONDS,
    user: str = "user_id",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add the four features to valid transactions (user, amount, us, seq not null).

    The mean covers the user's whole history up to and including the row; the count covers
    the trailing window, both ends inclusive; the gap is 0 for a user's first row.
    """
    if window_seconds <= 0:
        raise ValueError("window_seconds must be positive")
    scanned = running(tx, user, amount="amount", window_us=int(window_seconds * MICROS), hot_rows=hot_rows)
    return scanned.withColumns(
        {
            AMOUNT: F.col("amount").cast("double"),
            MEAN: F.col("run_sum") / F.col("run_count"),
            COUNT: F.col("window_count"),
            SINCE: F.coalesce(seconds_from_micros(F.col("us") - F.col("prev_us")), F.lit(0e0)),
        }
    ).drop("run_count", "run_sum", "window_count", "prev_us")


def training_features(tx: DataFrame, window_seconds: int = DEFAULT_WINDOW_SECONDS) -> DataFrame:
    """Only the feature columns, plus ``seq`` to sample by."""
    return features(tx, window_seconds).select("seq", *FEATURES)


def user_profile(tx: DataFrame, user: str = "user_id") -> DataFrame:
    """Final running state per user: rows, total, mean and last time. Combines on the map side."""
    return tx.groupBy(user).agg(
        F.count("*").alias("tx_count"),
        F.sum("amount").alias("sum_amount"),
        F.avg("amount").alias("mean_amount"),
        F.max("ts").alias("last_ts"),
    )


def user_amount_ema(tx: DataFrame, alpha: float = 0.2, user: str = "user_id", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Exponential moving average of the amounts per user, started at the first amount.

    Written as a weighted sum: an amount that has k later ones weighs alpha*(1-alpha)^k, and
    the first one weighs (1-alpha)^k. The position counts back from a user's last row, so
    the rest is a plain aggregate that combines before the shuffle.
    """
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be in (0, 1]")
    backwards = tx.select(user, "amount", (-F.col("us")).alias("us"), (-F.col("seq")).alias("seq"))
    later = F.col("run_count") - 1  # rows of the user that come after this one
    fade = F.exp(later * F.lit(math.log1p(-alpha))) if alpha < 1 else F.when(later == 0, F.lit(1e0)).otherwise(F.lit(0e0))
    term = F.col("amount") * fade
    ema = F.sum(term) * F.lit(float(alpha)) + F.max_by(term, "run_count") * F.lit(1 - float(alpha))
    return (
        running(backwards, user, hot_rows=hot_rows)
        .groupBy(user)
        .agg(ema.alias("ema_amount"), F.count("*").alias("tx_count"))
    )


def active_users(tx: DataFrame, seconds: int = 300, user: str = "user_id") -> DataFrame:
    """At every tick of ``seconds``, the number of users seen in [tick - seconds, tick].

    A row exactly on a tick belongs to that tick and, as the inclusive lower end, to the
    next one. Users are made distinct per tick before they are counted.
    """
    width = int(seconds * MICROS)
    up = F.expr(f"(us + pmod(-us, {width}L)) div {width}L")
    on_tick = F.pmod(F.col("us"), F.lit(width)) == 0
    ticks = F.when(on_tick, F.array(up, up + 1)).otherwise(F.array(up))
    return (
        tx.select(user, F.explode(ticks).alias("tick"))
        .distinct()
        .groupBy("tick")
        .agg(F.count("*").alias("active_users"))
        .select(F.timestamp_micros(F.col("tick") * width).alias("tick_ts"), "active_users")
    )


__all__ = ["FEATURES", "active_users", "features", "seconds_from_micros", "training_features", "user_amount_ema", "user_profile"]
