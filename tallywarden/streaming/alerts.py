"""Rate alerts per user with keyed state: each user's recent anomalies live in the state store until their window has passed."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tallywarden.operators.alerts import UNKNOWN_USER
from tallywarden.schemas import MICROS
from tallywarden.streaming.jobs import LATENESS_SECONDS

_OUT = T.StructType(
    [
        T.StructField("alert_key", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("us", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("anomaly_score", T.DoubleType()),
        T.StructField("window_count", T.LongType()),
    ]
)


class RecentAnomalies(StatefulProcessor):
    """Times (and arrival numbers) of a user's anomalies that may still count, and a timer that ends them.

    A timer at the newest time plus ``keep_us`` clears a user without further anomalies, so the state
    holds the users of the last window and lateness only.
    """

    def __init__(self, window_us: int, keep_us: int):
        self.window_us, self.keep_us = window_us, keep_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getValueState("recent", "times binary, newest bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["us", "seq"], ignore_index=True)
        packed, newest = self.recent.get() if self.recent.exists() else (b"", None)
        old = np.frombuffer(packed, np.int64).reshape(-1, 2)
        own = batch[["us", "seq"]].to_numpy(np.int64)
        counts, both = counted(old, own, self.window_us)
        newest = max(int(batch["seen_us"].max()), newest if newest is not None else -(1 << 63))
        self.recent.update((both[both[:, 0] >= newest - self.keep_us].tobytes(), newest))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((newest + self.keep_us) // 1000 + 1)
        yield batch.assign(window_count=counts)[_OUT.fieldNames()]

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.recent.clear()
        yield from ()

    def close(self) -> None:
        pass


def counted(old: np.ndarray, own: np.ndarray, window_us: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``own`` (time, number) the rows up to it, in order, that lie in its window; and all rows in order."""
    both = np.concatenate([old, own])
    order = np.lexsort((both[:, 1], both[:, 0]))
    place = np.empty(len(both), np.int64)
    place[order] = np.arange(len(both))
    both = both[order]
    return place[len(old) :] + 1 - np.searchsorted(both[:, 0], own[:, 0] - window_us, side="left"), both


def keyed_rate_alerts(scored: DataFrame, limit: int = 10, window_seconds: int = 60, lateness_seconds: int = LATENESS_SECONDS) -> DataFrame:
    """The anomalies of a scored stream whose user has more than ``limit`` in the trailing window, as a stream.

    The watermark follows the event time, or the processing time where that is earlier (a wrong clock) or the event has
    none; an event without a time counts at its processing time. Anomalies that come ``lateness_seconds`` later than the
    newest one of all are left out by the watermark; earlier alerts are not revised. A user's anomalies are one task's work: for
    users with very many of them, and for the rate over all users, use ``jobs.rate_alert_stream``.
    """
    processed = F.unix_micros("processed_ts")
    flagged = scored.where("is_anomaly").withColumns(
        {
            "alert_key": F.coalesce("user_id", F.lit(UNKNOWN_USER)),
            "us": F.coalesce("us", processed),
            "seen_us": F.coalesce(F.least(F.unix_micros("ts"), processed), processed),
        }
    )
    rows = flagged.select("alert_key", "seq", "user_id", "us", "ts", "anomaly_score", "seen_us", F.timestamp_micros("seen_us").alias("seen"))
    window_us = int(window_seconds) * MICROS
    out = rows.withWatermark("seen", f"{int(lateness_seconds)} seconds").groupBy("alert_key").transformWithStateInPandas(
        statefulProcessor=RecentAnomalies(window_us, window_us + int(lateness_seconds) * MICROS),
        outputStructType=_OUT,
        outputMode="Append",
        timeMode="EventTime",
    )
    return out.where(F.col("window_count") > int(limit))


def write_keyed_alerts(alerts: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append alerts to a table, each exactly once."""
    writer = alerts.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start(path)
