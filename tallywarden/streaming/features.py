"""Features of an unbounded stream, with state per user."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallywarden.schemas import AMOUNT, COUNT, DEFAULT_WINDOW_SECONDS, FEATURE_VECTOR, MEAN, MICROS, SINCE

_STATE = "n bigint, total double, last bigint, peak bigint, recent binary"
BUCKETS = 1024


class UserFeatures(StatefulProcessor):
    """Rows, total, last time and the times still inside the window, per user.

    Users are handled in buckets, since a call per user costs far more than a user's few rows.
    State is kept and written per user all the same. Rows of one micro-batch are put in event
    order first. A row older than one seen in an earlier batch is taken in arrival order: its
    gap is negative, and rows of the window stay until all that arrived before them have left.
    """

    def __init__(self, window_us: int):
        self.window_us = window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.users = handle.getMapState("users", "user_id string", _STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["user_id", "us", "seq"], ignore_index=True)
        users = batch["user_id"].to_numpy()
        us, amount = batch["us"].to_numpy(np.int64), batch["amount"].to_numpy(float)
        ends = np.append(np.flatnonzero(users[1:] != users[:-1]) + 1, len(users))
        means, gaps = np.empty(len(us)), np.empty(len(us))
        counts, late = np.empty(len(us), np.int64), np.empty(len(us), bool)
        start = 0
        for end in ends:
            user, part = (users[start],), slice(start, end)
            state = self.users.getValue(user) if self.users.containsKey(user) else None
            means[part], counts[part], gaps[part], late[part], state = advance(state, us[part], amount[part], self.window_us)
            self.users.updateValue(user, state)
            start = end
        yield batch.assign(**{AMOUNT: amount, MEAN: means, COUNT: counts, SINCE: gaps, "is_late": late})

    def close(self) -> None:
        pass


def advance(state: tuple | None, us: np.ndarray, amount: np.ndarray, window_us: int) -> tuple:
    """Means, counts, gaps and late marks of one user's rows, and the state after them."""
    n, total, last, peak, packed = state or (0, 0.0, us[0], us[0], b"")
    waiting = np.frombuffer(packed, np.int64)
    position = np.arange(1, len(us) + 1)
    totals = np.cumsum(np.concatenate(([total], amount)))[1:]
    previous = np.concatenate(([last], us[:-1]))
    highest = np.maximum.accumulate(np.concatenate(([peak], us)))
    window = np.concatenate((waiting, highest[1:]))
    gone = np.searchsorted(window, highest[1:] - window_us, side="left")
    gaps = np.floor((us - previous + 500) / 1e3) / 1e3
    after = (n + len(us), float(totals[-1]), int(us[-1]), int(highest[-1]), window[gone[-1] :].tobytes())
    return totals / (n + position), len(waiting) + position - gone, gaps, us < highest[:-1], after


def features_stream(
    tx: DataFrame, window_seconds: int = DEFAULT_WINDOW_SECONDS, buckets: int = BUCKETS
) -> DataFrame:
    """Add the four features and ``is_late`` to a stream of valid transactions.

    A bucket's rows of one micro-batch are handled by one task, so a source that may hold a
    very hot user needs a bound on rows per trigger (maxOffsetsPerTrigger, maxFilesPerTrigger).
    Use several buckets per core; the number must stay the same for the life of a checkpoint.
    """
    rows = tx.drop("ts").withColumn("bucket", F.pmod(F.xxhash64("user_id"), F.lit(buckets)).cast("int"))
    schema = T.StructType([*rows.schema.fields, *FEATURE_VECTOR.fields, T.StructField("is_late", T.BooleanType())])
    out = rows.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=UserFeatures(int(window_seconds * MICROS)),
        outputStructType=schema,
        outputMode="Append",
        timeMode="None",
    )
    return out.withColumn("ts", F.timestamp_micros("us")).drop("bucket")
