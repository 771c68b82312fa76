"""Column names and schemas shared by all modules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The four features, in model order.
FEATURES = [
    "transaction_amount",
    "rolling_mean_amount_per_user",
    "transaction_count_last_1_min",
    "time_since_last_transaction_seconds",
]
AMOUNT, MEAN, COUNT, SINCE = FEATURES

DEFAULT_THRESHOLD = 0.45
DEFAULT_WINDOW_SECONDS = 60
MICROS = 1_000_000

TRANSACTION = T.StructType(
    [
        T.StructField("seq", T.LongType(), False),
        T.StructField("transaction_id", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("us", T.LongType()),
        T.StructField("event", T.StringType()),
    ]
)

FEATURE_VECTOR = T.StructType(
    [
        T.StructField(AMOUNT, T.DoubleType()),
        T.StructField(MEAN, T.DoubleType()),
        T.StructField(COUNT, T.LongType()),
        T.StructField(SINCE, T.DoubleType()),
    ]
)

# Version 1 of the message on the scored stream.
SCORED_MESSAGE = T.StructType(
    [
        T.StructField("schema_version", T.IntegerType()),
        T.StructField("transaction_id", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("processed_timestamp", T.StringType()),
        T.StructField("anomaly_score", T.DoubleType()),
        T.StructField("is_anomaly", T.BooleanType()),
        T.StructField("explanation", T.ArrayType(T.StringType())),
        T.StructField("features", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("event", T.VariantType()),
        T.StructField("anomaly_row_id", T.LongType()),
    ]
)

RAW_EVENTS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("transaction_id", T.StringType()),
        T.StructField("event_json", T.StringType(), False),
        T.StructField("timestamp", T.TimestampType()),
    ]
)
FEATURE_ROWS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("raw_event_id", T.LongType(), False),
        T.StructField("features_json", T.StringType(), False),
        T.StructField("timestamp", T.TimestampType()),
    ]
)
ANOMALIES = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("raw_event_id", T.LongType(), False),
        T.StructField("anomaly_score", T.DoubleType()),
        T.StructField("is_anomaly", T.BooleanType()),
        T.StructField("processed_timestamp", T.TimestampType()),
    ]
)
HISTORY = T.StructType(
    [
        T.StructField("anomaly_row_id", T.LongType()),
        T.StructField("anomaly_score", T.DoubleType()),
        T.StructField("is_anomaly", T.BooleanType()),
        T.StructField("processed_timestamp", T.TimestampType()),
        T.StructField("event", T.VariantType()),
        T.StructField("features", T.VariantType()),
    ]
)


def conformance(df: DataFrame, expected: T.StructType) -> list[tuple[str, str, str | None, bool]]:
    """(field, expected type, found type, ok) per expected field; extra columns are allowed."""
    found = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return [
        (f.name, f.dataType.simpleString(), found.get(f.name), found.get(f.name) == f.dataType.simpleString())
        for f in expected.fields
    ]


def require(df: DataFrame, columns: list[str], what: str = "column") -> None:
    """Raise a KeyError that lists every missing name."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"missing {what}(s): {missing}")
