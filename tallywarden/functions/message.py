"""Messages for the transaction and scored streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywarden.functions.display import iso_text
from tallywarden.schemas import FEATURES, SCORED_MESSAGE

SCHEMA_VERSION = 1


def feature_map() -> Column:
    """All features as name -> DOUBLE."""
    pairs = [part for name in FEATURES for part in (F.lit(name), F.col(name).cast("double"))]
    return F.create_map(*pairs)


def scored_messages(scored: DataFrame) -> DataFrame:
    """Key and JSON value per scored event. ``event`` is the original JSON, kept whole, and so is its timestamp's text."""
    absent = F.lit("")
    written = F.try_variant_get(F.try_parse_json(F.col("event")), "$.timestamp", "string")
    body = F.struct(
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        F.coalesce(F.col("transaction_id"), absent).alias("transaction_id"),
        F.coalesce(F.col("user_id"), absent).alias("user_id"),
        F.coalesce(F.col("amount"), F.lit(0e0)).alias("amount"),
        F.coalesce(written, iso_text(F.col("ts")), absent).alias("timestamp"),
        iso_text(F.col("processed_ts")).alias("processed_timestamp"),
        F.col("anomaly_score"),
        F.col("is_anomaly"),
        F.col("explanation"),
        feature_map().alias("features"),
        F.try_parse_json(F.col("event")).alias("event"),
        F.col("seq").alias("anomaly_row_id"),
    )
    return scored.select(F.col("user_id").alias("key"), F.to_json(body).alias("value"))


def read_scored_messages(messages: DataFrame, value: str = "value") -> DataFrame:
    """The typed fields of scored messages."""
    text = F.col(value).cast("string")
    return messages.select(F.from_json(text, SCORED_MESSAGE).alias("m")).select("m.*")


def event_key(user: str = "user_id", us: str = "us", seq: str = "seq") -> Column:
    """A unique id made from the event, so that a retried job makes the same one."""
    return F.sha2(F.concat_ws("|", F.coalesce(F.col(user), F.lit("")), F.col(us), F.col(seq)), 256)


def with_transaction_id(tx: DataFrame) -> DataFrame:
    """Give events without a transaction id one of their own."""
    return tx.withColumn("transaction_id", F.coalesce("transaction_id", event_key()))


def transaction_messages(tx: DataFrame) -> DataFrame:
    """Key and JSON value per transaction; the value is the whole original event."""
    return tx.select(F.col("user_id").alias("key"), F.col("event").alias("value"))
