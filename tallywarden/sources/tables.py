"""The given tables as transaction feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywarden.functions.display import iso_text


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _event_text(**fields: Column) -> Column:
    return F.to_json(F.struct(*[value.alias(name) for name, value in fields.items()]))


def _with_extras(event: Column, extras: Column) -> Column:
    """A JSON object with the members of another one appended; other JSON or bad text adds nothing."""
    whole = F.to_json(F.try_parse_json(extras))
    more = F.when(whole.startswith("{") & (whole != "{}"), F.concat(F.lit(","), F.substring(whole, 2, (1 << 31) - 1)))
    return F.concat(F.regexp_replace(event, r"\}$", ""), F.coalesce(more, F.lit("}")))


def from_events(spark: SparkSession, folder: str) -> DataFrame:
    """Table ``events``: value is the amount, all props are extra fields, event_id is the arrival order."""
    rows = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.select(
        F.col("event_id").alias("seq"),
        F.col("event_id").cast("string").alias("transaction_id"),
        F.col("user_id").cast("string").alias("user_id"),
        F.col("value").alias("amount"),
        "ts",
        F.unix_micros("ts").alias("us"),
        "event_type",
        _with_extras(
            _event_text(
                transaction_id=F.col("event_id").cast("string"),
                user_id=F.col("user_id").cast("string"),
                amount=F.col("value"),
                timestamp=iso_text(F.col("ts")),
                event_type=F.col("event_type"),
            ),
            F.col("props"),
        ).alias("event"),
    )


def from_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Table ``orders``: large amounts and whole-day times, so many rows share an instant."""
    rows = table(spark, folder, "orders").withColumn("ts", F.col("o_orderdate").cast("timestamp"))
    return rows.select(
        F.col("o_orderkey").alias("seq"),
        F.col("o_orderkey").cast("string").alias("transaction_id"),
        F.col("o_custkey").cast("string").alias("user_id"),
        F.col("o_totalprice").alias("amount"),
        "ts",
        F.unix_micros("ts").alias("us"),
        _event_text(
            transaction_id=F.col("o_orderkey").cast("string"),
            user_id=F.col("o_custkey").cast("string"),
            amount=F.col("o_totalprice"),
            timestamp=iso_text(F.col("ts")),
        ).alias("event"),
    )


def messages(tx: DataFrame) -> DataFrame:
    """Transactions as keyed JSON messages, as a stream would deliver them."""
    return tx.select("seq", F.col("user_id").alias("key"), F.col("event").alias("value"))
