"""Decode events, reject bad ones with a reason, clean and check feature tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywarden.functions.parse import field, iso_timestamp, number_value, scalar, text_value
from tallywarden.schemas import AMOUNT, COUNT, FEATURES, MEAN, SINCE, require


def decode_events(raw: DataFrame, value: str = "value", seq: str = "seq") -> DataFrame:
    """JSON text to transactions with a ``reject_reason`` (null for valid rows).

    Unknown fields stay in ``event``, the text as it came. Reasons, first match wins:
    bad_json, missing_user_id, missing_amount, missing_timestamp, bad_amount, bad_timestamp.
    """
    text = F.col(value).cast("string")
    v = F.col("_v")
    names = {"transaction_id": "transaction_id", "_user": "user_id", "_amount": "amount", "_time": "timestamp"}
    parsed = raw.select(F.col(seq).alias("seq"), text.alias("event"), F.try_parse_json(text).alias("_v"))
    texts = parsed.select("seq", "event", "_v", *[scalar(v, name).alias(c) for c, name in names.items()])
    typed = texts.withColumns(
        {
            "user_id": text_value(v, "user_id", F.col("_user")),
            "amount": number_value(v, "amount", F.col("_amount")),
            "ts": iso_timestamp(text_value(v, "timestamp", F.col("_time"))),
        }
    )

    def absent(column: str) -> Column:
        # Only a field without text can be absent, so the second look is rare.
        return F.col(column).isNull() & field(v, names[column]).isNull()

    # Text that is JSON but no object has no fields at all, like an empty object.
    reason = (
        F.when(v.isNull(), "bad_json")
        .when(absent("_user"), "missing_user_id")
        .when(absent("_amount"), "missing_amount")
        .when(absent("_time"), "missing_timestamp")
        .when(F.col("amount").isNull(), "bad_amount")
        .when(F.col("ts").isNull(), "bad_timestamp")
    )
    plain = [F.col(c) for c in ("seq", "transaction_id", "user_id", "amount", "ts", "event")]
    row = F.struct(*plain, F.unix_micros("ts").alias("us"), reason.alias("reject_reason"))
    # A filter on the reason would be pushed below a projection and parse every row again;
    # it stays above a generator.
    return typed.select(F.inline(F.array(row)))


def valid_rows(decoded: DataFrame) -> DataFrame:
    return decoded.where(F.col("reject_reason").isNull())


def rejected_rows(decoded: DataFrame) -> DataFrame:
    return decoded.where(F.col("reject_reason").isNotNull())


def with_rejects_filled(featured: DataFrame, rejects: DataFrame) -> DataFrame:
    """Valid rows with features, plus rejected rows with their amount and zero features."""
    filled = rejects.withColumns(
        {
            AMOUNT: F.coalesce(F.col("amount"), F.lit(0e0)),
            MEAN: F.lit(0e0),
            COUNT: F.lit(0).cast("bigint"),
            SINCE: F.lit(0e0),
        }
    )
    return featured.unionByName(filled, allowMissingColumns=True)


def _not_a_number(name: str, dtype: str) -> Column:
    """True for null, NaN and, in text columns, anything that is no number."""
    value = F.col(name) if dtype in ("double", "float") else F.col(name).try_cast("double")
    return value.isNull() | F.isnan(value)


def count_not_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: rows in all, and rows without a number. One pass over the table."""
    require(df, columns)
    types = dict(df.dtypes)
    counts = df.agg(
        F.count("*").alias("rows"),
        *[F.count_if(_not_a_number(c, types[c])).alias(f"bad_{i}") for i, c in enumerate(columns)],
    )
    per_column = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(f"bad_{i}").alias("bad_rows")) for i, c in enumerate(columns)]
    )
    return counts.select("rows", F.inline(per_column))


def null_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Null (and NaN) counts per column in one pass, one output row per column."""
    columns = columns or df.columns
    types = dict(df.dtypes)

    def empty(c: str) -> Column:
        return F.col(c).isNull() | F.isnan(c) if types[c] in ("double", "float") else F.col(c).isNull()

    counts = df.agg(
        F.count("*").alias("rows"), *[F.count_if(empty(c)).alias(f"nulls_{i}") for i, c in enumerate(columns)]
    )
    per_column = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(f"nulls_{i}").alias("nulls")) for i, c in enumerate(columns)]
    )
    return counts.select("rows", F.inline(per_column))


def assert_numeric(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Return the columns as DOUBLE, or raise when any value is missing or no number."""
    columns = columns or df.columns
    bad = [(r.column_name, r.bad_rows) for r in count_not_numeric(df, columns).collect() if r.bad_rows]
    if bad:
        raise ValueError(f"not numeric: {bad}")
    return df.select(*[F.col(c).cast("double").alias(c) for c in columns])


def select_features(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The wide training columns V1..V28 and Amount as DOUBLE; a label column is left out."""
    columns = columns or [f"V{i}" for i in range(1, 29)] + ["Amount"]
    require(df, columns, "feature column")
    return df.select(*[F.col(c).cast("double").alias(c) for c in columns])


def clean_training(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Values that are no number become null, a missing gap becomes 0, rows with a null go."""
    columns = columns or FEATURES
    require(df, [SINCE], "feature")
    require(df, columns, "feature")
    numeric = df.withColumns({c: F.nanvl(F.col(c).try_cast("double"), F.lit(None).cast("double")) for c in columns})
    return numeric.fillna({SINCE: 0.0}).dropna("any", subset=columns)


def cleaning_report(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows before and after cleaning and rows dropped, in one pass: one row."""
    columns = columns or FEATURES
    require(df, [*columns, SINCE], "feature")
    types = dict(df.dtypes)
    lost = F.lit(False)
    for c in columns:
        if c != SINCE:  # a gap without a number becomes 0
            lost = lost | _not_a_number(c, types[c])
    counts = df.agg(F.count("*").alias("rows_before"), F.count_if(~lost).alias("rows_after"))
    return counts.withColumn("rows_dropped", F.col("rows_before") - F.col("rows_after"))


def vector(df: DataFrame, order: list[str], column: str = "vector") -> DataFrame:
    """Add the ordered feature vector. A missing name raises; a bad value gives a null vector."""
    require(df, order, "required feature")
    types = dict(df.dtypes)
    bad = F.lit(False)
    for c in order:
        bad = bad | _not_a_number(c, types[c])
    return df.withColumn(column, F.when(~bad, F.array(*[F.col(c).try_cast("double") for c in order])))


def vector_from_map(df: DataFrame, features: str, order: list[str], column: str = "vector") -> DataFrame:
    """As ``vector`` for a name -> value map column, plus ``missing_features`` per row."""
    names = F.array(*[F.lit(n) for n in order])
    missing = F.filter(names, lambda n: ~F.map_contains_key(F.col(features), n))
    values = F.transform(names, lambda n: F.try_element_at(F.col(features), n).cast("double"))
    whole = ~F.exists(values, lambda x: x.isNull() | F.isnan(x))
    return df.withColumns({"missing_features": missing, column: F.when(whole, values)})
