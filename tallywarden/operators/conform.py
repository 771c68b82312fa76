"""Do messages and records have the fields they should? Counts per field, and rows that have all of them right."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywarden.functions.parse import number

# The fields of a transaction message; all may be absent or null, others may be there.
EVENT_FIELDS = {"transaction_id": "string", "user_id": "string", "amount": "number", "timestamp": "string"}
# The fields of a history record; all must be there.
RECORD_FIELDS = {"anomaly_row_id": "bigint", "anomaly_score": "double", "is_anomaly": "boolean", "processed_timestamp": "timestamp"}


def _member(event: Column, name: str) -> Column:
    return F.try_variant_get(event, f"$.{name}", "variant")


def _is(value: Column, kind: str) -> Column:
    """Has a JSON value the kind? A number may be written as text if it is a finite one."""
    shape = F.schema_of_variant(value)
    if kind == "string":
        return shape == "STRING"
    numeric = shape.isin("BIGINT", "DOUBLE", "FLOAT") | shape.startswith("DECIMAL")
    return numeric | ((shape == "STRING") & number(F.try_variant_get(value, "$", "string")).isNotNull())


def event_checks(event: Column, fields: dict[str, str] = EVENT_FIELDS) -> dict[str, tuple[Column, Column]]:
    """Per field of a variant whether it has a value, and whether that has another type."""
    out = {}
    for name, kind in fields.items():
        value = _member(event, name)
        there = F.coalesce(value.isNotNull() & (F.schema_of_variant(value) != "VOID"), F.lit(False))
        out[name] = there, there & ~F.coalesce(_is(value, kind), F.lit(False))
    return out


def is_object(event: Column) -> Column:
    return F.coalesce(F.schema_of_variant(event).startswith("OBJECT"), F.lit(False))


def check_events(messages: DataFrame, value: str = "value", fields: dict[str, str] = EVENT_FIELDS) -> DataFrame:
    """Rows (field, expected, rows, present, wrong); the field ``(message)`` counts messages that are JSON objects, and those that are not.

    Extra fields are allowed, absent and null ones as well. A message that is no object has no fields.
    """
    parsed = messages.select(F.explode(F.array(F.try_parse_json(F.col(value).cast("string")))).alias("event"))  # parsed once
    checks = event_checks(F.col("event"), fields)
    items = [("(message)", "object", is_object(F.col("event")), ~is_object(F.col("event")))]
    items += [(name, kind, is_object(F.col("event")) & checks[name][0], is_object(F.col("event")) & checks[name][1]) for name, kind in fields.items()]
    return _counted(parsed, items)


def check_records(history: DataFrame) -> DataFrame:
    """The same for history records (``Store.recent``): their columns, and the fields of the event each holds.

    A column of another type is wrong in every row; features must be an object of numbers.
    """
    found = {f.name: f.dataType.simpleString() for f in history.schema.fields}
    items = []
    for name, kind in RECORD_FIELDS.items():
        there = F.col(name).isNotNull() if name in found else F.lit(False)
        items.append((name, kind, there, F.lit(found.get(name) != kind)))
    event = F.col("event")
    items.append(("event", "object", event.isNotNull(), ~is_object(event)))
    items += [(f"event.{name}", kind, there, wrong) for (name, kind), (there, wrong) in zip(EVENT_FIELDS.items(), event_checks(event).values())]
    numbers = F.try_variant_get(F.col("features"), "$", "map<string,double>")
    items.append(("features", "numbers", F.col("features").isNotNull(), numbers.isNull() | F.exists(F.map_values(numbers), lambda x: x.isNull())))
    return _counted(history, items)


def _counted(rows: DataFrame, items: list[tuple[str, str, Column, Column]]) -> DataFrame:
    counts = [F.count("*").alias("rows")]
    for n, (_, _, there, wrong) in enumerate(items):
        counts += [F.count_if(there).alias(f"present_{n}"), F.count_if(F.coalesce(wrong, F.lit(True))).alias(f"wrong_{n}")]
    lines = [
        F.struct(F.lit(name).alias("field"), F.lit(kind).alias("expected"), F.col("rows").alias("rows"), F.col(f"present_{n}").alias("present"), F.col(f"wrong_{n}").alias("wrong"))
        for n, (name, kind, _, _) in enumerate(items)
    ]
    return rows.agg(*counts).select(F.inline(F.array(*lines)))
