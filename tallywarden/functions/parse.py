"""Text to typed values: JSON events, ISO-8601 times, numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted ISO-8601 shapes. Date, time and offset may each be written with
# separators throughout or without any.
_DATE = r"(?:\d{4}-\d{2}-\d{2}|\d{8}|\d{4}-W\d{2}(?:-[1-7])?|\d{4}W\d{2}[1-7]?)"
_CLOCK = r"\d{2}(?::\d{2}(?::\d{2}(?:[.,]\d+)?)?|\d{2}(?:\d{2}(?:[.,]\d+)?)?)?"
_OFFSET = r"(?:Z|[+-]\d{2}(?::\d{2}(?::\d{2})?|\d{2}(?:\d{2})?)?)?"
WELL_FORMED = f"^{_DATE}(?:.{_CLOCK}{_OFFSET})?$"
# Parts of a well-formed time. Groups of CALENDAR: year, month, day, hour,
# minute, second, fraction, zone. Groups of WEEK: year, week, weekday, then the same tail.
_TIME = r"(?:.([01]\d|2[0-3])(?::?([0-5]\d))?(?::?([0-5]\d))?(?:[.,](\d+))?(Z|[+-]\d{2}(?::?[0-5]\d(?::?[0-5]\d)?)?)?)?$"
CALENDAR = r"^(\d{4})-?(\d{2})-?(\d{2})" + _TIME
WEEK = r"^(\d{4})-?W(\d{2})-?([1-7])?" + _TIME
# The common form, which Spark casts as it is.
PLAIN = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:\d{2})?$"
NUMBER = r"^\s*[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?\s*$"


def number(text: Column) -> Column:
    """Text to DOUBLE; null for anything that is not a finite decimal number."""
    plain = F.when(F.contains(text, F.lit("_")), F.regexp_replace(text, "_", "")).otherwise(text)
    value = F.when(text.rlike(NUMBER), F.trim(plain).try_cast("double"))
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def iso_timestamp(text: Column) -> Column:
    """ISO-8601 text to TIMESTAMP in UTC; null when it is not a valid time.

    Takes extended and basic form, week dates, comma fractions, and offsets as Z, +hh,
    +hhmm, +hh:mm or with seconds. Text without an offset is UTC. Digits beyond microseconds are cut.
    """

    tail = "T$4:$5:$6.$7@$8"
    year, week, weekday = (F.regexp_replace(text, WEEK, f"${group}") for group in (1, 2, 3))
    # Week 1 is the one that holds 4 January.
    first_monday = F.trunc(F.concat(year, F.lit("-01-04")).try_cast("date"), "week")
    days = (week.try_cast("int") - 1) * 7 + F.coalesce(weekday.try_cast("int"), F.lit(1)) - 1
    day = F.date_add(first_monday, days)
    in_year = F.weekofyear(day) == week.try_cast("int")
    spread = F.when(text.rlike(CALENDAR), F.regexp_replace(text, CALENDAR, "$1-$2-$3" + tail)).when(
        text.rlike(WEEK),
        F.when(in_year, F.concat(F.date_format(day, "yyyy-MM-dd"), F.regexp_replace(text, WEEK, tail))),
    )
    # Fill the parts that were left out, then the zone.
    filled = F.regexp_replace(F.regexp_replace(spread, "T:", "T00:"), r":(?=[:.])", ":00")
    zoned = F.regexp_replace(F.regexp_replace(filled, r"\.?@", "@"), "@Z?$", "Z")
    other = F.regexp_replace(zoned, "@", "").try_cast("timestamp")
    return F.when(text.rlike(PLAIN), text.try_cast("timestamp")).when(text.rlike(WELL_FORMED), other)


def iso_or(text: Column, fallback: Column) -> Column:
    """As ``iso_timestamp``, with a fallback time so that the row is never lost."""
    return F.coalesce(iso_timestamp(text), fallback)


def json_or_raw(text: Column) -> Column:
    """JSON text to VARIANT; text that is not JSON becomes ``{"raw": text}``."""
    raw = F.to_variant_object(F.struct(text.alias("raw")))
    return F.when(text.isNotNull(), F.coalesce(F.try_parse_json(text), raw))


def field(event: Column, name: str) -> Column:
    """A top-level field as VARIANT: null when absent, a VARIANT null when given as null."""
    return F.try_variant_get(event, f"$.{name}", "variant")


def scalar(event: Column, name: str) -> Column:
    """A top-level scalar field as text; null when absent, null or nested."""
    return F.try_variant_get(event, f"$.{name}", "string")


def text_value(event: Column, name: str, text: Column) -> Column:
    """``scalar`` text with ``None`` for an explicit null and ``True``/``False`` for booleans."""
    return (
        F.when(text.isNull(), F.when(field(event, name).isNotNull(), "None"))
        .when(text.isin("true", "false") & _is_boolean(event, name), F.initcap(text))
        .otherwise(text)
    )


def number_value(event: Column, name: str, text: Column) -> Column:
    """``scalar`` text as a finite DOUBLE; true and false count as 1 and 0, null is no number."""
    truth = F.when(text == "true", 1e0).otherwise(0e0)
    return F.when(text.isin("true", "false") & _is_boolean(event, name), truth).otherwise(number(text))


def _is_boolean(event: Column, name: str) -> Column:
    return F.schema_of_variant(field(event, name)) == "BOOLEAN"
