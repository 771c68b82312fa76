"""Text and tiers for tables and charts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits of the tiers.
SEVERITY_CRITICAL, SEVERITY_HIGH = 0.9, 0.7
RATE_HIGH, RATE_MEDIUM = 15.0, 5.0
GAUGE_LOW, GAUGE_MEDIUM = 0.33, 0.66
TIER_HIGH, TIER_MEDIUM = 0.7, 0.45


def severity(score: Column) -> Column:
    return F.when(score > SEVERITY_CRITICAL, "CRITICAL").when(score > SEVERITY_HIGH, "HIGH").otherwise("MEDIUM")


def rate_risk(rate: Column) -> Column:
    return F.when(rate >= RATE_HIGH, "HIGH").when(rate >= RATE_MEDIUM, "MED").otherwise("LOW")


def gauge_position(score: Column) -> Column:
    return F.greatest(F.lit(0e0), F.least(F.lit(1e0), score))


def gauge_risk(position: Column) -> Column:
    return F.when(position < GAUGE_LOW, "LOW RISK").when(position < GAUGE_MEDIUM, "MEDIUM RISK").otherwise("HIGH RISK")


def gauge_angle(position: Column) -> Column:
    return F.lit(-180e0) + position * F.lit(180e0)


def score_tier(score: Column) -> Column:
    return F.when(score >= TIER_HIGH, "high").when(score >= TIER_MEDIUM, "medium").otherwise("low")


def bar_tier(count: Column, peak: Column) -> Column:
    return F.when(count == 0, "none").when(count == peak, "peak").otherwise("other")


def status(flag: Column) -> Column:
    return F.when(flag, "ANOMALY").otherwise("Normal")


def fixed(value: Column, places: int) -> Column:
    """Text with a fixed number of decimals."""
    return F.format_string(f"%.{places}f", value)


def rupees(amount: Column) -> Column:
    """Rupee sign and Indian digit groups, two to three decimals: ₹1,23,456.50."""
    exact = F.abs(amount).cast("decimal(30,3)")
    text = exact.cast("string")
    whole = F.substring_index(text, ".", 1)
    thousands = F.regexp_replace(whole, r"(?<=\d)(?=(\d\d)*\d{3}$)", ",")
    decimals = F.regexp_replace(F.substring_index(text, ".", -1), r"0$", "")
    sign = F.when((amount < 0) & (exact > 0), "-").otherwise("")
    return F.concat(F.lit("₹"), sign, thousands, F.lit("."), decimals)


def order_number(position: Column) -> Column:
    """ORD-001, ORD-002, ...; longer numbers keep all digits."""
    return F.concat(F.lit("ORD-"), F.format_string("%03d", position))


def iso_text(ts: Column) -> Column:
    """ISO-8601 in UTC; the fraction is left out when it is zero."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.pmod(F.unix_micros(ts), F.lit(1_000_000))
    fraction = F.when(micros == 0, "").otherwise(F.format_string(".%06d", micros))
    return F.concat(whole, fraction, F.lit("+00:00"))
