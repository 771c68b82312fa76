"""Reasons in words for a flagged transaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallywarden.schemas import AMOUNT, COUNT, MEAN, SINCE

# Texts and limits of the reasons.
GAP_VERY_SMALL, GAP_SMALL, GAP_VERY_LONG = 5.0, 30.0, 3600.0
COUNT_HIGH, COUNT_ELEVATED = 5, 3
DEVIATION_LARGE, DEVIATION_NOTABLE = 3.0, 1.0
AMOUNT_VERY_LARGE, AMOUNT_LARGE = 50000.0, 5000.0
TEXT_GAP_VERY_SMALL = "very small time_since_last_transaction_seconds"
TEXT_GAP_SMALL = "small time_since_last_transaction_seconds"
TEXT_GAP_VERY_LONG = "very long time_since_last_transaction_seconds"
TEXT_COUNT_HIGH = "unusually high transaction_count_last_1_min"
TEXT_COUNT_ELEVATED = "elevated transaction_count_last_1_min"
TEXT_DEVIATION_LARGE = "large deviation between transaction_amount and rolling_mean_amount_per_user"
TEXT_DEVIATION_NOTABLE = "notable deviation between transaction_amount and rolling_mean_amount_per_user"
TEXT_AMOUNT_VERY_LARGE = "very large transaction_amount"
TEXT_AMOUNT_LARGE = "large transaction_amount"
TEXT_OTHER = "anomalous pattern detected"


def _known(name: str) -> Column:
    """The column, with NaN read as null: Spark orders NaN above every number."""
    return F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double"))


def explanations() -> Column:
    """Ordered list of reasons from the four feature columns; never empty."""
    gap, count, mean, amount = _known(SINCE), F.col(COUNT), _known(MEAN), _known(AMOUNT)
    by_gap = (
        F.when(gap <= GAP_VERY_SMALL, TEXT_GAP_VERY_SMALL)
        .when(gap <= GAP_SMALL, TEXT_GAP_SMALL)
        .when(gap > GAP_VERY_LONG, TEXT_GAP_VERY_LONG)
    )
    by_count = F.when(count >= COUNT_HIGH, TEXT_COUNT_HIGH).when(count >= COUNT_ELEVATED, TEXT_COUNT_ELEVATED)
    deviation = F.abs(amount - mean) / mean
    relative = F.when(deviation > DEVIATION_LARGE, TEXT_DEVIATION_LARGE).when(
        deviation > DEVIATION_NOTABLE, TEXT_DEVIATION_NOTABLE
    )
    absolute = F.when(amount >= AMOUNT_VERY_LARGE, TEXT_AMOUNT_VERY_LARGE).when(amount >= AMOUNT_LARGE, TEXT_AMOUNT_LARGE)
    by_amount = F.when((mean > 0) & amount.isNotNull(), relative).otherwise(absolute)
    found = F.array_compact(F.array(by_gap, by_count, by_amount))
    return F.when(F.size(found) == 0, F.array(F.lit(TEXT_OTHER))).otherwise(found)


def explain_flagged(flag: str = "is_anomaly") -> Column:
    """Reasons for flagged rows, an empty list for all others."""
    return F.when(F.col(flag), explanations()).otherwise(F.array().cast("array<string>"))
