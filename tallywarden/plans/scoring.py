"""From transactions to scored, flagged and explained events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywarden.functions.explain import explain_flagged
from tallywarden.functions.message import with_transaction_id
from tallywarden.operators import forest as forests
from tallywarden.operators.features import features
from tallywarden.operators.ordered import HOT_ROWS
from tallywarden.operators.validate import rejected_rows, valid_rows, with_rejects_filled
from tallywarden.schemas import DEFAULT_THRESHOLD, DEFAULT_WINDOW_SECONDS
from tallywarden.session import cut_lineage


def judge(featured: DataFrame, forest: forests.Forest, threshold: float = DEFAULT_THRESHOLD, fill_missing: bool = False) -> DataFrame:
    """Score, flag and explain rows that have features.

    A row that cannot be scored is left out, or with ``fill_missing`` scored 0 and not flagged.
    """
    scored = forests.score(featured, forest)
    if fill_missing:
        scored = scored.fillna({"anomaly_score": 0.0})
        unscored = F.lit(False)
    else:
        unscored = F.col("anomaly_score").isNull()
    return forests.flag(scored.where(~unscored), threshold).withColumn("explanation", explain_flagged())


def score_transactions(
    tx: DataFrame,
    forest: forests.Forest,
    threshold: float = DEFAULT_THRESHOLD,
    window_seconds: int = DEFAULT_WINDOW_SECONDS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Features, score, flag and explanation of valid transactions."""
    return judge(features(tx, window_seconds, hot_rows=hot_rows), forest, threshold)


def features_with_policy(
    decoded: DataFrame, fill_missing: bool = False, window_seconds: int = DEFAULT_WINDOW_SECONDS, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Features of decoded events; rejected ones are left out or kept with zero features.

    Rejected rows never enter a user's running values. Where both kinds are read, the decoded rows
    are stored once instead of parsed again.
    """
    if fill_missing:
        decoded = cut_lineage(decoded.sparkSession, decoded)
    featured = features(valid_rows(decoded), window_seconds, hot_rows=hot_rows)
    return with_rejects_filled(featured, rejected_rows(decoded)) if fill_missing else featured


def score_messages(
    decoded: DataFrame,
    forest: forests.Forest,
    threshold: float = DEFAULT_THRESHOLD,
    fill_missing: bool = False,
    window_seconds: int = DEFAULT_WINDOW_SECONDS,
) -> DataFrame:
    """Decoded events, good and bad, to scored events; an event without an id gets one."""
    featured = with_transaction_id(features_with_policy(decoded, fill_missing, window_seconds))
    return judge(featured, forest, threshold, fill_missing)
