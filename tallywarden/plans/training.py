"""From transactions to a saved forest."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallywarden.operators import forest as forests
from tallywarden.operators.features import training_features
from tallywarden.operators.validate import clean_training
from tallywarden.schemas import FEATURES


def train(tx: DataFrame, path: str | None = None, trees: int = forests.DEFAULT_TREES,
          sample_size: int = forests.DEFAULT_SAMPLE, seed: int = forests.DEFAULT_SEED) -> forests.Forest:
    """Features, cleaning, fit and, with a path, save. The model keeps the feature order."""
    clean = clean_training(training_features(tx), FEATURES)
    forest = forests.fit(clean, FEATURES, "seq", trees, sample_size, seed)
    if path:
        forests.save(tx.sparkSession, forest, path)
    return forest


def train_wide(df: DataFrame, features: list[str], row_id: str, trees: int = 100, seed: int = forests.DEFAULT_SEED) -> forests.Forest:
    """Fit on any numeric columns; the model is 100 trees by default."""
    return forests.fit(df, features, row_id, trees=trees, seed=seed)
