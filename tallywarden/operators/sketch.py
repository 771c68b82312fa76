"""A cut-off that grows with the data: one quantile sketch per day or batch, merged when it is asked for."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SKETCHES = "day date, scores bigint, sketch binary"
#: Size of a sketch: about 3 x 8 bytes for each, whatever it holds.
SIZE = 8000


def rank_error(size: int = SIZE) -> float:
    """How far the rank of a quantile may be off, as a share of all rows, at 99 % confidence (the published fit for KLL sketches)."""
    return 2.296 / size**0.9021


class ScoreSketches:
    """Sketches of scores below one folder: a version (day or micro-batch) reads its own rows only.

    A version that is added again replaces itself. Scores that are null or NaN are left out.
    """

    def __init__(self, spark: SparkSession, path: str, size: int = SIZE):
        if not 8 <= size <= 65535:
            raise ValueError("size must be in 8..65535")
        self.spark, self.path, self.size = spark, path, size

    def add(self, scored: DataFrame, version: int, score: str = "anomaly_score", ts: str = "ts") -> None:
        """Sketch the scores of each day of ``scored``; parts are combined before the shuffle, so a hot day is many tasks' work."""
        rows = scored.select(F.to_date(ts).alias("day"), F.nanvl(F.col(score).cast("double"), F.lit(None).cast("double")).alias("x")).where("x IS NOT NULL")
        made = rows.groupBy("day").agg(F.count("*").alias("scores"), F.kll_sketch_agg_double("x", self.size).alias("sketch"))
        made.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/v{version}")

    def sketches(self) -> DataFrame:
        """Rows (day, scores, sketch) of all versions; a day may have several."""
        try:
            return self.spark.read.schema(_SKETCHES).option("recursiveFileLookup", True).parquet(self.path)
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], _SKETCHES)

    def threshold(self, share: float = 0.01, since: str | None = None) -> DataFrame:
        """One row (threshold, scores): the score that the share of all rows (of days from ``since`` on) reach; null without any.

        Its rank is off by ``rank_error`` of all rows at most, at 99 % confidence.
        """
        if not 0 < share < 1:
            raise ValueError("share must be in (0, 1)")
        rows = self.sketches() if since is None else self.sketches().where(F.col("day") >= F.lit(since).cast("date"))
        whole = rows.agg(F.sum("scores").alias("scores"), F.kll_merge_agg_double("sketch").alias("sketch"))
        found = F.when(F.col("scores") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(1 - share)))
        return whole.select(found.alias("threshold"), F.coalesce("scores", F.lit(0)).alias("scores"))
