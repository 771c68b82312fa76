"""Features of new transactions from the stored state of all earlier ones: history is not read again.

The state of a user is what the next row needs: rows and total so far, the last time, the highest time, and the times
that are still inside the window. It lies in Parquet tables, one version per day or micro-batch, so a batch job, a
stream and a reader of profiles share it.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywarden.operators.features import seconds_from_micros
from tallywarden.operators.ordered import HOT_ROWS, hot_keys, running, with_key
from tallywarden.schemas import AMOUNT, COUNT, DEFAULT_WINDOW_SECONDS, MEAN, MICROS, SINCE
from tallywarden.session import cut_lineage

_USERS = "user_id string, n bigint, total double, last bigint, peak bigint, version bigint"
_RECENT = "user_id string, at bigint, version bigint"
_COMMITS = "version bigint, base bigint, newest bigint"
#: Versions after which all users are written together, so that a reader never opens more.
MERGE_EVERY = 16


class FeatureState:
    """State of all users below one folder.

    ``users`` and ``recent`` hold, per version, the users that had rows in it; every ``merge_every`` versions all users are
    written and older versions are no longer read. ``commits`` says which versions are whole. A version that is
    written again (a retry) replaces itself: it depends on the versions before only.

    With ``ttl_seconds`` users whose highest time is longer ago than that, seen from the newest time of all, are left
    out when versions are merged; one who returns later starts anew.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        window_seconds: int = DEFAULT_WINDOW_SECONDS,
        ttl_seconds: int | None = None,
        merge_every: int = MERGE_EVERY,
        hot_rows: int = HOT_ROWS,
    ):
        if window_seconds <= 0 or merge_every < 1:
            raise ValueError("window_seconds and merge_every must be positive")
        if ttl_seconds is not None and ttl_seconds < window_seconds:
            raise ValueError("ttl_seconds must not be shorter than the window")
        self.spark, self.path, self.hot_rows = spark, path, hot_rows
        self.window_us, self.merge_every = int(window_seconds * MICROS), merge_every
        self.ttl_us = None if ttl_seconds is None else int(ttl_seconds * MICROS)

    def advance(self, tx: DataFrame, version: int, stored: bool = False) -> DataFrame:
        """The rows of ``tx`` (user_id, amount, us, seq not null) with the four features and ``is_late``; the state after them is ``version``.

        Rows are taken in event order. A row older than one of an earlier version is late: it follows in arrival
        order (its gap is negative), and rows of the window stay until all that arrived before them have left.
        A user with more than ``hot_rows`` rows is cut into ranges that start from the totals before them, so it is many
        tasks' work; only the users of ``tx`` are looked up. The result is stored until the next version but one: reading it costs
        nothing again. ``tx`` is stored first as well, unless it is ``stored`` already.
        """
        done = self._commit(version)
        rows = tx if stored else cut_lineage(self.spark, tx)
        # No user has more rows than there are.
        hot = None if rows.count() <= self.hot_rows else hot_keys(rows, "user_id", self.hot_rows)
        if done is None:
            nothing = {f"{c}0": F.lit(None).cast(t) for c, t in (("n", "bigint"), ("total", "double"), ("last", "bigint"), ("peak", "bigint"))}
            both = rows.withColumns(nothing | {"waits": F.lit(None).cast("bigint"), "at": F.col("us"), "phase": F.lit(1)})
        else:
            before = self._users(done).join(rows.select("user_id").distinct(), "user_id", "left_semi")
            waiting = self._recent(done, before).select("user_id", "at")
            waits = waiting.groupBy("user_id").agg(F.count("*").alias("waits"))
            known = before.select("user_id", *[F.col(c).alias(f"{c}0") for c in ("n", "total", "last", "peak")]).join(waits, "user_id", "left")
            placed = with_key(rows, known, "user_id", hot).withColumns({"at": F.greatest("us", "peak0"), "phase": F.lit(1)})
            both = placed.unionByName(waiting.withColumn("phase", F.lit(0)), allowMissingColumns=True)
        both = both.withColumns({"place": F.struct("phase", "us", "seq"), "value": F.when(F.col("phase") == 1, F.col("amount").cast("double")).otherwise(0.0)})
        scanned = running(both, "user_id", us="at", seq="place", amount="value", window_us=self.window_us, hot_rows=self.hot_rows, previous="us", hot=hot)
        whole = scanned.withColumns(
            {
                "n": F.col("run_count") + F.coalesce("n0", F.lit(0)) - F.coalesce("waits", F.lit(0)),
                "total": F.col("run_sum") + F.coalesce("total0", F.lit(0.0)),
                "prev_us": F.coalesce("prev_us", "last0"),
            }
        )
        target = f"{self.path}/work/v{version}"
        whole.drop("value", "run_count", "run_sum", "waits", "n0", "total0", "last0").write.mode("overwrite").parquet(target)
        whole = self.spark.read.parquet(target)
        self._write(whole, version, done, hot)
        return whole.where("phase = 1").withColumns(
            {
                AMOUNT: F.col("amount").cast("double"),
                MEAN: F.col("total") / F.col("n"),
                COUNT: F.col("window_count"),
                SINCE: F.coalesce(seconds_from_micros(F.col("us") - F.col("prev_us")), F.lit(0e0)),
                "is_late": F.coalesce(F.col("us") < F.col("peak0"), F.lit(False)),
            }
        ).select(*tx.columns, AMOUNT, MEAN, COUNT, SINCE, "is_late")

    def profile(self) -> DataFrame:
        """Rows, total, mean and last time of every user: what ``user_profile`` gives over all rows of all versions."""
        users = self._users(self._commit())
        return users.select(
            "user_id", F.col("n").alias("tx_count"), F.col("total").alias("sum_amount"), (F.col("total") / F.col("n")).alias("mean_amount"),
            F.timestamp_micros("peak").alias("last_ts"),
        )

    def versions(self) -> tuple[int, int] | None:
        """The oldest version that is read, and the newest; None while there is none."""
        done = self._commit()
        return None if done is None else (done.base, done.version)

    def _commit(self, before: int | None = None):
        rows = self._read("commits", _COMMITS, None)
        if rows is None:
            return None
        rows = rows if before is None else rows.where(F.col("version") < before)
        return rows.orderBy(F.desc("version"), F.desc("base")).first()

    def _read(self, name: str, schema: str, done) -> DataFrame | None:
        """The commits (``done`` is None), or the versions that a commit says are to be read."""
        paths = [f"{self.path}/{name}"] if done is None else [f"{self.path}/{name}/v{n}" for n in range(done.base, done.version + 1)]
        found = []
        for path in paths:
            try:
                found.append(self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path))
            except AnalysisException as error:  # a version that no job wrote: days or batches need not follow each other
                if "PATH_NOT_FOUND" not in str(error):
                    raise
        out = None
        for one in found:
            out = one if out is None else out.unionAll(one)
        return out

    def _users(self, done) -> DataFrame:
        rows = None if done is None else self._read("users", _USERS, done)
        if rows is None:
            return self.spark.createDataFrame([], _USERS)
        newest = F.max_by(F.struct("n", "total", "last", "peak", "version"), "version").alias("s")
        return rows.groupBy("user_id").agg(newest).select("user_id", "s.*")

    def _recent(self, done, users: DataFrame) -> DataFrame:
        """Times in the window of the given users: those of each one's newest version."""
        rows = None if done is None else self._read("recent", _RECENT, done)
        if rows is None:
            return self.spark.createDataFrame([], _RECENT)
        return rows.join(users.select("user_id", "version"), ["user_id", "version"], "left_semi")

    def _write(self, whole: DataFrame, version: int, done, hot: DataFrame | None) -> None:
        """The state after ``whole``: the users of this version, or all when versions are merged."""
        order = F.struct("at", "place")
        # The last row of phase 0 is no row of this version; a user is here only with a row of phase 1, which is the last.
        users = whole.groupBy("user_id").agg(F.max_by(F.struct("n", "total", "us"), order).alias("s"), F.max("at").alias("peak"))
        users = users.select("user_id", "s.n", "s.total", F.col("s.us").alias("last"), "peak").withColumn("version", F.lit(version).cast("bigint"))
        times = with_key(whole.select("user_id", "at"), users.select("user_id", "peak"), "user_id", hot).where(F.col("at") >= F.col("peak") - self.window_us)
        times = times.select("user_id", "at").withColumn("version", F.lit(version).cast("bigint"))
        base = version if done is None else done.base
        newest = users.agg(F.max("peak")).first()[0] if self.ttl_us is not None else None
        newest = max([x for x in (newest, None if done is None else done.newest) if x is not None], default=None)
        if done is not None and version - done.base >= self.merge_every:
            base = version
            earlier = self._users(done).join(users, "user_id", "left_anti")
            if self.ttl_us is not None and newest is not None:
                earlier = earlier.where(F.col("peak") >= newest - self.ttl_us)
            kept = self._recent(done, earlier).withColumn("version", F.lit(version).cast("bigint"))
            users = users.unionByName(earlier.withColumn("version", F.lit(version).cast("bigint")))
            times = times.unionByName(kept)
        with ThreadPoolExecutor(2) as pool:  # two independent jobs
            tables = {"users": users, "recent": times}
            list(pool.map(lambda item: item[1].write.mode("overwrite").parquet(f"{self.path}/{item[0]}/v{version}"), tables.items()))
        row = self.spark.createDataFrame([(int(version), int(base), newest)], _COMMITS)
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/v{version}")
        if done is not None:
            self._forget(("work",), done.version)
            if base == version:  # a retry of this version reads from the last merged one before on
                self._forget(("users", "recent", "commits"), done.base)

    def _forget(self, names: tuple[str, ...], base: int) -> None:
        """Delete versions below ``base``."""
        jvm = self.spark._jvm
        for name in names:
            place = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            files = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
            for found in files.listStatus(place):
                if int(found.getPath().getName()[1:]) < base:
                    files.delete(found.getPath(), True)

