"""Three append-only tables of processed events and the queries over them."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from datetime import date, datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywarden.functions.parse import iso_or, json_or_raw
from tallywarden.schemas import ANOMALIES, FEATURE_ROWS, FEATURES, RAW_EVENTS
from tallywarden.session import cut_lineage

TABLES = {"raw_events": RAW_EVENTS, "features": FEATURE_ROWS, "anomalies": ANOMALIES}
#: Requests up to this many rows pick their ids first; larger ones join first.
PICKED = 1000
DEFAULT_LIMIT = 100
#: Folders of one table that such a request opens at most; if the newest days have more, whole tables are read.
PARTS = 1000
COMMITS = "batch_id bigint, attempt string, number bigint, processed_date date, rows bigint"
#: Commits after which they are written together.
MERGE_EVERY = 64


class Store:
    """Parquet tables below one folder, laid out as batch_id=.../attempt=.../processed_date=....

    Every attempt at a batch writes folders of its own, and when all three tables are written one small
    table in ``commits``: a row per day with its number of records. Readers see the last committed attempt of each
    batch, by the number of the commit: a batch appears in all tables at once or not at all, and a repeated one replaces
    the former without a gap. Every 64 commits they are written together, the last attempts only. Folders of
    other attempts can be deleted when no reader is left that began before. One job writes to a store at a time. ``seq`` is the id
    of the event in all three tables.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def init(self) -> None:
        """Create the tables; existing ones stay as they are."""
        for name, schema in TABLES.items():
            self.spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{self.path}/{name}")

    def table(self, name: str) -> DataFrame:
        """The committed rows of a table, empty when nothing has been stored yet."""
        parts = [T.StructField("batch_id", T.LongType()), T.StructField("attempt", T.StringType()), T.StructField("processed_date", T.DateType())]
        rows = self._read(name, T.StructType([*TABLES[name].fields, *parts]))
        last = self.commits().groupBy("batch_id", "attempt").agg(F.max("number").alias("number")).select("batch_id", "attempt")
        return rows.join(last, ["batch_id", "attempt"]).select(*[f.name for f in TABLES[name].fields], "batch_id", "processed_date")

    def _read(self, name: str, schema: T.StructType | str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], schema)

    def commits(self) -> DataFrame:
        """Rows (batch_id, attempt, number, processed_date, rows) of the last attempt of each batch."""
        paths, _ = self._commit_folders()
        if not paths:
            return self.spark.createDataFrame([], COMMITS)
        rows = self.spark.read.schema(COMMITS).parquet(*paths).coalesce(1)  # a row per batch and day: no shuffle is worth it
        last = F.max("number").over(Window.partitionBy("batch_id"))
        return rows.withColumn("last", last).where("number = last").select("batch_id", "attempt", "number", "processed_date", "rows")

    def _commit_folders(self) -> tuple[list[str], int]:
        """Folders that hold the commits, from the last merged one on; and the number of the next commit."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        files = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in files.listStatus(place)] if files.exists(place) else []
        done = [n for n in names if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits/{n}/_SUCCESS"))]
        base = max((int(n[3:]) for n in done if n.startswith("all")), default=-1)
        later = sorted(int(n[1:]) for n in done if n.startswith("c") and int(n[1:]) > base)
        numbers = [f"c{n}" for n in later]
        return [f"{self.path}/commits/{n}" for n in ([f"all{base}"] if base >= 0 else []) + numbers], max([base, *later], default=-1) + 1

    def append(self, scored: DataFrame, batch_id: int = 0) -> None:
        """Store scored events (needs seq, event, ts, features, score, flag, processed_ts).

        The input is read once per table: give a stored frame rather than a long plan.
        """
        self.write(self.frames(scored), batch_id)

    def frames(self, scored: DataFrame) -> dict[str, DataFrame]:
        """The rows of the three tables."""
        day = F.to_date("processed_ts").alias("processed_date")
        return {
            "raw_events": scored.select(
                F.col("seq").alias("id"),
                F.coalesce(F.col("transaction_id"), F.lit("None")).alias("transaction_id"),
                F.coalesce(F.col("event"), F.lit("{}")).alias("event_json"),
                F.col("ts").alias("timestamp"),
                day,
            ),
            "features": scored.select(
                F.col("seq").alias("id"),
                F.col("seq").alias("raw_event_id"),
                F.to_json(F.struct(*FEATURES)).alias("features_json"),
                F.col("processed_ts").alias("timestamp"),
                day,
            ),
            "anomalies": scored.select(
                F.col("seq").alias("id"),
                F.col("seq").alias("raw_event_id"),
                "anomaly_score",
                "is_anomaly",
                F.col("processed_ts").alias("processed_timestamp"),
                day,
            ),
        }

    def write(self, frames: dict[str, DataFrame], batch_id: int = 0) -> None:
        """Write a batch's rows of the three tables, then commit them together."""
        attempt = uuid.uuid4().hex

        def one(item: tuple[str, DataFrame]) -> None:
            name, frame = item
            # Rebalancing gathers a day's rows and splits large days: few files of even size.
            target = f"{self.path}/{name}/batch_id={batch_id}/attempt={attempt}"
            frame.hint("rebalance", "processed_date").write.partitionBy("processed_date").parquet(target)

        with ThreadPoolExecutor(len(frames)) as pool:  # three independent jobs
            list(pool.map(one, frames.items()))
        folders, number = self._commit_folders()
        days = frames["anomalies"].groupBy("processed_date").agg(F.count("*").alias("rows"))
        # A batch without rows commits as well: it may replace one that had some.
        days = days.unionByName(self.spark.createDataFrame([(None, 0)], "processed_date date, rows bigint"))
        done = days.select(F.lit(int(batch_id)).cast("bigint").alias("batch_id"), F.lit(attempt).alias("attempt"), F.lit(number).cast("bigint").alias("number"), "processed_date", "rows")
        done.coalesce(1).write.parquet(f"{self.path}/commits/c{number}")
        if len(folders) >= MERGE_EVERY:
            self.commits().coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/all{number}")
            self._forget(number)

    def _forget(self, number: int) -> None:
        """Delete commits that a merged one before the newest holds as well: a reader that began before the merge still finds its own."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        files = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in files.listStatus(place)]
        merged = sorted(int(n[3:]) for n in names if n.startswith("all"))
        before = merged[-2] if len(merged) > 1 else -1
        for n in names:
            if int(n.lstrip("alc")) <= before and n != f"all{before}":
                files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits/{n}"), True)

    def newest_parts(self, limit: int, since: date | None = None) -> list[Row] | None:
        """Commit rows of the newest days that hold ``limit`` records, or of all days from ``since`` on; None if that is no short list.

        Records without a processing time have no day and come last. One pass over the commits, none over the tables.
        """
        rows = self.commits().where("rows > 0")
        if since is not None:
            rows = rows.where(F.col("processed_date") >= F.lit(since))
        rows = rows.orderBy(F.desc_nulls_last("processed_date")).limit(PARTS + 1).collect()
        days: dict[date | None, list[Row]] = {}
        for row in rows:
            days.setdefault(row.processed_date, []).append(row)
        found: list[Row] = []
        whole = list(days.items()) if len(rows) <= PARTS else list(days.items())[:-1]  # the last day may have more rows
        for _, some in whole:
            found += some
            if since is None and sum(r.rows for r in found) >= limit:
                return found
        return found if len(rows) <= PARTS else None

    def part(self, name: str, rows: list[Row]) -> DataFrame:
        """The records of some commit rows: their folders are opened, no other is listed."""
        if not rows:
            return self.table(name).where("false")
        days = ["__HIVE_DEFAULT_PARTITION__" if r.processed_date is None else r.processed_date.isoformat() for r in rows]
        paths = [f"{self.path}/{name}/batch_id={r.batch_id}/attempt={r.attempt}/processed_date={day}" for r, day in zip(rows, days)]
        parts = [T.StructField("batch_id", T.LongType()), T.StructField("attempt", T.StringType()), T.StructField("processed_date", T.DateType())]
        reader = self.spark.read.schema(T.StructType([*TABLES[name].fields, *parts])).option("basePath", f"{self.path}/{name}")
        try:
            return reader.parquet(*paths).select(*[f.name for f in TABLES[name].fields], "batch_id", "processed_date")
        except AnalysisException as error:  # a table that lacks a day of the anomalies
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.table(name)

    def recent(self, limit: int = DEFAULT_LIMIT, since: datetime | str | None = None) -> DataFrame:
        """The newest records by processing time, optionally only from ``since`` on.

        For up to 1000 rows the commits say which folders hold the newest days; only these are opened, the newest ids are
        picked, and their events and features read. Should one of them lack its event or features, or for more rows, the tables are joined
        before the cut. An id stored in two batches is two records.
        """
        if int(limit) < 1:
            raise ValueError("limit must be positive")
        moment = None if since is None else parse_since(since)
        if limit <= PICKED and (parts := self.newest_parts(int(limit), None if moment is None else moment.date())) is not None:
            anomalies = _since(self.part("anomalies", parts), moment)
            picked = _newest(anomalies, limit).collect()
            if not picked:
                return _shaped(self._joined(*[self.table(name).where("false") for name in ("anomalies", "raw_events", "features")]))
            top = self.spark.createDataFrame(picked, anomalies.schema)
            taken = {(r.batch_id, r.processed_date) for r in picked}
            parts = [p for p in parts if (p.batch_id, p.processed_date) in taken]
            ids = [r.raw_event_id for r in picked]
            found = self._joined(
                F.broadcast(top),  # at most PICKED rows
                self.part("raw_events", parts).where(F.col("id").between(min(ids), max(ids))),
                self.part("features", parts).where(F.col("raw_event_id").between(min(ids), max(ids))),
            )
            rows = found.collect()  # no more than were picked
            if len(rows) == len(picked):
                return _shaped(_newest(self.spark.createDataFrame(rows, found.schema), limit))
        whole = _since(self.table("anomalies"), moment)
        return _shaped(_newest(self._joined(whole, self.table("raw_events"), self.table("features")), limit))

    def _joined(self, anomalies: DataFrame, raw: DataFrame, features: DataFrame) -> DataFrame:
        keep = ["batch_id", "id", "raw_event_id", "anomaly_score", "is_anomaly", "processed_timestamp"]
        events = raw.select("batch_id", F.col("id").alias("raw_event_id"), "event_json")
        values = features.select("batch_id", "raw_event_id", "features_json")
        return anomalies.select(keep).join(events, ["batch_id", "raw_event_id"]).join(values, ["batch_id", "raw_event_id"])

    def orphans(self) -> DataFrame:
        """Rows of features and anomalies without their raw event."""
        raw = self.table("raw_events").select(F.col("id").alias("raw_event_id"))
        parts = [
            self.table(name).select(F.lit(name).alias("table_name"), "id", "raw_event_id").join(raw, "raw_event_id", "left_anti")
            for name in ("features", "anomalies")
        ]
        return parts[0].unionByName(parts[1])


def parse_since(since: datetime | str) -> datetime:
    """A time as given or as ISO-8601 text; without an offset it is UTC. Bad text raises."""
    moment = since if isinstance(since, datetime) else datetime.fromisoformat(since)
    return moment.replace(tzinfo=timezone.utc) if moment.tzinfo is None else moment.astimezone(timezone.utc)


def _newest(df: DataFrame, limit: int) -> DataFrame:
    return first_rows(df, int(limit), F.desc("processed_timestamp"), F.desc("id"))


def first_rows(df: DataFrame, limit: int, *order: Column) -> DataFrame:
    """The first ``limit`` rows in the given order, sorted.

    Up to 1000 rows one task gathers those of all others. More are range-sorted and stored, and the counts of the ranges say which of
    them are whole and where the last one is cut, so that no task holds more than a range, however large the limit.
    """
    if limit <= PICKED:
        return df.orderBy(*order).limit(limit)
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = placed.withColumn("_range", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    rows = cut_lineage(df.sparkSession, numbered)
    counts = sorted((r._range, r.n) for r in rows.groupBy("_range").agg(F.count("*").alias("n")).collect())  # one row per range
    left = limit
    for place, count in counts:
        if count >= left:
            rows = rows.where((F.col("_range") < place) | (F.col("_range") == place) & (F.col("_at") < left))
            break
        left -= count
    return rows.drop("_range", "_at")


def _since(anomalies: DataFrame, moment: datetime | None) -> DataFrame:
    if moment is None:
        return anomalies
    return anomalies.where((F.col("processed_timestamp") >= F.lit(moment)) & (F.col("processed_date") >= F.lit(moment.date())))


def _shaped(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("id").alias("anomaly_row_id"),
        F.col("anomaly_score").cast("double").alias("anomaly_score"),
        F.coalesce(F.col("is_anomaly"), F.lit(False)).alias("is_anomaly"),
        "processed_timestamp",
        json_or_raw(F.col("event_json")).alias("event"),
        json_or_raw(F.col("features_json")).alias("features"),
    )


def live_rows(history: DataFrame) -> DataFrame:
    """History records in the shape of live rows, with defaults for what is missing.

    ``ts`` is the event's own time, as it is for live rows (the processing time where the event has none).
    """
    event = F.col("event")
    return history.select(
        F.col("anomaly_row_id").alias("seq"),
        F.coalesce(F.try_variant_get(event, "$.transaction_id", "string"), F.col("anomaly_row_id").cast("string")).alias(
            "transaction_id"
        ),
        F.coalesce(F.try_variant_get(event, "$.user_id", "string"), F.lit("unknown")).alias("user_id"),
        F.coalesce(F.try_variant_get(event, "$.amount", "double"), F.lit(0e0)).alias("amount"),
        iso_or(F.try_variant_get(event, "$.timestamp", "string"), F.col("processed_timestamp")).alias("ts"),
        F.col("processed_timestamp").alias("processed_ts"),
        "anomaly_score",
        "is_anomaly",
        F.array().cast("array<string>").alias("explanation"),
    )


def union_live(history: DataFrame, live: DataFrame, rows: int | None = 50) -> DataFrame:
    """History rows, then live rows, nothing removed; the newest ``rows`` (None keeps all)."""
    columns = ["seq", "transaction_id", "user_id", "amount", "ts", "processed_ts", "anomaly_score", "is_anomaly", "explanation"]
    past = live_rows(history).withColumn("origin", F.lit(0))
    both = past.unionByName(live.select(*columns).withColumn("origin", F.lit(1)))
    if rows is None:
        return both
    return first_rows(both, rows, F.desc("origin"), F.desc("ts"), F.desc("seq"))
