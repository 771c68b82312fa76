"""Streaming jobs. One job scores messages into a table; the others follow that table.

The scored table is written by the exactly-once file sink and plays the part of a topic:
history, alerts, figures and outgoing messages are separate queries that read it as a stream,
so a slow or failing one does not hold up scoring. Jobs that write per batch replace the
folder of their batch, which makes a retried batch harmless.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tallywarden.functions.message import scored_messages, with_transaction_id
from tallywarden.operators import kpis
from tallywarden.operators.alerts import UNKNOWN_USER, score_alerts
from tallywarden.operators.forest import Forest
from tallywarden.operators.history import Store
from tallywarden.operators.ordered import trailing_count
from tallywarden.operators.resume import FeatureState
from tallywarden.operators.validate import rejected_rows, valid_rows, with_rejects_filled
from tallywarden.plans.scoring import judge
from tallywarden.schemas import DEFAULT_THRESHOLD, DEFAULT_WINDOW_SECONDS, FEATURE_VECTOR, MICROS
from tallywarden.session import cut_lineage
from tallywarden.streaming.features import BUCKETS, features_stream

SCORED = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("transaction_id", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("event", T.StringType()),
        T.StructField("us", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        *FEATURE_VECTOR.fields,
        T.StructField("is_late", T.BooleanType()),
        T.StructField("anomaly_score", T.DoubleType()),
        T.StructField("is_anomaly", T.BooleanType()),
        T.StructField("explanation", T.ArrayType(T.StringType())),
        T.StructField("processed_ts", T.TimestampType()),
    ]
)
_ALERT = "alert_key string, seq bigint, user_id string, us bigint, ts timestamp, anomaly_score double"
_TAIL = f"{_ALERT}, seen_us bigint"
_MINUTES = "minute timestamp, total_events bigint, anomalies bigint, newest timestamp"
#: Batches after which closed minutes are written together.
MERGE_EVERY = 64
#: How much later than the newest event a late one may come and still find all its peers.
LATENESS_SECONDS = 600


def scored_stream(
    decoded: DataFrame,
    forest: Forest,
    threshold: float = DEFAULT_THRESHOLD,
    window_seconds: int = DEFAULT_WINDOW_SECONDS,
    fill_missing: bool = False,
    processed: Column | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Decoded messages to scored events, each with an id. Rejected rows never reach a user's state."""
    featured = features_stream(valid_rows(decoded), window_seconds, buckets)
    if fill_missing:
        featured = with_rejects_filled(featured, rejected_rows(decoded)).fillna({"is_late": False})
    judged = judge(featured, forest, threshold, fill_missing)
    stamped = judged.withColumn("processed_ts", F.current_timestamp() if processed is None else processed)
    return with_transaction_id(stamped).select(SCORED.fieldNames())


def write_scored(scored: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append scored events to a table, each exactly once."""
    writer = scored.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start(path)


def score_batches(
    decoded: DataFrame,
    forest: Forest,
    state: FeatureState,
    path: str,
    checkpoint: str,
    threshold: float = DEFAULT_THRESHOLD,
    fill_missing: bool = False,
    processed: Column | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """The scored table from features that start from stored state, batch by batch: a hot user's rows of a batch are many tasks' work.

    Each batch is one folder of the table (``scored_folders``) and one version of the state. A batch that is tried again
    computes the same state, and leaves its folder as it is once that is whole, so followers see each row once.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = cut_lineage(spark, batch)
        featured = state.advance(valid_rows(rows), batch_id, stored=True)
        target = f"{path}/batch-{batch_id:012d}"
        if _exists(spark, f"{target}/_SUCCESS"):
            return
        if fill_missing:
            featured = with_rejects_filled(featured, rejected_rows(rows)).fillna({"is_late": False})
        judged = judge(featured.withColumn("ts", F.timestamp_micros("us")), forest, threshold, fill_missing)
        stamped = judged.withColumn("processed_ts", F.current_timestamp() if processed is None else processed)
        with_transaction_id(stamped).select(SCORED.fieldNames()).write.mode("overwrite").parquet(target)

    return per_batch(decoded, handle, checkpoint, available_now=available_now)


def scored_folders(path: str) -> str:
    """The folders of a table that ``score_batches`` writes, for ``follow`` and for batch readers."""
    return f"{path}/batch-*"


def follow(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """The scored table as a stream."""
    reader = spark.readStream.schema(SCORED)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def per_batch(stream: DataFrame, handle, checkpoint: str, mode: str = "append", available_now: bool = True) -> StreamingQuery:
    writer = stream.writeStream.outputMode(mode).foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def persist(scored: DataFrame, store: Store, checkpoint: str, **options) -> StreamingQuery:
    """Keep the three history tables up to date."""
    store.init()
    return per_batch(scored, lambda batch, batch_id: store.append(batch, batch_id), checkpoint, **options)


def publish_files(scored: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Scored messages as JSON lines, each exactly once."""
    writer = (
        scored_messages(scored).select("value").writeStream.format("text").option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start(path)


def publish_kafka(scored: DataFrame, options: dict[str, str], checkpoint: str) -> StreamingQuery:
    """Scored messages to a topic, keyed by user."""
    return (
        scored_messages(scored).writeStream.format("kafka").options(**options).option("checkpointLocation", checkpoint).start()
    )


def score_alert_stream(scored: DataFrame, path: str, checkpoint: str, threshold: float, trigger: str = "above") -> StreamingQuery:
    """Score alerts need no state: a filter."""
    writer = score_alerts(scored, threshold, trigger).writeStream.format("parquet")
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def rate_alert_stream(
    scored: DataFrame,
    path: str,
    checkpoint: str,
    limit: int = 10,
    window_seconds: int = 60,
    scope: str = "global",
    lateness_seconds: int = LATENESS_SECONDS,
    **options,
) -> StreamingQuery:
    """Rate alerts, global or per user, without sending all anomalies through one task.

    A batch counts its own anomalies together with earlier ones, which the batch before has left below
    ``path``/tail, with the same spread-out count as the batch form. An anomaly is left there until the
    newest event time is its window and ``lateness_seconds`` ahead; an event that comes later than that is
    counted with what is left. A time that lies after the event's own processing time
    (a wrong clock) raises no other event's age: it counts as the processing time there. An
    event without a time counts at its processing time. Alerts that were sent are not revised.
    """
    window_us = int(window_seconds) * MICROS
    keep_us = window_us + int(lateness_seconds) * MICROS
    columns = ["alert_key", "seq", "user_id", "us", "ts", "anomaly_score", "seen_us"]

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        key = F.lit("global") if scope == "global" else F.coalesce(F.col("user_id"), F.lit(UNKNOWN_USER))
        processed = F.unix_micros("processed_ts")
        flagged = batch.where("is_anomaly").withColumns(
            {
                "alert_key": key,
                "seen_us": F.when(F.col("ts").isNotNull(), F.least(F.unix_micros("ts"), processed)),
                "us": F.coalesce("us", processed),
                "fresh": F.lit(True),
            }
        )
        before = _read(spark, f"{path}/tail/batch_id={batch_id - 1}", _TAIL).withColumn("fresh", F.lit(False))
        near = cut_lineage(spark, flagged.select(*columns, "fresh").unionByName(before))
        newest = near.agg(F.max("seen_us")).first()[0]
        kept = near if newest is None else near.where(F.col("us") >= newest - keep_us)
        kept.select(columns).write.mode("overwrite").parquet(f"{path}/tail/batch_id={batch_id}")
        counted = trailing_count(near, None if scope == "global" else "alert_key", window_us)
        raised = counted.where(F.col("fresh") & (F.col("window_count") > int(limit)))
        raised.drop("fresh", "seen_us").write.mode("overwrite").parquet(f"{path}/alerts/batch_id={batch_id}")
        _remove(spark, f"{path}/tail/batch_id={batch_id - 2}")  # a retry needs the batch before only

    return per_batch(scored, handle, checkpoint, **options)


def rate_alerts_so_far(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, f"{path}/alerts", f"{_ALERT}, window_count bigint, batch_id bigint").drop("batch_id")


def minute_stream(
    scored: DataFrame, path: str, checkpoint: str, delay_seconds: int = LATENESS_SECONDS, merge_every: int = MERGE_EVERY, **options
) -> StreamingQuery:
    """Events and anomalies per event-time minute, with a bounded state.

    Minutes stay open until the newest event is ``delay_seconds`` past them: each batch adds its counts to the
    open minutes of the batch before and writes those that are left open, then forgets older versions. A minute that closes goes to
    a table of closed ones, which is merged every ``merge_every`` batches. An event that comes later than the delay is not
    lost: it is a further row of its closed minute, and rows of a minute are summed by readers. A time that lies after the event's own processing
    time (a wrong clock) closes no other minute. Events without a time are in no minute.
    """
    counts = [F.sum("total_events").alias("total_events"), F.sum("anomalies").alias("anomalies"), F.max("newest").alias("newest")]

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen = F.least("ts", F.coalesce("processed_ts", "ts"))
        own = batch.where("ts IS NOT NULL").groupBy(F.date_trunc("minute", "ts").alias("minute")).agg(
            F.count("*").alias("total_events"), F.count_if("is_anomaly").alias("anomalies"), F.max(seen).alias("newest")
        )
        open_before = _version(spark, f"{path}/open", _MINUTES, batch_id - 1)
        both = cut_lineage(spark, own.unionByName(open_before).groupBy("minute").agg(*counts))  # one row per open minute
        newest = both.agg(F.max("newest")).first()[0]
        past = F.col("minute") < F.date_trunc("minute", F.lit(newest) - F.expr(f"INTERVAL {int(delay_seconds)} SECONDS"))
        closed = both.where(F.coalesce(past, F.lit(False)))
        still = both.where(~F.coalesce(past, F.lit(False)))
        if newest is not None:  # the newest time is known even if no minute is left open
            still = still.withColumn("newest", F.lit(newest))
        merged, base = _merged(spark, f"{path}/closed", batch_id)
        if batch_id - base >= merge_every:
            closed = merged.unionByName(closed).groupBy("minute").agg(*counts)
            closed.write.mode("overwrite").parquet(f"{path}/closed/all{batch_id}")
        else:
            closed.write.mode("overwrite").parquet(f"{path}/closed/v{batch_id}")
        still.write.mode("overwrite").parquet(f"{path}/open/v{batch_id}")
        _forget(spark, f"{path}/open", batch_id - 1)  # a retry needs the batch before only
        if batch_id - base >= merge_every:
            _forget(spark, f"{path}/closed", base)  # and the merged table before

    return per_batch(scored, handle, checkpoint, **options)


def _merged(spark: SparkSession, path: str, before: int) -> tuple[DataFrame, int]:
    """The closed minutes of the batches below ``before``, and the batch up to which they are merged (-1: none)."""
    names = [n for n in _folders(spark, path) if int(n.lstrip("alv")) < before]
    base = max([int(n[3:]) for n in names if n.startswith("all")], default=-1)
    wanted = [n for n in names if n == f"all{base}" or n.startswith("v") and int(n[1:]) > base]
    if not wanted:
        return spark.createDataFrame([], _MINUTES), base
    return spark.read.schema(_MINUTES).parquet(*[f"{path}/{n}" for n in wanted]), base


def minutes_so_far(spark: SparkSession, path: str) -> DataFrame:
    """The counts of every minute: the current version of the open ones, and the closed ones."""
    newest = max([int(n[1:]) for n in _folders(spark, f"{path}/open")], default=-1)
    rows = _merged(spark, f"{path}/closed", newest + 1)[0].unionByName(_version(spark, f"{path}/open", _MINUTES, newest))
    return rows.groupBy("minute").agg(F.sum("total_events").alias("total_events"), F.sum("anomalies").alias("anomalies"))


def totals_so_far(spark: SparkSession, path: str) -> DataFrame:
    """Totals, rate and risk over all minutes seen."""
    sums = minutes_so_far(spark, path).agg(
        F.coalesce(F.sum("total_events"), F.lit(0)).alias("total_events"),
        F.coalesce(F.sum("anomalies"), F.lit(0)).alias("anomalies"),
    )
    return kpis.with_rate(sums)


def live_view(scored: DataFrame, path: str, checkpoint: str, rows: int = kpis.BUFFER_ROWS, **options) -> StreamingQuery:
    """Keep the newest rows: each batch merges its newest with those of the batch before, whose version is then forgotten by the next."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = _version(spark, path, SCORED, batch_id - 1)
        both = batch.unionByName(before).orderBy(F.desc("us"), F.desc("seq")).limit(rows)
        both.write.mode("overwrite").parquet(f"{path}/v{batch_id}")
        _forget(spark, path, batch_id - 1)

    return per_batch(scored, handle, checkpoint, **options)


def live_rows_now(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the newest batch; no other version is opened."""
    return _version(spark, path, SCORED, max([int(n[1:]) for n in _folders(spark, path)], default=-1))


def _version(spark: SparkSession, path: str, schema: T.StructType | str, number: int) -> DataFrame:
    return _read(spark, f"{path}/v{number}", schema)


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the whole tables below a folder: those that their job has marked as done."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(place):
        return []
    names = [f.getPath().getName() for f in files.listStatus(place)]
    return [n for n in names if _exists(spark, f"{path}/{n}/_SUCCESS")]


def _forget(spark: SparkSession, path: str, below: int) -> None:
    """Delete the versions below a number."""
    for name in _folders(spark, path):
        if int(name.lstrip("alv")) < below:
            _remove(spark, f"{path}/{name}")


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it lies; nothing happens if it is not there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _read(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)
