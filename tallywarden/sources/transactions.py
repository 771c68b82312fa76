"""Transaction sources and sinks: Kafka, files, CSV."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywarden.operators.validate import decode_events

# Stream names.
TRANSACTIONS_TOPIC = "transactions"
SCORED_TOPIC = "scored-events"

MESSAGE = T.StructType(
    [T.StructField("seq", T.LongType()), T.StructField("key", T.StringType()), T.StructField("value", T.StringType())]
)


def kafka_source_options(servers: str, topic: str = TRANSACTIONS_TOPIC, max_per_batch: int | None = None) -> dict[str, str]:
    """Start at the newest offset; progress lives in the query's checkpoint, not in a consumer group."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "latest"}
    if max_per_batch:
        options["maxOffsetsPerTrigger"] = str(max_per_batch)
    return options


def kafka_sink_options(servers: str, topic: str = SCORED_TOPIC) -> dict[str, str]:
    return {
        "kafka.bootstrap.servers": servers,
        "topic": topic,
        "kafka.acks": "all",
        "kafka.retries": "3",
        "kafka.linger.ms": "5",
    }


def read_kafka(spark: SparkSession, servers: str, topic: str = TRANSACTIONS_TOPIC, max_per_batch: int | None = None) -> DataFrame:
    """Keyed messages of one topic. ``seq`` joins offset and partition into one unique number.

    A partition number of 4096 or more would make numbers collide: such a row is an error.
    """
    rows = spark.readStream.format("kafka").options(**kafka_source_options(servers, topic, max_per_batch)).load()
    return kafka_messages(rows)


def kafka_messages(rows: DataFrame) -> DataFrame:
    number = F.shiftleft(F.col("offset").cast("bigint"), 12) + F.col("partition")
    few = F.col("partition") < 4096
    return rows.select(
        F.when(few, number).otherwise(F.raise_error(F.lit("partition 4096 or above")).cast("bigint")).alias("seq"),
        F.col("key").cast("string").alias("key"),
        F.col("value").cast("string").alias("value"),
    )


def read_message_files(spark: SparkSession, path: str, max_files: int | None = 1) -> DataFrame:
    """The same messages from a folder of Parquet files that grows, as a stream."""
    reader = spark.readStream.schema(MESSAGE)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


_START = "modified timestamp, names array<string>"


def read_new_message_files(spark: SparkSession, path: str, start: str, max_files: int | None = 1) -> DataFrame:
    """As ``read_message_files``, but from the newest file on: what lay in the folder when the stream first began is left out.

    That place is kept in the small table ``start``, so a stream that is begun again goes on where its checkpoint says, and
    files that came while it was down are read. Older files are left out by their time, and files of the same time as the newest by name, so
    none of them is opened.
    """
    try:
        found = spark.read.schema(_START).parquet(start).first()
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        found = _newest_files(spark, path)
        found.coalesce(1).write.mode("overwrite").parquet(start)
        found = spark.read.schema(_START).parquet(start).first()
    rows = read_message_files(spark, path, max_files)
    if found.modified is None:
        return rows
    at = F.col("_metadata.file_modification_time")
    later = (at > F.lit(found.modified)) | ((at == F.lit(found.modified)) & ~F.col("_metadata.file_name").isin(found.names))
    return rows.where(later)


def _newest_files(spark: SparkSession, path: str) -> DataFrame:
    """One row: the time of the folder's newest file, and the names of the files of that time."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    there = [(f.getModificationTime(), f.getPath().getName()) for f in files.listStatus(place) if f.isFile()] if files.exists(place) else []
    newest = max((at for at, _ in there), default=None)
    row = spark.createDataFrame([(newest, [name for at, name in there if at == newest])], "ms bigint, names array<string>")
    return row.select(F.timestamp_millis("ms").alias("modified"), "names")


def transactions(messages: DataFrame) -> DataFrame:
    """Decoded transactions of a batch or a stream of messages, bad ones with a reason."""
    return decode_events(messages)


def without_repeats(decoded: DataFrame, delay_seconds: int = 600) -> DataFrame:
    """A stream of decoded transactions without those whose transaction id came before, off unless it is called.

    An id is remembered for ``delay_seconds`` after its arrival at least, then forgotten, so the state is bounded; a repeat that
    comes later passes. The arrival counts, not the event time: no event is ever too late for it, so none is lost.
    Messages without an id all pass.
    """
    named = F.coalesce(F.concat(F.lit("i"), F.col("transaction_id")), F.concat(F.lit("s"), F.col("seq").cast("string")))
    rows = decoded.withColumns({"_arrived": F.current_timestamp(), "_name": named}).withWatermark("_arrived", f"{int(delay_seconds)} seconds")
    return rows.dropDuplicatesWithinWatermark(["_name"]).drop("_arrived", "_name")


def replay(tx: DataFrame, count: int = 50) -> DataFrame:
    """The first ``count`` transactions in event order."""
    if int(count) < 1:
        raise ValueError("count must be positive")
    return tx.orderBy("us", "seq").limit(int(count))


def read_csv(spark: SparkSession, paths: str | list[str], schema: T.StructType | str) -> DataFrame:
    """CSV with a header from the first path that exists. No such path, or no rows, raises."""
    places = [paths] if isinstance(paths, str) else list(paths)
    for place in places:
        try:
            found = spark.read.option("header", True).schema(schema).csv(place)
        except AnalysisException as error:
            if "PATH_NOT_FOUND" in str(error):
                continue
            raise
        if found.isEmpty():
            raise ValueError(f"no rows in {place}")
        return found
    raise FileNotFoundError(f"no CSV at any of {places}")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def publish(messages: DataFrame, servers: str, topic: str = TRANSACTIONS_TOPIC) -> None:
    """Send key and value messages of a batch to Kafka."""
    messages.write.format("kafka").options(**kafka_sink_options(servers, topic)).save()


def write_json_lines(messages: DataFrame, path: str) -> None:
    """The message values, one JSON text per line."""
    messages.select("value").write.mode("overwrite").text(path)
