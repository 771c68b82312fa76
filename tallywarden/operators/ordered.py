"""Running and trailing values per key, in event order, safe against hot keys.

A key whose rows fit one task is computed with plain window functions: one exchange on
the key and one sort serve every value. A key with more rows than ``hot_rows`` would pin
one task, so its rows are cut into chunks that are ranges of (key, time, seq); each chunk
is computed on its own and starts from the totals of the chunks before it. Ranges are
drawn over the whole sort key, so many rows of one key, one day or even one instant are
still spread evenly.

``seq`` is the arrival position: unique, BIGINT, ordering rows that share a timestamp.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallywarden.session import cut_lineage

HOT_ROWS = 4_000_000
FEW_CHUNKS = 50_000
#: A chunk has so many rows at least, once there are so many for each shuffle partition (more than one, as they are dealt by a hash):
#: a small ``hot_rows`` on a large table makes no more tasks.
CHUNK_ROWS, CHUNKS_EACH = 100_000, 8
#: Hot keys that are held by the driver and sent to all rows; more of them are a stored table.
FEW_KEYS = 100_000


def hot_keys(df: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """Keys with more than ``hot_rows`` rows and their counts, or None when there are none.

    Counts combine on the map side. Fewer than rows/hot_rows keys can qualify; more than ``FEW_KEYS`` (a small
    ``hot_rows`` on a large table) are stored instead of passing through the driver.
    """
    counted = df.groupBy(key).agg(F.count("*").alias("rows")).where(F.col("rows") > hot_rows)
    found = counted.limit(FEW_KEYS + 1).collect()
    if not found:
        return None
    if len(found) > FEW_KEYS:
        return cut_lineage(df.sparkSession, counted)
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, rows bigint"
    return df.sparkSession.createDataFrame([(r[0], r[1]) for r in found], schema)


def with_key(df: DataFrame, one: DataFrame, key: str, hot: DataFrame | None) -> DataFrame:
    """Left join with one row per key; the rows of ``hot`` keys stay where they are, their few partners are sent to them.

    Of more than ``FEW_KEYS`` hot keys that holds for the largest; each of the others has less than rows / ``FEW_KEYS`` rows.
    """
    if hot is None:
        return df.join(one, key, "left")
    if hot.count() > FEW_KEYS:
        hot = hot.orderBy(F.desc("rows"), key).limit(FEW_KEYS)
    names = F.broadcast(hot.select(key))
    spread = df.join(names, key, "left_semi").join(F.broadcast(one.join(names, key, "left_semi")), key, "left")
    return df.join(names, key, "left_anti").join(one, key, "left").unionByName(spread)


def running(
    df: DataFrame,
    key: str | None,
    us: str = "us",
    seq: str = "seq",
    amount: str | None = None,
    window_us: int | None = None,
    hot_rows: int = HOT_ROWS,
    previous: str | None = None,
    hot: DataFrame | None | str = "count",
) -> DataFrame:
    """Add ``run_count``, ``prev_us`` and, when asked for, ``run_sum`` and ``window_count``.

    All values include the current row except ``prev_us``, the value of ``previous`` (``us``) in the row before. ``window_count`` counts rows of
    the key that arrived so far with time in [us - window_us, us], both ends inclusive.
    ``key=None`` treats the whole table as one key. Keys must not be null. ``hot`` is what ``hot_keys`` gave, where the
    caller knows it: then no job runs while the frame is built.
    """
    if key is None:
        whole = df.withColumn("_all", F.lit(0))
        return _chunked(whole, "_all", us, seq, amount, window_us, None, previous).drop("_all")
    if isinstance(hot, str):
        hot = hot_keys(df, key, hot_rows)
    if hot is None:
        return _windowed(df, key, us, seq, amount, window_us, previous)
    keys, hot_total = hot.agg(F.count("*"), F.sum("rows")).first()
    names = hot.select(key)  # Spark sends it whole only while it is small
    cold_rows = df.join(names, key, "left_anti").select(df.columns)
    hot_only = df.join(names, key, "left_semi").select(df.columns)
    most = max(CHUNKS_EACH * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), hot_total // CHUNK_ROWS)
    chunks = max(2, min(-(-2 * hot_total // hot_rows), most))
    return _windowed(cold_rows, key, us, seq, amount, window_us, previous).unionByName(
        _chunked(hot_only, key, us, seq, amount, window_us, chunks, previous, keys)
    )


def trailing_count(
    df: DataFrame, key: str | None, window_us: int, us: str = "us", seq: str = "seq", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Add ``window_count`` only."""
    return running(df, key, us, seq, None, window_us, hot_rows).drop("run_count", "prev_us")


def _windowed(
    df: DataFrame, key: str, us: str, seq: str, amount: str | None, window_us: int | None, previous: str | None = None
) -> DataFrame:
    in_order = W.partitionBy(key).orderBy(us, seq)
    so_far = in_order.rowsBetween(W.unboundedPreceding, W.currentRow)
    rank = F.row_number().over(in_order).cast("bigint")
    columns: dict[str, Column] = {"run_count": rank, "prev_us": F.lag(previous or us).over(in_order)}
    if amount:
        columns["run_sum"] = F.sum(amount).over(so_far)
    if window_us is not None:
        # Position minus the rows already out of the window. Both frames only grow, so the
        # cost per row does not depend on the window length, and ties need no extra step.
        expired = W.partitionBy(key).orderBy(us).rangeBetween(W.unboundedPreceding, -(window_us + 1))
        columns["window_count"] = rank - F.count("*").over(expired)
    return df.withColumns(columns)


def _chunked(
    df: DataFrame, key: str, us: str, seq: str, amount: str | None, window_us: int | None, chunks: int | None,
    previous: str | None = None, keys: int = 1,
) -> DataFrame:
    payload = F.struct(*[F.col(c) for c in df.columns])
    steps = df.select(F.col(key).alias("k"), F.col(us).alias("t"), F.col(seq).alias("q"), payload.alias("row"))
    if window_us is None:
        steps = steps.withColumn("arrives", F.lit(1))
    else:
        # Every row arrives once and leaves once; leaving sorts before arriving at the same
        # instant, which makes the trailing count a running total of +1 and -1.
        steps = (
            steps.withColumn("arrives", F.explode(F.array(F.lit(0), F.lit(1))))
            .withColumn("t", F.when(F.col("arrives") == 0, F.col("t") + F.lit(window_us + 1)).otherwise(F.col("t")))
            .withColumn("row", F.when(F.col("arrives") == 1, F.col("row")))
        )
    order = ["k", "t", "arrives", "q"]
    ranged = steps.repartitionByRange(chunks, *order) if chunks else steps.repartitionByRange(*order)
    # The chunk number must be the same for the totals and for the rows, so it is stored.
    rows = cut_lineage(df.sparkSession, ranged.withColumn("chunk", F.spark_partition_id()))

    arrived = F.col("arrives") == 1
    value = F.when(arrived, F.col("row")[amount]) if amount else F.lit(0e0)
    before_it = F.when(arrived, F.col("row")[previous or us])
    totals = rows.groupBy("k", "chunk").agg(
        F.sum("arrives").alias("n"),
        F.sum(value).alias("s"),
        F.sum(F.col("arrives") * 2 - 1).alias("d"),
        F.max_by(before_it, F.when(arrived, F.struct("t", "q"))).alias("last"),
    )
    # One row per chunk and key in it: a key's chunks follow each other, so these are fewer than chunks + keys.
    # They are sent everywhere while they are few, else joined by a shuffle.
    before = W.partitionBy("k").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    carry = totals.select(
        "k",
        "chunk",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"),
        F.coalesce(F.sum("s").over(before), F.lit(0e0)).alias("s0"),
        F.coalesce(F.sum("d").over(before), F.lit(0)).alias("d0"),
        F.last("last", ignorenulls=True).over(before).alias("last0"),
    )
    few = (chunks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))) + keys <= FEW_CHUNKS
    in_chunk = W.partitionBy("k", "chunk").orderBy("t", "arrives", "q")
    so_far = in_chunk.rowsBetween(W.unboundedPreceding, W.currentRow)
    earlier = in_chunk.rowsBetween(W.unboundedPreceding, -1)
    columns: dict[str, Column] = {
        "run_count": F.col("n0") + F.sum("arrives").over(so_far),
        "prev_us": F.coalesce(F.last(before_it, ignorenulls=True).over(earlier), F.col("last0")),
    }
    if amount:
        columns["run_sum"] = F.col("s0") + F.coalesce(F.sum(value).over(so_far), F.lit(0e0))
    if window_us is not None:
        columns["window_count"] = F.col("d0") + F.sum(F.col("arrives") * 2 - 1).over(so_far)
    scanned = rows.join(F.broadcast(carry) if few else carry, ["k", "chunk"]).withColumns(columns).where(arrived)
    return scanned.select("row.*", *columns)
