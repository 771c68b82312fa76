"""Named queries over the given tables. Each takes (spark, folder) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywarden.functions import display as D
from tallywarden.functions.explain import explanations
from tallywarden.functions.message import feature_map, read_scored_messages, scored_messages, transaction_messages, with_transaction_id
from tallywarden.functions.parse import iso_or, iso_timestamp, json_or_raw
from tallywarden.operators import alerts, conform, features as feats, forest as forests, kpis, validate
from tallywarden.operators.history import Store, union_live
from tallywarden.operators.resume import FeatureState
from tallywarden.operators.sketch import ScoreSketches, rank_error
from tallywarden.plans import scoring, training
from tallywarden.schemas import AMOUNT, COUNT, FEATURES, MEAN, SCORED_MESSAGE, SINCE, conformance
from tallywarden.session import cut_lineage, new_folder, prepare
from tallywarden.sources import tables, transactions
from tallywarden.streaming import alerts as keyed, jobs
from tallywarden.streaming.features import features_stream

THRESHOLD = 0.6
DAY = 86400
ORDER_WINDOW = 30 * DAY
HOT_ROWS = 20  # low enough that the small test tables have hot keys
ALERT_LIMIT, ALERT_WINDOW = 3, DAY
ORDER_ALERT_LIMIT, ORDER_ALERT_AMOUNT = 5, 400000.0
PROCESSING_SECONDS = 2
SINCE_TEXT = "2024-01-30T00:00:00"


def fixed_forest(trees: int = 10, sample_size: int = 32, seed: int = 7) -> forests.Forest:
    """A small forest made from a rule, so that queries and checks can share it."""
    rng = np.random.default_rng(seed)
    grown = []
    for tree in range(trees):
        points = np.column_stack(
            [
                rng.exponential(50, sample_size),
                rng.normal(50, 12, sample_size),
                1 + rng.poisson(0.1, sample_size),
                rng.exponential(40000, sample_size),
            ]
        )
        grown.append(forests.grow_tree(points, tree, sample_size, seed))
    return forests.Forest(pd.concat(grown, ignore_index=True), tuple(FEATURES), sample_size, trees, seed)


# Building blocks -------------------------------------------------------------------------


def _plain(df: DataFrame, *columns: str) -> DataFrame:
    """Feature columns rounded for comparison, after the named ones."""
    return df.select(
        *columns,
        F.col(AMOUNT).alias("amount_value"),
        _mean().alias("mean_amount"),
        F.col(COUNT).cast("bigint").alias("recent_count"),
        F.col(SINCE).alias("secs_since_last"),
    )


def _mean() -> Column:
    return F.round(F.col(MEAN) + 1e-9, 6)


def _score() -> Column:
    return F.round("anomaly_score", 9).alias("anomaly_score")


def _ntz(name: str) -> Column:
    return F.col(name).cast("timestamp_ntz").alias(name)


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    tx = tables.from_events(spark, folder)
    judged = scoring.score_transactions(tx, fixed_forest(), THRESHOLD)
    return judged.withColumn("processed_ts", F.col("ts") + F.expr(f"INTERVAL {PROCESSING_SECONDS} SECONDS"))


def _flagged_orders(spark: SparkSession, folder: str) -> DataFrame:
    return tables.from_orders(spark, folder).withColumn("is_anomaly", F.col("amount") >= ORDER_ALERT_AMOUNT)


def _dirty_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as JSON, some with a missing, null or malformed field."""
    tx = tables.from_events(spark, folder)
    kind = F.col("seq") % 20
    user, amount, at = F.col("user_id"), F.col("amount").cast("string"), D.iso_text(F.col("ts"))

    def member(name: str, value: Column) -> Column:
        return F.concat(F.lit(f'"{name}": '), value)

    def quoted(value: Column) -> Column:
        return F.concat(F.lit('"'), value, F.lit('"'))

    fields = F.array_compact(
        F.array(
            member("transaction_id", quoted(F.col("transaction_id"))),
            F.when(kind == 1, F.lit(None)).when(kind == 2, member("user_id", F.lit("null"))).otherwise(
                member("user_id", quoted(user))
            ),
            F.when(kind == 3, F.lit(None))
            .when(kind == 4, member("amount", F.lit("null")))
            .when(kind == 5, member("amount", F.lit('"12d"')))
            .when(kind == 6, member("amount", F.lit('"NaN"')))
            .when(kind == 7, member("amount", quoted(amount)))
            .otherwise(member("amount", amount)),
            F.when(kind == 8, F.lit(None))
            .when(kind == 9, member("timestamp", F.lit('"yesterday"')))
            .when(kind == 10, member("timestamp", F.lit("null")))
            .otherwise(member("timestamp", quoted(at))),
            member("event_type", quoted(F.col("event_type"))),
        )
    )
    whole = F.concat(F.lit("{"), F.array_join(fields, ", "), F.lit("}"))
    value = F.when(kind == 11, F.lit("{broken")).otherwise(whole)
    return tx.select("seq", F.col("user_id").alias("key"), value.alias("value"))


# Sources, sinks and messages -------------------------------------------------------------


def _stage(messages: DataFrame, folder: str) -> None:
    """Add messages to a folder in as many files as they are read in, one more than the cores at least."""
    tasks = max(messages.sparkSession.sparkContext.defaultParallelism + 1, messages.rdd.getNumPartitions())
    messages.repartition(tasks, "seq").write.mode("append").parquet(folder)


def src_transactions(spark: SparkSession, folder: str) -> DataFrame:
    work = new_folder(spark, "src")
    _stage(tables.messages(tables.from_events(spark, folder)), f"{work}/in")
    decoded = transactions.transactions(transactions.read_message_files(spark, f"{work}/in", None))
    writer = decoded.writeStream.format("parquet").option("checkpointLocation", f"{work}/checkpoint")
    writer.trigger(availableNow=True).start(f"{work}/out").awaitTermination()
    rows = spark.read.schema(decoded.schema).parquet(f"{work}/out")
    event = F.try_parse_json("event")
    return rows.select(
        "seq",
        "transaction_id",
        "user_id",
        "amount",
        _ntz("ts"),
        F.try_variant_get(event, "$.event_type", "string").alias("event_type"),
        F.try_variant_get(event, "$.k", "bigint").alias("k"),
        "reject_reason",
    )


def src_latest(spark: SparkSession, folder: str) -> DataFrame:
    """A stream that begins at the newest file: events of type view lay in the folder before, the others come later in two parts."""
    work = new_folder(spark, "src")
    tx = tables.from_events(spark, folder)
    _stage(tables.messages(tx.where("event_type = 'view'")), f"{work}/in")
    for part in (0, 1):
        rows = transactions.read_new_message_files(spark, f"{work}/in", f"{work}/start", None)
        if part == 0:  # begun once while only old files are there
            _drained(rows, work)
        _stage(tables.messages(tx.where(f"event_type <> 'view' AND seq % 2 = {part}")), f"{work}/in")
        _drained(transactions.read_new_message_files(spark, f"{work}/in", f"{work}/start", None), work)
    return transactions.transactions(spark.read.schema(transactions.MESSAGE).parquet(f"{work}/out")).select("seq", "transaction_id", "user_id", "amount", _ntz("ts"))


def _drained(rows: DataFrame, work: str) -> None:
    writer = rows.writeStream.format("parquet").option("checkpointLocation", f"{work}/checkpoint")
    writer.trigger(availableNow=True).start(f"{work}/out").awaitTermination()


def src_replay_limit(spark: SparkSession, folder: str) -> DataFrame:
    replayed = transactions.replay(tables.from_events(spark, folder), 80)
    return replayed.select("seq", "transaction_id", "user_id", "amount", _ntz("ts"))


_FEATURE_CSV = f"seq bigint, {AMOUNT} double, {MEAN} double, {COUNT} bigint, {SINCE} double"


def src_csv(spark: SparkSession, folder: str) -> DataFrame:
    path = new_folder(spark, "csv")
    transactions.write_csv(feats.training_features(tables.from_events(spark, folder)), path)
    return _plain(transactions.read_csv(spark, [f"{path}-elsewhere", path], _FEATURE_CSV), "seq")


def sink_csv(spark: SparkSession, folder: str) -> DataFrame:
    path = new_folder(spark, "csv")
    scored = _scored(spark, folder).select("seq", *FEATURES, "anomaly_score", "is_anomaly")
    transactions.write_csv(scored, path)
    rows = transactions.read_csv(spark, path, f"{_FEATURE_CSV}, anomaly_score double, is_anomaly boolean")
    return rows.select("seq", F.col(AMOUNT).alias("amount_value"), _score(), "is_anomaly")


def sink_json_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Transactions written as lines of JSON and read back."""
    path = new_folder(spark, "json")
    transactions.write_json_lines(transaction_messages(tables.from_events(spark, folder)), path)
    return spark.read.schema("transaction_id string, user_id string, amount double, timestamp string, event_type string, k bigint").json(path)


def msg_transactions(spark: SparkSession, folder: str) -> DataFrame:
    sent = transaction_messages(tables.from_events(spark, folder))
    event = F.try_parse_json("value")
    return sent.select(
        "key",
        *[F.try_variant_get(event, f"$.{n}", "string").alias(n) for n in ("transaction_id", "user_id", "timestamp")],
        F.try_variant_get(event, "$.amount", "double").alias("amount"),
        F.try_variant_get(event, "$.k", "bigint").alias("k"),
    )


def msg_scored(spark: SparkSession, folder: str) -> DataFrame:
    m = read_scored_messages(scored_messages(_scored(spark, folder)))
    return m.select(
        "schema_version",
        "transaction_id",
        "user_id",
        "amount",
        "timestamp",
        "processed_timestamp",
        _score(),
        "is_anomaly",
        F.array_join("explanation", "; ").alias("reasons"),
        F.round(F.col("features")[MEAN] + 1e-9, 6).alias("mean_amount"),
        F.col("features")[COUNT].alias("recent_count"),
        F.col("features")[SINCE].alias("secs_since_last"),
        F.try_variant_get("event", "$.k", "bigint").alias("k"),
        "anomaly_row_id",
    )


def msg_event_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of events, of which those of type view came without one."""
    tx = tables.from_events(spark, folder)
    bare = tx.withColumn("transaction_id", F.when(F.col("event_type") != "view", F.col("transaction_id")))
    return with_transaction_id(bare).select("seq", "transaction_id")


# Parsing, validation, cleaning -----------------------------------------------------------


def parse_json_props(spark: SparkSession, folder: str) -> DataFrame:
    props = F.try_parse_json("props")
    return tables.table(spark, folder, "events").select(
        "event_id",
        F.try_variant_get(props, "$.k", "bigint").alias("k"),
        F.schema_of_variant(props).alias("shape"),
        F.try_variant_get(props, "$.absent", "string").alias("absent"),
    )


def json_raw_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """Some texts are cut in the middle, which makes them no JSON."""
    events = tables.table(spark, folder, "events")
    text = F.when(F.col("event_id") % 7 == 3, F.substring("props", 1, 4)).otherwise(F.col("props"))
    parsed = json_or_raw(text)
    return events.select(
        "event_id",
        F.try_variant_get(parsed, "$.raw", "string").alias("raw"),
        F.try_variant_get(parsed, "$.k", "string").alias("k"),
    )


def parse_timestamps(spark: SparkSession, folder: str) -> DataFrame:
    """Every event time written in one of ten ways, parsed with and without a fallback."""
    tx = tables.from_events(spark, folder)
    ts, form = F.col("ts"), F.col("seq") % 10

    def text(pattern: str) -> Column:
        return F.date_format(ts, pattern)

    raw = (
        F.when(form == 0, text("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
        .when(form == 1, F.date_format(ts + F.expr("INTERVAL 330 MINUTES"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+05:30'"))
        .when(form == 2, text("yyyy-MM-dd HH:mm:ss.SSSSSS"))
        .when(form == 3, text("yyyyMMdd'T'HHmmss"))
        .when(form == 4, text("yyyy-MM-dd"))
        .when(form == 5, text("yyyy-MM-dd'T'HH:mm:ss','SSS"))
        .when(form == 6, text("dd/MM/yyyy HH:mm"))
        .when(form == 7, F.lit(None))
        .when(form == 8, text("yyyy-MM-dd'T'HH:mm"))
        .otherwise(text("yyyy"))
    )
    rows = tx.select("seq", raw.alias("raw"), F.timestamp_micros(F.lit(0)).alias("fallback"))
    return rows.select(
        "seq",
        F.unix_micros(iso_timestamp(F.col("raw"))).cast("string").alias("parsed_us"),
        F.unix_micros(iso_or(F.col("raw"), F.col("fallback"))).alias("kept_us"),
    )


def validate_events(spark: SparkSession, folder: str) -> DataFrame:
    decoded = validate.decode_events(_dirty_messages(spark, folder))
    return decoded.select("seq", "reject_reason", "user_id", "amount", _ntz("ts"))


def fill_policy(spark: SparkSession, folder: str) -> DataFrame:
    decoded = validate.decode_events(_dirty_messages(spark, folder))
    return _plain(scoring.features_with_policy(decoded, fill_missing=True), "seq", "reject_reason")


def skip_policy(spark: SparkSession, folder: str) -> DataFrame:
    """Bad events are left out: features of the good ones only."""
    decoded = validate.decode_events(_dirty_messages(spark, folder))
    return _plain(scoring.features_with_policy(decoded), "seq")


def zero_score_policy(spark: SparkSession, folder: str) -> DataFrame:
    """All events scored; those that are rejected keep their place with zero features."""
    decoded = validate.decode_events(_dirty_messages(spark, folder))
    scored = scoring.score_messages(decoded, fixed_forest(), THRESHOLD, fill_missing=True)
    return scored.select("seq", "reject_reason", (F.col("anomaly_score") >= THRESHOLD).eqNullSafe(F.col("is_anomaly")).alias("flag_fits"), F.col("anomaly_score").between(0, 1).alias("score_fits"))


def _dirty_features(spark: SparkSession, folder: str) -> DataFrame:
    """Features as text, with blanks, words and missing gaps put in."""
    rows = feats.training_features(tables.from_events(spark, folder))
    kind = F.col("seq") % 25
    return rows.select(
        "seq",
        F.when(kind == 1, "n/a").otherwise(F.col(AMOUNT).cast("string")).alias(AMOUNT),
        F.when(kind == 2, F.lit(None)).otherwise(F.col(MEAN).cast("string")).alias(MEAN),
        F.when(kind == 3, "NaN").otherwise(F.col(COUNT).cast("string")).alias(COUNT),
        F.when(kind == 4, F.lit(None)).otherwise(F.col(SINCE).cast("string")).alias(SINCE),
    )


def quality_assert(spark: SparkSession, folder: str) -> DataFrame:
    return validate.count_not_numeric(_dirty_features(spark, folder), FEATURES)


def clean_training(spark: SparkSession, folder: str) -> DataFrame:
    return _plain(validate.clean_training(_dirty_features(spark, folder)), "seq")


def cleaning_report(spark: SparkSession, folder: str) -> DataFrame:
    return validate.cleaning_report(_dirty_features(spark, folder))


def null_counts(spark: SparkSession, folder: str) -> DataFrame:
    return validate.null_counts(_dirty_features(spark, folder), FEATURES)


def training_features(spark: SparkSession, folder: str) -> DataFrame:
    return _plain(feats.training_features(tables.from_orders(spark, folder), ORDER_WINDOW), "seq")


def select_features(spark: SparkSession, folder: str) -> DataFrame:
    """The wide layout, filled from the embeddings; the label stays out."""
    wide = tables.table(spark, folder, "embeddings").select(
        *[F.get("embedding", F.lit(i)).alias(f"V{i + 1}") for i in range(28)],
        F.col("vec_id").alias("Amount"),
        F.col("label").alias("Class"),
    )
    return validate.select_features(wide)


def assemble_vector(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors from columns and from a map agree, and both score alike."""
    rows = feats.features(tables.from_events(spark, folder)).withColumn("named", feature_map())
    both = validate.vector_from_map(validate.vector(rows, FEATURES), "named", FEATURES, "from_map")
    scored = forests.score_vector(both, fixed_forest())
    return scored.select(
        "seq",
        F.col("vector")[0].alias("v0"),
        F.round(F.col("vector")[1] + 1e-9, 6).alias("v1"),
        F.col("vector")[2].alias("v2"),
        F.col("from_map")[3].alias("v3"),
        (F.col("vector") == F.col("from_map")).alias("same"),
        F.size("missing_features").cast("bigint").alias("missing"),
        _score(),
    )


def schema_check(spark: SparkSession, folder: str) -> DataFrame:
    """Fields of the scored messages: type as expected, and rows that have a value."""
    rows = read_scored_messages(scored_messages(_scored(spark, folder)))
    checks = conformance(rows, SCORED_MESSAGE)
    counts = rows.agg(*[F.count(name).alias(name) for name, *_ in checks])
    items = [
        F.struct(
            F.lit(name).alias("field"),
            F.lit(expected).alias("expected"),
            F.lit(ok).alias("ok"),
            F.col(name).alias("present"),
        )
        for name, expected, _, ok in checks
    ]
    return counts.select(F.inline(F.array(*items)))


def schema_check_events(spark: SparkSession, folder: str) -> DataFrame:
    """Fields of plain messages, some of them missing, null or of another type."""
    return conform.check_events(_dirty_messages(spark, folder))


def schema_check_history(spark: SparkSession, folder: str) -> DataFrame:
    """Fields of all history records and of the events in them."""
    return conform.check_records(_stored(spark, folder)[0].recent((1 << 31) - 1))


# Features --------------------------------------------------------------------------------


def features(spark: SparkSession, folder: str) -> DataFrame:
    tx = tables.from_events(spark, folder)
    return _plain(feats.features(tx), "seq", "user_id", _ntz("ts"))


def features_orders(spark: SparkSession, folder: str) -> DataFrame:
    return _plain(feats.features(tables.from_orders(spark, folder), ORDER_WINDOW), "seq", "user_id")


def features_hot_users(spark: SparkSession, folder: str) -> DataFrame:
    """As ``features_orders`` with the hot-key form for every customer of more than 20 orders."""
    tx = tables.from_orders(spark, folder)
    return _plain(feats.features(tx, ORDER_WINDOW, hot_rows=HOT_ROWS), "seq", "user_id")


def feat_running_mean(spark: SparkSession, folder: str) -> DataFrame:
    return feats.features(tables.from_events(spark, folder)).select("seq", "user_id", _mean().alias("mean_amount"))


def feat_count_60s(spark: SparkSession, folder: str) -> DataFrame:
    return feats.features(tables.from_events(spark, folder)).select("seq", F.col(COUNT).alias("recent_count"))


def feat_count_1d(spark: SparkSession, folder: str) -> DataFrame:
    return feats.features(tables.from_events(spark, folder), DAY).select("seq", F.col(COUNT).alias("recent_count"))


def feat_time_since_last(spark: SparkSession, folder: str) -> DataFrame:
    return feats.features(tables.from_events(spark, folder)).select("seq", F.col(SINCE).alias("secs_since_last"))


def user_profile(spark: SparkSession, folder: str) -> DataFrame:
    profile = feats.user_profile(tables.from_events(spark, folder))
    return profile.select(
        "user_id",
        "tx_count",
        F.round(F.col("sum_amount") + 1e-9, 4).alias("sum_amount"),
        F.round(F.col("mean_amount") + 1e-9, 6).alias("mean_amount"),
        _ntz("last_ts"),
    )


def _days(spark: SparkSession, folder: str, state: FeatureState) -> Iterator[DataFrame]:
    """All events, ten days at a time, each part starting from the state that the parts before have left."""
    tx = tables.from_events(spark, folder).drop("event")
    part = F.floor(F.col("us") / (10 * DAY * 1_000_000))
    for version in sorted(r.part for r in tx.select(part.alias("part")).distinct().collect()):  # one number per part
        yield state.advance(tx.where(part == version), version)


def _resumed(spark: SparkSession, folder: str, state: FeatureState) -> DataFrame:
    """The rows of all parts. A state keeps those of its last two versions only, so each part is written before the next one."""
    work, found = new_folder(spark, "days"), None
    for n, found in enumerate(_days(spark, folder, state)):
        found.write.parquet(f"{work}/part-{n:06d}")
    if found is None:
        return state.advance(tables.from_events(spark, folder).drop("event"), 0)
    return spark.read.schema(found.schema).parquet(f"{work}/part-*")


def resumed_features(spark: SparkSession, folder: str) -> DataFrame:
    """Features from stored state, part by part: no part reads the rows of another."""
    return _plain(_resumed(spark, folder, FeatureState(spark, new_folder(spark, "state"), merge_every=2)), "seq", "user_id", _ntz("ts"))


def resumed_hot_users(spark: SparkSession, folder: str) -> DataFrame:
    """The same with the hot-key form for every user of a few rows."""
    return _plain(_resumed(spark, folder, FeatureState(spark, new_folder(spark, "state"), hot_rows=40)), "seq", "user_id", _ntz("ts"))


def state_profile(spark: SparkSession, folder: str) -> DataFrame:
    """The user profile, read from the state that features were resumed from."""
    state = FeatureState(spark, new_folder(spark, "state"))
    for _ in _days(spark, folder, state):
        pass
    return state.profile().select(
        "user_id", "tx_count", F.round(F.col("sum_amount") + 1e-9, 4).alias("sum_amount"), F.round(F.col("mean_amount") + 1e-9, 6).alias("mean_amount"), _ntz("last_ts"),
    )


def user_amount_ema(spark: SparkSession, folder: str) -> DataFrame:
    ema = feats.user_amount_ema(tables.from_events(spark, folder))
    return ema.select("user_id", "tx_count", F.round("ema_amount", 6).alias("ema_amount"))


def active_users_5m(spark: SparkSession, folder: str) -> DataFrame:
    return feats.active_users(tables.from_events(spark, folder)).select(_ntz("tick_ts"), "active_users")


# Model -----------------------------------------------------------------------------------


def score_forest(spark: SparkSession, folder: str) -> DataFrame:
    rows = feats.features(tables.from_events(spark, folder))
    return forests.score(rows, fixed_forest()).select("seq", _score())


def score_flag(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder).select("seq", "user_id", _score(), "is_anomaly")


def score_natively(spark: SparkSession, folder: str) -> DataFrame:
    """Scores without Python workers."""
    rows = feats.features(tables.from_events(spark, folder))
    return forests.score_natively(rows, fixed_forest()).select("seq", _score())


def model_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of a forest that was saved and loaded again."""
    path = new_folder(spark, "forest")
    forests.save(spark, fixed_forest(), path)
    rows = feats.features(tables.from_events(spark, folder))
    return forests.score(rows, forests.load(spark, path)).select("seq", _score())


def _tree_facts(forest: forests.Forest, rows: DataFrame) -> DataFrame:
    """Per tree: rows in the root and in all leaves, whether no leaf is too deep, rows of the table that lie in exactly one leaf."""
    spark = rows.sparkSession
    facts, boxes = [], []
    for tree, part in forest.nodes.groupby("tree"):
        nodes = part.set_index("node")
        depth = {0: 0}
        for node in nodes.sort_index().itertuples():
            if node.feature != forests.LEAF:
                depth[int(node.left)] = depth[int(node.right)] = depth[node.Index] + 1
        leaf = nodes[nodes.feature == forests.LEAF]
        deepest = max(depth[i] for i in leaf.index)
        limit = int(np.ceil(np.log2(max(forest.sample_size, 2))))
        facts.append((int(tree), int(nodes["size"][0]), int(leaf["size"].sum()), deepest <= limit))
        boxes.append((int(tree), np.vstack(leaf.lo.to_list()), np.vstack(leaf.hi.to_list())))
    sent = spark.sparkContext.broadcast(boxes)  # trees x leaves, whatever the table's size

    def hits(batches):
        found = dict.fromkeys((tree for tree, _, _ in sent.value), 0)
        for batch in batches:
            points = np.column_stack([c.to_numpy() for c in batch.columns])
            for i in range(0, len(points), 256):
                x = points[i : i + 256, None, :]
                for tree, lo, hi in sent.value:
                    found[tree] += int((((x > lo) & (x <= hi)).all(axis=2).sum(axis=1) == 1).sum())
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array(list(found.values()), pa.int64())], ["tree", "n"])

    points = rows.select(*[F.col(f).cast("double").alias(f) for f in forest.feature_names])
    once = points.mapInArrow(hits, "tree int, n bigint").groupBy("tree").agg(F.sum("n").alias("rows_in_one_leaf"))
    known = spark.createDataFrame(facts, "tree int, root_rows bigint, leaf_rows bigint, within_depth boolean")
    return known.join(once, "tree")


def score_sql(spark: SparkSession, folder: str) -> DataFrame:
    """The scorer called by name from SQL."""
    forests.register_score(spark, fixed_forest(), "anomaly_score")
    feats.features(tables.from_events(spark, folder)).createOrReplaceTempView("tallywarden_features")
    return spark.sql(f"SELECT seq, round(anomaly_score({', '.join(FEATURES)}), 9) AS anomaly_score FROM tallywarden_features")


def train_forest(spark: SparkSession, folder: str) -> DataFrame:
    """Facts of each tree of a forest trained on all events; every event must lie in one leaf of each tree."""
    tx = tables.from_events(spark, folder)
    return _tree_facts(training.train(tx, trees=20), feats.features(tx))


def train_sanity(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of the default forest over its own training table: all there, all in (0, 1), extreme amounts above the median."""
    tx = tables.from_events(spark, folder)
    scored = forests.score(feats.features(tx), training.train(tx))
    top = scored.agg(F.max_by("anomaly_score", "amount").alias("of_largest"), F.percentile("anomaly_score", F.lit(0.5)).alias("middle"))
    s = F.col("anomaly_score")
    return scored.agg(F.count("*").alias("rows"), F.count_if((s > 0) & (s < 1)).alias("scored")).join(top.select((F.col("of_largest") > F.col("middle")).alias("largest_stands_out")))


def train_wide(spark: SparkSession, folder: str) -> DataFrame:
    """Facts of each tree of the 100-tree model over all dimensions of the embeddings."""
    vectors = tables.table(spark, folder, "embeddings")
    lengths = vectors.where("embedding IS NOT NULL").groupBy(F.size("embedding").alias("wide")).agg(F.count("*").alias("rows")).orderBy("wide").limit(10).collect()
    if len(lengths) != 1:
        raise ValueError(f"vectors of one length are needed; rows per length: { {r.wide: r.rows for r in lengths} }")
    wide = lengths[0].wide
    names = [f"V{i + 1}" for i in range(wide)]
    rows = vectors.where("embedding IS NOT NULL").select(F.col("vec_id").alias("seq"), *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)])
    return _tree_facts(training.train_wide(rows, names, "seq"), rows)


def score_sanity(spark: SparkSession, folder: str) -> DataFrame:
    return forests.sanity(_scored(spark, folder))


def contamination_threshold(spark: SparkSession, folder: str) -> DataFrame:
    found = forests.contamination_threshold(_scored(spark, folder), 0.01, exact=True)
    return found.select(F.round("threshold", 9).alias("threshold"))


def contamination_sketch(spark: SparkSession, folder: str) -> DataFrame:
    """The cut-off from one sketch per ten days: does its rank lie within the stated error?"""
    scored = cut_lineage(spark, _scored(spark, folder))
    sketches = ScoreSketches(spark, new_folder(spark, "sketches"))
    part = F.floor(F.col("us") / (10 * DAY * 1_000_000))
    for version in sorted(r.part for r in scored.select(part.alias("part")).distinct().collect()):  # one number per part
        sketches.add(scored.where(part == version), version)
    found = sketches.threshold(0.01).first()
    above, below = F.count_if(F.col("anomaly_score") > found.threshold), F.count_if(F.col("anomaly_score") < found.threshold)
    slack = F.ceil(F.count("*") * rank_error()) + 1
    within = (above <= F.count("*") * 0.01 + slack) & (below <= F.count("*") * 0.99 + slack)
    return scored.agg(F.count("*").alias("events"), F.lit(found.scores).alias("sketched"), within.alias("within_error"))


def explain(spark: SparkSession, folder: str) -> DataFrame:
    """Reasons of every event with a one-day window, so that all count limits occur."""
    rows = feats.features(tables.from_events(spark, folder), DAY)
    return rows.select("seq", F.array_join(explanations(), "; ").alias("reasons"))


def explain_flagged(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder).select(
        "seq", "is_anomaly", F.size("explanation").cast("bigint").alias("reason_count"),
        F.array_join("explanation", "; ").alias("reasons"),
    )


def explain_amounts(spark: SparkSession, folder: str) -> DataFrame:
    """Reasons of orders whose features were zero-filled, so only the amount speaks."""
    rejects = tables.from_orders(spark, folder).withColumn("reject_reason", F.lit("bad_timestamp"))
    filled = validate.with_rejects_filled(rejects.where("false"), rejects)
    return filled.select("seq", F.array_join(explanations(), "; ").alias("reasons"))


# Alerts ----------------------------------------------------------------------------------


def alert_score_above(spark: SparkSession, folder: str) -> DataFrame:
    return alerts.score_alerts(_scored(spark, folder), 0.65).select("seq", "user_id", _score(), "is_anomaly")


def alert_score_below(spark: SparkSession, folder: str) -> DataFrame:
    return alerts.score_alerts(_scored(spark, folder), 0.45, "below").select("seq", "user_id", _score(), "is_anomaly")


def alert_rate_global(spark: SparkSession, folder: str) -> DataFrame:
    raised = alerts.rate_alerts(_scored(spark, folder), ALERT_LIMIT, ALERT_WINDOW, "global")
    return raised.select("alert_key", "seq", "user_id", "window_count")


def alert_rate_user(spark: SparkSession, folder: str) -> DataFrame:
    raised = alerts.rate_alerts(_scored(spark, folder), 1, ALERT_WINDOW, "user")
    return raised.select("alert_key", "seq", "user_id", "window_count")


def alert_rate_global_ties(spark: SparkSession, folder: str) -> DataFrame:
    raised = alerts.rate_alerts(_flagged_orders(spark, folder), ORDER_ALERT_LIMIT, ORDER_WINDOW, "global")
    return raised.select("alert_key", "seq", "user_id", "window_count")


def alert_rate_user_hot(spark: SparkSession, folder: str) -> DataFrame:
    flagged = _flagged_orders(spark, folder)
    raised = alerts.rate_alerts(flagged, 1, ORDER_WINDOW, "user", hot_rows=3)
    return raised.select("alert_key", "seq", "user_id", "window_count")


# Figures ---------------------------------------------------------------------------------


def kpi_totals(spark: SparkSession, folder: str) -> DataFrame:
    return kpis.totals(_scored(spark, folder)).withColumn("anomaly_rate", F.round("anomaly_rate", 9))


def anomalies_per_minute(spark: SparkSession, folder: str) -> DataFrame:
    return kpis.recent_minutes(_scored(spark, folder)).select(_ntz("minute"), "anomalies", "peak", "tier")


def anomalies_all_minutes(spark: SparkSession, folder: str) -> DataFrame:
    return kpis.anomalies_by_minute(_scored(spark, folder)).select(_ntz("minute"), "anomalies")


def latest_score(spark: SparkSession, folder: str) -> DataFrame:
    newest = kpis.latest_score(_scored(spark, folder))
    return newest.select(
        F.round("latest_score", 9).alias("latest_score"),
        "score_text",
        F.round("gauge", 9).alias("gauge"),
        F.round("gauge_angle", 6).alias("gauge_angle"),
        "gauge_risk",
    )


def anomaly_fraction(spark: SparkSession, folder: str) -> DataFrame:
    return kpis.anomaly_fraction(_scored(spark, folder)).withColumn("fraction", F.round("fraction", 9))


def anomaly_samples(spark: SparkSession, folder: str) -> DataFrame:
    return kpis.anomaly_samples(_scored(spark, folder)).select("seq", "user_id", "amount", _score())


def first_rows(spark: SparkSession, folder: str) -> DataFrame:
    return _plain(kpis.first_rows(feats.features(tables.from_events(spark, folder))), "seq")


def live_buffer_50(spark: SparkSession, folder: str) -> DataFrame:
    return kpis.live_buffer(_scored(spark, folder)).select(
        "position", "seq", "user_id", "amount", _ntz("ts"), _score(), "is_anomaly"
    )


def sparkline_20(spark: SparkSession, folder: str) -> DataFrame:
    return kpis.sparkline(_scored(spark, folder)).select("seq", "idx", _score(), "anomaly_value")


def score_trend(spark: SparkSession, folder: str) -> DataFrame:
    return kpis.score_trend(_scored(spark, folder), THRESHOLD).select("idx", _score(), "is_anomaly", "ts_text", "threshold")


def rolling_rate_10(spark: SparkSession, folder: str) -> DataFrame:
    rates = kpis.rolling_rate(_scored(spark, folder))
    return rates.select("seq", "position", F.round("rate", 9).alias("rate"), "rate_text")


def rolling_rate_all(spark: SparkSession, folder: str) -> DataFrame:
    """The rolling rate at every event."""
    return kpis.rolling_rate_all(_scored(spark, folder)).select("seq", "position", F.round("rate", 9).alias("rate"))


def anomaly_feed(spark: SparkSession, folder: str) -> DataFrame:
    return kpis.anomaly_feed(_scored(spark, folder))


def anomaly_feed_all(spark: SparkSession, folder: str) -> DataFrame:
    return kpis.anomaly_feed(_scored(spark, folder), buffer_rows=None)


def txn_table(spark: SparkSession, folder: str) -> DataFrame:
    return kpis.transaction_table(_scored(spark, folder))


def display_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Display texts of large amounts, and a number per order."""
    rows = tables.from_orders(spark, folder)
    return rows.select(
        "seq", D.rupees(F.col("amount")).alias("amount_text"), D.order_number(F.col("seq")).alias("order_id"),
        D.iso_text(F.col("ts")).alias("ts_text"),
    )


# History ---------------------------------------------------------------------------------


def _stored(spark: SparkSession, folder: str) -> tuple[Store, DataFrame]:
    store = Store(spark, new_folder(spark, "store"))
    scored = cut_lineage(spark, _scored(spark, folder))
    store.init()
    store.append(scored)
    return store, scored


def persist_tables(spark: SparkSession, folder: str) -> DataFrame:
    """The three tables after a batch was stored twice, joined again."""
    store, scored = _stored(spark, folder)
    store.append(scored)
    raw, values, found = (store.table(n) for n in ("raw_events", "features", "anomalies"))
    parsed = F.from_json("features_json", f"{AMOUNT} double, {MEAN} double, {COUNT} bigint, {SINCE} double")
    joined = (
        raw.select(F.col("id").alias("raw_event_id"), "transaction_id", "event_json", F.col("timestamp").alias("ts"))
        .join(values.select("raw_event_id", parsed.alias("f")), "raw_event_id")
        .join(found.select("raw_event_id", "anomaly_score", "is_anomaly", "processed_timestamp"), "raw_event_id")
        .select("*", "f.*")
    )
    return _plain(
        joined.withColumns({"anomaly_score": _score(), "k": F.get_json_object("event_json", "$.k").cast("bigint")}),
        "raw_event_id", "transaction_id", "k", _ntz("ts"), "anomaly_score", "is_anomaly", _ntz("processed_timestamp"),
    )


def init_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Rows per table; creating tables that exist changes nothing."""
    store, _ = _stored(spark, folder)
    store.init()
    parts = [
        store.table(n).agg(F.count("*").alias("rows")).select(F.lit(n).alias("table_name"), "rows")
        for n in ("raw_events", "features", "anomalies")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _history_columns(history: DataFrame) -> DataFrame:
    return history.select(
        "anomaly_row_id",
        _score(),
        "is_anomaly",
        _ntz("processed_timestamp"),
        F.try_variant_get("event", "$.user_id", "string").alias("user_id"),
        F.try_variant_get("event", "$.k", "bigint").alias("k"),
        F.try_variant_get("features", f"$.{SINCE}", "double").alias("secs_since_last"),
    )


def history_recent(spark: SparkSession, folder: str) -> DataFrame:
    return _history_columns(_stored(spark, folder)[0].recent(100))


def history_since(spark: SparkSession, folder: str) -> DataFrame:
    return _history_columns(_stored(spark, folder)[0].recent(1000, SINCE_TEXT))


def _union_live(spark: SparkSession, folder: str, rows: int | None) -> DataFrame:
    store = Store(spark, new_folder(spark, "store"))
    scored = cut_lineage(spark, _scored(spark, folder))
    purchase = F.col("event_type") == "purchase"
    store.append(scored.where(~purchase))
    history = store.table("anomalies").select(
        F.col("id").alias("anomaly_row_id"), "raw_event_id", "anomaly_score", "is_anomaly", "processed_timestamp"
    )
    events = store.table("raw_events").select(F.col("id").alias("raw_event_id"), json_or_raw(F.col("event_json")).alias("event"))
    both = union_live(history.join(events, "raw_event_id"), scored.where(purchase), rows=rows)
    return both.select(
        "origin", "seq", "transaction_id", "user_id", "amount", _ntz("ts"), _ntz("processed_ts"), _score(), "is_anomaly",
        F.array_join("explanation", "; ").alias("reasons"),
    )


def history_union_live(spark: SparkSession, folder: str) -> DataFrame:
    """All but purchases come from stored history, purchases are live; nothing is cut."""
    return _union_live(spark, folder, None)


def history_union_live_newest(spark: SparkSession, folder: str) -> DataFrame:
    """The same, held to the size of the live buffer and beyond the live rows."""
    live = tables.table(spark, folder, "events").where("event_type = 'purchase'").count()
    return _union_live(spark, folder, live + 50)


def fk_orphans(spark: SparkSession, folder: str) -> DataFrame:
    """Feature and anomaly rows whose raw event (here: of type error) is not stored."""
    store = Store(spark, new_folder(spark, "store"))
    scored = cut_lineage(spark, _scored(spark, folder))
    frames = store.frames(scored)
    store.write(frames | {"raw_events": store.frames(scored.where("event_type <> 'error'"))["raw_events"]})
    return store.orphans()


# Streaming -------------------------------------------------------------------------------


def _rounds(spark: SparkSession, folder: str, work: str, rounds: int = 2):
    """Stage all events in event order, one slice per round."""
    tx = tables.from_events(spark, folder)
    first, last = tx.agg(F.min("us"), F.max("us")).first()
    step = (last - first) // rounds + 1
    for n in range(rounds):
        _stage(tables.messages(tx.where(F.floor((F.col("us") - first) / step) == n)), f"{work}/in")
        yield n


def _score_rounds(spark: SparkSession, folder: str, work: str, *followers: Callable[[DataFrame], object]) -> DataFrame:
    """Run the scoring job and its followers once per round; returns the scored table."""
    processed = F.col("ts") + F.expr(f"INTERVAL {PROCESSING_SECONDS} SECONDS")
    state = FeatureState(spark, f"{work}/state")
    table = jobs.scored_folders(f"{work}/scored")
    for _ in _rounds(spark, folder, work):
        decoded = transactions.transactions(transactions.read_message_files(spark, f"{work}/in", None))
        jobs.score_batches(decoded, fixed_forest(), state, f"{work}/scored", f"{work}/scored-checkpoint", THRESHOLD, processed=processed).awaitTermination()
        for start in followers:
            start(jobs.follow(spark, table)).awaitTermination()
    return spark.read.schema(jobs.SCORED).parquet(table)


def stream_features(spark: SparkSession, folder: str) -> DataFrame:
    work = new_folder(spark, "stream")
    for _ in _rounds(spark, folder, work):
        decoded = transactions.transactions(transactions.read_message_files(spark, f"{work}/in", None))
        out = features_stream(validate.valid_rows(decoded).drop("reject_reason"))
        writer = out.writeStream.format("parquet").option("checkpointLocation", f"{work}/checkpoint")
        writer.trigger(availableNow=True).start(f"{work}/out").awaitTermination()
    return _plain(spark.read.schema(out.schema).parquet(f"{work}/out"), "seq", "user_id", _ntz("ts"))


def stream_score(spark: SparkSession, folder: str) -> DataFrame:
    """Scored stream, stored by a follower and read back as history."""
    work = new_folder(spark, "stream")
    store = Store(spark, f"{work}/store")
    scored = _score_rounds(spark, folder, work, lambda s: jobs.persist(s, store, f"{work}/store-checkpoint"))
    stored = store.table("anomalies").select(F.col("raw_event_id").alias("seq"), F.lit(True).alias("stored"))
    return scored.join(stored, "seq", "left").select(
        "seq", "user_id", _score(), "is_anomaly", F.array_join("explanation", "; ").alias("reasons"),
        F.coalesce("stored", F.lit(False)).alias("stored"),
    )


def stream_publish(spark: SparkSession, folder: str) -> DataFrame:
    """Messages written by a follower, read back."""
    work = new_folder(spark, "stream")
    _score_rounds(spark, folder, work, lambda s: jobs.publish_files(s, f"{work}/out", f"{work}/out-checkpoint"))
    sent = read_scored_messages(spark.read.text(f"{work}/out"))
    return sent.select("transaction_id", "user_id", "timestamp", _score(), "is_anomaly",
                       F.array_join("explanation", "; ").alias("reasons"))


def stream_alerts(spark: SparkSession, folder: str) -> DataFrame:
    """Rate alerts of the stream, global and per user."""
    work = new_folder(spark, "stream")

    def job(scope: str, limit: int):
        return lambda s: jobs.rate_alert_stream(
            s, f"{work}/{scope}", f"{work}/{scope}-checkpoint", limit, ALERT_WINDOW, scope
        )

    _score_rounds(spark, folder, work, job("global", ALERT_LIMIT), job("user", 1))
    both = [jobs.rate_alerts_so_far(spark, f"{work}/{s}").withColumn("scope", F.lit(s)) for s in ("global", "user")]
    return both[0].unionByName(both[1]).select("scope", "alert_key", "seq", "user_id", "window_count")


def stream_alerts_keyed(spark: SparkSession, folder: str) -> DataFrame:
    """Rate alerts per user from keyed state."""
    work = new_folder(spark, "stream")

    def job(s: DataFrame):
        return keyed.write_keyed_alerts(keyed.keyed_rate_alerts(s, 1, ALERT_WINDOW), f"{work}/alerts", f"{work}/alerts-checkpoint")

    _score_rounds(spark, folder, work, job)
    return spark.read.schema(keyed._OUT).parquet(f"{work}/alerts").select("alert_key", "seq", "user_id", "window_count")


def stream_distinct(spark: SparkSession, folder: str) -> DataFrame:
    """Every message sent twice, in two rounds; each transaction is kept once."""
    work = new_folder(spark, "stream")
    for _ in range(2):
        _stage(tables.messages(tables.from_events(spark, folder)), f"{work}/in")
        decoded = transactions.transactions(transactions.read_message_files(spark, f"{work}/in", None))
        kept = transactions.without_repeats(decoded, 365 * DAY)
        writer = kept.writeStream.format("parquet").option("checkpointLocation", f"{work}/checkpoint")
        writer.trigger(availableNow=True).start(f"{work}/out").awaitTermination()
    return spark.read.schema(decoded.schema).parquet(f"{work}/out").select("seq", "transaction_id", "user_id", "amount", _ntz("ts"))


def stream_kpis(spark: SparkSession, folder: str) -> DataFrame:
    work = new_folder(spark, "stream")
    _score_rounds(spark, folder, work, lambda s: jobs.minute_stream(s, f"{work}/minutes", f"{work}/minutes-checkpoint"))
    return jobs.minutes_so_far(spark, f"{work}/minutes").select(_ntz("minute"), "total_events", "anomalies")


def stream_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Totals over everything the stream has scored so far."""
    work = new_folder(spark, "stream")
    _score_rounds(spark, folder, work, lambda s: jobs.minute_stream(s, f"{work}/minutes", f"{work}/minutes-checkpoint"))
    return jobs.totals_so_far(spark, f"{work}/minutes").withColumn("anomaly_rate", F.round("anomaly_rate", 9))


def stream_score_alerts(spark: SparkSession, folder: str) -> DataFrame:
    work = new_folder(spark, "stream")
    _score_rounds(spark, folder, work, lambda s: jobs.score_alert_stream(s, f"{work}/alerts", f"{work}/alerts-checkpoint", 0.65))
    return spark.read.schema(jobs.SCORED).parquet(f"{work}/alerts").select("seq", "user_id", _score(), "is_anomaly")


def live_view(spark: SparkSession, folder: str) -> DataFrame:
    work = new_folder(spark, "stream")
    _score_rounds(spark, folder, work, lambda s: jobs.live_view(s, f"{work}/live", f"{work}/live-checkpoint"))
    return jobs.live_rows_now(spark, f"{work}/live").select("seq", "user_id", "amount", _ntz("ts"), _score(), "is_anomaly")


QUERIES: list[Callable[[SparkSession, str], DataFrame]] = [
    src_transactions, src_latest, src_replay_limit, src_csv, sink_csv, sink_json_lines, msg_transactions, msg_scored, msg_event_keys,
    parse_json_props, json_raw_fallback, parse_timestamps, validate_events, fill_policy, skip_policy, zero_score_policy, quality_assert,
    clean_training, cleaning_report, null_counts, training_features, select_features, assemble_vector, schema_check, schema_check_events, schema_check_history,
    features, features_orders, features_hot_users, feat_running_mean, feat_count_60s, feat_count_1d,
    feat_time_since_last, user_profile, resumed_features, resumed_hot_users, state_profile, user_amount_ema, active_users_5m,
    score_forest, score_flag, score_sql, score_natively, model_roundtrip, train_forest, train_sanity, train_wide, score_sanity, contamination_threshold, contamination_sketch,
    explain, explain_flagged, explain_amounts,
    alert_score_above, alert_score_below, alert_rate_global, alert_rate_user, alert_rate_global_ties, alert_rate_user_hot,
    kpi_totals, anomalies_per_minute, anomalies_all_minutes, latest_score, anomaly_fraction, anomaly_samples, first_rows,
    live_buffer_50, sparkline_20, score_trend, rolling_rate_10, rolling_rate_all, anomaly_feed, anomaly_feed_all, txn_table, display_orders,
    persist_tables, init_tables, history_recent, history_since, history_union_live, history_union_live_newest, fk_orphans,
    stream_features, stream_score, stream_publish, stream_alerts, stream_alerts_keyed, stream_distinct, stream_kpis, stream_totals, stream_score_alerts, live_view,
]


def catalog() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def named(query):
        return lambda spark, folder: query(prepare(spark), folder)

    return {query.__name__: named(query) for query in QUERIES}
