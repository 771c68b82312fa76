"""DuckDB SQL that says what each query of the catalog must return.

Written from the definitions, not from the Spark code: windows, joins on leaf boxes and CASE
lists over the raw tables, with every limit and text written out. Only the fixed forest is shared.
"""

from __future__ import annotations

from tallywarden.plans.catalog import fixed_forest
from tallywarden.schemas import AMOUNT, COUNT, FEATURES, MEAN, SINCE

def _trees(trees: int, table: str) -> str:
    """What holds for every tree: 256 rows (all, if fewer) in the root and in the leaves together, every row in one leaf."""
    return f"""SELECT CAST(tree AS INT) AS tree, least(256, n) AS root_rows, least(256, n) AS leaf_rows, true AS within_depth, n AS rows_in_one_leaf
        FROM (SELECT unnest(range({trees})) AS tree), (SELECT count(*) AS n FROM {table})"""


EVENTS = "SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS user_id, ts, epoch_us(ts) AS us, value AS amount, event_type, props FROM events"
ORDERS = "SELECT o_orderkey AS seq, CAST(o_custkey AS VARCHAR) AS user_id, o_orderdate AS ts, epoch_us(o_orderdate) AS us, o_totalprice AS amount FROM orders"
ISO = "strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN us % 1000000 = 0 THEN '' ELSE printf('.%06d', us % 1000000) END || '+00:00'"
FEATURE_COLUMNS = "amount AS amount_value, round(mean_amount + 1e-9, 6) AS mean_amount, recent_count, secs_since_last"


def _double(x: float) -> str:
    if x in (float("inf"), float("-inf")):
        return "1e308" if x > 0 else "-1e308"
    text = repr(float(x))
    return text if "e" in text else text + "e0"


def features_cte(source: str = EVENTS, window_seconds: int = 60, valid: str = "true") -> str:
    """tx: the rows; d: valid rows with features."""
    w = window_seconds * 1_000_000
    return f"""tx AS ({source}),
d0 AS (SELECT *,
    sum(amount) OVER r / count(*) OVER r AS mean_amount,
    CAST(count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN {w} PRECEDING AND 1 PRECEDING)
      + row_number() OVER (PARTITION BY user_id, us ORDER BY seq) AS BIGINT) AS recent_count,
    us - lag(us) OVER (PARTITION BY user_id ORDER BY us, seq) AS gap_us
  FROM tx WHERE {valid} WINDOW r AS (PARTITION BY user_id ORDER BY us, seq ROWS UNBOUNDED PRECEDING)),
d AS (SELECT * EXCLUDE (gap_us), coalesce(floor((gap_us + 500) / 1e3) / 1e3, 0e0) AS secs_since_last FROM d0)"""


def reasons(amount: str = "amount", mean: str = "mean_amount", count: str = "recent_count", gap: str = "secs_since_last") -> str:
    """The joined reasons of a row."""
    return f"""(CASE WHEN {gap} <= 5.0 THEN '; very small time_since_last_transaction_seconds' WHEN {gap} <= 30.0 THEN '; small time_since_last_transaction_seconds'
      WHEN {gap} > 3600.0 THEN '; very long time_since_last_transaction_seconds' ELSE '' END
  || CASE WHEN {count} >= 5 THEN '; unusually high transaction_count_last_1_min' WHEN {count} >= 3 THEN '; elevated transaction_count_last_1_min' ELSE '' END
  || CASE WHEN {mean} > 0 THEN
       CASE WHEN abs({amount} - {mean}) / {mean} > 3.0 THEN '; large deviation between transaction_amount and rolling_mean_amount_per_user'
            WHEN abs({amount} - {mean}) / {mean} > 1.0 THEN '; notable deviation between transaction_amount and rolling_mean_amount_per_user' ELSE '' END
     WHEN {amount} >= 50000.0 THEN '; very large transaction_amount'
     WHEN {amount} >= 5000.0 THEN '; large transaction_amount' ELSE '' END)"""


def _reason_text(expression: str) -> str:
    return f"CASE WHEN {expression} = '' THEN 'anomalous pattern detected' ELSE substr({expression}, 3) END"


def scores_cte() -> str:
    """s: score per seq, from leaf boxes."""
    forest = fixed_forest()
    rows = []
    for leaf in forest.leaves().itertuples():
        box = ", ".join(f"{_double(lo)}, {_double(hi)}" for lo, hi in zip(leaf.lo, leaf.hi))
        rows.append(f"({leaf.tree}, {box}, {_double(leaf.path_length)})")
    names = ", ".join(f"lo{i}, hi{i}" for i in range(len(FEATURES)))
    values = ["amount", "mean_amount", "recent_count", "secs_since_last"]
    inside = " AND ".join(f"{v} > lo{i} AND {v} <= hi{i}" for i, v in enumerate(values))
    return f"""leaf (tree, {names}, path) AS (VALUES {", ".join(rows)}),
s AS (SELECT seq, power(2e0, -avg(path) / {_double(forest.normaliser)}) AS anomaly_score FROM d JOIN leaf ON {inside} GROUP BY seq)"""


def scored_cte(threshold: float = 0.6) -> str:
    """x: events with features, rounded score, flag, reasons and processing time."""
    return f"""{features_cte()}, {scores_cte()},
x AS (SELECT d.*, round(s.anomaly_score, 9) AS anomaly_score, s.anomaly_score >= {threshold}e0 AS is_anomaly,
    CASE WHEN s.anomaly_score >= {threshold}e0 THEN {_reason_text(reasons())} ELSE '' END AS reasons,
    ts + INTERVAL 2 SECOND AS processed_timestamp, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM d JOIN s USING (seq))"""


def _scored(select: str) -> str:
    return f"WITH {scored_cte()} {select}"


def _features(select: str, source: str = EVENTS, window_seconds: int = 60) -> str:
    return f"WITH {features_cte(source, window_seconds)} {select}"


def _trailing(window_seconds: int, partition: str | None) -> str:
    w = window_seconds * 1_000_000
    by, tie = (f"PARTITION BY {partition} ", f"{partition}, ") if partition else ("", "")
    return (
        f"CAST(count(*) OVER ({by}ORDER BY us RANGE BETWEEN {w} PRECEDING AND 1 PRECEDING)"
        f" + row_number() OVER (PARTITION BY {tie}us ORDER BY seq) AS BIGINT)"
    )


def _alerts(source: str, window_seconds: int, limit: int, per_user: bool) -> str:
    key, partition = ("user_id", "user_id") if per_user else ("'global'", None)
    return f"""SELECT * FROM (SELECT {key} AS alert_key, seq, user_id, {_trailing(window_seconds, partition)} AS window_count
      FROM {source} WHERE is_anomaly) WHERE window_count > {limit}"""


def _fixed(expression: str, places: int) -> str:
    return f"printf('%.{places}f', round({expression}, {places}))"


def _rupees(amount: str) -> str:
    exact = f"CAST(CAST(abs({amount}) AS DECIMAL(18,3)) AS VARCHAR)"
    whole = f"split_part({exact}, '.', 1)"
    head = f"substr({whole}, 1, greatest(length({whole}) - 3, 0))"
    odd = f"(length({head}) % 2)"
    pairs = f"regexp_replace(substr({head}, 1 + {odd}), '(..)', '\\1,', 'g')"
    grouped = f"CASE WHEN length({head}) = 0 THEN '' WHEN {odd} = 1 THEN substr({head}, 1, 1) || ',' || {pairs} ELSE {pairs} END"
    cents = f"split_part({exact}, '.', 2)"
    return f"'₹' || {grouped} || right({whole}, 3) || '.' || CASE WHEN right({cents}, 1) = '0' THEN left({cents}, 2) ELSE {cents} END"


KIND = "seq % 20"
DIRTY = f"""WITH dirty AS (SELECT *, CASE {KIND} WHEN 11 THEN 'bad_json' WHEN 1 THEN 'missing_user_id' WHEN 3 THEN 'missing_amount'
    WHEN 8 THEN 'missing_timestamp' WHEN 4 THEN 'bad_amount' WHEN 5 THEN 'bad_amount' WHEN 6 THEN 'bad_amount'
    WHEN 9 THEN 'bad_timestamp' WHEN 10 THEN 'bad_timestamp' END AS reject_reason FROM ({EVENTS}))
  SELECT seq, ts, us, reject_reason,
    CASE WHEN {KIND} IN (1, 11) THEN NULL WHEN {KIND} = 2 THEN 'None' ELSE user_id END AS user_id,
    CASE WHEN {KIND} IN (3, 4, 5, 6, 11) THEN NULL ELSE amount END AS amount,
    CASE WHEN {KIND} IN (8, 9, 10, 11) THEN NULL ELSE ts END AS known_ts FROM dirty"""

TOP50 = "SELECT *, row_number() OVER (ORDER BY us, seq) - 1 AS position FROM (SELECT * FROM x ORDER BY us DESC, seq DESC LIMIT 50)"
HISTORY = "seq AS anomaly_row_id, anomaly_score, is_anomaly, processed_timestamp, user_id, k, secs_since_last"
SCORE_ROWS = "SELECT seq, anomaly_score FROM x"
FLAG_ROWS = "SELECT seq, user_id, anomaly_score, is_anomaly FROM x"
UNION_LIVE = """SELECT CAST(event_type = 'purchase' AS INTEGER) AS origin, seq, CAST(seq AS VARCHAR) AS transaction_id, user_id, amount,
            ts, processed_timestamp AS processed_ts, anomaly_score, is_anomaly, CASE WHEN event_type = 'purchase' THEN reasons ELSE '' END AS reasons FROM x"""
SEVERITY = "CASE WHEN anomaly_score > 0.9 THEN 'CRITICAL' WHEN anomaly_score > 0.7 THEN 'HIGH' ELSE 'MEDIUM' END"
FEED = (
    f"SELECT seq, user_id, {SEVERITY} AS severity, {_fixed('anomaly_score', 4)} AS score_text, {_rupees('amount')} AS amount_text, "
    "reasons, strftime(ts, '%H:%M:%S') AS time_text FROM ({source}) WHERE is_anomaly ORDER BY us DESC, seq DESC LIMIT 10"
)


def oracle() -> dict[str, str]:
    order_flags = f"(SELECT *, amount >= 400000.0 AS is_anomaly FROM ({ORDERS}))"
    features = _features(f"SELECT seq, user_id, ts, {FEATURE_COLUMNS} FROM d")
    orders = _features(f"SELECT seq, user_id, {FEATURE_COLUMNS} FROM d", ORDERS, 2592000)
    filled = f"""WITH {features_cte(DIRTY, valid="reject_reason IS NULL")}
      SELECT seq, reject_reason, {FEATURE_COLUMNS} FROM d
      UNION ALL SELECT seq, reject_reason, coalesce(amount, 0e0), 0e0, CAST(0 AS BIGINT), 0e0 FROM tx WHERE reject_reason IS NOT NULL"""
    minutes = "SELECT date_trunc('minute', ts) AS minute, count(*) AS anomalies FROM x WHERE is_anomaly GROUP BY 1"
    rate = "CASE WHEN count(*) > 0 THEN 100e0 * count(*) FILTER (is_anomaly) / count(*) ELSE 0e0 END"
    tick = 300_000_000
    wide = ", ".join(f"CAST(embedding[{i}] AS DOUBLE) AS V{i}" for i in range(1, 29))
    dirty_kind = "seq % 25"
    message_fields = [
        ("schema_version", "int"), ("transaction_id", "string"), ("user_id", "string"), ("amount", "double"),
        ("timestamp", "string"), ("processed_timestamp", "string"), ("anomaly_score", "double"), ("is_anomaly", "boolean"),
        ("explanation", "array<string>"), ("features", "map<string,double>"), ("event", "variant"), ("anomaly_row_id", "bigint"),
    ]
    listed = ", ".join(f"('{n}', '{t}')" for n, t in message_fields)
    counted = ", ".join(f"('{n}', {k})" for n, k in zip(FEATURES, (1, 2, 3, 0)))
    nulls = ", ".join(f"('{n}', {k})" for n, k in zip(FEATURES, (0, 2, 0, 4)))
    bad_kinds = f"CASE column_name WHEN '{AMOUNT}' THEN 1 WHEN '{MEAN}' THEN 2 WHEN '{COUNT}' THEN 3 WHEN '{SINCE}' THEN 4 END"
    sql = {
        "src_transactions": f"SELECT seq, CAST(seq AS VARCHAR) AS transaction_id, user_id, amount, ts, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS reject_reason FROM ({EVENTS})",
        "src_replay_limit": f"SELECT seq, CAST(seq AS VARCHAR) AS transaction_id, user_id, amount, ts FROM ({EVENTS}) ORDER BY us, seq LIMIT 80",
        "src_csv": _features(f"SELECT seq, {FEATURE_COLUMNS} FROM d"),
        "sink_csv": _scored("SELECT seq, amount AS amount_value, anomaly_score, is_anomaly FROM x"),
        "msg_transactions": f"SELECT user_id AS key, CAST(seq AS VARCHAR) AS transaction_id, user_id, {ISO} AS timestamp, amount, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM ({EVENTS})",
        "msg_scored": _scored(
            f"SELECT CAST(1 AS INTEGER) AS schema_version, CAST(seq AS VARCHAR) AS transaction_id, user_id, amount, {ISO} AS timestamp, "
            + ISO.replace("(ts,", "(processed_timestamp,")
            + " AS processed_timestamp, anomaly_score, is_anomaly, reasons, round(mean_amount + 1e-9, 6) AS mean_amount, "
            "CAST(recent_count AS DOUBLE) AS recent_count, secs_since_last, k, seq AS anomaly_row_id FROM x"
        ),
        "parse_json_props": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, 'OBJECT<k: BIGINT>' AS shape, json_extract_string(props, '$.absent') AS absent FROM events",
        "json_raw_fallback": "SELECT event_id, CASE WHEN event_id % 7 = 3 THEN substr(props, 1, 4) END AS raw, CASE WHEN event_id % 7 <> 3 THEN json_extract_string(props, '$.k') END AS k FROM events",
        "parse_timestamps": f"""WITH p AS (SELECT seq, CASE seq % 10 WHEN 3 THEN us - us % 1000000 WHEN 4 THEN us - us % 86400000000
              WHEN 5 THEN us - us % 1000 WHEN 6 THEN NULL WHEN 7 THEN NULL WHEN 8 THEN us - us % 60000000 WHEN 9 THEN NULL ELSE us END AS parsed_us FROM ({EVENTS}))
            SELECT seq, CAST(parsed_us AS VARCHAR) AS parsed_us, coalesce(parsed_us, 0) AS kept_us FROM p""",
        "validate_events": f"SELECT seq, reject_reason, user_id, amount, known_ts AS ts FROM ({DIRTY})",
        "fill_policy": filled,
        "skip_policy": f"SELECT * EXCLUDE (reject_reason) FROM ({filled}) WHERE reject_reason IS NULL",
        "zero_score_policy": f"WITH tx AS ({DIRTY}) SELECT seq, reject_reason, true AS flag_fits, true AS score_fits FROM tx",
        "score_sql": _scored(SCORE_ROWS),
        "sink_json_lines": f"SELECT CAST(seq AS VARCHAR) AS transaction_id, user_id, amount, {ISO} AS timestamp, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM ({EVENTS})",
        "stream_score_alerts": _scored(FLAG_ROWS + " WHERE anomaly_score >= 0.65e0"),
        "quality_assert": f"SELECT count(*) AS rows, column_name, count(*) FILTER ({dirty_kind} = {bad_kinds}) AS bad_rows FROM ({EVENTS}), (VALUES {counted}) f(column_name, n) GROUP BY column_name",
        "null_counts": f"SELECT count(*) AS rows, column_name, count(*) FILTER ({dirty_kind} = kind) AS nulls FROM ({EVENTS}), (VALUES {nulls}) f(column_name, k0), LATERAL (SELECT CASE k0 WHEN 0 THEN -1 ELSE k0 END AS kind) GROUP BY column_name",
        "clean_training": _features(f"SELECT seq, amount AS amount_value, round(mean_amount + 1e-9, 6) AS mean_amount, recent_count, CASE WHEN {dirty_kind} = 4 THEN 0e0 ELSE secs_since_last END AS secs_since_last FROM d WHERE {dirty_kind} NOT IN (1, 2, 3)"),
        "cleaning_report": f"SELECT count(*) AS rows_before, count(*) FILTER ({dirty_kind} NOT IN (1, 2, 3)) AS rows_after, count(*) FILTER ({dirty_kind} IN (1, 2, 3)) AS rows_dropped FROM ({EVENTS})",
        "msg_event_keys": f"SELECT seq, CASE WHEN event_type = 'view' THEN sha256(user_id || '|' || us || '|' || seq) ELSE CAST(seq AS VARCHAR) END AS transaction_id FROM ({EVENTS})",
        "training_features": _features(f"SELECT seq, {FEATURE_COLUMNS} FROM d", ORDERS, 2592000),
        "select_features": f"SELECT {wide}, CAST(vec_id AS DOUBLE) AS Amount FROM embeddings",
        "assemble_vector": _scored("SELECT seq, amount AS v0, round(mean_amount + 1e-9, 6) AS v1, CAST(recent_count AS DOUBLE) AS v2, secs_since_last AS v3, true AS same, CAST(0 AS BIGINT) AS missing, anomaly_score FROM x"),
        "schema_check": f"SELECT field, expected, true AS ok, n AS present FROM (VALUES {listed}) f(field, expected), (SELECT count(*) AS n FROM events)",
        "features": features,
        "features_orders": orders,
        "features_hot_users": orders,
        "feat_running_mean": _features("SELECT seq, user_id, round(mean_amount + 1e-9, 6) AS mean_amount FROM d"),
        "feat_count_60s": _features("SELECT seq, recent_count FROM d"),
        "feat_count_1d": _features("SELECT seq, recent_count FROM d", window_seconds=86400),
        "feat_time_since_last": _features("SELECT seq, secs_since_last FROM d"),
        "user_profile": f"SELECT user_id, count(*) AS tx_count, round(sum(amount) + 1e-9, 4) AS sum_amount, round(avg(amount) + 1e-9, 6) AS mean_amount, max(ts) AS last_ts FROM ({EVENTS}) GROUP BY user_id",
        "resumed_features": features,
        "resumed_hot_users": features,
        "user_amount_ema": f"""WITH r AS (SELECT user_id, amount, row_number() OVER (PARTITION BY user_id ORDER BY us, seq) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM ({EVENTS}))
            SELECT user_id, count(*) AS tx_count, round(sum(CASE WHEN i = 1 THEN 1e0 ELSE 0.2e0 END * power(0.8e0, n - i) * amount), 6) AS ema_amount FROM r GROUP BY user_id""",
        "active_users_5m": f"""WITH t AS (SELECT user_id, unnest(CASE WHEN us % {tick} = 0 THEN [us // {tick}, us // {tick} + 1] ELSE [us // {tick} + 1] END) AS tick FROM ({EVENTS}))
            SELECT make_timestamp(tick * {tick}) AS tick_ts, count(DISTINCT user_id) AS active_users FROM t GROUP BY tick""",
        "score_forest": _scored(SCORE_ROWS),
        "score_flag": _scored(FLAG_ROWS),
        "model_roundtrip": _scored(SCORE_ROWS),
        "train_forest": _trees(20, "events"),
        "train_sanity": "SELECT count(*) AS rows, count(*) AS scored, true AS largest_stands_out FROM events",
        "train_wide": _trees(100, "embeddings"),
        "score_sanity": _scored("SELECT count(*) AS rows, count(*) FILTER (anomaly_score IS NULL) AS missing_scores, CAST(0 AS BIGINT) AS missing_flags, count(*) FILTER (anomaly_score < 0 OR anomaly_score > 1) AS out_of_range FROM x"),
        "contamination_threshold": _scored("SELECT round(quantile_cont(anomaly_score, 0.99), 9) AS threshold FROM x"),
        "explain": _features(f"SELECT seq, {_reason_text(reasons())} AS reasons FROM d", window_seconds=86400),
        "explain_flagged": _scored("SELECT seq, is_anomaly, CAST(CASE WHEN is_anomaly THEN len(string_split(reasons, '; ')) ELSE 0 END AS BIGINT) AS reason_count, reasons FROM x"),
        "explain_amounts": f"SELECT seq, {_reason_text(reasons(mean='0e0', count='0', gap='0e0'))} AS reasons FROM ({ORDERS})",
        "alert_score_above": _scored(FLAG_ROWS + " WHERE anomaly_score >= 0.65e0"),
        "alert_score_below": _scored(FLAG_ROWS + " WHERE anomaly_score <= 0.45e0"),
        "alert_rate_global": _scored(_alerts("x", 86400, 3, False)),
        "alert_rate_user": _scored(_alerts("x", 86400, 1, True)),
        "alert_rate_global_ties": _alerts(order_flags, 2592000, 5, False),
        "alert_rate_user_hot": _alerts(order_flags, 2592000, 1, True),
        "stream_totals": _scored(
            f"SELECT count(*) AS total_events, count(*) FILTER (is_anomaly) AS anomalies, round({rate}, 9) AS anomaly_rate, {_fixed(rate, 1)} AS rate_text_1, {_fixed(rate, 2)} AS rate_text_2, "
            f"CASE WHEN {rate} >= 15 THEN 'HIGH' WHEN {rate} >= 5 THEN 'MED' ELSE 'LOW' END AS risk FROM x"
        ),
        "kpi_totals": _scored(
            f"SELECT count(*) AS total_events, count(*) FILTER (is_anomaly) AS anomalies, round({rate}, 9) AS anomaly_rate, {_fixed(rate, 1)} AS rate_text_1, {_fixed(rate, 2)} AS rate_text_2, "
            f"CASE WHEN {rate} >= 15 THEN 'HIGH' WHEN {rate} >= 5 THEN 'MED' ELSE 'LOW' END AS risk FROM x"
        ),
        "anomalies_per_minute": _scored(
            f"SELECT minute, anomalies, greatest(max(anomalies) OVER (), 1) AS peak, CASE WHEN anomalies = greatest(max(anomalies) OVER (), 1) THEN 'peak' ELSE 'other' END AS tier FROM ({minutes} ORDER BY minute DESC LIMIT 15)"
        ),
        "anomalies_all_minutes": _scored(minutes),
        "latest_score": _scored(
            f"""SELECT anomaly_score AS latest_score, {_fixed('anomaly_score', 3)} AS score_text, anomaly_score AS gauge, round(-180e0 + 180e0 * anomaly_score, 6) AS gauge_angle,
            CASE WHEN anomaly_score < 0.33 THEN 'LOW RISK' WHEN anomaly_score < 0.66 THEN 'MEDIUM RISK' ELSE 'HIGH RISK' END AS gauge_risk FROM x ORDER BY us DESC, seq DESC LIMIT 1"""
        ),
        "anomaly_fraction": _scored("SELECT count(*) AS events, count(*) FILTER (is_anomaly) AS anomalies, round(avg(CASE WHEN is_anomaly THEN 1e0 ELSE 0e0 END), 9) AS fraction FROM x"),
        "anomaly_samples": _scored("SELECT seq, user_id, amount, anomaly_score FROM x WHERE is_anomaly ORDER BY seq LIMIT 5"),
        "first_rows": _features(f"SELECT seq, {FEATURE_COLUMNS} FROM d ORDER BY seq LIMIT 3"),
        "live_buffer_50": _scored(f"SELECT position, seq, user_id, amount, ts, anomaly_score, is_anomaly FROM ({TOP50})"),
        "sparkline_20": _scored(f"SELECT seq, position - 29 AS idx, anomaly_score, CAST(is_anomaly AS INTEGER) AS anomaly_value FROM ({TOP50}) WHERE position >= 30"),
        "score_trend": _scored(f"SELECT position AS idx, anomaly_score, is_anomaly, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts_text, 0.6e0 AS threshold FROM ({TOP50})"),
        "rolling_rate_10": _scored(
            f"""SELECT seq, position, round(rate, 9) AS rate, {_fixed('rate', 1)} AS rate_text FROM
            (SELECT seq, position, 100e0 * avg(CASE WHEN is_anomaly THEN 1e0 ELSE 0e0 END) OVER (ORDER BY position ROWS 9 PRECEDING) AS rate FROM ({TOP50}))"""
        ),
        "anomaly_feed": _scored(FEED.replace("{source}", TOP50)),
        "anomaly_feed_all": _scored(FEED.replace("{source}", "SELECT * FROM x")),
        "txn_table": _scored(
            f"""SELECT seq, 'ORD-' || printf('%03d', 50 - position) AS order_id, user_id, {_rupees('amount')} AS amount_text, {_fixed('anomaly_score', 4)} AS score_text,
            CASE WHEN anomaly_score >= 0.7 THEN 'high' WHEN anomaly_score >= 0.45 THEN 'medium' ELSE 'low' END AS score_tier,
            CASE WHEN is_anomaly THEN 'ANOMALY' ELSE 'Normal' END AS status FROM ({TOP50})"""
        ),
        "display_orders": f"SELECT seq, {_rupees('amount')} AS amount_text, 'ORD-' || printf('%03d', seq) AS order_id, {ISO} AS ts_text FROM ({ORDERS})",
        "persist_tables": _scored(f"SELECT seq AS raw_event_id, CAST(seq AS VARCHAR) AS transaction_id, k, ts, anomaly_score, is_anomaly, processed_timestamp, {FEATURE_COLUMNS} FROM x"),
        "init_tables": "SELECT table_name, n AS rows FROM (VALUES ('raw_events'), ('features'), ('anomalies')) t(table_name), (SELECT count(*) AS n FROM events)",
        "history_recent": _scored(f"SELECT {HISTORY} FROM x ORDER BY processed_timestamp DESC, seq DESC LIMIT 100"),
        "history_since": _scored(f"SELECT {HISTORY} FROM x WHERE processed_timestamp >= TIMESTAMP '2024-01-30T00:00:00' ORDER BY processed_timestamp DESC, seq DESC LIMIT 1000"),
        "history_union_live": _scored(UNION_LIVE),
        "history_union_live_newest": _scored(f"{UNION_LIVE} ORDER BY origin DESC, ts DESC, seq DESC LIMIT 50 + (SELECT count(*) FROM events WHERE event_type = 'purchase')"),
        "fk_orphans": "SELECT table_name, event_id AS id, event_id AS raw_event_id FROM events, (VALUES ('features'), ('anomalies')) t(table_name) WHERE event_type = 'error'",
        "stream_features": features,
        "stream_score": _scored("SELECT seq, user_id, anomaly_score, is_anomaly, reasons, true AS stored FROM x"),
        "stream_publish": _scored(f"SELECT CAST(seq AS VARCHAR) AS transaction_id, user_id, {ISO} AS timestamp, anomaly_score, is_anomaly, reasons FROM x"),
        "stream_alerts": _scored(
            f"SELECT 'global' AS scope, * FROM ({_alerts('x', 86400, 3, False)}) UNION ALL SELECT 'user' AS scope, * FROM ({_alerts('x', 86400, 1, True)})"
        ),
        "stream_kpis": _scored("SELECT date_trunc('minute', ts) AS minute, count(*) AS total_events, count(*) FILTER (is_anomaly) AS anomalies FROM x GROUP BY 1"),
        "live_view": _scored("SELECT seq, user_id, amount, ts, anomaly_score, is_anomaly FROM x ORDER BY us DESC, seq DESC LIMIT 50"),
    }
    sql["src_latest"] = f"SELECT seq, CAST(seq AS VARCHAR) AS transaction_id, user_id, amount, ts FROM ({EVENTS}) WHERE event_type <> 'view'"
    sql["contamination_sketch"] = "SELECT count(*) AS events, count(*) AS sketched, true AS within_error FROM events"
    field_rows = "('(message)', 'object', [11], [11]), ('transaction_id', 'string', [11], []), ('user_id', 'string', [1, 2, 11], []), ('amount', 'number', [3, 4, 11], [5, 6]), ('timestamp', 'string', [8, 10, 11], [])"
    sql["schema_check_events"] = f"""SELECT field, expected, count(*) AS rows, count(*) FILTER (NOT list_contains(absent, seq % 20)) AS present, count(*) FILTER (list_contains(bad, seq % 20)) AS wrong
        FROM ({EVENTS}), (VALUES {field_rows}) f(field, expected, absent, bad) GROUP BY field, expected"""
    record_fields = ", ".join(
        f"('{n}', '{t}')"
        for n, t in [("anomaly_row_id", "bigint"), ("anomaly_score", "double"), ("is_anomaly", "boolean"), ("processed_timestamp", "timestamp"), ("event", "object"),
                     ("event.transaction_id", "string"), ("event.user_id", "string"), ("event.amount", "number"), ("event.timestamp", "string"), ("features", "numbers")]
    )
    sql["schema_check_history"] = f"SELECT field, expected, n AS rows, n AS present, CAST(0 AS BIGINT) AS wrong FROM (VALUES {record_fields}) f(field, expected), (SELECT count(*) AS n FROM events)"
    sql["score_natively"] = sql["score_forest"]
    sql["stream_alerts_keyed"] = sql["alert_rate_user"]
    sql["stream_distinct"] = f"SELECT seq, CAST(seq AS VARCHAR) AS transaction_id, user_id, amount, ts FROM ({EVENTS})"
    sql["rolling_rate_all"] = _scored(
        "SELECT seq, row_number() OVER (ORDER BY us, seq) - 1 AS position, round(100e0 * avg(CASE WHEN is_anomaly THEN 1e0 ELSE 0e0 END) OVER (ORDER BY us, seq ROWS 9 PRECEDING), 9) AS rate FROM x"
    )
    sql["state_profile"] = sql["user_profile"]
    return sql
