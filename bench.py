"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores. Every query runs once to warm up
and once for time; results go to the no-op sink, so every row and column is computed.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import functions as F

from tallywarden.operators import alerts, features as feats, forest as forests, kpis
from tallywarden.operators.history import Store
from tallywarden.operators.resume import FeatureState
from tallywarden.operators.validate import decode_events
from tallywarden.plans import catalog as C, scoring, training
from tallywarden.session import build_session, cut_lineage, new_folder, prepare
from tallywarden.sources import tables, transactions
from tallywarden.streaming import jobs


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = prepare(build_session("bench", f"local[{cpus}]", int(cpus)))
    tx, orders = tables.from_events(spark, folder), tables.from_orders(spark, folder).drop("event")
    lean = tx.drop("event")  # the message text is only for messages
    named = C.catalog()
    forest = training.train(lean)

    def stored(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    def query(name: str):
        return lambda: stored(named[name](spark, folder))

    def stream() -> None:
        work = new_folder(spark, "bench")
        tables.messages(tx).write.parquet(f"{work}/in")
        decoded = transactions.transactions(transactions.read_message_files(spark, f"{work}/in", None))
        state = FeatureState(spark, f"{work}/state")
        jobs.score_batches(decoded, forest, state, f"{work}/scored", f"{work}/checkpoint").awaitTermination()

    flagged = orders.withColumn("is_anomaly", orders.amount >= 0)
    store = Store(spark, new_folder(spark, "bench"))
    processed = F.col("ts") + F.expr("INTERVAL 2 SECONDS")
    scored = cut_lineage(spark, scoring.score_transactions(tx, forest).withColumn("processed_ts", processed))
    store.append(scored)
    dirty = cut_lineage(spark, C._dirty_messages(spark, folder))  # building the messages is not what is measured
    runs = {
        "features": lambda: stored(feats.features(lean)),
        "features_1d_window": lambda: stored(feats.features(lean, C.DAY)),
        "features_orders": lambda: stored(feats.features(orders, C.ORDER_WINDOW)),
        "train_forest_200x256": lambda: training.train(lean),
        "score_forest_200x256": lambda: stored(forests.score(feats.features(lean), forest)),
        "score_flag_explain": lambda: stored(scoring.score_transactions(lean, forest)),
        "alert_rate_global": lambda: stored(alerts.rate_alerts(flagged, 10, C.ORDER_WINDOW, "global")),
        "alert_rate_user": lambda: stored(alerts.rate_alerts(flagged, 2, C.ORDER_WINDOW, "user")),
        "validate_events": lambda: stored(decode_events(dirty)),
        # The figures read a table of scored events; scoring is timed above.
        "kpi_totals": lambda: stored(kpis.totals(scored)),
        "anomalies_per_minute": lambda: stored(kpis.recent_minutes(scored)),
        "txn_table": lambda: stored(kpis.transaction_table(scored)),
        "user_amount_ema": query("user_amount_ema"),
        "active_users_5m": query("active_users_5m"),
        "persist_tables": lambda: store.append(scored),
        "history_recent": lambda: stored(store.recent(100)),
        "stream_score": stream,
    }
    chosen = sys.argv[1:] or list(runs)
    seconds, rows = {}, {"events": tx.count(), "orders": orders.count()}
    for name in chosen:
        runs[name]()
        start = time.perf_counter()
        runs[name]()
        seconds[name] = round(time.perf_counter() - start, 3)
    result = {
        "metric": "headline queries, total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")),
        "rows": rows,
        "rows_per_sec": {n: round(rows["orders" if n in ("features_orders", "alert_rate_global", "alert_rate_user") else "events"] / s) for n, s in seconds.items()},
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
