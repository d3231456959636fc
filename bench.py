"""Time the headline queries and print one JSON line.

Reads ``BENCH_SF_DIR`` (default ``/root/testdata/sf0.1``) on
``local[BENCH_CPUS]``. Every query runs to the end over all its columns.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "order_scores",
    "approve_or_hold",
    "order_batch_decisions",
    "score_contributions",
    "reserve_orders_snapshot",
    "reserve_fold",
    "reserve_orders_fold",
    "ledger_replay",
    "order_lines_merge",
    "order_current_state",
    "events_first_delivery",
    "claim_classify",
    "log_assign_offsets",
    "log_import",
    "rate_limit_decisions",
    "review_effects",
    "recon_report",
    "latency_percentiles",
    "alerts_sustained",
    "stream_score",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from orderlens.catalog import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    names = os.environ.get("BENCH_QUERIES")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("orderlens bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    spent: dict[str, float] = {}
    for name in names.split(",") if names else HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        spent[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {spent[name]}", file=sys.stderr, flush=True)
    flow = spent.get("approve_or_hold")
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(spent.values()), 3),
                "unit": "sec",
                "queries": spent,
                "sf": sf_dir.rsplit("sf", 1)[-1],
                "orders": orders,
                "orders_per_sec_score_route_allocate": round(orders / flow, 1) if flow else None,
            }
        )
    )


if __name__ == "__main__":
    main()
