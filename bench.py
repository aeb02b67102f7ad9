"""Times the headline queries over BENCH_SF_DIR on local[BENCH_CPUS] and prints one JSON line: best of two runs each."""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "row_counts",
    "join_hit_rate_orders_customer",
    "join_broken_part_customer",
    "join_when_click_events_supplier",
    "join_by_event_type",
    "orphan_rows_part_customer",
    "dense_keys",
    "measure_join_single",
    "measure_claims_all",
    "measure_claims_long_form",
    "profile_all",
    "describe_part",
    "value_lists_lineitem",
    "repeatable_sample_lineitem",
    "dead_tables_as_of",
    "inconsistent_values_docs",
    "duplicate_overlap_documents",
    "suspicions_all",
    "remeasure_moved",
    "join_lines",
    "table_reports",
    "profile_orders_sampled",
]
RUNS = 2


def main() -> None:
    from pyspark.sql import SparkSession

    from suite.queries import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.log.level", "ERROR")
        .getOrCreate()
    )
    times = {}
    for name in HEADLINE:
        best = None
        for _ in range(RUNS):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    spark.stop()
    sf = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf.group(1)) if sf else None}))


if __name__ == "__main__":
    main()
