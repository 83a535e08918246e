"""Benchmark: run the headline catalogue queries and print one JSON line.

    BENCH_SF_DIR (default /root/testdata/sf0.1)   BENCH_CPUS (default 8)
    BENCH_QUERIES (optional, comma-separated names)

Each query is executed completely with the ``noop`` sink (every row is
produced, nothing is collected to the driver) and timed with wall-clock time;
each runs twice and the better run is reported (the first also pays JIT and
code generation). ``BENCH_RUNS`` changes the number of runs.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "score_history", "history_products_mode", "history_products_distinct", "next_sku_labels",
    "items_flatten", "sku_count_pivot", "bundle_expand", "category_presence",
    "purchase_counts", "city_frequency", "gender_enrich", "census_enrich",
    "person_split", "label_weights", "auc_per_target", "pr_curve", "threshold_sweep",
    "rank_top_products", "clean_orders", "train_return_forest", "train_return_boosted", "serve_features",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE

    from ordersight.session import get_session
    from ordersight.plans.catalog import QUERIES

    spark = get_session(f"local[{cpus}]", shuffle_partitions=max(2 * cpus, 8),
                        extra={"spark.driver.memory": "16g"})
    # Warm-up: JVM, parquet reader and codegen paths, not timed.
    QUERIES["repeat_flags"](spark, sf_dir).write.format("noop").mode("overwrite").save()

    runs = int(os.environ.get("BENCH_RUNS", "2"))
    times = {}
    for name in names:
        best = None
        for _ in range(runs):
            t0 = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
        times[name] = round(best, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
