"""Benchmark the headline queries.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is executed in full with the ``noop`` sink (every row produced,
nothing collected to the driver).  Prints one JSON line on stdout.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "features_recorded", "features_blocked", "features_events_blocked", "features_as_of",
    "features_single_series_blocked",
    "clean_draws", "read_draws_tabular", "extract_result_rows", "upsert", "bulk_load_report",
    "acf", "lag_corr", "classification_report", "top3_numbers", "alerts", "converged",
    "backtest_frequency", "backtest_metrics", "flagship",
    "ingest_stream", "ml_predict_latest", "backtest_rf",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    from drawseries.plans.registry import REGISTRY, spark_query
    from drawseries import plans  # noqa: F401
    from drawseries.session import get_spark

    spark = get_spark(f"local[{cpus}]", shuffle_partitions=cpus,
                      extra={"spark.driver.memory": "16g"})
    spark.range(1000).selectExpr("sum(id)").collect()          # JVM warm-up, not timed
    timings: dict[str, float] = {}
    for name in names:
        if name not in REGISTRY:
            continue
        t0 = time.perf_counter()
        spark_query(name)(spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - t0, 3)
        print(f"{name}: {timings[name]}s", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(timings.values()), 3),
                      "unit": "sec", "queries": timings, "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
