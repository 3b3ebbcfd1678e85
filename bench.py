"""Benchmark: run the headline operator queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (optional comma-separated subset).  Each query is built, executed to
completion (results collected - all outputs are aggregates or bounded) and timed
warm: one untimed run of the flagship first loads the JVM, caches file listings and
compiles the common code paths.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "q00_flagship_nutrient_by_region",   # scan + join + aggregate
    "a05_feature_stats",                 # moments profile
    "a06_describe",                      # exact distributed quantiles
    "p10_iqr_sequential",                # sequential outlier removal
    "x01_stratified_split",              # exact stratified split, no class window
    "x09_pipeline",                      # full preprocessing pipeline
    "a19_roc_auc",                       # one-vs-rest AUC with ties
    "r01_crop_suitability",              # 22 crop rules per sample
    "w05_top_and_avoid",                 # per-sample ranking
    "j02_point_in_polygon",              # grid-bucketed spatial join
    "j12_asof_weather",                  # bucketed as-of join
    "w01_session_history",               # chunked bounded history
    "r08_compatibility",                 # weather rules on as-of result
    "m01_logistic_regression",           # Spark ML training + evaluation
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    from terroir.plans import catalog
    from terroir.session import local_session

    spark = local_session(cores=cpus, shuffle_partitions=max(8, int(cpus) * 2), app="terroir-bench")
    entries = catalog.load_all()
    entries["q00_flagship_nutrient_by_region"].fn(spark, sf_dir).collect()   # warm-up
    times, rows = {}, {}
    for name in wanted:
        if name not in entries:
            continue
        t0 = time.perf_counter()
        out = entries[name].fn(spark, sf_dir).collect()
        times[name] = round(time.perf_counter() - t0, 3)
        rows[name] = len(out)
        print(f"{name}: {times[name]}s", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "rows": rows, "sf": sf, "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
