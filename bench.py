"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

    python bench.py                 # headline queries
    python bench.py all             # every query of the catalogue
    python bench.py f06 h04         # queries whose names start so
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

HEADLINE = [
    "b06_prefix_linear_fit",
    "c10_robust_zscore",
    "d01_rolling_trailing",
    "d20_window_chain",
    "e12_path_summary",
    "f01_interp_join",
    "f06_lag_scan",
    "f07_lag_scan_multiscale",
    "f10_local_offset_search",
    "f16_self_match",
    "f18_signature_match",
    "f19_dtw_lag_features",
    "f24_posterior_match",
    "g04_layer_context",
    "h04_knn_idw",
    "i02_datum_predict",
    "j01_savgol",
    "j09_slope_limit",
    "k04_baseline_report",
    "l03_gram",
    "l12_policy_grid",
    "n03_overlap_gate",
    "o06_pairwise_distance",
    "p01_numeric_summary",
    "q06_rank_records",
    "z01_holdout_report",
    "z02_feature_set",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("strataline-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from strataline.plans.catalog import CATALOG
    from strataline.settings import clear_work

    wanted = sys.argv[1:]
    names = HEADLINE if not wanted else [n for n in CATALOG if wanted == ["all"] or any(n.startswith(w) for w in wanted)]
    if wanted:
        repeats = 1

    def run(name: str) -> float:
        start = time.perf_counter()
        CATALOG[name].plan(spark, sf_dir).write.format("noop").mode("overwrite").save()
        took = time.perf_counter() - start
        clear_work(spark)
        return took

    run("d01_rolling_trailing")  # start-up is not part of any query
    times = {}
    for name in names:
        times[name] = round(statistics.median(run(name) for _ in range(repeats)), 3)
        if wanted:
            print(name, times[name], file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total_seconds", "value": total, "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
