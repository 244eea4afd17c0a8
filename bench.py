"""Headline-query benchmark: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_REPEATS (default 1),
BENCH_QUERIES (comma list, default the headline set). Each query is built and fully executed
(noop sink, no driver collection); the reported time is the median over the repeats, after each
query ran once on BENCH_WARMUP_DIR (default sf0.001) to warm the JVM.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "flagship_forecast",
    "describe_numeric", "histogram", "correlation_matrix", "iqr_filter",
    "fill_missing", "fill_forward_series", "interpolate_linear",
    "scaler_windowed_mean", "time_encoding", "label_encode",
    "random_split", "kfold", "chronological_split",
    "sliding_windows", "sliding_windows_raw", "seq2seq_windows", "strided_windows", "pad_series", "pad_series_long",
    "moving_average", "fourier_extrapolate", "decompose_rows", "exp_smooth_rows", "top_frequencies_rows", "autocorrelation_rows",
    "regression_metrics_multi", "precision_recall_f1", "roc_auc", "latest_runs", "tree_stump", "cross_validate",
    "cross_validate_ridge", "boost_stump_levels",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    names = [q for q in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if q]

    from tidepool.plans.flagship import flagship_forecast
    from tidepool.plans.suite import QUERIES
    from tidepool.session import local_session

    parts = int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", int(cpus) * 2))
    spark = local_session(cores=cpus, shuffle_partitions=parts, app="tidepool-bench")
    runners = dict(QUERIES)
    runners["flagship_forecast"] = flagship_forecast

    def run(name: str) -> float:
        t0 = time.perf_counter()
        df = runners[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        spark.catalog.clearCache()
        return time.perf_counter() - t0

    # JVM warm-up: every headline query once on the smallest scale factor (not reported)
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm_dir):
        for name in names:
            t0 = time.perf_counter()
            df = runners[name](spark, warm_dir)
            df.write.format("noop").mode("overwrite").save()
            spark.catalog.clearCache()
    times = {}
    for name in names:
        samples = [run(name) for _ in range(repeats)]
        times[name] = round(statistics.median(samples), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": int(cpus), "repeats": repeats}))
    spark.stop()


if __name__ == "__main__":
    main()
