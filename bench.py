"""Headline queries on local[$BENCH_CPUS] at $BENCH_SF_DIR; prints one JSON line."""

import json
import os
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks.queries import prepare, queries  # noqa: E402

HEADLINE = [
    "src_validate",
    "src_bulk",
    "flt_last_n",
    "flt_spike",
    "win_lag",
    "win_roll",
    "win_matrix",
    "res_mean",
    "res_mean_full",
    "agg_stats",
    "agg_describe",
    "agg_hourly",
    "agg_corr",
    "agg_corrpairs",
    "join_nearest",
    "join_knn",
    "join_knn_hashed",
    "join_knn_index",
    "sort_abs",
    "mod_if_fit",
    "mod_train",
    "mod_score_df",
    "mod_lof_fit",
    "q_timeseries",
    "q_anomalies",
]


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("wattspan-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="wattspan-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered, timings = queries(), {}
    prepare(spark, sf_dir)
    wanted = sys.argv[1:] or HEADLINE
    for name in wanted:
        started = time.time()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.time() - started, 3)
    total = round(sum(timings.values()), 3)
    line = {"metric": "total_query_time", "value": total, "unit": "sec", "queries": timings, "sf": Path(sf_dir).name[2:]}
    print(json.dumps(line))


if __name__ == "__main__":
    main()
