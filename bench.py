"""Headline timings: one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from risklake.plans.catalog import REGISTRY

# the flows with a published or interactive cost in the comparison figures, then the heavy operators
HEADLINE = [
    "agg_01_performance_table", "ret_04_portfolio_constant_weight", "ret_05_portfolio_drift", "join_07_portfolio_totals", "ind_03_macd", "ind_12_regime_features",
    "agg_15_covariance_matrix", "agg_16_risk_contributions", "cor_04_snapshot_batch", "cor_09_portfolio_regime_watch", "reg_05_portfolio_regime", "var_01_historical", "var_03_joint_bootstrap",
    "var_11_method_comparison", "alc_12_allocation_report", "sim_05_portfolio_fan", "sim_10_worst_case_shock", "evl_08_league_table", "alt_05_evaluate_all", "alt_07_cooldown", "str_02_osd_decode",
    "str_08_latest_device_state", "flt_03_saved_screens",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("risklake-bench").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "6g")).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    REGISTRY[names[0]].run(spark, sf_dir).count()  # warm the JVM and the file cache, not timed
    timings: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        REGISTRY[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {timings[name]}", file=sys.stderr, flush=True)
    total = round(sum(timings.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": timings, "sf": sf_dir.rstrip("/").split("sf")[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
