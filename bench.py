"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
Each query runs once to warm up and is then timed to a full, discarded result; nothing stays cached in between.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from meterlens.plans.registry import all_queries  # noqa: E402

HEADLINE = (
    "basic_metrics_company",
    "basic_metrics_meter",
    "meter_profile_metrics",
    "company_profile_metrics",
    "monthly_profiles",
    "hourly_profiles",
    "meter_heterogeneity",
    "wide_to_long",
    "series_quality",
    "zero_runs",
    "value_anomalies",
    "active_span_flag",
    "meter_outliers",
    "company_outliers",
    "peer_metric_outliers",
    "enriched_hourly",
    "daily_energy",
    "weather_sensitivity",
    "holiday_effects",
    "outlier_context",
    "company_series",
    "weekday_profile",
    "prosumer_monthly",
    "company_card",
    "weather_parse",
    "holiday_calendar",
    "scaled_features",
)
# Iterative fits and whole runs: timed once, without a warm-up.
HEAVY = ("run_audits", "kmeans_groups", "silhouette_grid", "publish_run")


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("meterlens-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    available = all_queries()

    def timed(name: str) -> float:
        started = time.perf_counter()
        available[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took = time.perf_counter() - started
        spark.catalog.clearCache()
        return took

    seconds = {}
    for name in HEADLINE:
        timed(name)
        seconds[name] = round(timed(name), 3)
    for name in HEAVY:
        seconds[name] = round(timed(name), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
