from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from meterlens.operators import outliers
from meterlens.settings import PEER_METRICS

BASELINE = "company_id string, energy_mean_kwh double, energy_std_kwh double"


def test_hourly_outlier_by_hand(spark):
    # Mean 20, deviation 4: 31 has z 2.75, 34 has z 3.5 and 6 has z -3.5.
    readings = spark.createDataFrame([("Z", 31.0), ("Z", 34.0), ("Z", 6.0)], "company_id string, energy_kwh double")
    baseline = spark.createDataFrame([("Z", 20.0, 4.0)], BASELINE)
    rows = outliers.zscore_outliers(readings, baseline, ["company_id"], 3.0, 2.0).orderBy("z_score").collect()
    assert [(r["z_score"], r["outlier_direction"]) for r in rows] == [(-3.5, "low"), (3.5, "high")]
    assert [r["recommendation"] for r in rows] == ["technical_or_outage", "business_check"]
    assert rows[1]["reason"] == "above the mean with z > 3"


def test_directions_recommendations_and_null_paths(spark):
    readings = spark.createDataFrame(
        [("K", -10.0), ("K", 1000.0), ("K", None), ("flat", 9.0), ("unknown", 9.0), (None, 50.0)],
        "company_id string, energy_kwh double",
    )
    baseline = spark.createDataFrame(
        [("K", 10.0, 5.0), ("flat", 9.0, 0.0), (None, 10.0, 5.0)], BASELINE
    )
    found = outliers.zscore_outliers(readings, baseline, ["company_id"], 3.0, 50.0)
    got = {(r["company_id"], r["energy_kwh"]): (r["outlier_direction"], r["recommendation"]) for r in found.collect()}
    assert got == {
        ("K", -10.0): ("low", "technical_or_outage"),
        ("K", 1000.0): ("high", "technical"),
        (None, 50.0): ("high", "business_check"),
    }
    summary = outliers.outlier_summary(found, ["company_id"]).collect()
    assert [(r["company_id"], r["outlier_hours"], r["high_outliers"], r["low_outliers"]) for r in summary] == [("K", 2, 1, 1)]
    assert summary[0]["maximum_absolute_z"] == 198.0


def test_threshold_is_strict_and_order_is_by_size(spark):
    readings = spark.createDataFrame([("K", 25.0), ("K", 26.0), ("K", -20.0)], "company_id string, energy_kwh double")
    baseline = spark.createDataFrame([("K", 10.0, 5.0)], BASELINE)
    found = outliers.zscore_outliers(readings, baseline, ["company_id"], 3.0, 50.0)
    assert [r["energy_kwh"] for r in outliers.most_extreme_first(found).collect()] == [-20.0, 26.0]
    assert [r["energy_kwh"] for r in outliers.top_outliers(found, 1, ["energy_kwh"]).collect()] == [-20.0]


def test_peer_metrics(spark):
    rows = [(f"C{i}", *[1.0] * 6, None) for i in range(9)] + [("odd", 5.0, *[1.0] * 5, 2.0)]
    metrics = spark.createDataFrame(rows, "company_id string, " + ", ".join(f"{m} double" for m in PEER_METRICS))
    got = outliers.peer_metric_outliers(metrics, 2.0).collect()
    # The other metrics are constant or have a single value, so they have no deviation.
    assert [(r["company_id"], r["metric"]) for r in got] == [("odd", "peak_offpeak_ratio")]
    assert got[0]["peer_mean"] == pytest.approx(1.4)
    assert metrics.agg(F.stddev_samp("peak_offpeak_ratio")).first()[0] == pytest.approx(got[0]["peer_std"])
