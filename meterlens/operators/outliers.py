"""Z-score outliers of hours and of company metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlens.functions.skew import salted_lookup
from meterlens.settings import PEER_METRICS


def zscore_outliers(
    readings: DataFrame,
    baseline: DataFrame,
    keys: Sequence[str],
    threshold: float,
    extreme_multiple: float,
) -> DataFrame:
    """Readings further than ``threshold`` deviations from their own group mean.

    ``baseline`` has one row per key with ``energy_mean_kwh`` and ``energy_std_kwh``.
    """
    moments = baseline.select(*keys, "energy_mean_kwh", "energy_std_kwh")
    z = F.when(
        F.col("energy_std_kwh") > 0, (F.col("energy_kwh") - F.col("energy_mean_kwh")) / F.col("energy_std_kwh")
    )
    high = F.col("z_score") > 0
    technical = F.col("energy_kwh") > F.lit(extreme_multiple) * F.col("energy_mean_kwh")
    return (
        salted_lookup(readings.where(F.col("energy_kwh").isNotNull()), moments, keys, "inner")
        .withColumn("z_score", z)
        .where(F.abs("z_score") > threshold)
        .withColumns(
            {
                "outlier_direction": F.when(high, "high").otherwise("low"),
                "reason": F.when(high, f"above the mean with z > {threshold:g}").otherwise(
                    f"below the mean with z < -{threshold:g}"
                ),
                "recommendation": F.when(~high, "technical_or_outage")
                .when(technical, "technical")
                .otherwise("business_check"),
            }
        )
    )


def most_extreme_first(outliers: DataFrame, ties: Sequence[str] = ()) -> DataFrame:
    """All outliers in the order of a report: a range sort, so no task holds them all."""
    return outliers.orderBy(F.abs("z_score").desc(), *ties)


def top_outliers(outliers: DataFrame, rows: int, ties: Sequence[str]) -> DataFrame:
    """The ``rows`` most extreme outliers; ``ties`` decide between equal scores."""
    return most_extreme_first(outliers, ties).limit(rows)


def outlier_summary(outliers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Outlier hours per group, most first. Groups with a NULL key are left out."""
    return (
        outliers.dropna(subset=list(keys))
        .groupBy(*keys)
        .agg(
            F.count("*").alias("outlier_hours"),
            F.max(F.abs("z_score")).alias("maximum_absolute_z"),
            F.count_if(F.col("outlier_direction") == "high").alias("high_outliers"),
            F.count_if(F.col("outlier_direction") == "low").alias("low_outliers"),
        )
        .orderBy(F.col("outlier_hours").desc())
    )


def peer_metric_outliers(
    company_metrics: DataFrame, threshold: float, metrics: Sequence[str] = PEER_METRICS
) -> DataFrame:
    """Company metrics further than ``threshold`` deviations from the mean of all companies.

    The peer moments are one row per metric name, a fixed handful, and are broadcast.
    """
    values = company_metrics.select(
        "company_id", *[F.col(m).cast("double").alias(m) for m in metrics]
    ).unpivot(["company_id"], list(metrics), "metric", "metric_value")
    values = values.where(F.col("metric_value").isNotNull())
    peers = values.groupBy("metric").agg(
        F.avg("metric_value").alias("peer_mean"), F.stddev_samp("metric_value").alias("peer_std")
    )
    return (
        values.join(F.broadcast(peers.where(F.col("peer_std") > 0)), "metric")
        .withColumn("z_score", (F.col("metric_value") - F.col("peer_mean")) / F.col("peer_std"))
        .where(F.abs("z_score") > threshold)
        .select(
            "company_id",
            "metric",
            "metric_value",
            "peer_mean",
            "peer_std",
            "z_score",
            F.lit("all_companies_provisional").alias("comparison_scope"),
            F.lit("sector_metadata_pending").alias("sector_comparison_status"),
            F.lit("business_check_not_sector_outlier").alias("recommendation"),
        )
    )
