"""Interactive queries on the result tables. Without a company they answer for all companies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlens.functions.calendar import month_start
from meterlens.functions.cells import EXPORT, IMPORT, trailing_number
from meterlens.operators.profiles import imported

# Display texts of the energy flows and of the day kinds.
FLOW_LABELS = {IMPORT: "Consumption / import (A+)", EXPORT: "Injection / export (A-)"}
DAY_LABELS = {False: "working day", True: "weekend"}


def _label(column: Column, labels: dict) -> Column:
    pairs = [F.lit(x) for pair in labels.items() for x in pair]
    return F.create_map(*pairs)[column]


def for_company(
    table: DataFrame, company_id: str | None = None, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Rows of one company and an inclusive date range; both filters reach the scan."""
    if company_id is not None:
        table = table.where(F.col("company_id") == company_id)
    if start is not None:
        table = table.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        table = table.where(F.col("date") <= F.lit(end).cast("date"))
    return table


def natural_order(df: DataFrame, column: str = "company_id") -> DataFrame:
    """Order ids by their trailing number; ids without one come last."""
    return df.orderBy(trailing_number(F.col(column)), column)


def company_list(company_metrics: DataFrame) -> DataFrame:
    return natural_order(company_metrics.select("company_id").distinct())


def date_bounds(hourly: DataFrame) -> DataFrame:
    return hourly.groupBy("company_id").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def meter_flows(meter_metrics: DataFrame) -> DataFrame:
    """Flows available for each meter."""
    return meter_metrics.select("company_id", "meter_id", "energy_flow").distinct()


def company_series(hourly: DataFrame) -> DataFrame:
    """Hourly consumption of a company; NULL when every meter is missing."""
    return imported(hourly).groupBy("company_id", "interval_start").agg(F.sum("energy_kwh").alias("energy_kwh"))


def day_kind_profile(hourly: DataFrame) -> DataFrame:
    """Mean 24-hour profile of working days and weekends from company hours."""
    hours = (
        imported(hourly)
        .groupBy("company_id", "interval_start", "hour_1_24", "is_weekend")
        .agg(F.sum("energy_kwh").alias("energy_kwh"))
    )
    return (
        hours.groupBy("company_id", "hour_1_24", "is_weekend")
        .agg(F.avg("energy_kwh").alias("energy_kwh"))
        .withColumn("day_kind", _label(F.col("is_weekend"), DAY_LABELS))
    )


def holiday_days(daily: DataFrame) -> DataFrame:
    return daily.where("is_holiday_or_day_off").select(
        "company_id", "date", "holiday_name", "energy_total_kwh", "temperature_2m_mean"
    )


def outlier_counts(outliers: DataFrame) -> DataFrame:
    """Outliers per company: all, high, low, on holidays."""
    direction = F.col("outlier_direction")
    return outliers.groupBy("company_id").agg(
        F.count("*").alias("outliers"),
        F.count_if(direction == "high").alias("high"),
        F.count_if(direction == "low").alias("low"),
        F.count_if(F.coalesce("is_holiday_or_day_off", F.lit(False))).alias("on_holiday"),
    )


def prosumer_monthly(hourly: DataFrame) -> DataFrame:
    """Monthly energy per flow of the meters that have both flows.

    Readings are reduced to one row per meter, month and flow before the flows are counted.
    """
    monthly = (
        hourly.withColumn("month", month_start(F.col("interval_start")))
        .groupBy("company_id", "meter_id", "energy_flow", "month")
        .agg(F.sum("energy_kwh").alias("energy_kwh"))
    )
    both = (
        monthly.groupBy("company_id", "meter_id")
        .agg(F.countDistinct("energy_flow").alias("flows"))
        .where(F.col("flows") == 2)
    )
    return monthly.join(both, ["company_id", "meter_id"], "left_semi").withColumn(
        "direction", _label(F.col("energy_flow"), FLOW_LABELS)
    )


def status_counts(quality: DataFrame) -> DataFrame:
    """Series per company and quality status."""
    return quality.groupBy("company_id", "quality_status").agg(F.count("*").alias("series"))


def company_card(
    metrics: DataFrame,
    heterogeneity: DataFrame,
    sensitivity: DataFrame,
    holidays: DataFrame,
    clusters: DataFrame | None = None,
) -> DataFrame:
    """One row per company with its headline figures and default texts where a part is absent."""
    card = metrics.select(
        "company_id",
        (F.col("energy_total_kwh") / 1000).alias("energy_total_mwh"),
        "peak_offpeak_ratio",
        "weekday_weekend_ratio",
        "load_factor",
        "coverage_share",
        "seasonality_label",
        "monthly_trend_pct",
        "seasonality_reliable",
        "meter_count",
    )
    parts = [
        heterogeneity.select("company_id", "meter_profile_similarity"),
        sensitivity.select(
            "company_id",
            "temperature_correlation",
            "hdd_correlation",
            "cdd_correlation",
            "weather_sensitivity_label",
        ),
        holidays.select("company_id", "mean_holiday_effect_pct"),
    ]
    if clusters is not None:
        group = F.replace(F.col("cluster_id"), F.lit("Cluster"), F.lit("Group"))
        parts.append(clusters.select("company_id", group.alias("cluster_id"), "cluster_description"))
    for part in parts:
        card = card.join(part, "company_id", "left")
    if clusters is None:
        return card
    return card.fillna(
        {"cluster_id": "No group", "cluster_description": "One or more metrics for grouping are missing"}
    )


def cluster_overview(centers: DataFrame) -> DataFrame:
    """Groups with description and size, as shown next to the scatter plot."""
    return centers.select(
        F.replace(F.col("cluster_id"), F.lit("Cluster"), F.lit("Group")).alias("cluster_id"),
        "cluster_description",
        "company_count",
    )
