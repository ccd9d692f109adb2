"""Load-profile metrics per meter and per company."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meterlens.functions.calendar import month_start
from meterlens.functions.cells import IMPORT
from meterlens.functions.skew import join_null_safe
from meterlens.functions.stats import relative_change, safe_ratio
from meterlens.settings import Settings

METER = ("company_id", "meter_id", "energy_flow")
COMPANY = ("company_id",)
COMPANY_HOUR = ("company_id", "interval_start", "date", "hour_1_24", "is_weekend", "is_peak_07_18")


def basic_metrics(readings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Totals, conditional means and ratios per group, in one aggregation."""
    x = F.col("energy_kwh")
    peak, weekend = F.col("is_peak_07_18"), F.col("is_weekend")
    agg = readings.groupBy(*keys).agg(
        F.count("*").alias("expected_rows"),
        F.count(x).alias("valid_hours"),
        F.coalesce(F.sum(x), F.lit(0.0)).alias("energy_total_kwh"),
        F.avg(x).alias("energy_mean_kwh"),
        F.stddev_samp(x).alias("energy_std_kwh"),
        F.max(x).alias("energy_max_kwh"),
        F.avg(F.when(peak, x)).alias("peak_mean_kwh"),
        F.avg(F.when(~peak, x)).alias("offpeak_mean_kwh"),
        F.avg(F.when(~weekend, x)).alias("weekday_mean_kwh"),
        F.avg(F.when(weekend, x)).alias("weekend_mean_kwh"),
        F.count_if(~peak).alias("_offpeak_rows"),
        F.count_if(weekend).alias("_weekend_rows"),
    )

    def zero_denominator(rows: str, mean: str):
        return F.when(F.col(rows) > 0, F.coalesce(F.col(mean), F.lit(0.0)) == 0)

    return agg.withColumns(
        {
            "missing_hours": F.col("expected_rows") - F.col("valid_hours"),
            "coverage_share": F.col("valid_hours") / F.col("expected_rows"),
            "peak_offpeak_ratio": safe_ratio(F.col("peak_mean_kwh"), F.col("offpeak_mean_kwh")),
            "weekday_weekend_ratio": safe_ratio(F.col("weekday_mean_kwh"), F.col("weekend_mean_kwh")),
            "coefficient_of_variation": safe_ratio(F.col("energy_std_kwh"), F.col("energy_mean_kwh")),
            "load_factor": safe_ratio(F.col("energy_mean_kwh"), F.col("energy_max_kwh")),
            "zero_offpeak_denominator": zero_denominator("_offpeak_rows", "offpeak_mean_kwh"),
            "zero_weekend_denominator": zero_denominator("_weekend_rows", "weekend_mean_kwh"),
        }
    ).drop("_offpeak_rows", "_weekend_rows")


def imported(readings: DataFrame) -> DataFrame:
    return readings.where(F.col("energy_flow") == IMPORT)


def company_hourly(long: DataFrame) -> DataFrame:
    """Consumption of a company per hour; NULL when no meter reports."""
    return (
        imported(long)
        .groupBy(*COMPANY_HOUR)
        .agg(F.sum("energy_kwh").alias("energy_kwh"), F.count("energy_kwh").alias("reporting_meter_count"))
    )


def monthly_profiles(readings: DataFrame, keys: Sequence[str], settings: Settings) -> DataFrame:
    """Month totals, means and seasonality index inside the profile period.

    The period mean is summed from the month rows, at most one row per month and group, so the
    window needs no second pass over the readings.
    """
    start = F.lit(settings.profile_start_date).cast("date").cast("timestamp_ntz")
    last = F.timestamp_add("HOUR", F.lit(23), F.lit(settings.profile_end_date).cast("date").cast("timestamp_ntz"))
    monthly = (
        readings.where(F.col("interval_start").between(start, last))
        .withColumn("month_start", month_start(F.col("interval_start")))
        .groupBy(*keys, "month_start")
        .agg(
            F.coalesce(F.sum("energy_kwh"), F.lit(0.0)).alias("month_total_kwh"),
            F.avg("energy_kwh").alias("month_mean_kwh"),
            F.count("energy_kwh").alias("valid_hours"),
            F.count("*").alias("expected_hours"),
        )
    )
    group = W.partitionBy(*keys)
    valid = F.sum("valid_hours").over(group)
    return monthly.withColumns(
        {
            "coverage_share": F.col("valid_hours") / F.col("expected_hours"),
            "profile_period_mean_kwh": safe_ratio(F.sum("month_total_kwh").over(group), valid),
        }
    ).withColumn("seasonality_index", F.try_divide("month_mean_kwh", "profile_period_mean_kwh"))


def _month_roles(monthly: DataFrame, scope: Sequence[str]) -> DataFrame:
    """The first three months and the last month of each scope, at most one row per month."""
    months = F.array_sort(F.collect_set("month_start"))
    return (
        monthly.groupBy(*scope)
        .agg(months.alias("months"))
        .select(*scope, F.size("months").alias("n"), F.posexplode("months").alias("pos", "month_start"))
        .select(
            *scope,
            "month_start",
            (F.col("pos") < 3).alias("is_first_3"),
            (F.col("pos") == F.col("n") - 1).alias("is_last"),
        )
    )


def seasonality_and_trend(
    monthly: DataFrame, keys: Sequence[str], settings: Settings, scope: Sequence[str] = ()
) -> DataFrame:
    """Season indices, label and month trend per group.

    ``scope`` names the columns inside which the first three and the last month are looked up:
    the source sheet for meters, nothing (all rows) for companies.
    """
    marked = join_null_safe(monthly, _month_roles(monthly, scope), [*scope, "month_start"], "inner")
    month, index = F.month("month_start"), F.col("seasonality_index")
    covered = F.col("coverage_share") >= settings.reliable_coverage
    first, last = F.col("is_first_3"), F.col("is_last")
    agg = marked.groupBy(*keys).agg(
        F.avg(F.when(month.isin(6, 7, 8), index)).alias("summer_index"),
        F.avg(F.when(month.isin(12, 1, 2), index)).alias("winter_index"),
        F.avg(F.when(first, F.col("month_mean_kwh"))).alias("first_3_months_mean_kwh"),
        F.avg(F.when(last, F.col("month_mean_kwh"))).alias("last_month_mean_kwh"),
        F.count_if(F.col("valid_hours") > 0).alias("months_with_values"),
        F.count_if(covered).alias("months_with_90pct_coverage"),
        F.count_if(first).alias("_first"),
        F.count_if(first & covered).alias("_first_covered"),
        F.count_if(last).alias("_last"),
        F.count_if(last & covered).alias("_last_covered"),
    )
    summer, winter = F.col("summer_index"), F.col("winter_index")

    def dominates(season, other):
        return (season >= settings.seasonality_index) & (season - other >= settings.seasonality_difference)

    return agg.withColumns(
        {
            "seasonality_label": F.when(dominates(summer, winter), "summer")
            .when(dominates(winter, summer), "winter")
            .otherwise("none"),
            "monthly_trend_pct": relative_change(
                F.col("last_month_mean_kwh"), F.col("first_3_months_mean_kwh")
            ),
            "seasonality_reliable": F.col("months_with_90pct_coverage") == 12,
            "trend_reliable": (F.col("_first") == 3)
            & (F.col("_first_covered") == 3)
            & (F.col("_last") == 1)
            & (F.col("_last_covered") == 1),
        }
    ).drop("_first", "_first_covered", "_last", "_last_covered")


def hourly_profiles(readings: DataFrame, keys: Sequence[str]) -> DataFrame:
    return readings.groupBy(*keys, "hour_1_24").agg(
        F.avg("energy_kwh").alias("mean_kwh"), F.count("energy_kwh").alias("valid_hours")
    )


def meter_monthly(long: DataFrame, settings: Settings) -> DataFrame:
    """Monthly profiles of meters; ``source_sheet`` is kept because trend months are per sheet."""
    return monthly_profiles(long, [*METER, "source_sheet"], settings)


def meter_profile_metrics(long: DataFrame, settings: Settings) -> DataFrame:
    """The ``meter_profile_metrics`` table. Series are unique across sheets and statuses are
    constant per series, so both ride along as grouping columns instead of a second join."""
    keys = [*METER, "quality_status", "active_period_quality_status", "source_sheet"]
    seasonal = seasonality_and_trend(
        meter_monthly(long, settings), [*METER, "source_sheet"], settings, scope=["source_sheet"]
    )
    return join_null_safe(basic_metrics(long, keys), seasonal, [*METER, "source_sheet"])


def company_profile_metrics(
    company_hours: DataFrame, meter_metrics: DataFrame, settings: Settings
) -> DataFrame:
    """The ``company_profile_metrics`` table from company hours and meter metrics."""
    reporting = company_hours.groupBy(*COMPANY).agg(
        F.avg("reporting_meter_count").alias("mean_reporting_meters"),
        F.min("reporting_meter_count").alias("minimum_reporting_meters"),
        F.max("reporting_meter_count").alias("maximum_reporting_meters"),
    )
    meters = imported(meter_metrics).groupBy(*COMPANY).agg(F.countDistinct("meter_id").alias("meter_count"))
    seasonal = seasonality_and_trend(monthly_profiles(company_hours, COMPANY, settings), COMPANY, settings)
    metrics = basic_metrics(company_hours, COMPANY)
    for part in (seasonal, meters, reporting):
        metrics = join_null_safe(metrics, part, COMPANY)
    return metrics
