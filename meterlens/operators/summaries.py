"""Run summaries: one-row aggregates and their (metric, value) form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlens.settings import Settings


def metric_table(one_row: DataFrame) -> DataFrame:
    """A one-row summary as rows (metric, value); values are text, as kinds differ."""
    as_text = one_row.select(*[F.col(c).cast("string").alias(c) for c in one_row.columns])
    return as_text.unpivot([], as_text.columns, "metric", "value")


def _one_row_each(*parts: DataFrame) -> DataFrame:
    """Metric tables of several one-row summaries, stacked."""
    first, *rest = [metric_table(p) for p in parts]
    for part in rest:
        first = first.unionByName(part)
    return first


def quality_summary(
    quality: DataFrame, sheets: DataFrame, timeline: DataFrame, anomalies: DataFrame
) -> DataFrame:
    status, active = F.col("quality_status"), F.col("active_period_quality_status")
    series = quality.agg(
        F.count("*").alias("series_count"),
        F.countDistinct("meter_id").alias("physical_meter_count"),
        F.countDistinct("company_id").alias("company_count"),
        *[F.count_if(status == s).alias(f"{s}_series") for s in ("clean", "review", "unusable")],
        *[F.count_if(active == s).alias(f"active_period_{s}_series") for s in ("clean", "review", "unusable")],
    )
    return _one_row_each(
        sheets.agg(F.count("*").alias("sheet_count")),
        series,
        timeline.agg(F.count("*").alias("timeline_issue_count")),
        anomalies.agg(F.count("*").alias("anomaly_count")),
    )


def profile_summary(
    meter_metrics: DataFrame, company_metrics: DataFrame, company_monthly: DataFrame, heterogeneity: DataFrame
) -> DataFrame:
    label = F.col("meter_profile_similarity")
    return _one_row_each(
        meter_metrics.agg(
            F.count("*").alias("meter_energy_series"), F.countDistinct("meter_id").alias("physical_meters")
        ),
        company_metrics.agg(F.count("*").alias("companies")),
        company_monthly.agg(F.countDistinct("month_start").alias("profile_months")),
        heterogeneity.agg(
            F.count_if(label == "single_meter").alias("companies_one_meter"),
            F.count_if(label == "similar").alias("companies_similar_meters"),
            F.count_if(label == "partly_different").alias("companies_partly_different_meters"),
            F.count_if(label == "clearly_different").alias("companies_different_meters"),
        ),
    )


def outlier_run_summary(
    meter_outliers: DataFrame, company_outliers: DataFrame, peer_outliers: DataFrame
) -> DataFrame:
    """Rows and affected series; series are reduced first so the count is of distinct keys."""
    series = meter_outliers.select("company_id", "meter_id", "energy_flow").dropna().distinct()
    return _one_row_each(
        meter_outliers.agg(F.count("*").alias("meter_hourly_outliers")),
        series.agg(F.count("*").alias("meter_series_with_outliers")),
        company_outliers.agg(
            F.count("*").alias("company_hourly_outliers"),
            F.countDistinct("company_id").alias("companies_with_hourly_outliers"),
        ),
        peer_outliers.agg(F.count("*").alias("global_provisional_metric_outliers")),
    )


def weather_summary(weather: DataFrame, daily: DataFrame, calendar: DataFrame, settings: Settings) -> DataFrame:
    temperature = F.col("temperature_2m")
    per_hour = weather.groupBy("interval_start").agg(
        F.count("*").alias("copies"),
        F.count_if(temperature.isNull()).alias("missing"),
        F.min(temperature).alias("low"),
        F.max(temperature).alias("high"),
    )
    return _one_row_each(
        per_hour.agg(
            F.sum("copies").alias("weather_hourly_rows"),
            F.sum("missing").alias("weather_missing_temperatures"),
            (F.sum("copies") - F.count("*")).alias("weather_duplicate_timestamps"),
            F.min("low").alias("temperature_min_c"),
            F.max("high").alias("temperature_max_c"),
        ),
        daily.agg(F.count("*").alias("weather_daily_rows")),
        calendar.agg(
            F.count("*").alias("holiday_calendar_days"),
            F.count_if("is_official_holiday_date").alias("official_holiday_dates_in_period"),
            F.count_if("is_observed_day_off").alias("observed_days_off_in_period"),
            F.count_if("is_holiday_or_day_off").alias("holiday_or_day_off_unique_days"),
            F.lit(settings.hdd_base_c).alias("hdd_base_c"),
            F.lit(settings.cdd_base_c).alias("cdd_base_c"),
        ),
    )


def enrichment_summary(enriched: DataFrame) -> DataFrame:
    return enriched.agg(
        F.count("*").alias("enriched_rows"),
        F.count_if(F.col("temperature_2m").isNull()).alias("missing_weather_after_join"),
        F.coalesce(F.sum("energy_kwh"), F.lit(0.0)).alias("enriched_energy_sum_kwh"),
    )


def external_summary(
    meter_days: DataFrame,
    company_days: DataFrame,
    meter_sensitivity: DataFrame,
    company_sensitivity: DataFrame,
    effects: DataFrame,
    holiday_companies: DataFrame,
    outliers: DataFrame,
    settings: Settings,
) -> DataFrame:
    temperature = F.col("temperature_2m")
    return _one_row_each(
        meter_days.agg(F.count("*").alias("meter_daily_rows")),
        company_days.agg(F.count("*").alias("company_daily_rows")),
        meter_sensitivity.agg(F.count("*").alias("meter_weather_profiles")),
        company_sensitivity.agg(
            F.count("*").alias("company_weather_profiles"),
            F.count_if("weather_analysis_reliable").alias("reliable_company_weather_profiles"),
        ),
        effects.agg(F.count("*").alias("holiday_company_event_rows")),
        holiday_companies.agg(F.count("*").alias("companies_with_holiday_analysis")),
        outliers.agg(
            F.count("*").alias("company_outliers_enriched"),
            F.count_if(F.coalesce("is_holiday_or_day_off", F.lit(False))).alias("outliers_on_holiday_or_day_off"),
            F.count_if(temperature <= settings.cold_context_c).alias("outliers_with_cold_context"),
            F.count_if(temperature >= settings.hot_context_c).alias("outliers_with_hot_context"),
        ),
    )


def long_summary(validation: DataFrame) -> DataFrame:
    """Overall line of the long-table validation as metrics."""
    overall = validation.where(F.col("sheet").isNull())
    return metric_table(
        overall.select(
            F.col("series").alias("series_count"),
            F.col("physical_meters").alias("physical_meter_count"),
            "consumption_import_series",
            "injection_export_series",
            "output_rows",
            "missing_energy_rows",
            (F.col("output_rows") - F.col("missing_energy_rows")).alias("non_missing_energy_rows"),
            "energy_sum_kwh",
        )
    )
