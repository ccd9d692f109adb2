"""Weather and holidays: dimensions, enrichment, sensitivity, holiday effects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meterlens.functions.calendar import degree_days, period_days
from meterlens.functions.cells import joined_names, joined_pair
from meterlens.functions.stats import guarded_corr, relative_change
from meterlens.operators.profiles import imported
from meterlens.settings import Settings

WEATHER = ("temperature_2m", "temperature_2m_mean", "temperature_2m_min", "temperature_2m_max", "hdd_18", "cdd_18")
HOLIDAY = (
    "is_official_holiday_date",
    "is_observed_day_off",
    "is_holiday_or_day_off",
    "holiday_name",
    "is_day_before_holiday",
    "is_day_after_holiday",
)
DAY_ATTRIBUTES = (
    "date",
    "temperature_2m_mean",
    "temperature_2m_min",
    "temperature_2m_max",
    "hdd_18",
    "cdd_18",
    "is_holiday_or_day_off",
    "holiday_name",
)


def with_degree_days(daily: DataFrame, settings: Settings) -> DataFrame:
    mean = F.col("temperature_2m_mean")
    return daily.withColumns(
        {
            "hdd_18": degree_days(mean, settings.hdd_base_c, heating=True),
            "cdd_18": degree_days(mean, settings.cdd_base_c, heating=False),
        }
    )


def weather_hourly(hourly: DataFrame, daily: DataFrame, settings: Settings, keys: Sequence[str] = ()) -> DataFrame:
    """Hourly temperatures with the daily figures and degree days of their date."""
    by_day = with_degree_days(daily, settings).select(*keys, "date", *WEATHER[1:])
    return hourly.join(by_day, [*keys, "date"], "left").select(
        *keys, "interval_start", "temperature_2m", "date", *WEATHER[1:]
    )


def holiday_calendar(spark: SparkSession, events: DataFrame, settings: Settings) -> DataFrame:
    """One row per day of the analysis period with holiday flags and names.

    Both dates of an event, and the days around them, become one table by day that is aggregated and joined once. A
    date outside the period marks no day next to it.
    """
    official, observed, here = F.col("official"), ~F.col("official"), F.col("offset") == 0
    dates = F.array(
        F.struct(F.col("holiday_date").alias("day"), F.lit(True).alias("official")),
        F.struct(F.col("observed_date").alias("day"), F.lit(False).alias("official")),
    )
    day = F.col("day").between(F.lit(settings.start_date).cast("date"), F.lit(settings.end_date).cast("date"))
    marks = (
        events.select("holiday_name", F.inline(dates))
        .where(day)
        .select("holiday_name", "official", "day", F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)])).alias("offset"))
        .select("holiday_name", "official", "offset", F.date_add("day", "offset").alias("date"))
        .groupBy("date")
        .agg(
            F.bool_or(official & here).alias("is_official_holiday_date"),
            joined_names(F.when(official & here, F.col("holiday_name"))).alias("actual_holiday_name"),
            F.bool_or(observed & here).alias("is_observed_day_off"),
            joined_names(F.when(observed & here, F.col("holiday_name"))).alias("observed_holiday_name"),
            F.bool_or(F.col("offset") == -1).alias("is_day_before_holiday"),
            F.bool_or(F.col("offset") == 1).alias("is_day_after_holiday"),
        )
    )
    flags = ("is_official_holiday_date", "is_observed_day_off", "is_day_before_holiday", "is_day_after_holiday")
    return (
        period_days(spark, settings.start_date, settings.end_date)
        .join(marks, "date", "left")
        .fillna(False, list(flags))
        .withColumns(
            {
                "is_holiday_or_day_off": F.col("is_official_holiday_date") | F.col("is_observed_day_off"),
                "holiday_name": joined_pair(F.col("actual_holiday_name"), F.col("observed_holiday_name")),
            }
        )
        .select(
            "date",
            "is_official_holiday_date",
            "actual_holiday_name",
            "is_observed_day_off",
            "observed_holiday_name",
            "is_holiday_or_day_off",
            "holiday_name",
            "is_day_before_holiday",
            "is_day_after_holiday",
        )
    )


def enrich_hourly(long: DataFrame, weather: DataFrame, calendar: DataFrame) -> DataFrame:
    """Readings with weather of the hour and holiday of the day.

    Both dimensions hold one row per hour or day of the period; no hint is given, so Spark
    broadcasts them by their measured size.
    """
    return long.join(weather.select("interval_start", *WEATHER), "interval_start", "left").join(
        calendar.select("date", *HOLIDAY), "date", "left"
    )


def meter_daily(enriched: DataFrame) -> DataFrame:
    """Import energy and valid hours per meter and day."""
    return (
        imported(enriched)
        .groupBy("company_id", "meter_id", *DAY_ATTRIBUTES)
        .agg(
            F.coalesce(F.sum("energy_kwh"), F.lit(0.0)).alias("energy_total_kwh"),
            F.count("energy_kwh").alias("valid_hours"),
        )
    )


def company_daily(meters: DataFrame) -> DataFrame:
    """Company days from meter days, which hold a meter once per day, so meters are just counted."""
    return meters.groupBy("company_id", *DAY_ATTRIBUTES).agg(
        F.coalesce(F.sum("energy_total_kwh"), F.lit(0.0)).alias("energy_total_kwh"),
        F.sum("valid_hours").alias("valid_hours"),
        F.count("meter_id").alias("reporting_meters"),
    )


def weather_sensitivity(daily: DataFrame, keys: Sequence[str], settings: Settings) -> DataFrame:
    """Correlation of daily energy with temperature and degree days, cold- and hot-day means.

    Quartiles are windowed per key: a key has one row per day of the period.
    """
    energy, mean = F.col("energy_total_kwh"), F.col("temperature_2m_mean")
    valid = (F.col("valid_hours") > 0) & energy.isNotNull()
    group = W.partitionBy(*keys)
    days = daily.dropna(subset=list(keys)).withColumn("_temp", F.when(valid, mean))
    days = days.withColumns(
        {
            "_q25": F.percentile("_temp", F.lit(0.25)).over(group),
            "_q75": F.percentile("_temp", F.lit(0.75)).over(group),
            "_energy": F.when(valid, energy),
        }
    )
    temp = F.col("_temp")
    x = F.col("_energy")
    agg = days.groupBy(*keys).agg(
        F.count_if(valid).alias("days_with_consumption"),
        guarded_corr(x, temp).alias("temperature_correlation"),
        guarded_corr(x, F.col("hdd_18")).alias("hdd_correlation"),
        guarded_corr(x, F.col("cdd_18")).alias("cdd_correlation"),
        F.avg(F.when(temp <= F.col("_q25"), x)).alias("cold_days_mean_kwh"),
        F.avg(F.when(temp >= F.col("_q75"), x)).alias("hot_days_mean_kwh"),
    )
    heating = F.coalesce(F.col("hdd_correlation") >= settings.weather_correlation, F.lit(False))
    cooling = F.coalesce(F.col("cdd_correlation") >= settings.weather_correlation, F.lit(False))
    return agg.withColumns(
        {
            "weather_sensitivity_label": F.when(heating & cooling, "both")
            .when(heating, "heating")
            .when(cooling, "cooling")
            .otherwise("unclear"),
            "weather_analysis_reliable": F.col("days_with_consumption") >= settings.minimum_weather_days,
        }
    )


def holiday_effects(daily: DataFrame) -> DataFrame:
    """Energy of each holiday against the mean of normal days on the same weekday."""
    days = daily.where(F.col("company_id").isNotNull() & (F.col("valid_hours") > 0)).withColumn(
        "weekday_number", F.weekday("date")
    )
    normal = (
        days.where(~F.col("is_holiday_or_day_off"))
        .groupBy("company_id", "weekday_number")
        .agg(
            F.avg("energy_total_kwh").alias("same_weekday_baseline_kwh"),
            F.count("*").alias("baseline_day_count"),
        )
    )
    energy, baseline = F.col("energy_total_kwh"), F.col("same_weekday_baseline_kwh")
    return (
        days.where("is_holiday_or_day_off")
        .join(normal, ["company_id", "weekday_number"], "left")
        .select(
            "company_id",
            "date",
            "holiday_name",
            "weekday_number",
            energy.alias("holiday_energy_kwh"),
            baseline,
            relative_change(energy, baseline).alias("holiday_effect_pct"),
            F.coalesce("baseline_day_count", F.lit(0)).alias("baseline_day_count"),
        )
    )


def holiday_summary(effects: DataFrame, settings: Settings) -> DataFrame:
    """Mean, median and count of reductions per company; a company has one row per holiday."""
    effect, mean = F.col("holiday_effect_pct"), F.col("mean_holiday_effect_pct")
    return (
        effects.groupBy("company_id")
        .agg(
            F.countDistinct("date").alias("holiday_days_analysed"),
            F.avg(effect).alias("mean_holiday_effect_pct"),
            F.median(effect).alias("median_holiday_effect_pct"),
            F.count_if(effect < 0).alias("holidays_with_reduction"),
        )
        .withColumn(
            "holiday_behavior_label",
            F.when(mean <= -settings.holiday_cut, "lower")
            .when(mean >= settings.holiday_cut, "higher")
            .otherwise("limited"),
        )
    )


def outlier_context(outliers: DataFrame, weather: DataFrame, calendar: DataFrame, settings: Settings) -> DataFrame:
    """Company outliers with the weather and holiday that may explain them."""
    temperature = F.col("temperature_2m")
    return (
        outliers.join(
            weather.select("interval_start", "temperature_2m", "temperature_2m_mean", "hdd_18", "cdd_18"),
            "interval_start",
            "left",
        )
        .join(calendar.select("date", "is_holiday_or_day_off", "holiday_name"), "date", "left")
        .withColumn(
            "external_context",
            F.when(F.col("is_holiday_or_day_off"), "holiday")
            .when(temperature <= settings.cold_context_c, "cold")
            .when(temperature >= settings.hot_context_c, "hot")
            .otherwise("none"),
        )
    )
