"""The long fact table: one typed reading per series and hour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlens.functions import cells as C
from meterlens.functions.calendar import with_calendar
from meterlens.functions.skew import join_null_safe, salted_lookup
from meterlens.operators.quality import SERIES, typed_cells
from meterlens.schemas import HOURLY_LONG, conform
from meterlens.settings import Settings

_QUALITY = ("leading_missing_hours", "active_span_hours", "quality_status", "active_period_quality_status")


def hourly_long(cells: DataFrame, quality: DataFrame, settings: Settings) -> DataFrame:
    """Typed cells with calendar columns, active-span flag and the statuses of their series."""
    typed = (
        typed_cells(cells)
        .withColumnRenamed("value", "energy_kwh")
        .drop("raw_value", "kind", "hour_text", "period_year", "period_month")
    )
    series = quality.select(*SERIES, *_QUALITY)
    position, leading = F.col("row_position"), F.col("leading_missing_hours")
    joined = salted_lookup(typed, series, SERIES, "inner").withColumns(
        {
            "source_sheet": F.col("sheet"),
            "hour_1_24": F.col("hour"),
            "is_missing": F.col("energy_kwh").isNull(),
            "in_active_span": (position >= leading) & (position < leading + F.col("active_span_hours")),
        }
    )
    return conform(with_calendar(joined, settings.peak_hours), HOURLY_LONG)


def long_validation(long: DataFrame) -> DataFrame:
    """Counts and energy per sheet and overall (sheet NULL).

    Series are reduced before the roll-up: distinct counts then run over one row per series.
    """
    hours = long.groupBy("source_sheet", "interval_start").agg(F.count("*").alias("copies"))
    time_rows = hours.rollup("source_sheet").agg(F.count("*").alias("time_rows"))
    per_series = long.groupBy("source_sheet", "meter_id", "energy_flow").agg(
        F.count("*").alias("rows"),
        F.count_if("is_missing").alias("missing"),
        F.sum("energy_kwh").alias("energy"),
    )
    flow = F.col("energy_flow")
    totals = per_series.rollup("source_sheet").agg(
        F.count("*").alias("series"),
        F.countDistinct("meter_id").alias("physical_meters"),
        F.count_if(flow == C.IMPORT).alias("consumption_import_series"),
        F.count_if(flow == C.EXPORT).alias("injection_export_series"),
        F.sum("rows").alias("output_rows"),
        F.sum("missing").alias("missing_energy_rows"),
        F.coalesce(F.sum("energy"), F.lit(0.0)).alias("energy_sum_kwh"),
    )
    return join_null_safe(totals, time_rows, ["source_sheet"], "inner").withColumnRenamed(
        "source_sheet", "sheet"
    )
