"""Data-quality assertions that stop a run: rows (check, violations, passed)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlens.functions import cells as C
from meterlens.functions.skew import join_null_safe
from meterlens.operators.quality import overlapping_series
from meterlens.settings import Settings


def _count(df: DataFrame, check: str) -> DataFrame:
    """One audit row that counts the rows of a violations table."""
    return df.agg(F.count("*").alias("violations")).select(F.lit(check).alias("check"), "violations")


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where(F.col("copies") > 1)


def combine(parts: Sequence[DataFrame]) -> DataFrame:
    rows = reduce(DataFrame.unionByName, parts)
    return rows.withColumn("passed", F.col("violations") == 0)


def header_audits(series: DataFrame, prosumer_match: str) -> list[DataFrame]:
    """Series unique within and across sheets; prosumer meters carry both flows."""
    within = duplicates(series, ["sheet", "meter_id", "energy_flow"])
    across = overlapping_series(series).where(F.col("sheets") > 1)
    unpaired = (
        series.where(C.is_prosumer_sheet(F.col("sheet"), prosumer_match))
        .groupBy("meter_id")
        .agg(F.countDistinct("energy_flow").alias("flows"))
        .where(F.col("flows") != 2)
    )
    return [
        _count(within, "series_unique_in_sheet"),
        _count(across, "series_unique_across_sheets"),
        _count(unpaired, "prosumer_has_both_flows"),
    ]


def long_audits(rows: DataFrame, series: DataFrame, quality: DataFrame, long: DataFrame) -> list[DataFrame]:
    """Time keys unique, rows = time rows x series, missing cells as counted by the quality step."""
    expected = (
        rows.groupBy("sheet").agg(F.count("*").alias("time_rows"))
        .join(series.groupBy("sheet").agg(F.count("*").alias("series")), "sheet", "full_outer")
        .select("sheet", (F.coalesce("time_rows", F.lit(0)) * F.coalesce("series", F.lit(0))).alias("expected"))
    )
    produced = long.groupBy(F.col("source_sheet").alias("sheet")).agg(
        F.count("*").alias("produced"), F.count_if("is_missing").alias("missing")
    )
    reported = quality.groupBy("sheet").agg(
        F.sum(F.col("missing_hours") + F.col("non_numeric_values")).alias("reported")
    )
    sheets = (
        expected.join(produced, "sheet", "full_outer").join(reported, "sheet", "full_outer").fillna(0)
    )
    return [
        _count(duplicates(rows, ["sheet", "date", "hour_text"]), "time_key_unique_in_sheet"),
        _count(sheets.where("expected <> produced"), "rows_equal_time_rows_by_series"),
        _count(sheets.where("missing <> reported"), "missing_equals_quality_report"),
    ]


def written_rows_audit(produced: DataFrame, stored: DataFrame, check: str) -> DataFrame:
    """Rows of a stored table equal the rows that were meant to be written."""
    both = produced.select(F.lit(1).alias("sign")).unionAll(stored.select(F.lit(-1).alias("sign")))
    return both.agg(F.abs(F.coalesce(F.sum("sign"), F.lit(0))).alias("violations")).select(
        F.lit(check).alias("check"), "violations"
    )


def weather_audits(weather: DataFrame, settings: Settings) -> list[DataFrame]:
    """Hour count as expected, no duplicate hour, no missing temperature."""
    coverage = weather.agg(
        F.abs(F.count("*") - F.lit(settings.expected_hours)).alias("violations")
    ).select(F.lit("weather_hours_complete").alias("check"), "violations")
    return [
        coverage,
        _count(duplicates(weather, ["interval_start"]), "weather_hour_unique"),
        _count(weather.where(F.col("temperature_2m").isNull()), "weather_temperature_present"),
    ]


def enrichment_audits(long: DataFrame, enriched: DataFrame, calendar: DataFrame) -> list[DataFrame]:
    """Enrichment keeps every row once and finds a temperature for each."""
    return [
        _count(duplicates(calendar, ["date"]), "calendar_date_unique"),
        written_rows_audit(long, enriched, "enrichment_keeps_rows"),
        _count(enriched.where(F.col("temperature_2m").isNull()), "enriched_temperature_present"),
    ]


def key_unique_audit(dimension: DataFrame, keys: Sequence[str], check: str) -> DataFrame:
    return _count(duplicates(dimension, keys), check)


def required_audit(required: DataFrame, produced: DataFrame, check: str = "required_tables_present") -> DataFrame:
    """Names in ``required(name)`` that ``produced(name)`` lacks."""
    return _count(required.join(produced, "name", "left_anti"), check)


def required_columns(df: DataFrame, columns: Sequence[str]) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"columns missing: {missing}")


def lookup_audit(cells: DataFrame, quality: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every series of the cells has its quality row."""
    known = quality.select(*keys, F.lit(True).alias("_known"))
    orphans = join_null_safe(cells.select(*keys).distinct(), known, keys).where(F.col("_known").isNull())
    return _count(orphans, "series_has_quality_row")


def failures(audits: DataFrame) -> Mapping[str, int]:
    """Failed checks as {check: violations}; the table has one row per check."""
    return {row["check"]: row["violations"] for row in audits.where(~F.col("passed")).collect()}
