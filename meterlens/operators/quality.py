"""Series quality: gaps, zero runs, extreme values, timeline and sheet checks.

Input is the ``cells`` table of :func:`meterlens.sources.sheets.melt_sheets`: one text cell per
series and sheet row, with ``row_position`` numbering the rows of a sheet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meterlens.functions import cells as C
from meterlens.functions.calendar import period_dates
from meterlens.functions.skew import join_null_safe, salted_lookup
from meterlens.settings import Settings

SERIES = ("sheet", "company_id", "meter_id", "energy_flow")

# Positions per block when zero runs are found; a block is the unit of ordered work.
RUN_BLOCK = 4096


def typed_cells(cells: DataFrame) -> DataFrame:
    """Add the numeric value and the kind of each cell, once.

    Stored with these columns, later passes read numbers instead of parsing text again, and the
    zero-run pass filters zeros in the scan.
    """
    if {"value", "kind"} <= set(cells.columns):
        return cells
    return cells.withColumns(
        {"value": C.number_or_null(F.col("raw_value")), "kind": C.value_kind(F.col("raw_value"))}
    )


def series_statistics(cells: DataFrame, expected_hours: int) -> DataFrame:
    """Counts, moments and span of every series in one aggregation."""
    kind = F.col("kind")
    numeric_position = F.when(F.col("value").isNotNull(), F.col("row_position"))
    stats = (
        typed_cells(cells)
        .groupBy(*SERIES)
        .agg(
            F.count("value").alias("valid_numeric_hours"),
            F.count_if(kind == "missing").alias("missing_hours"),
            F.count_if(kind == "non_numeric").alias("non_numeric_values"),
            F.count_if(kind == "negative").alias("negative_values"),
            F.count_if(kind == "zero").alias("zero_hours"),
            F.avg("value").alias("mean_kwh"),
            F.stddev_samp("value").alias("std_kwh"),
            F.min("value").alias("min_kwh"),
            F.max("value").alias("max_kwh"),
            F.min(numeric_position).alias("first_position"),
            F.max(numeric_position).alias("last_position"),
        )
    )
    first, last, expected = F.col("first_position"), F.col("last_position"), F.lit(expected_hours)
    span = F.coalesce(last - first + 1, F.lit(0))
    return stats.withColumns(
        {
            "expected_hours": expected,
            "leading_missing_hours": F.coalesce(first, expected),
            "trailing_missing_hours": F.coalesce(F.greatest(F.lit(0), expected - last - 1), F.lit(0)),
            "active_span_hours": span,
            # Every non-numeric cell is subtracted, also outside the span; then clamped.
            "internal_missing_hours": F.greatest(
                F.lit(0), span - F.col("valid_numeric_hours") - F.col("non_numeric_values")
            ),
        }
    ).drop("first_position", "last_position")


def with_extreme_flag(cells: DataFrame, statistics: DataFrame, multiple: float) -> DataFrame:
    """Mark values above ``multiple`` times a positive series mean."""
    means = statistics.select(*SERIES, F.col("mean_kwh").alias("_mean"))
    flag = (F.col("_mean") > 0) & (F.col("value") > F.lit(multiple) * F.col("_mean"))
    return (
        salted_lookup(typed_cells(cells), means, SERIES)
        .withColumn("is_extreme", F.coalesce(flag, F.lit(False)))
        .drop("_mean")
    )


def _islands(zeros: DataFrame) -> DataFrame:
    """Runs of consecutive positions as (series, first, last).

    Positions are cut into blocks, runs are found inside each block, and only the at most two
    runs per block that touch its edge are stitched along the series.
    """
    block = F.floor(F.col("row_position") / RUN_BLOCK)
    in_block = W.partitionBy(*SERIES, "block").orderBy("row_position")
    pieces = (
        zeros.select(*SERIES, F.col("row_position").cast("bigint").alias("row_position"))
        .withColumn("block", block)
        .withColumn("island", F.col("row_position") - F.row_number().over(in_block))
        .groupBy(*SERIES, "block", "island")
        .agg(F.min("row_position").alias("first"), F.max("row_position").alias("last"))
    )
    at_edge = (F.col("first") % RUN_BLOCK == 0) | (F.col("last") % RUN_BLOCK == RUN_BLOCK - 1)
    inner = pieces.where(~at_edge).select(*SERIES, "first", "last")
    along = W.partitionBy(*SERIES).orderBy("first")
    starts_new = F.coalesce((F.lag("last").over(along) + 1 != F.col("first")).cast("int"), F.lit(1))
    stitched = (
        pieces.where(at_edge)
        .withColumn("starts", starts_new)
        .withColumn("run", F.sum("starts").over(along))
        .groupBy(*SERIES, "run")
        .agg(F.min("first").alias("first"), F.max("last").alias("last"))
        .drop("run")
    )
    return inner.unionByName(stitched)


def all_zero_runs(cells: DataFrame) -> DataFrame:
    """Every run of zeros in row order: (series, first, last, run_hours).

    A run follows the rows of the sheet, so an absent hour does not break it but a blank,
    non-numeric or non-zero cell does.
    """
    zeros = typed_cells(cells).where(F.col("value") == 0)
    return _islands(zeros).withColumn("run_hours", F.col("last") - F.col("first") + 1)


def zero_runs(cells: DataFrame, rows: DataFrame, threshold: int) -> DataFrame:
    """Runs of at least ``threshold`` zeros with their first key and the key that closes them.

    ``rows`` are the sheet rows with ``row_position``; the keys come from there, so the cells
    are only scanned for zeros. They are merged and never broadcast: there is one for every row of the sheets, and a
    stored table looks small until it is read.
    """
    keys = rows.groupBy("sheet", "row_position").agg(F.min("date").alias("date"), F.min("hour").alias("hour"))
    start = keys.select(
        "sheet",
        F.col("row_position").alias("first"),
        F.col("date").alias("start_date"),
        F.col("hour").alias("start_hour"),
    )
    closing = keys.select(
        "sheet",
        (F.col("row_position") - 1).alias("last"),
        F.col("date").alias("next_date"),
        F.col("hour").alias("next_hour"),
    )
    runs = all_zero_runs(cells).where(F.col("run_hours") >= threshold)
    return (
        runs.join(start.hint("merge"), ["sheet", "first"], "left")
        .join(closing.hint("merge"), ["sheet", "last"], "left")
        .select(*SERIES, "start_date", "start_hour", "run_hours", "next_date", "next_hour")
    )


def value_anomalies(cells: DataFrame, statistics: DataFrame, multiple: float) -> DataFrame:
    """One row per non-numeric, negative or extreme cell."""
    kind = F.col("kind")
    reasons = F.array_compact(
        F.array(
            F.when(kind.isin("non_numeric", "negative"), kind),
            F.when(F.col("is_extreme"), F.lit("extreme_multiple")),
        )
    )
    return with_extreme_flag(cells, statistics, multiple).select(
        *SERIES, "date", "hour", F.col("raw_value").alias("value"), F.explode(reasons).alias("reason")
    )


def _status(unusable: Column, review: list[str]) -> Column:
    flagged = F.greatest(*[F.col(c) for c in review]) > 0
    return F.when(unusable, "unusable").when(flagged, "review").otherwise("clean")


def series_quality(cells: DataFrame, settings: Settings) -> DataFrame:
    """The ``meter_quality`` table: one row per series with counts, spans and two statuses."""
    stats = series_statistics(cells, settings.expected_hours)
    runs = all_zero_runs(cells)
    long_run = F.col("run_hours") >= settings.zero_run_hours
    run_stats = runs.groupBy(*SERIES).agg(
        F.count_if(long_run).alias("zero_run_events_48h_plus"),
        F.sum(F.when(long_run, F.col("run_hours")).otherwise(0)).alias("zero_run_hours_48h_plus"),
        F.max("run_hours").alias("maximum_zero_run_hours"),
    )
    extremes = (
        with_extreme_flag(cells, stats, settings.extreme_multiple)
        .where("is_extreme")
        .groupBy(*SERIES)
        .agg(F.count("*").alias("extreme_values_50x_mean"))
    )
    joined = join_null_safe(join_null_safe(stats, run_stats, SERIES), extremes, SERIES).fillna(
        0,
        [
            "zero_run_events_48h_plus",
            "zero_run_hours_48h_plus",
            "maximum_zero_run_hours",
            "extreme_values_50x_mean",
        ],
    )
    expected, span = F.col("expected_hours"), F.col("active_span_hours")
    leading, trailing = F.col("leading_missing_hours") > 0, F.col("trailing_missing_hours") > 0
    pattern = (
        F.when(F.col("valid_numeric_hours") == 0, "no_readings")
        .when(leading & trailing, "late_start_early_end")
        .when(leading, "late_start")
        .when(trailing, "early_end")
        .when(F.col("internal_missing_hours") > 0, "internal_gaps")
        .otherwise("complete")
    )
    common = ["negative_values", "non_numeric_values", "zero_run_events_48h_plus", "extreme_values_50x_mean"]
    return (
        joined.withColumn(
            "missing_share", F.when(expected > 0, F.col("missing_hours") / expected).otherwise(1.0)
        )
        .withColumn(
            "internal_missing_share_active_span",
            F.when(span > 0, F.col("internal_missing_hours") / span).otherwise(1.0),
        )
        .withColumns(
            {
                "missing_pattern": pattern,
                "quality_status": _status(
                    F.col("missing_share") > settings.unusable_missing_share, ["missing_hours", *common]
                ),
                "active_period_quality_status": _status(
                    (span == 0)
                    | (F.col("internal_missing_share_active_span") > settings.unusable_missing_share),
                    ["internal_missing_hours", *common],
                ),
            }
        )
        .select(
            *SERIES,
            "expected_hours",
            "valid_numeric_hours",
            "missing_hours",
            "missing_share",
            "leading_missing_hours",
            "internal_missing_hours",
            "trailing_missing_hours",
            "active_span_hours",
            "internal_missing_share_active_span",
            "missing_pattern",
            "negative_values",
            "non_numeric_values",
            "zero_hours",
            "zero_run_events_48h_plus",
            "zero_run_hours_48h_plus",
            "maximum_zero_run_hours",
            "extreme_values_50x_mean",
            "mean_kwh",
            "std_kwh",
            "min_kwh",
            "max_kwh",
            "quality_status",
            "active_period_quality_status",
        )
    )


def _in_period(settings: Settings) -> Column:
    day = F.col("date").between(F.lit(settings.start_date).cast("date"), F.lit(settings.end_date).cast("date"))
    return F.coalesce(day & F.col("hour").between(1, 24), F.lit(False))


def sheet_checks(rows: DataFrame, series: DataFrame, settings: Settings) -> DataFrame:
    """Row, series and time-key checks per sheet.

    ``rows`` are typed sheet rows (:func:`meterlens.sources.sheets.time_rows`), ``series`` the
    parsed headers. Keys are counted once per distinct key, so the shuffle carries keys, not rows.
    """
    mismatch = F.col("date").isNotNull() & ~(
        F.col("period_year").eqNullSafe(F.year("date")) & F.col("period_month").eqNullSafe(F.month("date"))
    )
    invalid = F.col("hour").isNull() | ~F.col("hour").between(1, 24)
    per_key = rows.groupBy("sheet", "date", "hour", "hour_text").agg(
        F.count("*").alias("copies"),
        F.count_if(mismatch).alias("mismatches"),
    )
    known = _in_period(settings)
    checked = per_key.groupBy("sheet").agg(
        F.sum("copies").alias("data_rows"),
        (F.lit(settings.expected_hours) - F.count_if(known)).alias("missing_time_keys"),
        F.count_if(~known).alias("extra_time_keys"),
        (F.sum("copies") - F.count("*")).alias("duplicate_time_keys"),
        F.sum(F.when(invalid, F.col("copies")).otherwise(0)).alias("invalid_hours"),
        F.sum("mismatches").alias("date_metadata_mismatches"),
    )
    columns = series.groupBy("sheet").agg(
        F.count("*").alias("series_columns"), F.countDistinct("meter_id").alias("physical_meters")
    )
    counts = ["data_rows", "series_columns", "physical_meters"]
    zero_when_empty = ["extra_time_keys", "duplicate_time_keys", "invalid_hours", "date_metadata_mismatches"]
    return (
        checked.join(columns, "sheet", "full_outer")
        .fillna(0, counts + zero_when_empty)
        .fillna(settings.expected_hours, ["missing_time_keys"])
        .select("sheet", *counts, "missing_time_keys", *zero_when_empty)
    )


def timeline_issues(rows: DataFrame, settings: Settings) -> DataFrame:
    """Expected keys without a row (missing) and keys of rows outside the period, by sheet and time."""
    present = rows.select("sheet", "date", "hour", "hour_text").distinct()
    expected = (
        rows.select("sheet")
        .distinct()
        .select("sheet", F.explode(period_dates(settings.start_date, settings.end_date)).alias("date"))
        .select("sheet", "date", F.explode(F.sequence(F.lit(1), F.lit(24))).alias("hour"))
    )
    missing = expected.join(present.where(F.col("hour").isNotNull()), ["sheet", "date", "hour"], "left_anti")
    outside = present.where(~_in_period(settings))
    found = missing.select(
        "sheet", "date", F.col("hour").cast("string").alias("hour"), F.lit("missing").alias("issue")
    ).unionByName(outside.select("sheet", "date", F.col("hour_text").alias("hour"), F.lit("out_of_period").alias("issue")))
    return found.orderBy("sheet", "date", F.col("hour").try_cast("int"), "hour")


def overlapping_series(series: DataFrame) -> DataFrame:
    """(meter_id, energy_flow) identities that occur more than once, with their sheet count."""
    return (
        series.groupBy("meter_id", "energy_flow")
        .agg(F.count("*").alias("columns"), F.countDistinct("sheet").alias("sheets"))
        .where(F.col("columns") > 1)
    )
