"""Calendar columns and period generators on zone-free timestamps."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def hour_start(date: Column, hour_1_24: Column) -> Column:
    """Start of interval ``hour_1_24`` (1..24) of a day."""
    return F.timestamp_add("HOUR", (hour_1_24 - 1).cast("int"), date.cast("timestamp_ntz"))


def floor_hour(ts: Column) -> Column:
    return hour_start(F.to_date(ts), F.hour(ts) + 1)


def month_start(ts: Column) -> Column:
    return F.trunc(F.to_date(ts), "month").cast("timestamp_ntz")


def with_calendar(df: DataFrame, peak_hours: tuple[int, int]) -> DataFrame:
    """Add interval, year, month, weekday, weekend and peak columns to (date, hour_1_24)."""
    start = hour_start(F.col("date"), F.col("hour_1_24"))
    weekday = F.weekday("date")
    return df.withColumns(
        {
            "interval_start": start,
            "interval_end": F.timestamp_add("HOUR", F.lit(1), start),
            "year": F.year("date"),
            "month": F.month("date"),
            "weekday_number": weekday,
            "is_weekend": weekday >= 5,
            "is_peak_07_18": F.col("hour_1_24").between(*peak_hours),
        }
    )


def period_days(spark: SparkSession, start: str, end: str) -> DataFrame:
    """One row per day of an inclusive period."""
    first = dt.date.fromisoformat(start)
    count = (dt.date.fromisoformat(end) - first).days + 1
    return spark.range(count).select(F.date_add(F.lit(first), F.col("id").cast("int")).alias("date"))


def period_dates(start: str, end: str) -> Column:
    """The same days as an array, for exploding next to other columns."""
    return F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))


def degree_days(temperature: Column, base: float, heating: bool) -> Column:
    """max(0, base - t) for heating, max(0, t - base) for cooling; NULL stays NULL."""
    gap = F.lit(base) - temperature if heating else temperature - F.lit(base)
    return F.when(temperature.isNotNull(), F.greatest(F.lit(0.0), gap))
