"""Official holidays as a CSV of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meterlens.schemas import HOLIDAY_EVENTS


def read_holiday_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HOLIDAY_EVENTS).option("header", True).csv(path)
