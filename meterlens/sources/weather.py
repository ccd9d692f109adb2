"""Weather documents: JSON objects that hold parallel arrays per hour and per day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlens.functions.stats import missing_if_nan
from meterlens.schemas import WEATHER_DOCUMENT

_DAILY = ("temperature_2m_mean", "temperature_2m_min", "temperature_2m_max")


def read_weather_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(WEATHER_DOCUMENT).option("multiLine", True).json(path)


def documents_from_text(df: DataFrame, text_column: str) -> DataFrame:
    """Parse documents held as text in a column; other columns are kept as identifiers."""
    parsed = df.withColumn("_doc", F.from_json(F.col(text_column), WEATHER_DOCUMENT))
    return parsed.select(*[c for c in df.columns if c != text_column], "_doc.*")


def document_metadata(documents: DataFrame) -> DataFrame:
    return documents.drop("hourly", "daily")


def _identifiers(documents: DataFrame) -> list[str]:
    return [c for c in documents.columns if c not in set(WEATHER_DOCUMENT.names)]


def hourly_observations(documents: DataFrame) -> DataFrame:
    """(interval_start, temperature_2m, date), one row per array element."""
    zipped = F.arrays_zip(
        F.col("hourly.time").alias("time"), F.col("hourly.temperature_2m").alias("temperature_2m")
    )
    start = F.to_timestamp_ntz(F.regexp_replace("time", "T", " "))
    return documents.select(*_identifiers(documents), F.inline(zipped)).select(
        *_identifiers(documents),
        start.alias("interval_start"),
        missing_if_nan(F.col("temperature_2m")).alias("temperature_2m"),
        F.to_date(start).alias("date"),
    )


def daily_observations(documents: DataFrame) -> DataFrame:
    """(date, temperature mean / min / max), one row per array element."""
    zipped = F.arrays_zip(F.col("daily.time").alias("time"), *[F.col(f"daily.{c}").alias(c) for c in _DAILY])
    return documents.select(*_identifiers(documents), F.inline(zipped)).select(
        *_identifiers(documents),
        F.to_date("time").alias("date"),
        *[missing_if_nan(F.col(c)).alias(c) for c in _DAILY],
    )
