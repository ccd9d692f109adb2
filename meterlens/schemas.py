"""Explicit schemas of the files read and of the fact table."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


# The six leading columns of a wide sheet, in sheet order (fixed values).
SHEET_TIME_COLUMNS = ("PeriodYear", "PeriodMonth", "WeekDay", "Date", "Hour", "Tariff")

SERIES_HEADER = _struct(
    sheet=T.StringType(), column=T.StringType(), company_id=T.StringType(), raw_header=T.StringType()
)

HOLIDAY_EVENTS = _struct(
    holiday_id=T.StringType(),
    holiday_name=T.StringType(),
    holiday_date=T.DateType(),
    observed_date=T.DateType(),
    source_year=T.IntegerType(),
    date_may_change=T.BooleanType(),
)

WEATHER_DOCUMENT = _struct(
    latitude=T.DoubleType(),
    longitude=T.DoubleType(),
    elevation=T.DoubleType(),
    timezone=T.StringType(),
    hourly=_struct(
        time=T.ArrayType(T.StringType()),
        temperature_2m=T.ArrayType(T.DoubleType()),
    ),
    daily=_struct(
        time=T.ArrayType(T.StringType()),
        temperature_2m_mean=T.ArrayType(T.DoubleType()),
        temperature_2m_min=T.ArrayType(T.DoubleType()),
        temperature_2m_max=T.ArrayType(T.DoubleType()),
    ),
)

HOURLY_LONG = _struct(
    company_id=T.StringType(),
    meter_id=T.StringType(),
    energy_flow=T.StringType(),
    interval_start=T.TimestampNTZType(),
    interval_end=T.TimestampNTZType(),
    date=T.DateType(),
    year=T.ShortType(),
    month=T.ByteType(),
    weekday_number=T.ByteType(),
    is_weekend=T.BooleanType(),
    hour_1_24=T.ShortType(),
    is_peak_07_18=T.BooleanType(),
    tariff=T.StringType(),
    energy_kwh=T.DoubleType(),
    is_missing=T.BooleanType(),
    in_active_span=T.BooleanType(),
    quality_status=T.StringType(),
    active_period_quality_status=T.StringType(),
    source_sheet=T.StringType(),
)


def conform(df, schema: T.StructType):
    """Select and cast to a fixed schema."""
    return df.select(*[df[field.name].cast(field.dataType).alias(field.name) for field in schema])
