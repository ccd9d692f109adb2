"""Meter-shaped views over the benchmark tables.

* ``hourly_readings``: events summed per meter and hour on a dense hourly grid. Thirty
  consecutive users form a company with four meters, so series grow with the table.
* ``daily_readings``: orders per customer nation over several years.
* ``wide_sheets`` / ``series_header``: the hourly readings as wide sheets of text cells.
* ``weather_documents``: one JSON text per company, temperatures derived from its events.

Energies are rounded down to quarters: sums are then exact in binary floating point and do not
depend on the order of addition.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlens.functions.calendar import floor_hour, period_days, with_calendar
from meterlens.functions.cells import EXPORT, IMPORT
from meterlens.functions.skew import stored_bytes
from meterlens.settings import Settings

USERS_PER_COMPANY = 30
HOLIDAY_EVERY = 29
# Stored bytes of events and rows of the dense hourly grid for one of its parts.
EVENT_BYTES = 4 << 20
GRID_ROWS = 1 << 19
# Stored bytes of events up to which their series are not counted.
UNCOUNTED_BYTES = 1 << 20
# Hours that wide sheets repeat, as a condition that both engines read.
TWICE = "day(date) = 10 AND hour_1_24 IN (5, 6)"

# The 30 days of the events table.
HOURLY = Settings(
    start_date="2024-01-01",
    end_date="2024-01-30",
    profile_start_date="2024-01-01",
    profile_end_date="2024-01-30",
    unusable_missing_share=0.60,
    zero_run_hours=20,
    extreme_multiple=5.0,
    minimum_weather_days=20,
)
# Shifted by one day against the rows, so that keys are missing at one end and extra at the other.
SHIFTED = HOURLY.replace(start_date="2024-01-02", end_date="2024-01-31")
# One full year of the orders table.
YEARLY = HOURLY.replace(
    start_date="1995-01-01",
    end_date="2001-12-31",
    profile_start_date="1998-01-01",
    profile_end_date="1998-12-31",
    seasonality_index=1.02,
    seasonality_difference=0.02,
)
# A whole run over all readings, profiles over that year.
RUN = YEARLY


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quarters(value: Column) -> Column:
    return F.floor(value * 4) / 4


def _named(number: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), number.cast("string"))


def _event_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(n, m, exported, hour, energy) per event: company number, meter slot, flow, hour.

    A company feeds in at meter 0, whichever of its meters the event came from.
    """
    slot = F.col("user_id") % 16
    exported = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").select(
        F.expr(f"user_id div {USERS_PER_COMPANY} + 1").alias("n"),
        F.when(exported | (slot < 8), 0).when(slot < 12, 1).when(slot < 14, 2).otherwise(3).alias("m"),
        exported.alias("exported"),
        floor_hour(F.col("ts")).alias("hour"),
        quarters(F.col("value")).alias("energy"),
    )


def _period_hours(settings: Settings) -> Column:
    first = F.lit(settings.start_date).cast("date").cast("timestamp_ntz")
    last = F.timestamp_add("HOUR", F.lit(23), F.lit(settings.end_date).cast("date").cast("timestamp_ntz"))
    return F.sequence(first, last, F.expr("interval 1 hour"))


def filled_parts(events: DataFrame, series: list[str]) -> int:
    """Parts for series that are filled up: the shuffle partitions at least, more for many stored events or grid rows.

    Stored bytes don't tell how many series the events have: one of a single event has as many hours as any other. So
    series are counted, near enough for a number of parts, unless the events are few.
    """
    stored = stored_bytes(events)
    parts = max(int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")), stored // EVENT_BYTES)
    if stored <= UNCOUNTED_BYTES:
        return parts
    count = events.agg(F.approx_count_distinct(F.xxhash64(*series))).first()[0]
    return max(parts, count * HOURLY.expected_hours // GRID_ROWS)


def hourly_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per series and hour. Hours without events are NULL, on meter 3 they are 0.

    Events are summed per hour first, so that a series has no more rows than hours. Only then its hours are filled up, in
    a number of parts that Spark doesn't lower: the few bytes of a series become all hours of the period. They are dealt
    by a hash of their own, as Spark leaves out a repartitioning by the keys that it has just grouped by.
    """
    events, series = _event_energy(spark, sf_dir), ["n", "m", "exported"]
    parts, part = filled_parts(events, series), F.xxhash64(*series)
    grid = (
        events.select(*series)
        .distinct()
        .withColumn("part", part)
        .repartition(parts, "part")
        .select(*series, "part", F.explode(_period_hours(HOURLY)).alias("hour"), F.lit(None).cast("double").alias("energy"))
    )
    energy = F.col("energy")
    readings = (
        events.groupBy(*series, "hour")
        .agg(F.sum("energy").alias("energy"))
        .withColumn("part", part)
        .repartition(parts, "part")
        .unionByName(grid)
        .groupBy("part", *series, "hour")
        .agg(F.max("energy").alias("energy"))
        .select(
            "n",
            "m",
            _named(F.col("n"), "Company ").alias("company_id"),
            F.concat(_named(F.col("n"), "C"), _named(F.col("m"), "-M")).alias("meter_id"),
            F.when(F.col("exported"), EXPORT).otherwise(IMPORT).alias("energy_flow"),
            F.when(F.col("m") == 0, "prosumer").otherwise("standard").alias("source_sheet"),
            F.to_date("hour").alias("date"),
            (F.hour("hour") + 1).alias("hour_1_24"),
            F.when(F.col("m") == 3, F.coalesce(energy, F.lit(0.0))).otherwise(energy).alias("energy_kwh"),
            F.when(F.col("m") == 3, "clean").when(F.col("m") == 2, "unusable").otherwise("review").alias("quality_status"),
            F.when(F.col("m") == 3, "clean").otherwise("review").alias("active_period_quality_status"),
        )
    )
    return with_calendar(readings, HOURLY.peak_hours)


def daily_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings per customer nation and order hour; pending orders without a priority have no energy."""
    unread = (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "4-NOT SPECIFIED")
    orders = table(spark, sf_dir, "orders").select(
        "o_custkey",
        F.to_date("o_orderdate").alias("date"),
        (F.col("o_orderkey") % 24 + 1).cast("int").alias("hour_1_24"),
        F.when(~unread, quarters(F.col("o_totalprice"))).alias("energy"),
    )
    customers = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_nationkey") + 1).alias("n"))
    readings = (
        orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("n", (F.col("o_custkey") % 3).alias("m"), "date", "hour_1_24")
        .agg(F.sum("energy").alias("energy_kwh"))
        .select(
            _named(F.col("n"), "Company ").alias("company_id"),
            F.concat(_named(F.col("n"), "N"), _named(F.col("m"), "-M")).alias("meter_id"),
            F.lit(IMPORT).alias("energy_flow"),
            F.lit("orders").alias("source_sheet"),
            "date",
            "hour_1_24",
            "energy_kwh",
        )
    )
    return with_calendar(readings, YEARLY.peak_hours)


def wide_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets of text cells: per company one prosumer sheet (s1, s2) and one standard sheet (s1-s3).

    Rows for which TWICE holds stand in their sheet twice.
    """
    hourly = hourly_readings(spark, sf_dir)
    energy, hour = F.col("energy_kwh"), F.col("hour_1_24")
    text = (
        F.when(energy.isNull(), F.when(hour % 2 == 0, F.lit(" ")))
        .when(energy == 0.25, "n/a")
        .when(energy == 0.5, "-0.5")
        .otherwise(energy.cast("string"))
    )
    cells = hourly.select(
        F.concat(F.initcap("source_sheet"), _named(F.col("n"), " ")).alias("sheet"),
        "date",
        "hour_1_24",
        _slot(F.col("m"), F.col("energy_flow")).alias("slot"),
        text.alias("raw"),
    )
    # The last hour of a day carries the month of the day after next, a metadata error.
    period = F.when(F.col("Hour") == 24, F.date_add("Date", 2)).otherwise(F.col("Date"))
    once = (
        cells.groupBy("sheet", F.col("date").alias("Date"), F.col("hour_1_24").alias("Hour"))
        .agg(*[F.max(F.when(F.col("slot") == i, F.col("raw"))).alias(f"s{i}") for i in (1, 2, 3)])
        .withColumns(
            {
                "PeriodYear": F.year(period),
                "PeriodMonth": F.month(period),
                "WeekDay": F.weekday("Date"),
                "Tariff": F.when(F.col("Hour").between(8, 22), "A1").otherwise("A2"),
            }
        )
    )
    twice = F.expr(TWICE.replace("hour_1_24", "Hour"))
    return once.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(twice, 2).otherwise(1)))).drop("copy")


def _slot(m: Column, flow: Column) -> Column:
    return F.when(m == 0, F.when(flow == EXPORT, 2).otherwise(1)).otherwise(m)


def series_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = _event_energy(spark, sf_dir).select("n", "m", "exported").distinct()
    prosumer = F.col("m") == 0
    flow = F.when(F.col("exported"), EXPORT).otherwise(IMPORT)
    suffix = F.when(F.col("exported"), " - A-").otherwise(" - A+")
    meter = F.concat(_named(F.col("n"), "C"), _named(F.col("m"), "-M"))
    return series.select(
        F.concat(F.when(prosumer, "Prosumer ").otherwise("Standard "), F.col("n").cast("string")).alias("sheet"),
        _named(_slot(F.col("m"), flow), "s").alias("column"),
        F.concat(_named(F.col("n"), " Company "), F.lit(" ")).alias("company_id"),
        F.when(prosumer, F.concat(meter, suffix)).otherwise(meter).alias("raw_header"),
    )


@dataclass(frozen=True)
class Weather:
    hourly: DataFrame
    daily: DataFrame


def weather(spark: SparkSession, settings: Settings = HOURLY) -> Weather:
    """Hourly temperatures of a period, -4 to 31.5 degrees in halves, and daily figures."""
    day = F.col("date")
    hours = period_days(spark, settings.start_date, settings.end_date).select(
        "date", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("h")
    )
    hourly = hours.select(
        F.timestamp_add("HOUR", F.col("h"), day.cast("timestamp_ntz")).alias("interval_start"),
        ((F.dayofyear(day) * 3) % 36 - 4 + (F.col("h") % 6) * 0.5).cast("double").alias("temperature_2m"),
        "date",
    )
    daily = hourly.groupBy("date").agg(
        F.avg("temperature_2m").alias("temperature_2m_mean"),
        F.min("temperature_2m").alias("temperature_2m_min"),
        F.max("temperature_2m").alias("temperature_2m_max"),
    )
    return Weather(hourly, daily)


def holiday_events(spark: SparkSession) -> DataFrame:
    """Four holidays: two names on one date, observed on the Monday after, and at the period edge."""
    return spark.sql(
        """
        SELECT * FROM VALUES
          ('new_year_day_1', 'New Year 1', DATE'2024-01-01', DATE'2024-01-01'),
          ('new_year_day_2', 'New Year 2', DATE'2024-01-02', DATE'2024-01-02'),
          ('winter_feast', 'Winter Feast', DATE'2024-01-07', DATE'2024-01-08'),
          ('local_day', 'Local Day', DATE'2024-01-07', DATE'2024-01-08')
        AS t(holiday_id, holiday_name, holiday_date, observed_date)
        """
    )


def order_holidays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holidays named by the priorities of a day's orders; weekend days are observed on Monday.

    A day is one when the quarters of all its orders add up to a multiple of HOLIDAY_EVERY: about one day in so many,
    whatever the size of the tables.
    """
    day = F.col("day")
    weekday = F.weekday(day)
    orders = table(spark, sf_dir, "orders").select(
        F.to_date("o_orderdate").alias("day"), "o_orderpriority", F.floor(F.col("o_totalprice") * 4).alias("price")
    )
    days = orders.groupBy("day").agg(
        F.sum("price").alias("price"), F.array_sort(F.collect_set("o_orderpriority")).alias("names")
    )
    return days.where(F.col("price") % HOLIDAY_EVERY == 0).select(
        F.explode("names").alias("holiday_name"),
        day.alias("holiday_date"),
        F.when(weekday >= 5, F.date_add(day, F.lit(7) - weekday)).otherwise(day).alias("observed_date"),
    )


def _parallel_arrays(df: DataFrame, keys: list[str], time: Column, **values: str) -> DataFrame:
    """Rows of a group as one struct of parallel arrays in time order; a group holds a period's hours."""
    item = F.struct(time.alias("time"), *[F.col(v).alias(k) for k, v in values.items()])
    return (
        df.groupBy(*keys)
        .agg(F.array_sort(F.collect_list(item)).alias("items"))
        .select(*keys, F.struct(F.col("items.time").alias("time"), *[F.col(f"items.{k}").alias(k) for k in values]).alias("part"))
    )


def _hour_text(ts: Column) -> Column:
    """2024-01-01T05:00. Formatting functions would go through the session zone; text does not."""
    return F.replace(F.substring(ts.cast("string"), 1, 16), F.lit(" "), F.lit("T"))


def weather_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(company_id, document): a JSON text per company; its arrays hold at most the period's hours."""
    number = F.expr(f"user_id div {USERS_PER_COMPANY} + 1")
    events = table(spark, sf_dir, "events").select(
        number.alias("n"), floor_hour(F.col("ts")).alias("hour"), quarters(F.col("value")).alias("t")
    )
    hourly = events.groupBy("n", "hour").agg(F.max("t").alias("t"))
    daily = hourly.groupBy("n", F.to_date("hour").alias("day")).agg(
        F.avg("t").alias("mean"), F.min("t").alias("low"), F.max("t").alias("high")
    )

    hours = _parallel_arrays(hourly, ["n"], _hour_text(F.col("hour")), temperature_2m="t")
    days = _parallel_arrays(
        daily,
        ["n"],
        F.col("day").cast("string"),
        temperature_2m_mean="mean",
        temperature_2m_min="low",
        temperature_2m_max="high",
    )
    joined = hours.withColumnRenamed("part", "hourly").join(days.withColumnRenamed("part", "daily"), "n")
    return joined.select(
        _named(F.col("n"), "Company ").alias("company_id"),
        F.to_json(
            F.struct(
                (F.lit(42.5) + F.col("n") / 8).alias("latitude"),
                (F.lit(21.0) + F.col("n") / 8).alias("longitude"),
                F.lit(573.0).alias("elevation"),
                F.lit("UTC").alias("timezone"),
                "hourly",
                "daily",
            )
        ).alias("document"),
    )


def inertia_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of order prices to the middle of 2 to 8 equal price bands: a falling cost per k."""
    price = quarters(F.col("o_totalprice"))
    width = F.floor(F.lit(520_000) / F.col("k"))
    band = F.least(F.floor(F.col("price") / width), F.col("k") - 1)
    return (
        table(spark, sf_dir, "orders")
        .select(price.alias("price"), F.explode(F.sequence(F.lit(2), F.lit(8))).alias("k"))
        .select("k", F.abs(F.col("price") - (band * width + width / 2)).alias("gap"))
        .groupBy("k")
        .agg(F.sum("gap").alias("inertia"))
    )


def period_weather_documents(spark: SparkSession, settings: Settings = RUN) -> DataFrame:
    """One parsed weather document with the hours and days of the run's period."""
    temperatures = weather(spark, settings)
    one = F.lit(1).alias("one")
    hours = _parallel_arrays(
        temperatures.hourly.select("*", one),
        ["one"],
        _hour_text(F.col("interval_start")),
        temperature_2m="temperature_2m",
    ).withColumnRenamed("part", "hourly")
    figures = ["temperature_2m_mean", "temperature_2m_min", "temperature_2m_max"]
    days = _parallel_arrays(
        temperatures.daily.select("*", one), ["one"], F.col("date").cast("string"), **{f: f for f in figures}
    ).withColumnRenamed("part", "daily")
    return hours.join(days, "one").select(
        F.lit(42.5).alias("latitude"),
        F.lit(21.0).alias("longitude"),
        F.lit(573.0).alias("elevation"),
        F.lit("UTC").alias("timezone"),
        "hourly",
        "daily",
    )


def run_inputs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Sources of a whole run: one sheet of three meters per nation, weather and holidays of the period."""
    number = F.substring_index("company_id", " ", -1)
    readings = daily_readings(spark, sf_dir).withColumns(
        {
            "sheet": F.concat(F.lit("Orders "), number),
            "slot": F.substring_index("meter_id", "M", -1).cast("int") + 1,
        }
    )
    wide = (
        readings.groupBy("sheet", F.col("date").alias("Date"), F.col("hour_1_24").alias("Hour"))
        .agg(*[F.max(F.when(F.col("slot") == i, F.col("energy_kwh"))).alias(f"s{i}") for i in (1, 2, 3)])
        .withColumns(
            {
                "PeriodYear": F.year("Date"),
                "PeriodMonth": F.month("Date"),
                "WeekDay": F.weekday("Date"),
                "Tariff": F.lit("A1"),
            }
        )
    )
    header = readings.select(
        "sheet", _named(F.col("slot"), "s").alias("column"), "company_id", F.col("meter_id").alias("raw_header")
    ).distinct()
    return {
        "wide": wide,
        "header": header,
        "weather_documents": period_weather_documents(spark),
        "holiday_events": order_holidays(spark, sf_dir),
    }
