"""Wide meter sheets: one row per hour, one column per meter series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlens.functions import cells
from meterlens.functions.skew import join_null_safe, salted_lookup
from meterlens.functions.stats import missing_if_nan
from meterlens.schemas import SERIES_HEADER, SHEET_TIME_COLUMNS, conform


def read_sheet_csv(spark: SparkSession, path: str, sheet: str, series_columns: Sequence[str]) -> DataFrame:
    """Data rows of one sheet exported as CSV without its header rows; every cell is text."""
    columns = [*SHEET_TIME_COLUMNS, *series_columns]
    schema = T.StructType([T.StructField(name, T.StringType(), True) for name in columns])
    return spark.read.schema(schema).csv(path).withColumn("sheet", F.lit(sheet))


def _file_positions(raw: DataFrame) -> DataFrame:
    """Rows of files with `row_position`, their place in their file.

    Rows are numbered inside their file block and offset by the rows of earlier blocks, so a large file is still read in
    parallel. A block holds at most what one task reads.
    """
    placed = raw.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
    )
    in_block = W.partitionBy("_file", "_block").orderBy("_id")
    blocks = W.partitionBy("_file").orderBy("_block")  # one row per file block
    offsets = (
        placed.groupBy("_file", "_block")
        .agg(F.count("*").alias("_rows"))
        .select("_file", "_block", (F.sum("_rows").over(blocks) - F.col("_rows")).alias("_before"))
    )
    return (
        placed.withColumn("_in_block", F.row_number().over(in_block))
        .join(offsets, ["_file", "_block"])
        .withColumn("row_position", F.col("_before") + F.col("_in_block") - 1)
        .drop("_file", "_block", "_id", "_before", "_in_block")
    )


def _data_and_header(numbered: DataFrame, names: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Data rows and the two header rows (as a table) of numbered rows with a `sheet`."""
    lead = len(SHEET_TIME_COLUMNS)
    data = (
        numbered.where(F.col("row_position") >= 2)
        .withColumn("row_position", F.col("row_position") - 2)
        .withColumnsRenamed(dict(zip(names[:lead], SHEET_TIME_COLUMNS)))
    )
    two = numbered.where(F.col("row_position") < 2).unpivot(["sheet", "row_position"], names[lead:], "column", "text")
    header = two.groupBy("sheet", "column").agg(
        F.max(F.when(F.col("row_position") == 0, F.col("text"))).alias("company_id"),
        F.max(F.when(F.col("row_position") == 1, F.col("text"))).alias("raw_header"),
    )
    return data, header


def read_raw_sheet(spark: SparkSession, path: str, sheet: str) -> tuple[DataFrame, DataFrame]:
    """One sheet exported whole as a single CSV file: (data rows, header rows as a table).

    The first line names the company and the second the meter of each column from the seventh
    on. ``row_position`` is the row's place in the file.
    """
    raw = spark.read.csv(path)
    return _data_and_header(_file_positions(raw).withColumn("sheet", F.lit(sheet)), raw.columns)


def read_raw_sheets(spark: SparkSession, folder: str, series: int) -> tuple[DataFrame, DataFrame]:
    """All sheets below ``folder``, each a CSV file as of :func:`read_raw_sheet` in ``sheet=<name>``, in one pass.

    ``series`` is the largest number of series columns of a sheet. Columns without a meter in the header belong to no
    series.
    """
    names = [*SHEET_TIME_COLUMNS, *[f"s{i}" for i in range(1, series + 1)]]
    schema = T.StructType([T.StructField(name, T.StringType(), True) for name in [*names, "sheet"]])
    raw = spark.read.schema(schema).csv(folder)
    data, header = _data_and_header(_file_positions(raw), names)
    return data, header.where("raw_header IS NOT NULL")


def write_raw_sheets(wide: DataFrame, header: DataFrame, folder: str, order: Sequence[str] = ("Date", "Hour")) -> None:
    """Sheets as raw files that :func:`read_raw_sheets` reads: two header rows, then the rows by ``order``.

    A sheet is one file, so one task writes it.
    """
    series = [c for c in wide.columns if c not in {"sheet", *SHEET_TIME_COLUMNS}]
    names = [*SHEET_TIME_COLUMNS, *series]
    rows = wide.select("sheet", F.lit(2).alias("_line"), *[F.col(c).alias(f"_{c}") for c in order], *[F.col(c).cast("string") for c in names])
    lines = []
    for line, cell in ((0, "company_id"), (1, "raw_header")):
        cells_of = [F.max(F.when(F.col("column") == c, F.col(cell))).alias(c) for c in series]
        one = header.groupBy("sheet").agg(*cells_of).withColumn("_line", F.lit(line))
        lines.append(one)
    whole = rows.unionByName(lines[0].unionByName(lines[1]), allowMissingColumns=True)
    placed = whole.repartition("sheet").sortWithinPartitions("sheet", "_line", *[f"_{c}" for c in order])
    writer = placed.select("sheet", *names).write.partitionBy("sheet").option("emptyValue", "")
    # A cell's white space is part of it.
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(folder)


def read_series_header(spark: SparkSession, path: str) -> DataFrame:
    """The two header rows of all sheets as rows (sheet, column, company_id, raw_header)."""
    return spark.read.schema(SERIES_HEADER).option("header", True).csv(path)


def stack_sheets(sheets: Sequence[DataFrame]) -> DataFrame:
    """Union of sheets with different series columns; absent columns are NULL and carry no header."""
    first, *rest = sheets
    for other in rest:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def parse_headers(header: DataFrame, prosumer_match: str) -> DataFrame:
    """Series identities (sheet, column, company_id, meter_id, energy_flow) from raw headers."""
    prosumer = cells.is_prosumer_sheet(F.col("sheet"), prosumer_match)
    return conform(header, SERIES_HEADER).select(
        "sheet",
        "column",
        cells.stripped(F.col("company_id")).alias("company_id"),
        cells.header_meter(F.col("raw_header"), prosumer).alias("meter_id"),
        cells.header_flow(F.col("raw_header"), prosumer).alias("energy_flow"),
    )


def time_rows(wide: DataFrame) -> DataFrame:
    """The time part of every sheet row, typed. ``hour_text`` keeps an hour that is no integer."""
    hour_text = cells.stripped(F.col("Hour").cast("string"))
    hour = hour_text.try_cast("int") if isinstance(wide.schema["Hour"].dataType, T.StringType) else F.col(
        "Hour"
    ).cast("int")
    return wide.select(
        "sheet",
        *([c for c in ("row_position",) if c in wide.columns]),
        F.col("PeriodYear").try_cast("int").alias("period_year"),
        F.col("PeriodMonth").try_cast("int").alias("period_month"),
        F.col("Date").try_cast("date").alias("date"),
        hour.alias("hour"),
        F.coalesce(hour.cast("string"), hour_text).alias("hour_text"),
        F.col("Tariff").cast("string").alias("tariff"),
        *[c for c in wide.columns if c not in {"sheet", "row_position", *SHEET_TIME_COLUMNS}],
    )


#: Parts that rows without a readable date are dealt to, for each sheet.
_UNDATED_PARTS = 4096


def with_row_position(rows: DataFrame) -> DataFrame:
    """Zero-based position of each row inside its sheet.

    A given ``row_position`` column (the row number in the source) is kept. Otherwise rows are
    numbered by date and hour, repeated keys by their content, in two levels: hours inside a day
    and days inside a sheet. The ordered windows see the rows of a day or the days of a sheet.
    Rows without a readable date come last; they have no day that bounds them, so they are dealt
    to parts by a hash of their content first, which are ordered like days.
    """
    if "row_position" in rows.columns:
        return rows
    content = F.xxhash64(*rows.columns)
    part = F.when(F.col("date").isNull(), F.pmod(content, F.lit(_UNDATED_PARTS)).cast("int")).otherwise(0)
    parted = rows.withColumn("_part", part)
    in_day = W.partitionBy("sheet", "date", "_part").orderBy(F.col("hour").asc_nulls_last(), "hour_text", content)
    days = W.partitionBy("sheet").orderBy(F.col("date").asc_nulls_last(), "_part")
    offsets = (
        parted.groupBy("sheet", "date", "_part")
        .agg(F.count("*").alias("_in_day"))
        .select("sheet", "date", "_part", (F.sum("_in_day").over(days) - F.col("_in_day")).alias("_before"))
    )
    numbered = parted.withColumn("_in_order", F.row_number().over(in_day) - 1)
    return (
        join_null_safe(numbered, offsets, ["sheet", "date", "_part"], "inner")
        .withColumn("row_position", F.col("_before") + F.col("_in_order"))
        .drop("_before", "_in_order", "_part")
    )


_ROW_COLUMNS = ("sheet", "row_position", "period_year", "period_month", "date", "hour", "hour_text", "tariff")


def placed_rows(wide: DataFrame) -> DataFrame:
    """Typed sheet rows with positions; the series columns become text.

    Floating-point columns lose NaN here; from this point on a missing value is NULL.
    """
    series = [c for c in wide.columns if c not in {"sheet", "row_position", *SHEET_TIME_COLUMNS}]
    as_text = {
        c: (missing_if_nan(F.col(c)) if isinstance(wide.schema[c].dataType, (T.DoubleType, T.FloatType)) else F.col(c))
        .cast("string")
        for c in series
    }
    return with_row_position(time_rows(wide.withColumns(as_text)))


def row_times(placed: DataFrame) -> DataFrame:
    """The time part of placed rows."""
    return placed.select(*_ROW_COLUMNS)


def melt_rows(placed: DataFrame, header: DataFrame, prosumer_match: str) -> DataFrame:
    """Placed rows to one text cell per (series, row)."""
    series = [c for c in placed.columns if c not in _ROW_COLUMNS]
    melted = placed.unpivot(list(_ROW_COLUMNS), series, "column", "raw_value")
    named = salted_lookup(melted, parse_headers(header, prosumer_match), ["sheet", "column"], "inner")
    return named.drop("column")


def melt_sheets(wide: DataFrame, header: DataFrame, prosumer_match: str) -> DataFrame:
    """Wide sheets to cells; positions are attached before melting, while rows are few."""
    return melt_rows(placed_rows(wide), header, prosumer_match)
