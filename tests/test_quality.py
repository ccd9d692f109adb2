from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from meterlens.operators import audits, ingest, quality
from meterlens.settings import Settings
from meterlens.sources.sheets import (
    melt_sheets,
    parse_headers,
    read_raw_sheet,
    read_sheet_csv,
    stack_sheets,
    time_rows,
    with_row_position,
)

DAY = dt.date(2026, 1, 1)
TWO_DAYS = Settings(start_date="2026-01-01", end_date="2026-01-02", zero_run_hours=3, extreme_multiple=2.0)
CELLS = (
    "sheet string, company_id string, meter_id string, energy_flow string, row_position bigint, date date, hour int, "
    "raw_value string"
)


def cells(spark, **series):
    """Series given as lists of raw cells in row order, one hour per row from the first day on."""
    rows = [
        ("S", "Company 1", meter, "consumption_import", i, DAY + dt.timedelta(days=i // 24), i % 24 + 1, raw)
        for meter, values in series.items()
        for i, raw in enumerate(values)
    ]
    return spark.createDataFrame(rows, CELLS)


def by_meter(df):
    return {r["meter_id"]: r.asDict() for r in df.collect()}


def test_48_zero_hours_are_one_event(spark):
    settings = Settings(start_date="2026-01-01", end_date="2026-01-02")
    row = by_meter(quality.series_quality(cells(spark, M1=["0"] * 48), settings))["M1"]
    assert row["zero_run_events_48h_plus"] == 1
    assert row["zero_run_hours_48h_plus"] == 48
    assert row["maximum_zero_run_hours"] == 48
    assert row["quality_status"] == "review"


def test_zero_run_closed_by_blank_text_value_or_end(spark):
    table = cells(spark, A=["0", "0", "0", None, "0", "0", "0", "x", "0", "0", "0", "5", "0", "0", "0"])
    runs = quality.zero_runs(table, table, 3).orderBy("start_hour").collect()
    assert [(r["start_hour"], r["run_hours"], r["next_hour"]) for r in runs] == [
        (1, 3, 4),
        (5, 3, 8),
        (9, 3, 12),
        (13, 3, None),
    ]


def test_maximum_run_ignores_the_threshold(spark):
    row = by_meter(quality.series_quality(cells(spark, A=["0", "0", "1", "0"]), TWO_DAYS))["A"]
    assert (row["zero_run_events_48h_plus"], row["maximum_zero_run_hours"], row["zero_hours"]) == (0, 2, 3)


def test_zero_runs_across_blocks_match_a_scan(spark, monkeypatch):
    monkeypatch.setattr(quality, "RUN_BLOCK", 4)
    rng = random.Random(3)
    series = {f"M{i}": [rng.choice(["0", "0", "0", "1", None]) for _ in range(60)] for i in range(6)}
    series["ALL"] = ["0"] * 60
    expected = set()
    for meter, values in series.items():
        start = None
        for i, raw in enumerate([*values, "end"]):
            if raw == "0":
                start = i if start is None else start
            elif start is not None:
                expected.add((meter, start, i - 1, i - start))
                start = None
    got = {(r["meter_id"], r["first"], r["last"], r["run_hours"]) for r in quality.all_zero_runs(cells(spark, **series)).collect()}
    assert got == expected


def test_spans_shares_and_patterns(spark):
    n = 48
    table = cells(
        spark,
        full=["1"] * n,
        none=[None] * n,
        late=[None] * 6 + ["1"] * 42,
        early=["1"] * 42 + [" "] * 6,
        both=[None] + ["1"] * 46 + [None],
        gaps=["1"] + [None] * 10 + ["1"] * 37,
        text=["1", "x"] + ["1"] * 46,
        single=[None] * 10 + ["2"] + [None] * 37,
    )
    got = by_meter(quality.series_quality(table, TWO_DAYS))
    assert {m: r["missing_pattern"] for m, r in got.items()} == {
        "full": "complete",
        "none": "no_readings",
        "late": "late_start",
        "early": "early_end",
        "both": "late_start_early_end",
        "gaps": "internal_gaps",
        "text": "complete",
        "single": "late_start_early_end",
    }
    assert {m: r["quality_status"] for m, r in got.items()} == {
        "full": "clean",
        "none": "unusable",
        "late": "unusable",
        "early": "unusable",
        "both": "review",
        "gaps": "unusable",
        "text": "review",
        "single": "unusable",
    }
    assert {m: r["active_period_quality_status"] for m, r in got.items()} == {
        "full": "clean",
        "none": "unusable",
        "late": "clean",
        "early": "clean",
        "both": "clean",
        "gaps": "unusable",
        "text": "review",
        "single": "clean",
    }
    none, single = got["none"], got["single"]
    assert (none["leading_missing_hours"], none["trailing_missing_hours"], none["active_span_hours"]) == (48, 0, 0)
    assert none["internal_missing_share_active_span"] == 1.0
    assert none["mean_kwh"] is None and none["std_kwh"] is None and none["min_kwh"] is None
    assert (single["leading_missing_hours"], single["trailing_missing_hours"], single["active_span_hours"]) == (10, 37, 1)
    assert single["std_kwh"] is None and single["mean_kwh"] == 2.0


def test_anomalies_and_extremes(spark):
    table = cells(spark, A=["1", "1", "1", "-1", "bad", "10"], B=["-1", "-2"])
    stats = quality.series_statistics(table, 48)
    got = {(r["meter_id"], r["hour"], r["value"], r["reason"]) for r in quality.value_anomalies(table, stats, 2.0).collect()}
    # A's mean is 2.4; B's mean is negative, so nothing in B is extreme.
    assert got == {
        ("A", 4, "-1", "negative"),
        ("A", 5, "bad", "non_numeric"),
        ("A", 6, "10", "extreme_multiple"),
        ("B", 1, "-1", "negative"),
        ("B", 2, "-2", "negative"),
    }


def test_null_company_is_kept(spark):
    table = cells(spark, A=["1", "0", "0", "0"]).withColumn("company_id", F.lit(None).cast("string"))
    row = quality.series_quality(table, TWO_DAYS).first()
    assert row["company_id"] is None and row["zero_run_events_48h_plus"] == 1


@pytest.fixture
def wide(spark):
    """A prosumer sheet with a gap, a repeated key, hour 25, a text hour and a wrong month."""
    rows = [
        ("2026", "1", "3", "2026-01-01", str(h), "A1", "1.5", str(h), "ignored") for h in range(1, 25) if h != 5
    ]
    rows += [
        ("2026", "1", "3", "2026-01-01", "7", "A1", "9", None, None),
        ("2026", "1", "3", "2026-01-01", "25", "A1", "9", None, None),
        ("2026", "1", "3", "2026-01-01", "noon", "A1", "9", None, None),
        ("2026", "2", "4", "2026-01-02", "1", "A1", " ", "0", None),
        ("2026", "1", "5", "2026-01-03", "1", "A1", "x", "-2", None),
    ]
    names = "PeriodYear string, PeriodMonth string, WeekDay string, Date string, Hour string, Tariff string"
    return spark.createDataFrame(rows, names + ", s1 string, s2 string, s3 string").withColumn("sheet", F.lit("Prosumer A"))


@pytest.fixture
def header(spark):
    rows = [("Prosumer A", "s1", " Company 1 ", "M1 - A+"), ("Prosumer A", "s2", "Company 1", "M1 - A-")]
    return spark.createDataFrame(rows, "sheet string, column string, company_id string, raw_header string")


def test_sheet_checks(spark, wide, header):
    series = parse_headers(header, "prosumer")
    row = quality.sheet_checks(time_rows(wide), series, TWO_DAYS).first().asDict()
    assert row == {
        "sheet": "Prosumer A",
        "data_rows": 28,
        "series_columns": 2,
        "physical_meters": 1,
        "missing_time_keys": 48 - 24,
        "extra_time_keys": 3,
        "duplicate_time_keys": 1,
        "invalid_hours": 2,
        "date_metadata_mismatches": 1,
    }


def test_sheet_without_rows(spark, header):
    empty = time_rows(
        spark.createDataFrame([], "sheet string, PeriodYear int, PeriodMonth int, WeekDay int, Date date, Hour int, Tariff string")
    )
    row = quality.sheet_checks(empty, parse_headers(header, "prosumer"), TWO_DAYS).first()
    assert (row["data_rows"], row["missing_time_keys"], row["series_columns"]) == (0, 48, 2)


def test_timeline_issues(spark, wide):
    got = {(str(r["date"]), r["hour"], r["issue"]) for r in quality.timeline_issues(time_rows(wide), TWO_DAYS).collect()}
    assert ("2026-01-01", "5", "missing") in got
    assert {g for g in got if g[2] == "out_of_period"} == {
        ("2026-01-01", "25", "out_of_period"),
        ("2026-01-01", "noon", "out_of_period"),
        ("2026-01-03", "1", "out_of_period"),
    }
    assert len([g for g in got if g[2] == "missing"]) == 24


def test_melt_positions_and_columns(spark, wide, header):
    melted = melt_sheets(wide, header, "prosumer")
    assert melted.count() == 28 * 2
    row = melted.where("date = DATE'2026-01-02' AND energy_flow = 'injection_export'").first()
    assert (row["company_id"], row["meter_id"], row["raw_value"]) == ("Company 1", "M1", "0")
    # Rows of the first day: 23 hours, one of them twice, hour 25 and the text hour.
    assert row["row_position"] == 26


def test_numeric_columns_lose_nan(spark, header):
    rows = [(2026, 1, 3, DAY, 1, "A1", float("nan"), 2.0), (2026, 1, 3, DAY, 2, "A1", 1e-7, None)]
    wide = spark.createDataFrame(
        rows, "PeriodYear int, PeriodMonth int, WeekDay int, Date date, Hour int, Tariff string, s1 double, s2 double"
    ).withColumn("sheet", F.lit("Prosumer A"))
    typed = quality.typed_cells(melt_sheets(wide, header, "prosumer"))
    got = {(r["energy_flow"][:6], r["hour"]): (r["kind"], r["value"]) for r in typed.collect()}
    assert got == {
        ("consum", 1): ("missing", None),
        ("consum", 2): ("positive", 1e-7),
        ("inject", 1): ("positive", 2.0),
        ("inject", 2): ("missing", None),
    }


def _csv(path, rows):
    path.write_text("\n".join(",".join(r) for r in rows) + "\n")
    return str(path)


def test_read_raw_sheet_keeps_file_order_over_blocks(spark, tmp_path):
    hours = [(i // 24, i % 24 + 1) for i in range(400)]
    random.Random(1).shuffle(hours)
    rows = [["", "", "", "", "", "", "Company 1", "Company 2"], ["Y", "M", "W", "D", "H", "T", "M1", "M2 - A+"]]
    rows += [
        ["2026", "1", "0", str(dt.date(2026, 1, 1) + dt.timedelta(days=d)), str(h), "A1", str(i), str(-i)]
        for i, (d, h) in enumerate(hours)
    ]
    path = _csv(tmp_path / "sheet.csv", rows)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        data, header = read_raw_sheet(spark, path, "Prosumer X")
        melted = melt_sheets(data, header, "prosumer").where("meter_id = 'M1'")
        got = {r["row_position"]: (r["hour"], float(r["raw_value"])) for r in melted.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {i: (h, float(i)) for i, (_, h) in enumerate(hours)}
    names = {(r["company_id"], r["meter_id"], r["energy_flow"]) for r in parse_headers(header, "prosumer").collect()}
    assert names == {("Company 1", "M1", "consumption_import"), ("Company 2", "M2", "consumption_import")}


def test_sheets_with_different_columns_stack(spark, tmp_path):
    a = read_sheet_csv(spark, _csv(tmp_path / "a.csv", [["2026", "1", "3", "2026-01-01", "1", "A1", "1"]]), "A", ["c7"])
    b = read_sheet_csv(
        spark, _csv(tmp_path / "b.csv", [["2026", "1", "3", "2026-01-01", "1", "A1", "2", "3"]]), "B", ["c7", "c8"]
    )
    header = spark.createDataFrame(
        [("A", "c7", "K", "M1"), ("B", "c7", "K", "M2"), ("B", "c8", "K", "M3")],
        "sheet string, column string, company_id string, raw_header string",
    )
    got = {(r["meter_id"], r["raw_value"]) for r in melt_sheets(stack_sheets([a, b]), header, "prosumer").collect()}
    assert got == {("M1", "1"), ("M2", "2"), ("M3", "3")}


def test_explicit_positions_are_kept(spark, wide):
    rows = with_row_position(time_rows(wide.withColumn("row_position", F.lit(7))))
    assert {r["row_position"] for r in rows.collect()} == {7}


def test_long_table_and_active_span(spark):
    table = cells(spark, A=[None, "1", "x", "2", None]).withColumn("tariff", F.lit("A1"))
    long = ingest.hourly_long(table, quality.series_quality(table, TWO_DAYS), TWO_DAYS).orderBy("interval_start")
    rows = long.collect()
    assert [r["in_active_span"] for r in rows] == [False, True, True, True, False]
    assert [r["energy_kwh"] for r in rows] == [None, 1.0, None, 2.0, None]
    assert [r["is_missing"] for r in rows] == [True, False, True, False, True]
    assert len(long.columns) == 19


def test_audits_find_what_is_wrong(spark, wide, header):
    bad = header.unionByName(header.limit(1)).unionByName(
        spark.createDataFrame([("Prosumer A", "s3", "K", "M9 - A+"), ("B", "s1", "K", "M9")], header.schema)
    )
    series = parse_headers(bad, "prosumer")
    got = audits.failures(audits.combine(audits.header_audits(series, "prosumer")))
    assert got == {"series_unique_in_sheet": 1, "series_unique_across_sheets": 1, "prosumer_has_both_flows": 1}
    rows = time_rows(wide)
    good = parse_headers(header, "prosumer")
    melted = melt_sheets(wide, header, "prosumer")
    report = quality.series_quality(melted, TWO_DAYS)
    long = ingest.hourly_long(melted.where("hour IS NOT NULL"), report, TWO_DAYS)
    found = audits.failures(audits.combine(audits.long_audits(rows, good, report, long)))
    assert found == {"time_key_unique_in_sheet": 1, "rows_equal_time_rows_by_series": 1, "missing_equals_quality_report": 1}
    lost = audits.failures(audits.combine([audits.lookup_audit(melted, report.where("energy_flow = 'x'"), quality.SERIES)]))
    assert lost == {"series_has_quality_row": 2}


def test_required_columns():
    class Frame:
        columns = ["a"]

    with pytest.raises(ValueError, match="b"):
        audits.required_columns(Frame, ["a", "b"])


def test_repeated_time_keys_are_rows_of_their_own(spark):
    # Zeros at the hours 1, 2, 2 and 3, then a 7: one run of four rows, a span of five.
    values = [(1, "0"), (2, "0"), (2, "0"), (3, "0"), (4, "7")]
    wide = spark.createDataFrame(
        [("S", 2026, 1, DAY, hour, 3, "A1", raw) for hour, raw in values],
        "sheet string, PeriodYear int, PeriodMonth int, Date date, Hour int, WeekDay int, Tariff string, s1 string",
    )
    header = spark.createDataFrame([("S", "s1", "Company 1", "M1")], "sheet string, column string, company_id string, raw_header string")
    row = by_meter(quality.series_quality(melt_sheets(wide, header, "prosumer"), TWO_DAYS))["M1"]
    assert (row["maximum_zero_run_hours"], row["zero_run_events_48h_plus"], row["active_span_hours"]) == (4, 1, 5)


def test_rows_without_a_date_are_numbered_in_parts(spark):
    """They come behind the dated rows, each with a position of its own, and no window holds them all."""
    date = F.when(F.col("id") < 48, F.date_add(F.lit(DAY), (F.col("id") / 24).cast("int")))
    wide = spark.range(20_000).select(
        F.lit("S").alias("sheet"),
        F.lit(2026).alias("PeriodYear"),
        F.lit(1).alias("PeriodMonth"),
        F.lit("3").alias("WeekDay"),
        F.coalesce(date.cast("string"), F.concat(F.lit("day "), "id")).alias("Date"),
        (F.col("id") % 24 + 1).alias("Hour"),
        F.lit("A1").alias("Tariff"),
        F.col("id").alias("s1"),
    )
    placed = with_row_position(time_rows(wide))
    found = {r["s1"]: r["row_position"] for r in placed.select("s1", "row_position").collect()}
    assert sorted(found.values()) == list(range(20_000))
    assert [found[i] for i in range(48)] == list(range(48))
    again = with_row_position(time_rows(wide.repartition(7))).select("s1", "row_position").collect()
    assert {r["s1"]: r["row_position"] for r in again} == found
    windows = placed._jdf.queryExecution().analyzed().toString()
    assert "windowspecdefinition(sheet" in windows and "_part" in windows.split("windowspecdefinition(")[1].split(")")[0]


def test_row_keys_of_zero_runs_are_not_broadcast(spark, tmp_path):
    """The keys are one for every row of the stored sheets, however small these look."""
    rows = spark.range(5000).select(
        F.lit("S").alias("sheet"),
        F.col("id").alias("row_position"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") / 24).cast("int")).alias("date"),
        (F.col("id") % 24 + 1).cast("int").alias("hour"),
    )
    rows.write.parquet(str(tmp_path / "rows"))
    stored = spark.read.parquet(str(tmp_path / "rows"))
    text = F.when(F.col("row_position").between(10, 40), "0").otherwise("1")
    names = {"company_id": F.lit("C"), "meter_id": F.lit("M"), "energy_flow": F.lit("import"), "raw_value": text}
    found = quality.zero_runs(stored.withColumns(names), stored, 20)
    assert [(r["run_hours"], r["start_hour"], r["next_hour"]) for r in found.collect()] == [(31, 11, 18)]
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
