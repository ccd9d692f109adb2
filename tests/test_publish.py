from __future__ import annotations

import datetime as dt
import hashlib
import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from meterlens.operators import dashboard
from meterlens.plans import fixtures as fx
from meterlens.plans.analysis import REQUIRED_REPORTS, Analysis, AuditFailure, Inputs, run_all
from meterlens.sinks import store as store_module
from meterlens.sinks.commits import CommitLog
from meterlens.sinks.store import RunLog, RunStore, current_run, current_table, run_history, step_history
from meterlens.sources.tables import read_table, sha256_of, source_manifest


def write_run(spark, root, value, fail=False):
    store = RunStore(spark, root)
    log = RunLog(store)

    def first():
        store.write(spark.createDataFrame([(value,)], "v int"), "answer")
        return {"rows": 1}

    def second():
        if fail:
            raise RuntimeError("step broke")
        return {}

    try:
        log.step("write", first)
        log.step("check", second)
    except RuntimeError as error:
        log.finish(error)
        raise
    log.finish()
    return store.run_id


def test_failed_run_keeps_the_previous_tables(spark, tmp_path):
    root = str(tmp_path)
    assert current_run(spark, root) is None
    with pytest.raises(ValueError):
        current_table(spark, root, "answer")
    first = write_run(spark, root, 1)
    with pytest.raises(RuntimeError, match="step broke"):
        write_run(spark, root, 2, fail=True)
    assert current_run(spark, root) == first
    assert current_table(spark, root, "answer").first()["v"] == 1
    history = run_history(spark, root).orderBy("started_at").collect()
    assert [r["status"] for r in history] == ["success", "failed"]
    assert (history[1]["error_type"], history[1]["error"]) == ("RuntimeError", "step broke")
    steps = step_history(spark, root).where(F.col("run_id") != first).orderBy("step").collect()
    assert [(r["name"], r["status"]) for r in steps] == [("write", "success"), ("check", "failed")]
    third = write_run(spark, root, 3)
    assert current_run(spark, root) == third
    assert current_table(spark, root, "answer").first()["v"] == 3


def test_tables_are_written_once(spark, tmp_path):
    store = RunStore(spark, str(tmp_path))
    one = spark.createDataFrame([(1, "a"), (2, "b")], "v int, part string")
    stored = store.write(one, "t", partition_by=["part"], sort_by=["v"])
    assert {tuple(r) for r in stored.select("v", "part").collect()} == {(1, "a"), (2, "b")}
    with pytest.raises(Exception, match="(?i)exist"):
        store.write(one, "t")
    found = read_table(spark, store.path("t"), columns=["v"], equals={"part": "b"})
    assert [r["v"] for r in found.collect()] == [2]
    assert "PartitionFilters: [isnotnull(part" in found._jdf.queryExecution().executedPlan().toString()


def test_source_manifest(spark, tmp_path):
    contents = {"a.bin": b"source", "b.bin": b"a longer source" * 1000}
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    with open(tmp_path / "large.bin", "wb") as large:  # above what Spark holds in one value; takes no room on the disk
        large.truncate(2_500_000_000)
    rows = {r["name"]: r for r in source_manifest(spark, str(tmp_path / "*.bin")).collect()}
    zeros = hashlib.sha256()
    for _ in range(2500):
        zeros.update(bytes(1_000_000))
    assert rows.pop("large.bin")["sha256"] == zeros.hexdigest()
    assert set(rows) == set(contents)
    for name, content in contents.items():
        assert rows[name]["size_bytes"] == len(content)
        assert rows[name]["sha256"] == hashlib.sha256(content).hexdigest()


def test_a_digest_holds_one_block():
    class Stream:
        """Hands out whole blocks and remembers the buffers that it filled."""

        def __init__(self, content):
            self.content, self.buffers = content, set()

        def readinto(self, buffer):
            part, self.content = self.content[: len(buffer)], self.content[len(buffer) :]
            buffer[: len(part)] = part
            self.buffers.add((id(buffer), len(buffer)))
            return len(part)

    content = bytes(range(256)) * 100 + b"end"
    stream = Stream(content)
    assert sha256_of(stream, block_bytes=1000) == hashlib.sha256(content).hexdigest()
    assert [size for _, size in stream.buffers] == [1000]


def test_numbers_are_claimed_once(spark, tmp_path):
    """Eight writers at a time: numbers without a gap, every entry whole and under its own number."""
    log = CommitLog(spark, str(tmp_path / "log"))
    assert log.last() == 0 and log.read("writer int") is None
    with ThreadPoolExecutor(8) as pool:
        numbers = list(pool.map(lambda i: CommitLog(spark, str(tmp_path / "log")).append({"writer": i}), range(40)))
    assert sorted(numbers) == list(range(1, 41)) and log.last() == 40
    assert {(r["number"], r["writer"]) for r in log.read("writer int").collect()} == set(zip(numbers, range(40)))


def test_renames_refuse_to_overwrite(spark, tmp_path):
    """The way of other file systems than the local one."""
    log = CommitLog(spark, str(tmp_path / "log"))
    log._local = False
    assert [log.append({"v": v}) for v in (7, 8)] == [1, 2]
    log.last = lambda: 0  # as a writer sees it that looked before the others claimed theirs
    assert log.append({"v": 9}) == 3
    assert sorted((r["number"], r["v"]) for r in log.read("v int").collect()) == [(1, 7), (2, 8), (3, 9)]
    assert not [n for n in os.listdir(tmp_path / "log") if n.startswith("_")]


def test_an_older_run_never_becomes_current(spark, tmp_path, monkeypatch):
    """Two runs end together, the older one last, and clocks go back in between."""
    root = str(tmp_path)
    clock = iter(dt.datetime(2030, 1, 1, tzinfo=dt.timezone.utc) - dt.timedelta(days=k) for k in range(100))
    monkeypatch.setattr(store_module, "_now", lambda: next(clock))
    stores = [RunStore(spark, root, name) for name in ("older", "newer")]
    logs = [RunLog(store) for store in stores]
    for value, store in enumerate(stores):
        store.write(spark.createDataFrame([(value,)], "v int"), "answer")
    logs[1].finish()
    assert current_run(spark, root) == "newer"
    logs[0].finish()
    assert current_run(spark, root) == "newer"
    assert current_table(spark, root, "answer").first()["v"] == 1
    history = run_history(spark, root).orderBy("number").collect()
    assert [(r["run_id"], r["run_number"], r["number"]) for r in history] == [("newer", 2, 3), ("older", 1, 4)]
    # A run that starts now is newer than both, however early its clock.
    last = RunLog(RunStore(spark, root, "last"))
    last.finish()
    assert current_run(spark, root) == "last"


def test_reports_hold_nested_columns_as_json(spark, tmp_path):
    store = RunStore(spark, str(tmp_path))
    store.write_report(spark.sql("SELECT 1 AS a, array(1, 2) AS b, named_struct('x', 'y') AS c"), "nested")
    row = spark.read.option("header", True).option("escape", '"').csv(store.report_path("nested")).first()
    assert (row["a"], row["b"]) == ("1", "[1,2]") and store.reports == ["nested"]


# The year that the small sheets cover.
RUN = fx.RUN.replace(start_date="1998-01-01", end_date="1998-12-31", k_max=3, n_init=1)


@pytest.fixture(scope="module")
def year(spark, tmp_path_factory):
    """A small year of four companies, three meters each, every second hour absent from the sheet."""
    root = str(tmp_path_factory.mktemp("year"))
    hours = spark.range(365 * 12).select((F.col("id") * 2).alias("h"))
    rows = hours.select(
        F.date_add(F.lit("1998-01-01").cast("date"), F.floor(F.col("h") / 24).cast("int")).alias("Date"),
        (F.col("h") % 24 + 1).cast("int").alias("Hour"),
        F.explode(F.sequence(F.lit(1), F.lit(5))).alias("n"),
    )
    level = 10 + F.col("n") * F.sin(F.col("Hour") / 4) + F.month("Date") % 5 + F.dayofweek("Date") / F.col("n")
    wide = rows.select(
        F.concat(F.lit("Sheet "), F.col("n").cast("string")).alias("sheet"),
        F.year("Date").alias("PeriodYear"),
        F.month("Date").alias("PeriodMonth"),
        F.weekday("Date").alias("WeekDay"),
        "Date",
        "Hour",
        F.lit("A1").alias("Tariff"),
        level.alias("s1"),
        (level * 2 + F.col("Hour") % 3).alias("s2"),
        F.when(F.dayofmonth("Date") > 3, level + F.pmod(F.xxhash64("Date", "Hour"), F.lit(7))).alias("s3"),
    )
    wide.write.parquet(f"{root}/wide")
    names = [(f"Sheet {n}", f"s{i}", f"Company {n}", f"N{n}-M{i}") for n in range(1, 6) for i in (1, 2, 3)]
    header = spark.createDataFrame(names, "sheet string, column string, company_id string, raw_header string")
    return spark.read.parquet(f"{root}/wide"), header


def inputs(year, dimensions):
    wide, header = year
    return Inputs(wide, header, dimensions["weather_documents"], dimensions["holiday_events"])


@pytest.fixture(scope="module")
def dimensions(spark):
    """Weather of the year and two holidays, without the benchmark tables."""
    events = spark.sql(
        "SELECT 'New Year' AS holiday_name, DATE'1998-01-01' AS holiday_date, DATE'1998-01-01' AS observed_date "
        "UNION ALL SELECT 'May Day', DATE'1998-05-01', DATE'1998-05-04'"
    )
    return {"weather_documents": fx.period_weather_documents(spark, RUN), "holiday_events": events}


def test_whole_run(spark, tmp_path, year, dimensions):
    root = str(tmp_path)
    run_id = run_all(spark, inputs(year, dimensions), RUN, root)
    assert current_run(spark, root) == run_id
    steps = step_history(spark, root).collect()
    assert len(steps) == 7 and all(r["status"] == "success" for r in steps)
    long = current_table(spark, root, "hourly_long")
    assert long.count() == 365 * 12 * 15
    assert current_table(spark, root, "hourly_enriched").where("temperature_2m IS NULL").count() == 0
    assert current_table(spark, root, "company_clusters").count() == 5
    assert current_table(spark, root, "meter_profile_metrics").count() == 15
    assert current_table(spark, root, "audits").where("NOT passed").count() == 0
    assert set(run_history(spark, root).first()["reports"]) == set(REQUIRED_REPORTS)
    for name, rows in (("meter_metrics", 15), ("company_clusters", 5), ("holidays_in_period", 3), ("sheet_checks", 5)):
        assert spark.read.option("header", True).csv(f"{root}/reports/{run_id}/{name}").count() == rows
    summary = spark.read.option("header", True).csv(f"{root}/reports/{run_id}/profiles_summary")
    assert {r["metric"]: r["value"] for r in summary.collect()}["meter_energy_series"] == "15"
    card = dashboard.company_card(
        current_table(spark, root, "company_profile_metrics"),
        current_table(spark, root, "company_meter_heterogeneity"),
        current_table(spark, root, "company_weather_sensitivity"),
        current_table(spark, root, "company_holiday_effect_summary"),
        current_table(spark, root, "company_clusters").where("company_id <> 'Company 1'"),
    )
    got = {r["company_id"]: r for r in card.collect()}
    assert got["Company 1"]["cluster_id"] == "No group"
    assert got["Company 2"]["cluster_id"].startswith("Group ")
    assert dashboard.cluster_overview(current_table(spark, root, "cluster_centers")).count() >= 2


def test_failed_audit_stops_publication(spark, tmp_path, year, dimensions, monkeypatch):
    wide, header = year
    twice = wide.where("sheet = 'Sheet 1' AND Hour = 1 AND PeriodMonth = 1")
    # Only the first and the audit step run, on one sheet with repeated keys.
    monkeypatch.setattr(Analysis, "profile_step", lambda self: {})
    monkeypatch.setattr(Analysis, "outlier_step", lambda self: {})
    monkeypatch.setattr(Analysis, "external_step", lambda self: {})
    monkeypatch.setattr(Analysis, "cluster_step", lambda self: {})
    bad = Inputs(
        twice.unionByName(twice), header.where("sheet = 'Sheet 1'"), dimensions["weather_documents"], dimensions["holiday_events"]
    )
    with pytest.raises(AuditFailure, match="time_key_unique_in_sheet.*required_tables_present.*required_reports_present"):
        run_all(spark, bad, RUN, str(tmp_path))
    assert current_run(spark, str(tmp_path)) is None
    last = step_history(spark, str(tmp_path)).orderBy(F.col("step").desc()).first()
    assert (last["name"], last["status"], last["error_type"]) == ("audits", "failed", "AuditFailure")


def test_inputs_from_files(spark, tmp_path):
    lead = ["", "", "", "", "", ""]
    for name, meters in (("Prosumer", ["M1 - A+", "M1 - A-"]), ("Other", ["M2"])):
        rows = [lead + ["Company 1"] * len(meters), lead + meters]
        rows += [["1998", "1", "3", "1998-01-01", str(h), "A1"] + ["2.5"] * len(meters) for h in (1, 2)]
        (tmp_path / f"{name}.csv").write_text("\n".join(",".join(r) for r in rows) + "\n")
    (tmp_path / "weather.json").write_text('{"latitude": 42.5, "hourly": {"time": ["1998-01-01T00:00"], "temperature_2m": [1.5]}}')
    (tmp_path / "holidays.csv").write_text(
        "holiday_id,holiday_name,holiday_date,observed_date,source_year,date_may_change\na,New Year,1998-01-01,1998-01-01,1998,false\n"
    )
    loaded = Inputs.from_files(
        spark,
        {n: str(tmp_path / f"{n}.csv") for n in ("Prosumer", "Other")},
        str(tmp_path / "weather.json"),
        str(tmp_path / "holidays.csv"),
        str(tmp_path / "*.csv"),
    )
    run = Analysis(spark, loaded, RUN, str(tmp_path / "out"))
    found = run.quality_step()
    assert (found["series_count"], found["physical_meter_count"], found["sheet_count"]) == ("3", "2", "2")
    assert {r["name"] for r in run.store.read("source_manifest").collect()} == {"Prosumer.csv", "Other.csv", "holidays.csv"}
    assert loaded.holiday_events.first()["holiday_name"] == "New Year"


def test_kernels_reach_tasks_from_any_folder(sf_dir, tmp_path):
    """A session started elsewhere, with the package on the driver's path only."""
    import subprocess
    import sys
    from pathlib import Path

    repo = str(Path(__file__).resolve().parents[1])
    code = f"""
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
import __spark_entry__ as entry
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
print("rows", entry.queries()["meter_heterogeneity"](spark, {sf_dir!r}).count())
"""
    import os

    plain = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=plain, capture_output=True, text=True, timeout=300)
    assert "rows " in done.stdout, done.stderr[-2000:]
