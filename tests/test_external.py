from __future__ import annotations

import datetime as dt
import json

import numpy as np
import pytest

from meterlens.operators import audits, external, summaries
from meterlens.settings import Settings
from meterlens.sources.holidays import read_holiday_events
from meterlens.sources.weather import (
    daily_observations,
    document_metadata,
    hourly_observations,
    read_weather_documents,
)

THREE_DAYS = Settings(start_date="2026-03-28", end_date="2026-03-30")

DAILY = (
    "company_id string, date date, energy_total_kwh double, valid_hours int, temperature_2m_mean double, "
    "hdd_18 double, cdd_18 double"
)


def days(n, step=1, first=dt.date(2025, 6, 1)):
    return [first + dt.timedelta(days=i * step) for i in range(n)]


def test_cooling_days_by_hand(spark):
    # Twelve warm days: energy is 40 up to 18 degrees and rises by 7 for each degree above.
    temperatures = [12.0, 13.0, 14.0, 15.0, 16.0, 17.0, 19.0, 20.0, 21.0, 22.0, 23.0, 24.0]
    rows = [
        ("Z", day, 40.0 + 7 * max(t - 18, 0.0), 24, t, max(18 - t, 0.0), max(t - 18, 0.0))
        for day, t in zip(days(12), temperatures)
    ]
    settings = Settings().replace(minimum_weather_days=12)
    row = external.weather_sensitivity(spark.createDataFrame(rows, DAILY), ["company_id"], settings).first()
    assert row["cdd_correlation"] == pytest.approx(1.0)
    assert row["weather_analysis_reliable"]
    # Quartiles are 14.75 and 21.25: three days below (all 40), three above (68, 75, 82).
    assert row["cold_days_mean_kwh"] == pytest.approx(40.0)
    assert row["hot_days_mean_kwh"] == pytest.approx(75.0)


def test_sensitivity_null_paths(spark):
    rows = [("none", d, 0.0, 0, 10.0, 8.0, 0.0) for d in days(3)]
    rows += [("flat", d, 5.0, 24, 10.0 + i, 8.0 - i, 0.0) for i, d in enumerate(days(3))]
    rows += [("gap", d, 5.0 + i, 24, None if i == 1 else 10.0 + i, None, 0.0) for i, d in enumerate(days(4))]
    rows += [(None, d, 5.0, 24, 10.0, 8.0, 0.0) for d in days(2)]
    table = external.weather_sensitivity(spark.createDataFrame(rows, DAILY), ["company_id"], Settings())
    got = {r["company_id"]: r for r in table.collect()}
    assert set(got) == {"none", "flat", "gap"}
    assert (got["none"]["days_with_consumption"], got["none"]["cold_days_mean_kwh"]) == (0, None)
    assert got["none"]["weather_sensitivity_label"] == "unclear"
    assert got["flat"]["temperature_correlation"] is None
    assert got["gap"]["days_with_consumption"] == 4
    assert got["gap"]["temperature_correlation"] == pytest.approx(1.0)
    assert got["gap"]["hdd_correlation"] is None and got["gap"]["cdd_correlation"] is None


HOLIDAY_DAILY = (
    "company_id string, date date, energy_total_kwh double, valid_hours int, is_holiday_or_day_off boolean, "
    "holiday_name string"
)


def test_baseline_of_the_same_weekday_by_hand(spark):
    # Thursdays at 60, 80 and 100, Fridays at 500; the holiday is a Thursday at 100.
    thursday = dt.date(2023, 3, 2)
    plain = [(0, 60.0), (7, 80.0), (14, 100.0), (1, 500.0), (8, 500.0)]
    rows = [("Z", thursday + dt.timedelta(n), e, 24, False, None) for n, e in plain]
    rows.append(("Z", thursday + dt.timedelta(21), 100.0, 24, True, "Feast"))
    row = external.holiday_effects(spark.createDataFrame(rows, HOLIDAY_DAILY)).first()
    assert row["same_weekday_baseline_kwh"] == pytest.approx(80.0)
    assert row["holiday_effect_pct"] == pytest.approx(0.25)
    assert row["baseline_day_count"] == 3


def test_holiday_null_paths_and_labels(spark):
    monday = dt.date(2025, 6, 2)
    rows = [
        ("only holidays", monday, 50.0, 24, True, "A"),
        ("zero base", monday, 50.0, 24, True, "A"),
        ("zero base", monday + dt.timedelta(7), 0.0, 24, False, None),
        ("less", monday, 50.0, 24, True, "A"),
        ("less", monday + dt.timedelta(7), 100.0, 24, False, None),
        ("less", monday + dt.timedelta(14), 900.0, 0, False, None),
        ("more", monday, 150.0, 24, True, "A"),
        ("more", monday + dt.timedelta(7), 100.0, 24, False, None),
        ("outside", monday, 10.0, 24, None, None),
        (None, monday, 50.0, 24, True, "A"),
    ]
    effects = external.holiday_effects(spark.createDataFrame(rows, HOLIDAY_DAILY))
    got = {r["company_id"]: r for r in effects.collect()}
    assert set(got) == {"only holidays", "zero base", "less", "more"}
    lone = got["only holidays"]
    assert (lone["same_weekday_baseline_kwh"], lone["holiday_effect_pct"], lone["baseline_day_count"]) == (None, None, 0)
    assert got["zero base"]["holiday_effect_pct"] is None and got["zero base"]["baseline_day_count"] == 1
    summary = {r["company_id"]: r for r in external.holiday_summary(effects, Settings()).collect()}
    assert {k: r["holiday_behavior_label"] for k, r in summary.items()} == {
        "only holidays": "limited",
        "zero base": "limited",
        "less": "lower",
        "more": "higher",
    }
    assert summary["less"]["holidays_with_reduction"] == 1 and summary["only holidays"]["holidays_with_reduction"] == 0
    assert external.holiday_summary(effects.where("false"), Settings()).count() == 0


@pytest.fixture
def documents(spark, tmp_path):
    hours = [f"2026-03-{d}T{h:02d}:00" for d in (28, 29, 30) for h in range(24)]
    body = {
        "latitude": 42.5,
        "longitude": 21.0,
        "elevation": 573.0,
        "timezone": "Europe/Belgrade",
        "hourly": {"time": hours, "temperature_2m": [float(i % 7) for i in range(len(hours))]},
        "daily": {
            "time": ["2026-03-28", "2026-03-29", "2026-03-30"],
            "temperature_2m_mean": [3.0, None, 20.0],
            "temperature_2m_min": [0.0, 0.0, 15.0],
            "temperature_2m_max": [6.0, 6.0, 25.0],
        },
    }
    path = tmp_path / "weather.json"
    path.write_text(json.dumps(body, indent=2))
    return read_weather_documents(spark, str(path))


def test_weather_file_to_hours(spark, documents):
    hourly, daily = hourly_observations(documents), daily_observations(documents)
    weather = external.weather_hourly(hourly, daily, THREE_DAYS)
    assert weather.count() == 72
    # The night of the clock change keeps its 24 hours.
    assert weather.where("date = DATE'2026-03-29'").count() == 24
    assert audits.failures(audits.combine(audits.weather_audits(weather, THREE_DAYS))) == {}
    got = {str(r["date"]): (r["hdd_18"], r["cdd_18"]) for r in external.with_degree_days(daily, THREE_DAYS).collect()}
    assert got == {"2026-03-28": (15.0, 0.0), "2026-03-29": (None, None), "2026-03-30": (0.0, 2.0)}
    assert document_metadata(documents).first().asDict() == {
        "latitude": 42.5,
        "longitude": 21.0,
        "elevation": 573.0,
        "timezone": "Europe/Belgrade",
    }


def test_weather_audits_fail(spark, documents):
    weather = hourly_observations(documents)
    bad = weather.unionByName(weather.limit(1).selectExpr("interval_start", "CAST(NULL AS DOUBLE) AS temperature_2m", "date"))
    assert audits.failures(audits.combine(audits.weather_audits(bad, THREE_DAYS))) == {
        "weather_hours_complete": 1,
        "weather_hour_unique": 1,
        "weather_temperature_present": 1,
    }


def test_calendar_from_csv(spark, tmp_path):
    lines = [
        "holiday_id,holiday_name,holiday_date,observed_date,source_year,date_may_change",
        "a,Feast B,2026-03-29,2026-03-30,2026,true",
        "b,Feast A,2026-03-29,2026-03-30,2026,false",
        "c,Far away,2025-01-01,2025-01-01,2025,false",
    ]
    (tmp_path / "h.csv").write_text("\n".join(lines) + "\n")
    events = read_holiday_events(spark, str(tmp_path / "h.csv"))
    calendar = external.holiday_calendar(spark, events, THREE_DAYS).orderBy("date").collect()
    assert [r["is_official_holiday_date"] for r in calendar] == [False, True, False]
    assert [r["is_observed_day_off"] for r in calendar] == [False, False, True]
    assert [r["holiday_name"] for r in calendar] == [None, "Feast A; Feast B", "Feast A; Feast B"]
    assert [r["is_day_before_holiday"] for r in calendar] == [True, True, False]
    assert [r["is_day_after_holiday"] for r in calendar] == [False, False, True]
    assert audits.failures(audits.combine([audits.key_unique_audit(external.holiday_calendar(spark, events, THREE_DAYS), ["date"], "x")])) == {}


def test_context_order(spark, documents):
    hour = dt.datetime(2026, 3, 28)
    outliers = spark.createDataFrame(
        [("holiday", hour, hour.date()), ("cold", hour, dt.date(2026, 3, 27)), ("none", dt.datetime(2027, 1, 1), dt.date(2027, 1, 1))],
        "company_id string, interval_start timestamp_ntz, date date",
    )
    events = spark.createDataFrame([("X", hour.date(), hour.date())], "holiday_name string, holiday_date date, observed_date date")
    weather = external.weather_hourly(hourly_observations(documents), daily_observations(documents), THREE_DAYS)
    calendar = external.holiday_calendar(spark, events, THREE_DAYS)
    got = external.outlier_context(outliers, weather, calendar, THREE_DAYS).collect()
    assert {r["company_id"]: r["external_context"] for r in got} == {"holiday": "holiday", "cold": "cold", "none": "none"}


def test_metric_table(spark):
    rows = summaries.metric_table(spark.sql("SELECT 1 AS a, 2.5D AS b, 'x' AS c")).collect()
    assert {r["metric"]: r["value"] for r in rows} == {"a": "1", "b": "2.5", "c": "x"}
