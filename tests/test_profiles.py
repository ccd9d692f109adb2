from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meterlens.operators import profiles, similarity
from meterlens.plans import fixtures
from meterlens.settings import Settings

BASIC = "company_id string, energy_kwh double, is_peak_07_18 boolean, is_weekend boolean"


def test_basic_metrics_by_hand(spark):
    # Peak hours 6, 10 and 8, off-peak 2 and 4; the hours of 8 and 4 lie on a weekend.
    rows = [("Z", 6.0, True, False), ("Z", 10.0, True, False), ("Z", 8.0, True, True), ("Z", 2.0, False, False), ("Z", 4.0, False, True)]
    row = profiles.basic_metrics(spark.createDataFrame(rows, BASIC), ["company_id"]).first()
    assert row["peak_offpeak_ratio"] == pytest.approx(8 / 3)
    assert row["weekday_weekend_ratio"] == pytest.approx(1.0)
    assert row["load_factor"] == pytest.approx(0.6)


def test_basic_metrics_null_paths(spark):
    rows = [
        ("all missing", None, True, False),
        ("all missing", None, False, True),
        ("no offpeak", 2.0, True, False),
        ("zero offpeak", 2.0, True, False),
        ("zero offpeak", 0.0, False, False),
        (None, 4.0, False, True),
    ]
    got = {r["company_id"]: r for r in profiles.basic_metrics(spark.createDataFrame(rows, BASIC), ["company_id"]).collect()}
    missing = got["all missing"]
    assert missing["energy_total_kwh"] == 0.0 and missing["energy_mean_kwh"] is None
    assert missing["zero_offpeak_denominator"] is True and missing["zero_weekend_denominator"] is True
    assert got["no offpeak"]["zero_offpeak_denominator"] is None
    assert got["no offpeak"]["energy_std_kwh"] is None and got["no offpeak"]["coefficient_of_variation"] is None
    assert got["zero offpeak"]["zero_offpeak_denominator"] is True
    assert got["zero offpeak"]["peak_offpeak_ratio"] is None
    assert got[None]["energy_total_kwh"] == 4.0


YEAR = Settings(start_date="2025-01-01", end_date="2025-12-31", profile_start_date="2025-01-01", profile_end_date="2025-12-31")


def monthly(spark, **series):
    """One reading a month at noon of the first day; a value per month."""
    rows = [
        (name, sheet, dt.datetime(2025, month, 1, 12), value)
        for (name, sheet), values in ((tuple(k.split("__")), v) for k, v in series.items())
        for month, value in values.items()
    ]
    schema = "company_id string, source_sheet string, interval_start timestamp_ntz, energy_kwh double"
    return spark.createDataFrame(rows, schema)


def test_seasonality_labels_and_trend(spark):
    summer = {m: (3.0 if m in (6, 7, 8) else 1.0) for m in range(1, 13)}
    winter = {m: (3.0 if m in (12, 1, 2) else 1.0) for m in range(1, 13)}
    half = {m: 1.0 for m in range(6, 9)}
    table = monthly(spark, s__A=summer, w__A=winter, h__A=half)
    months = profiles.monthly_profiles(table, ["company_id"], YEAR)
    got = {r["company_id"]: r for r in profiles.seasonality_and_trend(months, ["company_id"], YEAR).collect()}
    assert {k: r["seasonality_label"] for k, r in got.items()} == {"s": "summer", "w": "winter", "h": "none"}
    assert got["s"]["seasonality_reliable"] and got["s"]["trend_reliable"]
    assert got["s"]["monthly_trend_pct"] == 0.0
    assert got["w"]["monthly_trend_pct"] == pytest.approx((3.0 - 7.0 / 3) / (7.0 / 3))
    assert got["h"]["winter_index"] is None and not got["h"]["trend_reliable"]


def test_trend_months_are_per_scope(spark):
    table = monthly(spark, a__A={1: 1.0, 2: 1.0, 3: 1.0, 4: 4.0}, b__B={5: 2.0, 6: 2.0, 7: 2.0, 8: 3.0})
    months = profiles.monthly_profiles(table, ["company_id", "source_sheet"], YEAR)
    keys = ["company_id", "source_sheet"]
    scoped = {r["company_id"]: r for r in profiles.seasonality_and_trend(months, keys, YEAR, ["source_sheet"]).collect()}
    assert (scoped["a"]["monthly_trend_pct"], scoped["b"]["monthly_trend_pct"]) == (3.0, 0.5)
    whole = {r["company_id"]: r for r in profiles.seasonality_and_trend(months, keys, YEAR).collect()}
    assert whole["a"]["last_month_mean_kwh"] is None and whole["b"]["first_3_months_mean_kwh"] is None


def test_zero_period_mean_gives_no_index(spark):
    months = profiles.monthly_profiles(monthly(spark, z__A={1: 0.0, 2: 0.0}), ["company_id"], YEAR).collect()
    assert [r["seasonality_index"] for r in months] == [None, None]


def test_profile_period_is_inclusive_to_the_last_hour(spark):
    settings = YEAR.replace(profile_start_date="2025-02-01", profile_end_date="2025-02-28")
    rows = [("K", dt.datetime(2025, 1, 31, 23), 1.0), ("K", dt.datetime(2025, 2, 28, 23), 1.0), ("K", dt.datetime(2025, 3, 1), 1.0)]
    table = spark.createDataFrame(rows, "company_id string, interval_start timestamp_ntz, energy_kwh double")
    got = profiles.monthly_profiles(table, ["company_id"], settings).collect()
    assert [(str(r["month_start"]), r["expected_hours"]) for r in got] == [("2025-02-01 00:00:00", 1)]


def test_company_hours_stay_null_when_no_meter_reports(spark):
    hour = dt.datetime(2026, 1, 1)
    rows = [("K", f, hour, hour.date(), 1, False, False, v) for f, v in (("consumption_import", None), ("consumption_import", None), ("injection_export", 5.0))]
    schema = "company_id string, energy_flow string, interval_start timestamp_ntz, date date, hour_1_24 int, is_weekend boolean, is_peak_07_18 boolean, energy_kwh double"
    row = profiles.company_hourly(spark.createDataFrame(rows, schema)).first()
    assert (row["energy_kwh"], row["reporting_meter_count"]) == (None, 0)


# --- similarity ------------------------------------------------------------------------------


def brute(frame: pd.DataFrame):
    """Mean, minimum of all pairwise correlations by the definition."""
    found = []
    for i in range(len(frame)):
        for j in range(i + 1, len(frame)):
            pair = pd.concat([frame.iloc[i], frame.iloc[j]], axis=1).dropna()
            a, b = pair.iloc[:, 0], pair.iloc[:, 1]
            if len(pair) < 6:
                continue
            flat = (a.nunique() <= 1, b.nunique() <= 1)
            found.append(1.0 if all(flat) else 0.0 if any(flat) else a.corr(b))
    return (np.mean(found), np.min(found)) if found else (None, None)


@pytest.fixture(scope="module")
def profiles_of_meters():
    rng = np.random.default_rng(11)
    companies = {}
    for company, meters in (("A", 23), ("B", 2), ("C", 7)):
        values = rng.gamma(2.0, 10.0, size=(meters, 24))
        values[rng.random(values.shape) < 0.25] = np.nan
        companies[company] = values
    companies["A"][0] = 5.0  # constant
    companies["A"][1] = 5.0
    companies["A"][2] = np.nan
    companies["A"][2, :4] = 1.0  # fewer than six hours
    companies["A"][3] = np.nan
    companies["A"][3, :12] = 7.0  # constant where it meets the next, varying elsewhere
    companies["A"][3, 12:20] = rng.random(8)
    companies["A"][4] = np.nan
    companies["A"][4, :12] = rng.random(12)
    companies["C"][0] = 1e6 + rng.random(24) * 1e-3  # tiny variation on a large level
    return companies


def test_correlation_matrix_against_definition(profiles_of_meters):
    values = profiles_of_meters["A"]
    matrix = similarity.correlations(values, values)
    for i in range(len(values)):
        for j in range(len(values)):
            expected = brute(pd.DataFrame([values[i], values[j]]))[0]
            if expected is None:
                assert np.isnan(matrix[i, j])
            else:
                assert matrix[i, j] == pytest.approx(expected, abs=1e-7)


@pytest.mark.parametrize("block_rows", [3, 8192])
def test_pairwise_correlation_over_tiles(spark, profiles_of_meters, block_rows):
    rows = [
        (company, f"m{i}", *[None if np.isnan(v) else float(v) for v in row])
        for company, values in profiles_of_meters.items()
        for i, row in enumerate(values)
    ]
    schema = "company_id string, meter_id string, " + ", ".join(f"{h} double" for h in similarity.HOURS)
    got = {
        r["company_id"]: (r[1], r[2])
        for r in similarity.pairwise_profile_correlation(spark.createDataFrame(rows, schema), block_rows).collect()
    }
    for company, values in profiles_of_meters.items():
        assert got[company] == pytest.approx(brute(pd.DataFrame(values)), abs=1e-7)


def test_heterogeneity_labels(spark):
    hours = range(1, 25)
    shapes = {
        ("one", "a"): lambda h: h,
        ("alike", "a"): lambda h: h,
        ("alike", "b"): lambda h: 2 * h + 1,
        ("apart", "a"): lambda h: h,
        ("apart", "b"): lambda h: -h,
        ("flat", "a"): lambda h: 1,
        ("flat", "b"): lambda h: 2,
    }
    hourly = spark.createDataFrame(
        [(c, m, "consumption_import", h, float(f(h)), 1) for (c, m), f in shapes.items() for h in hours],
        "company_id string, meter_id string, energy_flow string, hour_1_24 int, mean_kwh double, valid_hours int",
    )
    metrics = spark.createDataFrame(
        [(c, m, "consumption_import", 1.0 + i, 0.5) for i, (c, m) in enumerate(shapes)],
        "company_id string, meter_id string, energy_flow string, peak_offpeak_ratio double, load_factor double",
    )
    got = {r["company_id"]: r for r in similarity.meter_heterogeneity(metrics, hourly, Settings()).collect()}
    assert {k: r["meter_profile_similarity"] for k, r in got.items()} == {
        "one": "single_meter",
        "alike": "similar",
        "apart": "clearly_different",
        "flat": "similar",
    }
    assert got["one"]["peak_ratio_range"] == 0.0 and got["one"]["mean_pairwise_profile_correlation"] is None
    assert got["alike"]["peak_ratio_range"] == 1.0
    assert got["apart"]["minimum_pairwise_profile_correlation"] == pytest.approx(-1.0)
    assert got["flat"]["mean_pairwise_profile_correlation"] == 1.0


def test_every_tile_stays_within_the_block_size(spark):
    from meterlens.functions.tiles import TILE, into_tiles

    members = spark.range(1000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("c"), (F.col("id") % 30).cast("string"))).alias("g"),
        F.col("id").cast("string").alias("m"),
    )
    tiled = into_tiles(members, ["g"], "m", block_rows=50)
    sizes = tiled.groupBy("g", *TILE).count()
    assert sizes.agg(F.max("count")).first()[0] < 4 * 50
    # Every pair of a group meets in exactly one tile: count them for the hot group.
    sides = tiled.where("g = 'hot'").groupBy(*TILE).agg(
        F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b")
    )
    pairs = sum(
        r["a"] * (r["a"] - 1) // 2 if r["tile_i"] == r["tile_j"] else r["a"] * r["b"] for r in sides.collect()
    )
    hot = members.where("g = 'hot'").count()
    assert pairs == hot * (hot - 1) // 2


def test_hourly_grid_is_filled_up_in_many_parts(spark, sf_dir, monkeypatch):
    """Series take few bytes before their hours are filled up; Spark must not gather them in one task for that."""
    for size in (4096, 1 << 30):  # also with as many parts as there are shuffle partitions
        monkeypatch.setattr(fixtures, "EVENT_BYTES", size)
        hourly = fixtures.hourly_readings(spark, sf_dir)
        assert hourly._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") == 2
        sizes = [r["count"] for r in hourly.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) >= 2 and max(sizes) < 0.9 * sum(sizes)


def test_hourly_grid_of_rare_events_is_filled_up_in_many_parts(spark, tmp_path, monkeypatch):
    """A series of one event has all hours too, so parts follow the series and not the stored events alone."""
    monkeypatch.setattr(fixtures, "GRID_ROWS", 1 << 12, raising=False)
    monkeypatch.setattr(fixtures, "UNCOUNTED_BYTES", 0, raising=False)
    users = F.expr("CASE WHEN id > 0 THEN id * 30 END").alias("user_id")
    times = F.lit("2024-01-03 04:00:00").cast("timestamp_ntz").alias("ts")
    events = spark.range(200).select(users, F.lit("view").alias("event_type"), times, F.lit(1.5).alias("value"))
    events.write.parquet(str(tmp_path / "events.parquet"))
    got = fixtures.hourly_readings(spark, str(tmp_path))
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 200 * 720 and len(sizes) >= 20 and max(sizes) < 25 * 720
    assert got.where("energy_kwh > 0").count() == 200


def test_hourly_readings_by_hand(spark, tmp_path):
    """Repeated and null values, null users and hours outside the period."""
    rows = [
        (1, "view", "2024-01-01 00:10:00", 1.3), (1, "view", "2024-01-01 00:50:00", 2.0), (1, "view", "2024-01-01 01:00:00", None),
        (33, "error", "2023-12-31 23:00:00", 4.0), (14, "view", "2024-02-02 05:30:00", -1.0), (14, "view", None, 5.0), (None, "view", "2024-01-02 00:00:00", 7.0),
    ]
    events = spark.createDataFrame(rows, "user_id long, event_type string, ts string, value double")
    events.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(str(tmp_path / "events.parquet"))
    got = fixtures.hourly_readings(spark, str(tmp_path))
    sizes = {(r["n"], r["m"]): r["count"] for r in got.groupBy("n", "m").count().collect()}
    assert sizes == {(1, 0): 720, (2, 0): 721, (1, 3): 722, (None, 3): 720}
    filled = got.where("energy_kwh != 0").select("n", "m", F.col("date").cast("string").alias("d"), "hour_1_24", "energy_kwh")
    assert {tuple(r) for r in filled.collect()} == {
        (1, 0, "2024-01-01", 1, 3.25), (2, 0, "2023-12-31", 24, 4.0), (1, 3, "2024-02-02", 6, -1.0), (1, 3, None, None, 5.0), (None, 3, "2024-01-02", 1, 7.0),
    }
