from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterlens.functions import cells as C
from meterlens.functions.calendar import degree_days, hour_start, month_start, period_days, with_calendar
from meterlens.functions.skew import hot_keys, join_null_safe, salted_lookup, stored_bytes
from meterlens.functions.stats import exact_quantiles, guarded_corr, safe_ratio
from meterlens.settings import Settings


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


@pytest.mark.parametrize(
    "raw, prosumer, expected",
    [
        ("DFE123 - A+", True, ("DFE123", C.IMPORT)),
        ("DFE123 - A-", True, ("DFE123", C.EXPORT)),
        ("DFE123 - A-", False, ("DFE123 - A-", C.IMPORT)),
        (" North - 7 - A- ", True, ("North - 7", C.EXPORT)),
        ("DFE123 - B", True, ("DFE123 - B", C.IMPORT)),
        ("DFE123", True, ("DFE123", C.IMPORT)),
    ],
)
def test_header_parse(spark, raw, prosumer, expected):
    row = column(spark, [raw]).select(
        C.header_meter(F.col("x"), F.lit(prosumer)), C.header_flow(F.col("x"), F.lit(prosumer))
    ).first()
    assert tuple(row) == expected


def test_prosumer_sheet_match_ignores_case(spark):
    rows = column(spark, ["My PROSUMER sheet", "other"]).select(C.is_prosumer_sheet(F.col("x"), "Prosumer")).collect()
    assert [r[0] for r in rows] == [True, False]


def test_cell_kinds_and_numbers(spark):
    cases = {
        None: ("missing", None),
        "": ("missing", None),
        " \t": ("missing", None),
        "n/a": ("non_numeric", None),
        "1_000": ("non_numeric", None),
        "12d": ("non_numeric", None),
        "nan": ("non_numeric", None),
        "inf": ("non_numeric", None),
        "-0.5": ("negative", -0.5),
        "0": ("zero", 0.0),
        "-0.0": ("zero", 0.0),
        " 7.25 ": ("positive", 7.25),
        "1e3": ("positive", 1000.0),
        ".5": ("positive", 0.5),
        "5.": ("positive", 5.0),
        "+2": ("positive", 2.0),
    }
    rows = column(spark, list(cases)).select("x", C.value_kind(F.col("x")), C.number_or_null(F.col("x"))).collect()
    assert {r[0]: (r[1], r[2]) for r in rows} == cases


def test_natural_order_key(spark):
    rows = column(spark, ["Company 10", "Company 2", "Company x", "7", "Company"]).select(
        "x", C.trailing_number(F.col("x")).alias("k")
    )
    assert {r["x"]: r["k"] for r in rows.collect()} == {
        "Company 10": 10,
        "Company 2": 2,
        "Company x": 10**9,
        "7": 10**9,
        "Company": 10**9,
    }


def test_joined_names(spark):
    names = column(spark, ["b", "a", " ", None, "b"])
    assert names.agg(C.joined_names(F.col("x"))).first()[0] == "a; b"
    assert column(spark, [None, ""]).agg(C.joined_names(F.col("x"))).first()[0] is None
    pairs = spark.createDataFrame([("b", "a"), ("a", "a"), (None, "z"), (None, None), ("a; b", "a")], "l string, r string")
    got = [r[0] for r in pairs.select(C.joined_pair(F.col("l"), F.col("r"))).collect()]
    assert got == ["a; b", "a", "z", None, "a; a; b"]


def test_degree_days_keep_null(spark):
    rows = column(spark, [20.0, 10.0, None], "double").select(
        degree_days(F.col("x"), 18.0, heating=True), degree_days(F.col("x"), 18.0, heating=False)
    )
    assert [tuple(r) for r in rows.collect()] == [(0.0, 2.0), (8.0, 0.0), (None, None)]


def test_safe_ratio(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0), (1.0, -2.0), (None, 1.0), (1.0, None)], "a double, b double")
    assert [r[0] for r in rows.select(safe_ratio(F.col("a"), F.col("b"))).collect()] == [0.5, None, None, None, None]


def test_guarded_corr(spark):
    rows = [("up", 1.0, 2.0), ("up", 2.0, 4.0), ("up", 3.0, 7.0), ("flat", 1.0, 5.0), ("flat", 2.0, 5.0)]
    rows += [("one", 1.0, 1.0), ("holes", 1.0, None), ("holes", None, 2.0), ("holes", 2.0, 3.0)]
    got = {
        r[0]: r[1]
        for r in spark.createDataFrame(rows, "k string, x double, y double")
        .groupBy("k")
        .agg(guarded_corr(F.col("x"), F.col("y")))
        .collect()
    }
    assert got["up"] == pytest.approx(np.corrcoef([1, 2, 3], [2, 4, 7])[0, 1])
    assert got["flat"] is None and got["one"] is None and got["holes"] is None


def test_exact_quantiles_match_linear_interpolation(spark):
    rng = np.random.default_rng(7)
    a = np.concatenate([rng.normal(size=200), [-5.0, 0.0, 0.0, 1e9]])
    b = np.concatenate([np.full(150, 2.0), rng.gamma(2.0, size=54)])
    frame = spark.createDataFrame(list(zip(a.tolist(), b.tolist())), "a double, b double")
    probabilities = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    got = {
        (r["column"], r["probability"]): r["quantile"]
        for r in exact_quantiles(frame, ["a", "b"], probabilities).collect()
    }
    for name, values in (("a", a), ("b", b)):
        for p in probabilities:
            assert got[name, p] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-12)


def test_null_keys_match_each_other(spark):
    left = spark.createDataFrame([("a", 1), (None, 2), ("b", 3)], "k string, v int")
    right = spark.createDataFrame([("a", 10), (None, 20)], "k string, w int")
    expected = {(1, 10), (2, 20), (3, None)}
    assert {(r["v"], r["w"]) for r in join_null_safe(left, right, ["k"]).collect()} == expected
    assert {(r["v"], r["w"]) for r in salted_lookup(left, right, ["k"]).collect()} == expected
    salted = salted_lookup(left, right, ["k"], rows_per_salt=1, small_input=0)
    assert {(r["v"], r["w"]) for r in salted.collect()} == expected


@pytest.fixture
def two_hundred_tasks(spark):
    names = ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    before = {n: spark.conf.get(n) for n in names}
    for n, v in zip(names, ("200", "-1", "false")):
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def test_a_hot_key_is_spread_evenly_and_others_are_not_copied(spark, two_hundred_tasks):
    """One key holds 40 % of the rows, null another 20 %; the join's partitions stay close to even."""
    key = F.when(F.col("id") % 5 < 2, "hot").when(F.col("id") % 5 == 2, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id") % 997))
    fact = spark.range(0, 100_000, 1, 8).select(key.alias("k"), "id")
    lookup = fact.groupBy("k").agg(F.count("*").alias("n"))
    joined = salted_lookup(fact, lookup, ["k"], "inner", rows_per_salt=100, small_input=0)
    sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 100_000 and max(sizes) < 0.02 * sum(sizes) and len(sizes) > 190
    counts = {r["k"]: (r["n"], r["rows"]) for r in joined.groupBy("k").agg(F.max("n").alias("n"), F.count("*").alias("rows")).collect()}
    assert counts["hot"] == (40_000, 40_000) and counts[None] == (20_000, 20_000)
    assert all(n == rows for n, rows in counts.values())
    hot = {r["k"]: r["_salts"] for r in hot_keys(fact, ["k"], 100).collect()}
    assert hot == {"hot": 200, None: 200}
    assert hot_keys(fact, ["k"], 50_000).count() == 0


def test_small_inputs_are_joined_as_they_are(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    assert 0 < stored_bytes(events.groupBy("user_id").count()) < 64 << 20
    plan = salted_lookup(events, events.groupBy("user_id").count(), ["user_id"])._jdf.queryExecution().toString()
    assert "_salt" not in plan


def test_salted_lookup_keeps_identical_rows_of_a_hot_key(spark):
    fact = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.lit(1).alias("v"))
    joined = salted_lookup(fact, fact.groupBy("k").agg(F.sum("v").alias("n")), ["k"], "inner", rows_per_salt=3, small_input=0)
    assert joined.count() == 3000
    assert joined.where("k = 'hot'").agg(F.min("n"), F.max("n"), F.count("*")).first() == (1000, 1000, 1000)


def test_stored_facts_that_look_small_are_not_broadcast(spark, tmp_path):
    """Two stored tables: the facts compress to less than the lookup, which Spark sees before it reads them."""
    spark.range(200_000).select((F.col("id") % 3).alias("k"), F.lit(1).alias("v")).write.parquet(str(tmp_path / "fact"))
    spark.range(2000).select("id", (F.col("id") - 1).alias("k"), F.uuid().alias("w")).write.parquet(str(tmp_path / "lookup"))
    fact, lookup = (spark.read.parquet(str(tmp_path / n)) for n in ("fact", "lookup"))
    lookup = lookup.where("id > 0").unionByName(lookup.where("id = 2")).drop("id")  # k = 1 twice, k = 2000 and beyond not
    for small_input in (64 << 20, 0):
        joined = salted_lookup(fact, lookup, ["k"], "inner", small_input=small_input, rows_per_salt=50_000)
        counts = {r["k"]: r["count"] for r in joined.groupBy("k").count().collect()}
        assert counts == {0: 66_667, 1: 2 * 66_667, 2: 66_666}
        assert "BuildLeft" not in joined._jdf.queryExecution().executedPlan().toString()


def test_calendar_has_24_hours_on_clock_change_days(spark):
    days = period_days(spark, "2026-03-29", "2026-03-29").select("date", F.explode(F.sequence(F.lit(1), F.lit(24))).alias("hour_1_24"))
    got = with_calendar(days, (7, 18)).orderBy("hour_1_24").collect()
    assert len({r["interval_start"] for r in got}) == 24
    assert got[0]["weekday_number"] == 6 and got[0]["is_weekend"]
    assert [r["hour_1_24"] for r in got if r["is_peak_07_18"]] == list(range(7, 19))
    assert str(got[2]["interval_start"]) == "2026-03-29 02:00:00"
    assert str(got[23]["interval_end"]) == "2026-03-30 00:00:00"


def test_month_start_is_zone_free(spark):
    row = spark.sql("SELECT timestamp_ntz'2026-03-29 02:30:00' AS t").select(month_start(F.col("t"))).first()
    assert str(row[0]) == "2026-03-01 00:00:00"
    assert str(spark.sql("SELECT date'2026-01-02' AS d, 5 AS h").select(hour_start(F.col("d"), F.col("h"))).first()[0]) == "2026-01-02 04:00:00"


def test_settings_defaults_and_json():
    s = Settings()
    assert (s.start_date, s.peak_hours, s.expected_hours) == ("2025-06-01", (7, 18), 395 * 24)
    sections = '"analysis": {"start_date": "2026-01-01", "end_date": "2026-01-02", "peak_hours": [8, 20]}'
    rest = ", ".join(f'"{n}": {{}}' for n in ("profile_metrics", "external_factors", "quality", "outliers", "clustering", "inputs"))
    loaded = Settings.from_json("{" + sections + ", " + rest + "}")
    assert (loaded.expected_hours, loaded.peak_hours, loaded.zero_run_hours) == (48, (8, 20), 48)
    with pytest.raises(ValueError):
        Settings.from_json("{}")


@pytest.mark.parametrize(
    "bad",
    [
        {"start_date": "2027-01-01"},
        {"peak_hours": (9, 5)},
        {"unusable_missing_share": 1.5},
        {"zero_run_hours": 0},
        {"k_min": 1},
        {"k_min": 5, "k_max": 4},
    ],
)
def test_settings_reject(bad):
    with pytest.raises(ValueError):
        Settings(**bad)
