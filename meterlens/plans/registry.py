"""Queries over the benchmark tables, one or more per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlens.functions.calendar import with_calendar
from meterlens.functions.cells import trailing_number
from meterlens.operators import (
    audits,
    certificates,
    clusters,
    dashboard,
    external,
    ingest,
    outliers,
    profiles,
    quality,
    similarity,
    summaries,
)
from meterlens.plans import fixtures as fx
from meterlens.plans.analysis import Inputs, run_all
from meterlens.schemas import HOLIDAY_EVENTS
from meterlens.settings import CLUSTER_FEATURES, PEER_METRICS
from meterlens.sinks.store import RunStore, current_table, new_folder, run_history, step_history
from meterlens.sources import weather as weather_source
from meterlens.sources.holidays import read_holiday_events
from meterlens.sources.sheets import (
    melt_rows,
    melt_sheets,
    parse_headers,
    placed_rows,
    read_raw_sheets,
    row_times,
    time_rows,
    write_raw_sheets,
)
from meterlens.sources.tables import source_manifest

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    _QUERIES[function.__name__] = function
    return function


def comparable(df: DataFrame) -> DataFrame:
    """Types that two engines print alike: 6-digit doubles, bigint counts, dates and times as text."""

    def plain(field: T.StructField):
        column = F.col(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            column = F.round(column, 6)
        elif isinstance(field.dataType, T.IntegralType):
            column = column.cast("bigint")
        elif isinstance(field.dataType, (T.DateType, T.TimestampNTZType, T.TimestampType)):
            column = column.cast("string")
        return column.alias(field.name)

    return df.select(*[plain(field) for field in df.schema])


def all_queries() -> dict[str, Query]:
    def wrapped(function: Query) -> Query:
        return lambda spark, sf_dir: comparable(function(spark, sf_dir))

    return {name: wrapped(function) for name, function in _QUERIES.items()}


# --- shared intermediate tables -------------------------------------------------------------


def _cells(spark, d):
    return melt_sheets(fx.wide_sheets(spark, d), fx.series_header(spark, d), "prosumer")


def _kept(df):
    """A table that several passes read: written to the shared folder and read back, as a run does with its tables.

    Later passes read the columns that they need, hold nothing on the executors, and don't reach behind it when one is lost.
    """
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _typed_cells(spark, d):
    return _kept(quality.typed_cells(_cells(spark, d)))


def _rows(spark, d):
    return time_rows(fx.wide_sheets(spark, d)).drop("s1", "s2", "s3")


def _series(spark, d):
    return parse_headers(fx.series_header(spark, d), "prosumer")


def _quality(spark, d):
    return quality.series_quality(_typed_cells(spark, d), fx.SHIFTED)


def _company_hours(spark, d):
    return profiles.company_hourly(fx.hourly_readings(spark, d))


def _yearly_company_metrics(spark, d):
    readings = fx.daily_readings(spark, d)
    meters = profiles.basic_metrics(readings, profiles.METER)
    return profiles.company_profile_metrics(profiles.company_hourly(readings), meters, fx.YEARLY)


def _calendar(spark):
    return external.holiday_calendar(spark, fx.holiday_events(spark), fx.HOURLY)


def _weather(spark):
    w = fx.weather(spark)
    return external.weather_hourly(w.hourly, w.daily, fx.HOURLY)


def _enriched(spark, d):
    return external.enrich_hourly(fx.hourly_readings(spark, d).drop("n", "m"), _weather(spark), _calendar(spark))


def _meter_daily(spark, d):
    return external.meter_daily(_enriched(spark, d))


def _company_daily(spark, d):
    return external.company_daily(_meter_daily(spark, d))


def _meter_outliers(spark, d):
    hourly = fx.hourly_readings(spark, d)
    keys = [*profiles.METER, "source_sheet"]
    readings = hourly.select(
        *keys, "interval_start", "date", "hour_1_24", "energy_kwh", "quality_status", "active_period_quality_status"
    )
    return outliers.zscore_outliers(
        readings,
        profiles.basic_metrics(hourly, keys),
        keys,
        fx.HOURLY.hourly_zscore,
        fx.HOURLY.extreme_multiple,
    )


def _company_outliers(spark, d):
    hours = _company_hours(spark, d)
    return outliers.zscore_outliers(
        hours.drop("is_weekend", "is_peak_07_18"),
        profiles.basic_metrics(hours, profiles.COMPANY),
        profiles.COMPANY,
        fx.HOURLY.hourly_zscore,
        fx.HOURLY.extreme_multiple,
    )


def _outlier_context(spark, d):
    return external.outlier_context(_company_outliers(spark, d), _weather(spark), _calendar(spark), fx.HOURLY)


def _heterogeneity(hourly):
    return similarity.meter_heterogeneity(
        profiles.basic_metrics(hourly, profiles.METER),
        profiles.hourly_profiles(hourly, profiles.METER),
        fx.HOURLY,
    )


def _documents(spark, d):
    return weather_source.documents_from_text(fx.weather_documents(spark, d), "document")


def _region_centers(spark, d):
    """Mean features of the companies (nations) of each region, as cluster centers."""
    nation = fx.table(spark, d, "nation").select(
        F.concat(F.lit("Company "), (F.col("n_nationkey") + 1).cast("string")).alias("company_id"),
        F.col("n_regionkey").alias("region"),
    )
    metrics = clusters.eligible_companies(_yearly_company_metrics(spark, d), CLUSTER_FEATURES)
    labelled = metrics.join(nation, "company_id")
    return labelled, labelled.groupBy("region").agg(*[F.avg(f).alias(f) for f in CLUSTER_FEATURES])


# --- ingest and quality ----------------------------------------------------------------------


@query
def header_parse(spark, d):
    return _series(spark, d)


@query
def calendar_columns(spark, d):
    orders = fx.table(spark, d, "orders").select(
        "o_orderkey",
        F.to_date("o_orderdate").alias("date"),
        (F.col("o_orderkey") % 24 + 1).cast("int").alias("hour_1_24"),
    )
    return with_calendar(orders, fx.HOURLY.peak_hours)


@query
def wide_to_long(spark, d):
    cells = quality.typed_cells(_cells(spark, d))
    return cells.select(*quality.SERIES, "row_position", "date", "hour", "tariff", "raw_value", "value", "kind")


@query
def series_quality(spark, d):
    return _quality(spark, d)


@query
def sheet_checks(spark, d):
    return quality.sheet_checks(_rows(spark, d), _series(spark, d), fx.SHIFTED)


@query
def zero_runs(spark, d):
    placed = _kept(placed_rows(fx.wide_sheets(spark, d)))
    cells = melt_rows(placed, fx.series_header(spark, d), "prosumer")
    return quality.zero_runs(cells, row_times(placed), fx.SHIFTED.zero_run_hours)


@query
def value_anomalies(spark, d):
    cells = _typed_cells(spark, d)
    statistics = quality.series_statistics(cells, fx.SHIFTED.expected_hours)
    return quality.value_anomalies(cells, statistics, fx.SHIFTED.extreme_multiple)


@query
def timeline_issues(spark, d):
    return quality.timeline_issues(_rows(spark, d), fx.SHIFTED)


@query
def quality_summary(spark, d):
    cells = _typed_cells(spark, d)
    found = _kept(quality.series_quality(cells, fx.SHIFTED))
    rows = _rows(spark, d)
    return _numeric(
        summaries.quality_summary(
            found,
            quality.sheet_checks(rows, _series(spark, d), fx.SHIFTED),
            quality.timeline_issues(rows, fx.SHIFTED),
            quality.value_anomalies(cells, found, fx.SHIFTED.extreme_multiple),
        )
    )


def _numeric(metrics: DataFrame) -> DataFrame:
    return metrics.select("metric", F.col("value").try_cast("double").alias("value"))


def _long(spark, d):
    cells = _typed_cells(spark, d)
    return ingest.hourly_long(cells, quality.series_quality(cells, fx.SHIFTED), fx.SHIFTED)


@query
def active_span_flag(spark, d):
    return _long(spark, d)


@query
def long_validation(spark, d):
    return ingest.long_validation(_long(spark, d))


@query
def long_summary(spark, d):
    return _numeric(summaries.long_summary(ingest.long_validation(_long(spark, d))))


@query
def run_audits(spark, d):
    cells = _typed_cells(spark, d)
    found = _kept(quality.series_quality(cells, fx.SHIFTED))
    series, rows = _kept(_series(spark, d)), _kept(_rows(spark, d))
    long = _kept(ingest.hourly_long(cells, found, fx.SHIFTED))
    calendar, weather = _kept(_calendar(spark)), _kept(_weather(spark))
    enriched = external.enrich_hourly(long, weather, calendar)
    names = lambda values: spark.createDataFrame([(v,) for v in values], "name string")
    return audits.combine(
        [
            *audits.header_audits(series, "prosumer"),
            *audits.long_audits(rows, series, found, long),
            audits.lookup_audit(cells, found, quality.SERIES),
            audits.written_rows_audit(cells, long, "written_rows_equal_produced"),
            *audits.weather_audits(weather, fx.HOURLY),
            *audits.enrichment_audits(long, enriched, calendar),
            audits.required_audit(names(["meter_quality", "hourly_long", "extra"]), names(["meter_quality", "hourly_long"])),
        ]
    )


# --- profiles --------------------------------------------------------------------------------


@query
def basic_metrics_company(spark, d):
    return profiles.basic_metrics(_company_hours(spark, d), profiles.COMPANY)


@query
def basic_metrics_meter(spark, d):
    return profiles.basic_metrics(fx.hourly_readings(spark, d), profiles.METER)


@query
def company_hourly(spark, d):
    return _company_hours(spark, d)


@query
def monthly_profiles(spark, d):
    return profiles.monthly_profiles(fx.daily_readings(spark, d), profiles.METER, fx.YEARLY)


@query
def company_monthly_profiles(spark, d):
    hours = profiles.company_hourly(fx.daily_readings(spark, d))
    return profiles.monthly_profiles(hours, profiles.COMPANY, fx.YEARLY)


@query
def seasonality_trend(spark, d):
    hours = profiles.company_hourly(fx.daily_readings(spark, d))
    return profiles.seasonality_and_trend(
        profiles.monthly_profiles(hours, profiles.COMPANY, fx.YEARLY), profiles.COMPANY, fx.YEARLY
    )


@query
def meter_profile_metrics(spark, d):
    return profiles.meter_profile_metrics(fx.hourly_readings(spark, d), fx.HOURLY)


@query
def company_profile_metrics(spark, d):
    return _yearly_company_metrics(spark, d)


@query
def hourly_profiles(spark, d):
    return profiles.hourly_profiles(fx.hourly_readings(spark, d), profiles.METER)


@query
def company_hourly_profiles(spark, d):
    return profiles.hourly_profiles(_company_hours(spark, d), profiles.COMPANY)


@query
def meter_heterogeneity(spark, d):
    return _heterogeneity(fx.hourly_readings(spark, d))


@query
def profile_summary(spark, d):
    hourly = _kept(fx.hourly_readings(spark, d))
    hours = profiles.company_hourly(hourly)
    return _numeric(
        summaries.profile_summary(
            profiles.basic_metrics(hourly, profiles.METER),
            profiles.basic_metrics(hours, profiles.COMPANY),
            profiles.monthly_profiles(hours, profiles.COMPANY, fx.HOURLY),
            _heterogeneity(hourly),
        )
    )


# --- outliers --------------------------------------------------------------------------------


@query
def meter_outliers(spark, d):
    return _meter_outliers(spark, d)


@query
def company_outliers(spark, d):
    return _company_outliers(spark, d)


@query
def outlier_summary(spark, d):
    return outliers.outlier_summary(_meter_outliers(spark, d), profiles.METER)


@query
def company_outlier_summary(spark, d):
    return outliers.outlier_summary(_company_outliers(spark, d), profiles.COMPANY)


@query
def top_outliers(spark, d):
    top = outliers.top_outliers(_meter_outliers(spark, d), 50, ties=["meter_id", "energy_flow", "interval_start"])
    return top.select("meter_id", "energy_flow", "interval_start", "energy_kwh", "z_score")


@query
def peer_metric_outliers(spark, d):
    return outliers.peer_metric_outliers(_yearly_company_metrics(spark, d), fx.YEARLY.peer_zscore, PEER_METRICS)


@query
def outlier_run_summary(spark, d):
    peers = outliers.peer_metric_outliers(_yearly_company_metrics(spark, d), fx.YEARLY.peer_zscore)
    return _numeric(
        summaries.outlier_run_summary(_meter_outliers(spark, d), _company_outliers(spark, d), peers)
    )


# --- weather and holidays --------------------------------------------------------------------


@query
def weather_parse(spark, d):
    return weather_source.hourly_observations(_documents(spark, d))


@query
def weather_metadata(spark, d):
    return weather_source.document_metadata(_documents(spark, d))


@query
def degree_days(spark, d):
    return external.with_degree_days(weather_source.daily_observations(_documents(spark, d)), fx.HOURLY)


@query
def weather_hourly(spark, d):
    documents = _documents(spark, d)
    return external.weather_hourly(
        weather_source.hourly_observations(documents),
        weather_source.daily_observations(documents),
        fx.HOURLY,
        keys=["company_id"],
    )


@query
def holiday_calendar(spark, d):
    return external.holiday_calendar(spark, fx.order_holidays(spark, d), fx.YEARLY)


@query
def enriched_hourly(spark, d):
    return _enriched(spark, d).drop("interval_end", "year", "month")


@query
def daily_energy(spark, d):
    return _meter_daily(spark, d)


@query
def company_daily(spark, d):
    return _company_daily(spark, d)


@query
def weather_sensitivity(spark, d):
    return external.weather_sensitivity(_company_daily(spark, d), ["company_id"], fx.HOURLY)


@query
def meter_weather_sensitivity(spark, d):
    return external.weather_sensitivity(_meter_daily(spark, d), ["company_id", "meter_id"], fx.HOURLY)


@query
def holiday_effects(spark, d):
    return external.holiday_effects(_company_daily(spark, d))


@query
def holiday_summary(spark, d):
    return external.holiday_summary(external.holiday_effects(_company_daily(spark, d)), fx.HOURLY)


@query
def outlier_context(spark, d):
    return _outlier_context(spark, d)


@query
def weather_summary(spark, d):
    """Source summary of the weather of all companies and of the order holidays."""
    documents = _documents(spark, d)
    hourly = weather_source.hourly_observations(documents)
    calendar = external.holiday_calendar(spark, fx.order_holidays(spark, d), fx.YEARLY)
    return _numeric(
        summaries.weather_summary(hourly, weather_source.daily_observations(documents), calendar, fx.HOURLY)
    )


@query
def enrichment_summary(spark, d):
    return _numeric(summaries.metric_table(summaries.enrichment_summary(_enriched(spark, d))))


@query
def external_summary(spark, d):
    meter_days = _kept(_meter_daily(spark, d))
    company_days = external.company_daily(meter_days)
    effects = external.holiday_effects(company_days)
    return _numeric(
        summaries.external_summary(
            meter_days,
            company_days,
            external.weather_sensitivity(meter_days, ["company_id", "meter_id"], fx.HOURLY),
            external.weather_sensitivity(company_days, ["company_id"], fx.HOURLY),
            effects,
            external.holiday_summary(effects, fx.HOURLY),
            _outlier_context(spark, d),
            fx.HOURLY,
        )
    )


# --- dashboard -------------------------------------------------------------------------------


@query
def company_series(spark, d):
    return dashboard.company_series(
        dashboard.for_company(fx.hourly_readings(spark, d), start="2024-01-05", end="2024-01-20")
    )


@query
def weekday_profile(spark, d):
    return dashboard.day_kind_profile(fx.hourly_readings(spark, d))


@query
def prosumer_monthly(spark, d):
    return dashboard.prosumer_monthly(fx.hourly_readings(spark, d))


@query
def status_counts(spark, d):
    return dashboard.status_counts(_quality(spark, d))


@query
def outlier_counts(spark, d):
    return dashboard.outlier_counts(_outlier_context(spark, d))


@query
def holiday_days(spark, d):
    return dashboard.holiday_days(_company_daily(spark, d))


@query
def natural_order(spark, d):
    """Companies and customer names in natural order, with the sort key that orders them."""
    names = fx.table(spark, d, "customer").select(F.col("c_name").alias("company_id")).unionByName(
        _company_hours(spark, d).select("company_id").distinct()
    )
    return dashboard.natural_order(names).withColumn("sort_key", trailing_number(F.col("company_id")))


@query
def company_card(spark, d):
    readings = _kept(fx.hourly_readings(spark, d))
    hours = profiles.company_hourly(readings)
    metrics = profiles.company_profile_metrics(
        hours, profiles.basic_metrics(readings, profiles.METER), fx.HOURLY
    )
    enriched = external.enrich_hourly(readings.drop("n", "m"), _weather(spark), _calendar(spark))
    days = _kept(external.company_daily(external.meter_daily(enriched)))
    return dashboard.company_card(
        metrics,
        _heterogeneity(readings),
        external.weather_sensitivity(days, ["company_id"], fx.HOURLY),
        external.holiday_summary(external.holiday_effects(days), fx.HOURLY),
    )


@query
def company_card_groups(spark, d):
    """Cards with the groups of two companies in three; the others show the default texts."""
    hourly = fx.hourly_readings(spark, d)
    grouped = hourly.where(F.col("n") % 3 > 0).select("company_id", F.col("n") % 3).distinct()
    groups = grouped.toDF("company_id", "k").select(
        "company_id",
        F.concat(F.lit("Cluster "), F.col("k").cast("string")).alias("cluster_id"),
        F.when(F.col("k") == 1, "Even profile").otherwise("Day profile").alias("cluster_description"),
    )
    metrics = profiles.company_profile_metrics(
        _company_hours(spark, d), profiles.basic_metrics(hourly, profiles.METER), fx.HOURLY
    )
    days = _company_daily(spark, d)
    card = dashboard.company_card(
        metrics,
        _heterogeneity(hourly),
        external.weather_sensitivity(days, ["company_id"], fx.HOURLY),
        external.holiday_summary(external.holiday_effects(days), fx.HOURLY),
        groups,
    )
    return card.select("company_id", "energy_total_mwh", "meter_count", "cluster_id", "cluster_description")


@query
def company_lookup(spark, d):
    """One company's readings of a week; both filters reach the readings."""
    week = dashboard.for_company(fx.hourly_readings(spark, d), "Company 2", "2024-01-08", "2024-01-14")
    return week.select("company_id", "meter_id", "energy_flow", "interval_start", "energy_kwh", "quality_status")


@query
def company_list(spark, d):
    return dashboard.company_list(_yearly_company_metrics(spark, d))


@query
def date_bounds(spark, d):
    return dashboard.date_bounds(fx.daily_readings(spark, d))


@query
def meter_flows(spark, d):
    return dashboard.meter_flows(profiles.basic_metrics(fx.hourly_readings(spark, d), profiles.METER))


# --- company groups --------------------------------------------------------------------------


@query
def scaled_features(spark, d):
    """Features under each of the three scalers."""
    eligible = clusters.eligible_companies(_kept_metrics(spark, d), CLUSTER_FEATURES)
    parts = []
    for scaler in clusters.SCALERS:
        scaling = clusters.fit_scaling(eligible, CLUSTER_FEATURES, scaler)
        parts.append(
            eligible.select(
                F.lit(scaler).alias("scaler"),
                "company_id",
                *[scaling.apply(f).alias(f) for f in CLUSTER_FEATURES],
            )
        )
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def feature_statistics(spark, d):
    eligible = clusters.eligible_companies(_yearly_company_metrics(spark, d), CLUSTER_FEATURES)
    scaling = clusters.fit_scaling(eligible, CLUSTER_FEATURES, "minmax")
    return clusters.feature_statistics(eligible, CLUSTER_FEATURES, scaling)


@query
def excluded_companies(spark, d):
    """Companies of the events have no summer month, so all of them are excluded."""
    hourly = fx.hourly_readings(spark, d)
    metrics = profiles.company_profile_metrics(
        _company_hours(spark, d), profiles.basic_metrics(hourly, profiles.METER), fx.HOURLY
    )
    return clusters.excluded_companies(metrics, CLUSTER_FEATURES)


@query
def elbow(spark, d):
    return clusters.elbow_choice(fx.inertia_curve(spark, d))


@query
def center_order(spark, d):
    _, centers = _region_centers(spark, d)
    return clusters.number_centers(centers)


@query
def cluster_description(spark, d):
    labelled, centers = _region_centers(spark, d)
    overall = labelled.agg(*[F.avg(f).alias(f) for f in CLUSTER_FEATURES]).first().asDict()
    return clusters.describe_centers(centers, overall).select("region", "cluster_description")


@query
def silhouette_by_region(spark, d):
    """Exact silhouette of the grouping of companies by region under minmax scaling."""
    labelled, _ = _region_centers(spark, d)
    labelled = _kept(labelled)
    scaling = clusters.fit_scaling(labelled, CLUSTER_FEATURES, "minmax")
    points = clusters.scaled_points(labelled, CLUSTER_FEATURES, scaling).join(
        labelled.select("company_id", F.col("region").alias(clusters.label_column(5))), "company_id"
    )
    score = clusters.silhouette_scores(points, [5], clusters.cluster_sizes(points, [5]))[5]
    return spark.createDataFrame([(5, score)], "k int, silhouette_score double")


@query
def kmeans_groups(spark, d):
    groups = clusters.company_clusters(spark, _kept_metrics(spark, d), fx.YEARLY)
    return groups.assignments.select(
        "company_id", "cluster_number", "cluster_id", "cluster_description", "pca_1", "pca_2"
    )


def _grouping(spark, d):
    """One fit of the company groups with the scaling of its features."""
    metrics = _kept_metrics(spark, d)
    groups = clusters.company_clusters(spark, metrics, fx.YEARLY)
    eligible = clusters.eligible_companies(metrics, CLUSTER_FEATURES)
    return groups, clusters.fit_scaling(eligible, CLUSTER_FEATURES, fx.YEARLY.scaler)


@query
def kmeans_nearest(spark, d):
    """Whether every company's group is the one whose center is nearest."""
    groups, scaling = _grouping(spark, d)
    return certificates.nearest_centers(groups, CLUSTER_FEATURES, scaling)


@query
def kmeans_centers(spark, d):
    """Violations of what the centers of any grouping fulfil."""
    groups, scaling = _grouping(spark, d)
    return certificates.center_checks(groups, CLUSTER_FEATURES, scaling)


@query
def kmeans_choice(spark, d):
    """Violations of what the choice of the number of groups fulfils, with the silhouette of the groups worked out anew."""
    groups, scaling = _grouping(spark, d)
    sizes = {r["cluster_number"]: r["company_count"] for r in groups.centers.collect()}
    return certificates.choice_checks(groups, CLUSTER_FEATURES, scaling, sizes)


@query
def scaler_grid(spark, d):
    """What sizes and scores of every scaler and k fulfil."""
    metrics = clusters.eligible_companies(_kept_metrics(spark, d), CLUSTER_FEATURES)
    n = metrics.count()
    return certificates.grid_checks(clusters.scaler_sensitivity(spark, metrics, clusters.k_values(n, fx.YEARLY), fx.YEARLY), n)


@query
def silhouette_grid(spark, d):
    metrics = clusters.eligible_companies(_kept_metrics(spark, d), CLUSTER_FEATURES)
    ks = clusters.k_values(metrics.count(), fx.YEARLY)
    return clusters.scaler_sensitivity(spark, metrics, ks, fx.YEARLY)


@query
def pca_2d(spark, d):
    metrics = clusters.eligible_companies(_kept_metrics(spark, d), CLUSTER_FEATURES)
    scaling = clusters.fit_scaling(metrics, CLUSTER_FEATURES, "minmax")
    points = clusters.scaled_points(metrics, CLUSTER_FEATURES, scaling)
    return clusters.pca_2d(points).apply(points).drop("features")


def _kept_metrics(spark, d):
    """Company metrics, which iterative fits read many times."""
    return _kept(_yearly_company_metrics(spark, d))


# --- publication -----------------------------------------------------------------------------


def _published(spark, d):
    """The folder of a whole published run over the orders table, one sheet of three meters per nation."""
    root = new_folder(spark)
    run_all(spark, Inputs(**fx.run_inputs(spark, d)), fx.RUN, root)
    return root


@query
def publish_run(spark, d):
    root = _published(spark, d)
    tables = run_history(spark, root).select("status", F.explode("tables").alias("table"))
    return tables.withColumn("companies", F.lit(current_table(spark, root, "company_clusters").count()))


@query
def run_steps(spark, d):
    return step_history(spark, _published(spark, d)).select("step", "name", "status")


@query
def stored_long(spark, d):
    """The long table as a run stores it, partitioned by sheet and sorted, read back."""
    store = RunStore(spark, new_folder(spark))
    return store.write(
        _long(spark, d),
        "hourly_long",
        partition_by=["source_sheet"],
        sort_by=["company_id", "meter_id", "energy_flow", "interval_start"],
    )


@query
def stored_partitions(spark, d):
    """Rows and energy of every stored partition, from the files that its folder holds."""
    files = stored_long(spark, d)
    folder = F.regexp_extract(F.col("_metadata.file_path"), "source_sheet=([^/]+)/", 1)
    return (
        files.select("source_sheet", "energy_kwh", folder.alias("folder"), F.col("_metadata.file_path").alias("file"))
        .groupBy("source_sheet")
        .agg(
            F.count("*").alias("rows"),
            F.sum("energy_kwh").alias("energy_kwh"),
            F.countDistinct("folder").alias("folders"),
            (F.countDistinct("file") >= 1).alias("has_files"),
        )
    )


@query
def stored_summary(spark, d):
    """A metric table written as a report sheet and read back."""
    store = RunStore(spark, new_folder(spark))
    store.write_report(summaries.long_summary(ingest.long_validation(_long(spark, d))), "long_table_summary")
    stored = spark.read.schema("metric string, value string").option("header", True).csv(store.report_path("long_table_summary"))
    return _numeric(stored)


@query
def raw_sheets(spark, d):
    """The wide sheets written as raw files with two header rows, read by the file reader, as long cells."""
    wide, header, folder = fx.wide_sheets(spark, d), fx.series_header(spark, d), f"{new_folder(spark)}/sheets"
    write_raw_sheets(wide, header, folder)
    data, found = read_raw_sheets(spark, folder, 3)
    cells = quality.typed_cells(melt_sheets(data, found, "prosumer"))
    return cells.select(*quality.SERIES, "row_position", "date", "hour", "tariff", "raw_value", "value", "kind")


@query
def holiday_file(spark, d):
    """Holidays written as a CSV of events, read by the file reader, as the calendar of the period."""
    folder = f"{new_folder(spark)}/holidays"
    events = fx.order_holidays(spark, d)
    columns = {
        "holiday_id": F.concat_ws("_", "holiday_date", "holiday_name"),
        "source_year": F.year("holiday_date"),
        "date_may_change": F.lit(False),
    }
    named = events.withColumns(columns).select(*HOLIDAY_EVENTS.fieldNames())
    named.write.option("header", True).csv(folder)
    return external.holiday_calendar(spark, read_holiday_events(spark, folder), fx.YEARLY)


@query
def source_files(spark, d):
    """Fingerprints of the benchmark tables themselves."""
    return source_manifest(spark, f"{d}/*.parquet").select("name", "size_bytes", "sha256")
