"""The full analysis: six steps on stored tables, audits, then publication."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from meterlens.operators import audits, clusters, external, ingest, outliers, profiles, quality, similarity, summaries
from meterlens.settings import Settings
from meterlens.sinks.store import RunLog, RunStore
from meterlens.sources.holidays import read_holiday_events
from meterlens.sources.sheets import (
    melt_rows,
    parse_headers,
    placed_rows,
    read_raw_sheet,
    row_times,
    stack_sheets,
)
from meterlens.sources.tables import source_manifest
from meterlens.sources.weather import (
    daily_observations,
    document_metadata,
    hourly_observations,
    read_weather_documents,
)

# Tables without which a run is not published.
REQUIRED_TABLES = (
    "meter_quality",
    "hourly_long",
    "company_profile_metrics",
    "company_hourly_outliers",
    "hourly_enriched",
    "company_clusters",
)
# The sheets of each report; all of them are required as well.
REPORTS = {
    "quality": ("quality_summary", "sheet_checks", "meter_quality", "zero_runs", "value_anomalies", "timeline_issues"),
    "long_table": ("long_table_summary", "long_table_by_sheet"),
    "profiles": ("profiles_summary", "meter_metrics", "company_metrics", "meter_heterogeneity"),
    "outliers": (
        "outliers_summary",
        "meter_outlier_summary",
        "company_outlier_summary",
        "meter_hourly_detail",
        "company_hourly_detail",
        "metric_outliers",
    ),
    "weather": ("weather_summary", "weather_daily", "holidays_in_period", "weather_source"),
    "weather_and_holidays": (
        "enrichment_summary",
        "weather_and_holidays_summary",
        "company_weather",
        "meter_weather",
        "holiday_summary",
        "holiday_detail",
        "company_outliers_enriched",
    ),
    "company_groups": (
        "company_groups_summary",
        "company_clusters",
        "cluster_centers",
        "cluster_evaluation",
        "scaler_sensitivity",
        "feature_scaling",
        "excluded_companies",
    ),
}
REQUIRED_REPORTS = tuple(sheet for sheets in REPORTS.values() for sheet in sheets)


class AuditFailure(RuntimeError):
    """A data-quality assertion does not hold."""


@dataclass(frozen=True)
class Inputs:
    """Sources of a run. ``source_path`` names the raw files to fingerprint, if any."""

    wide: DataFrame
    header: DataFrame
    weather_documents: DataFrame
    holiday_events: DataFrame
    source_path: str | None = None

    @classmethod
    def from_files(
        cls, spark: SparkSession, sheets: Mapping[str, str], weather_path: str, holiday_path: str, source_path: str
    ) -> Inputs:
        """Read exported sheets (name -> CSV path, header rows included), weather JSON and holiday CSV."""
        read = [read_raw_sheet(spark, path, name) for name, path in sheets.items()]
        header = read[0][1]
        for _, other in read[1:]:
            header = header.unionByName(other)
        return cls(
            wide=stack_sheets([data for data, _ in read]),
            header=header,
            weather_documents=read_weather_documents(spark, weather_path),
            holiday_events=read_holiday_events(spark, holiday_path),
            source_path=source_path,
        )


def _as_mapping(metrics: DataFrame) -> dict[str, str]:
    """A (metric, value) summary of a fixed number of rows as a dict."""
    return {row["metric"]: row["value"] for row in metrics.collect()}


class Analysis:
    """One run. Every step reads stored tables of earlier steps and stores its own."""

    def __init__(self, spark: SparkSession, inputs: Inputs, settings: Settings, root: str) -> None:
        self.spark = spark
        self.inputs = inputs
        self.settings = settings
        self.store = RunStore(spark, root)
        self.log = RunLog(self.store)
        self._audits: list[DataFrame] = []

    def run(self) -> str:
        """Execute all steps and publish; returns the run id. On failure nothing is published."""
        try:
            for name, action in (
                ("quality", self.quality_step),
                ("long_table", self.long_step),
                ("profiles", self.profile_step),
                ("outliers", self.outlier_step),
                ("weather_and_holidays", self.external_step),
                ("company_groups", self.cluster_step),
                ("audits", self.audit_step),
            ):
                self.log.step(name, action)
        except Exception as error:
            self.log.finish(error)
            raise
        self.log.finish()
        return self.store.run_id

    def _summarise(self, metrics: DataFrame, name: str) -> Mapping[str, Any]:
        found = _as_mapping(metrics)
        rows = self.spark.createDataFrame(list(found.items()), "metric string, value string")
        self.store.write_report(rows.coalesce(1), f"{name}_summary")
        return found

    def _report(self, **sheets: DataFrame) -> None:
        """Stored tables as sheets of a report."""
        for name, table in sheets.items():
            self.store.write_report(table, name)

    def quality_step(self) -> Mapping[str, Any]:
        s, store = self.settings, self.store
        if self.inputs.source_path is not None:
            store.write(source_manifest(self.spark, self.inputs.source_path), "source_manifest")
        # Placed rows and typed cells are stored first: every later pass scans them column by column.
        placed = store.write(placed_rows(self.inputs.wide), "sheet_rows")
        self.rows = row_times(placed)
        self.series = store.write(parse_headers(self.inputs.header, s.prosumer_sheet_match), "series")
        self.cells = store.write(
            quality.typed_cells(melt_rows(placed, self.inputs.header, s.prosumer_sheet_match)),
            "sheet_cells",
        )
        self.quality = store.write(quality.series_quality(self.cells, s), "meter_quality")
        checks = store.write(quality.sheet_checks(self.rows, self.series, s), "sheet_checks")
        timeline = store.write(quality.timeline_issues(self.rows, s), "timeline_issues")
        anomalies = store.write(
            quality.value_anomalies(self.cells, self.quality, s.extreme_multiple), "value_anomalies"
        )
        zeros = store.write(quality.zero_runs(self.cells, self.rows, s.zero_run_hours), "zero_runs")
        self._report(
            sheet_checks=checks,
            meter_quality=self.quality,
            zero_runs=zeros,
            value_anomalies=anomalies,
            timeline_issues=timeline,
        )
        self._audits += audits.header_audits(self.series, s.prosumer_sheet_match)
        self._audits.append(audits.lookup_audit(self.cells, self.quality, quality.SERIES))
        return self._summarise(summaries.quality_summary(self.quality, checks, timeline, anomalies), "quality")

    def long_step(self) -> Mapping[str, Any]:
        long = ingest.hourly_long(self.cells, self.quality, self.settings)
        self.long = self.store.write(
            long,
            "hourly_long",
            partition_by=["source_sheet"],
            sort_by=["company_id", "meter_id", "energy_flow", "interval_start"],
        )
        validation = self.store.write(ingest.long_validation(self.long), "long_validation")
        self._report(long_table_by_sheet=validation.where("sheet IS NOT NULL"))
        self._audits += audits.long_audits(self.rows, self.series, self.quality, self.long)
        self._audits.append(audits.written_rows_audit(self.cells, self.long, "written_rows_equal_produced"))
        return self._summarise(summaries.long_summary(validation), "long_table")

    def profile_step(self) -> Mapping[str, Any]:
        s, store = self.settings, self.store
        self.company_hours = store.write(profiles.company_hourly(self.long), "company_hourly")
        self.meter_metrics = store.write(profiles.meter_profile_metrics(self.long, s), "meter_profile_metrics")
        self.company_metrics = store.write(
            profiles.company_profile_metrics(self.company_hours, self.meter_metrics, s), "company_profile_metrics"
        )
        store.write(profiles.meter_monthly(self.long, s).drop("source_sheet"), "meter_monthly_profiles")
        monthly = store.write(
            profiles.monthly_profiles(self.company_hours, profiles.COMPANY, s), "company_monthly_profiles"
        )
        meter_hours = store.write(profiles.hourly_profiles(self.long, profiles.METER), "meter_hourly_profiles")
        store.write(profiles.hourly_profiles(self.company_hours, profiles.COMPANY), "company_hourly_profiles")
        heterogeneity = store.write(
            similarity.meter_heterogeneity(self.meter_metrics, meter_hours, s), "company_meter_heterogeneity"
        )
        self._report(meter_metrics=self.meter_metrics, company_metrics=self.company_metrics, meter_heterogeneity=heterogeneity)
        self._audits.append(
            audits.key_unique_audit(self.meter_metrics, profiles.METER, "meter_metrics_key_unique")
        )
        self._audits.append(
            audits.key_unique_audit(self.company_metrics, profiles.COMPANY, "company_metrics_key_unique")
        )
        return self._summarise(
            summaries.profile_summary(self.meter_metrics, self.company_metrics, monthly, heterogeneity), "profiles"
        )

    def outlier_step(self) -> Mapping[str, Any]:
        s, store = self.settings, self.store
        meter_keys = [*profiles.METER, "source_sheet"]
        meters = outliers.zscore_outliers(
            self.long.select(
                *meter_keys,
                "interval_start",
                "date",
                "hour_1_24",
                "energy_kwh",
                "quality_status",
                "active_period_quality_status",
            ),
            self.meter_metrics,
            meter_keys,
            s.hourly_zscore,
            s.extreme_multiple,
        )
        self.meter_outliers = store.write(meters, "meter_hourly_outliers")
        companies = outliers.zscore_outliers(
            self.company_hours.drop("is_weekend", "is_peak_07_18"),
            self.company_metrics,
            profiles.COMPANY,
            s.hourly_zscore,
            s.extreme_multiple,
        )
        self.company_outliers = store.write(companies, "company_hourly_outliers")
        peers = store.write(
            outliers.peer_metric_outliers(self.company_metrics, s.peer_zscore), "company_metric_outliers"
        )
        of_meters = store.write(outliers.outlier_summary(self.meter_outliers, profiles.METER), "meter_outlier_summary")
        of_companies = store.write(
            outliers.outlier_summary(self.company_outliers, profiles.COMPANY), "company_outlier_summary"
        )
        self._report(meter_outlier_summary=of_meters, company_outlier_summary=of_companies, metric_outliers=peers)
        for table, keys, name in (
            (self.meter_outliers, profiles.METER, "meter_hourly_detail"),
            (self.company_outliers, profiles.COMPANY, "company_hourly_detail"),
        ):
            store.write_report(outliers.most_extreme_first(table, [*keys, "interval_start"]), name)
        return self._summarise(
            summaries.outlier_run_summary(self.meter_outliers, self.company_outliers, peers), "outliers"
        )

    def external_step(self) -> Mapping[str, Any]:
        s, store, documents = self.settings, self.store, self.inputs.weather_documents
        daily = store.write(
            external.with_degree_days(daily_observations(documents), s), "weather_daily"
        )
        weather = store.write(
            external.weather_hourly(hourly_observations(documents), daily.drop("hdd_18", "cdd_18"), s), "weather_hourly"
        )
        calendar = store.write(
            external.holiday_calendar(self.spark, self.inputs.holiday_events, s), "holiday_calendar"
        )
        store.write_json(document_metadata(documents), "weather_source")
        self._report(weather_daily=daily, holidays_in_period=calendar.where("is_holiday_or_day_off"))
        self._audits += audits.weather_audits(weather, s)
        enriched = store.write(
            external.enrich_hourly(self.long, weather, calendar),
            "hourly_enriched",
            partition_by=["source_sheet"],
            sort_by=["company_id", "meter_id", "energy_flow", "interval_start"],
        )
        self._audits += audits.enrichment_audits(self.long, enriched, calendar)
        meter_days = store.write(external.meter_daily(enriched), "meter_daily")
        company_days = store.write(external.company_daily(meter_days), "company_daily")
        meter_sense = store.write(
            external.weather_sensitivity(meter_days, ["company_id", "meter_id"], s), "meter_weather_sensitivity"
        )
        company_sense = store.write(
            external.weather_sensitivity(company_days, ["company_id"], s), "company_weather_sensitivity"
        )
        effects = store.write(external.holiday_effects(company_days), "company_holiday_effect_detail")
        holidays = store.write(external.holiday_summary(effects, s), "company_holiday_effect_summary")
        context = store.write(
            external.outlier_context(self.company_outliers, weather, calendar, s),
            "company_hourly_outliers_enriched",
        )
        self._report(
            company_weather=company_sense,
            meter_weather=meter_sense,
            holiday_summary=holidays,
            holiday_detail=effects,
            company_outliers_enriched=context,
        )
        found = dict(self._summarise(summaries.weather_summary(weather, daily, calendar, s), "weather"))
        found |= self._summarise(
            summaries.metric_table(summaries.enrichment_summary(enriched)), "enrichment"
        )
        found |= self._summarise(
            summaries.external_summary(
                meter_days, company_days, meter_sense, company_sense, effects, holidays, context, s
            ),
            "weather_and_holidays",
        )
        return found

    def cluster_step(self) -> Mapping[str, Any]:
        groups = clusters.company_clusters(self.spark, self.company_metrics, self.settings)
        sheets = {
            "company_clusters": (groups.assignments, "company_clusters"),
            "cluster_centers": (groups.centers, "cluster_centers"),
            "cluster_evaluation": (groups.evaluation, "cluster_evaluation"),
            "cluster_scaler_sensitivity": (groups.scaler_sensitivity, "scaler_sensitivity"),
            "cluster_feature_stats": (groups.feature_stats, "feature_scaling"),
            "cluster_excluded_companies": (groups.excluded, "excluded_companies"),
        }
        for name, (table, sheet) in sheets.items():
            self._report(**{sheet: self.store.write(table, name)})
        return self._summarise(summaries.metric_table(groups.summary), "company_groups")

    def audit_step(self) -> Mapping[str, Any]:
        names = lambda values: self.spark.createDataFrame([(v,) for v in values], "name string")
        required = [
            audits.required_audit(names(REQUIRED_TABLES), names(self.store.tables)),
            audits.required_audit(names(REQUIRED_REPORTS), names(self.store.reports), "required_reports_present"),
        ]
        results = self.store.write(audits.combine([*self._audits, *required]), "audits")
        failed = audits.failures(results)
        if failed:
            raise AuditFailure(f"audits failed: {failed}")
        return {"audits": results.count()}


def run_all(spark: SparkSession, inputs: Inputs, settings: Settings, root: str) -> str:
    """Run the whole analysis below ``root`` and publish it; returns the run id."""
    return Analysis(spark, inputs, settings, root).run()
