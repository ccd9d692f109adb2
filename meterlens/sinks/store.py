"""Tables of one run and the log that decides which run readers see.

Layout below ``root`` (any Hadoop path)::

    tables/<run_id>/<table>      Parquet, written once by its run
    reports/<run_id>/<name>      report tables (CSV) and summaries (JSON)
    run_steps/<run_id>           steps of a run
    commits                      numbered log of run starts and outcomes

A run claims a number when it starts and appends its outcome when it ends. The current run is, of those that succeeded,
the one that started last by these numbers: an older run that ends late never replaces a newer one, and no clock decides.
A failed run only adds a ``failed`` entry, so earlier tables stay current and untouched.
"""

from __future__ import annotations

import datetime as dt
import json
import time
import uuid
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlens.sinks.commits import CommitLog

RUNS_SCHEMA = (
    "run_id string, run_number long, status string, started_at timestamp, completed_at timestamp, "
    "duration_seconds double, tables array<string>, reports array<string>, error_type string, error string"
)
STEPS_SCHEMA = (
    "run_id string, step int, name string, status string, duration_seconds double, summary string, "
    "error_type string, error string"
)


def new_folder(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share: below the checkpoint folder, else below the warehouse."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{shared.rstrip('/')}/meterlens-{uuid.uuid4().hex}"


def _now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc)


class RunStore:
    """Write-once tables of a single run."""

    def __init__(self, spark: SparkSession, root: str, run_id: str | None = None) -> None:
        self.spark = spark
        self.root = root.rstrip("/")
        self.run_id = run_id or f"{_now():%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:8]}"
        self.tables: list[str] = []
        self.reports: list[str] = []

    def path(self, table: str) -> str:
        return f"{self.root}/tables/{self.run_id}/{table}"

    def write(
        self, df: DataFrame, table: str, partition_by: Sequence[str] = (), sort_by: Sequence[str] = ()
    ) -> DataFrame:
        """Store a table and return it read back, which also cuts the lineage.

        Partitioned tables are rebalanced on their partition columns first: small partitions
        share a task and a hot one is split, so neither many tiny files nor one huge task arise.
        """
        if partition_by:
            df = df.hint("rebalance", *[F.col(c) for c in partition_by])
        if sort_by:
            df = df.sortWithinPartitions(*partition_by, *sort_by)
        writer = df.write.mode("error").option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(self.path(table))
        self.tables.append(table)
        return self.read(table, df.schema)

    def read(self, table: str, schema=None) -> DataFrame:
        reader = self.spark.read.schema(schema) if schema is not None else self.spark.read
        return reader.parquet(self.path(table))

    def write_report(self, df: DataFrame, name: str) -> None:
        """One sheet of a report as CSV with header; arrays and structs as JSON."""
        nested = [f.name for f in df.schema if f.dataType.typeName() in ("array", "map", "struct")]
        plain = df.withColumns({c: F.to_json(c) for c in nested}) if nested else df
        plain.write.mode("error").option("header", True).csv(self.report_path(name))
        self.reports.append(name)

    def report_path(self, name: str) -> str:
        return f"{self.root}/reports/{self.run_id}/{name}"

    def write_json(self, df: DataFrame, name: str) -> None:
        df.write.mode("error").json(self.report_path(name))
        self.reports.append(name)


def _commits(spark: SparkSession, root: str) -> CommitLog:
    return CommitLog(spark, f"{root.rstrip('/')}/commits")


class RunLog:
    """Claims the number of a run, times its steps and appends the outcome."""

    def __init__(self, store: RunStore) -> None:
        self.store = store
        self.started_at = _now()
        self._clock = time.perf_counter()
        self._steps: list[tuple] = []
        self._log = _commits(store.spark, store.root)
        self.run_number = self._log.append(
            {"run_id": store.run_id, "status": "started", "started_at": self.started_at.isoformat()}
        )

    def step(self, name: str, action: Callable[[], Mapping[str, Any] | None]) -> Mapping[str, Any]:
        """Run one step; its result becomes the step summary. A failure is recorded and raised."""
        started = time.perf_counter()
        status, summary, error = "success", {}, None
        try:
            summary = dict(action() or {})
            return summary
        except Exception as problem:
            status, error = "failed", problem
            raise
        finally:
            self._steps.append(
                (
                    self.store.run_id,
                    len(self._steps) + 1,
                    name,
                    status,
                    round(time.perf_counter() - started, 3),
                    json.dumps(summary, default=str),
                    type(error).__name__ if error else None,
                    str(error) if error else None,
                )
            )

    def finish(self, error: BaseException | None = None) -> int:
        """Store the step records, then append the entry that publishes (or reports) the run; returns its number."""
        store = self.store
        if self._steps:
            steps = store.spark.createDataFrame(self._steps, STEPS_SCHEMA).coalesce(1)
            steps.write.mode("error").json(f"{store.root}/run_steps/{store.run_id}")
        return self._log.append(
            {
                "run_id": store.run_id,
                "run_number": self.run_number,
                "status": "failed" if error else "success",
                "started_at": self.started_at.isoformat(),
                "completed_at": _now().isoformat(),
                "duration_seconds": round(time.perf_counter() - self._clock, 3),
                "tables": sorted(store.tables),
                "reports": sorted(store.reports),
                "error_type": type(error).__name__ if error else None,
                "error": str(error) if error else None,
            }
        )


def run_history(spark: SparkSession, root: str) -> DataFrame:
    """One row per run that ended, with the numbers of its start and of its end."""
    entries = _commits(spark, root).read(RUNS_SCHEMA)
    if entries is None:
        entries = spark.createDataFrame([], f"number long, {RUNS_SCHEMA}")
    return entries.where("status <> 'started'")


def step_history(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(STEPS_SCHEMA).json(f"{root.rstrip('/')}/run_steps/*")


def current_run(spark: SparkSession, root: str) -> str | None:
    """Id of the successful run that started last, or None."""
    done = run_history(spark, root).where(F.col("status") == "success")
    return done.agg(F.max_by("run_id", "run_number").alias("run_id")).first()["run_id"]


def current_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    run_id = current_run(spark, root)
    if run_id is None:
        raise ValueError(f"no successful run below {root}")
    return RunStore(spark, root, run_id).read(table)
