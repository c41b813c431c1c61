"""Lineage: what a run read and wrote, counted and fingerprinted while it was written.

Each output carries an ``Observation``, so counts and fingerprints come with the write
itself and cost no further job. Records are JSON files, one per run, that Spark reads back as a
table; every query over runs is a DataFrame query.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.fingerprints import combine, schema_fingerprint, table_fingerprint_columns
from ..operators.joins import newest
from ..operators.models import now

STEP = "name string, direction string, format string, location string, row_count long, schema_hash string, data_hash string"
RECORD = (
    "run_id string, task_path string, usecase string, package string, task_name string, profile string, model string, version string, "
    "config_hash string, started_at string, ended_at string, duration_sec double, status string, error string, "
    f"inputs array<struct<{STEP.replace(' ', ': ').replace(',:', ',')}>>, outputs array<struct<{STEP.replace(' ', ': ').replace(',:', ',')}>>"
)


@dataclass
class StepRecord:
    name: str
    direction: str
    format: str
    location: str | None = None
    row_count: int | None = None
    schema_hash: str | None = None
    data_hash: str | None = None


@dataclass
class RunRecord:
    run_id: str
    task_path: str
    usecase: str = ""
    package: str = ""
    task_name: str = ""
    profile: str | None = None
    model: str = "etl"
    version: str = "0.0.0-dev"
    config_hash: str = ""
    started_at: str = field(default_factory=now)
    ended_at: str | None = None
    duration_sec: float | None = None
    status: str = "running"
    error: str | None = None
    inputs: list[StepRecord] = field(default_factory=list)
    outputs: list[StepRecord] = field(default_factory=list)


def location_of(cfg: Mapping[str, Any]) -> str | None:
    for key in ("path", "table", "dbtable", "url"):
        if cfg.get(key):
            return str(cfg[key])
    parts = [cfg.get(k) for k in ("catalog", "schema", "db_name", "tbl_name") if cfg.get(k)]
    return ".".join(map(str, parts)) or ("sql" if cfg.get("sql") else None)


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """``df`` with its count and order-free row sum observed by whatever job runs it."""
    watch = Observation(f"lineage_{name}")
    return df.observe(watch, *table_fingerprint_columns(df)), watch


def settled(step: StepRecord, df: DataFrame, watch: Observation) -> StepRecord:
    """The step with what the write observed. Only after the write has run."""
    seen = watch.get
    step.row_count, step.schema_hash = int(seen["row_count"]), schema_fingerprint(df)
    step.data_hash = combine(step.schema_hash, step.row_count, int(seen["row_sum"]))
    return step


class LineageStore:
    """Runs under a folder of any Hadoop file system, as ``<task path>/<run id>.json``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, text: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(text)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def save(self, record: RunRecord) -> None:
        """Write beside and rename, so a reader sees whole records only."""
        target, fs = self._path(f"{self.folder}/{record.task_path}/{record.run_id}.json")
        draft, _ = self._path(f"{self.folder}/{record.task_path}/.{record.run_id}.tmp")
        out = fs.create(draft, True)
        try:
            out.write(bytearray(json.dumps(asdict(record)).encode()))
        finally:
            out.close()
        fs.delete(target, False)
        fs.rename(draft, target)

    def runs(self) -> DataFrame:
        root, fs = self._path(self.folder)
        if not fs.exists(root):
            return self.spark.createDataFrame([], RECORD)
        return self.spark.read.schema(RECORD).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(self.folder)

    def latest(self, task_path: str | None = None, n: int = 10) -> DataFrame:
        runs = self.runs() if task_path is None else self.runs().filter(F.col("task_path") == task_path)
        return newest(runs, ["task_path"], ["started_at", "run_id"], n)

    def find(self, run_id: str) -> DataFrame:
        return self.runs().filter(F.col("run_id") == run_id)

    def search(self, status: str | None = None, since: str | None = None, usecase: str | None = None, package: str | None = None, task: str | None = None) -> DataFrame:
        """Each condition by itself; times compare as ISO texts."""
        runs = self.runs()
        for column, value in (("status", status), ("usecase", usecase), ("package", package), ("task_name", task)):
            if value is not None:
                runs = runs.filter(F.col(column) == value)
        return runs.filter(F.col("started_at") >= since) if since else runs

    def compare(self, a: str, b: str) -> DataFrame:
        """Outputs of two runs by name: counts, their difference and whether the data match."""
        side = lambda run, s: self.find(run).select(F.inline("outputs")).select("name", F.col("row_count").alias(f"rows_{s}"), F.col("data_hash").alias(f"hash_{s}"), F.col("schema_hash").alias(f"schema_{s}"))
        both = side(a, "a").join(side(b, "b"), "name", "full_outer")
        return both.select("name", "rows_a", "rows_b", (F.col("rows_b") - F.col("rows_a")).alias("delta"), (F.col("schema_a") == F.col("schema_b")).alias("same_schema"), (F.col("hash_a") == F.col("hash_b")).alias("same_data"))

    def trace(self, run_id: str) -> DataFrame:
        """The steps of a run with, for each input, the runs that wrote its location before."""
        steps = self.find(run_id).select("started_at", F.explode(F.concat("inputs", "outputs")).alias("s")).select("started_at", "s.*")
        wrote = self.runs().select(F.col("run_id").alias("writer_run"), F.col("ended_at").alias("_at"), F.explode("outputs").alias("o")).select("writer_run", "_at", F.col("o.location").alias("location"))
        return steps.join(wrote, (steps["location"] == wrote["location"]) & (steps["direction"] == "input") & (wrote["_at"] <= steps["started_at"]), "left").select(steps["name"], "direction", "format", steps["location"], "row_count", "writer_run")
