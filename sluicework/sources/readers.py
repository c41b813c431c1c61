"""Readers: named inputs to DataFrames. Filters and columns reach the scans through Catalyst."""

from __future__ import annotations

import logging
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .rest import read_rest


log = logging.getLogger("sluicework")


def table_name(cfg: Mapping[str, Any]) -> str:
    """``table``, or any of catalog, schema (or db_name) and tbl_name, joined by dots."""
    if cfg.get("table"):
        return str(cfg["table"])
    parts = [cfg.get("catalog"), cfg.get("schema") or cfg.get("db_name"), cfg.get("tbl_name")]
    if not parts[-1]:
        raise ValueError("name a table by table, or by tbl_name with db_name or catalog and schema")
    return ".".join(str(p) for p in parts if p)


def read_path(spark: SparkSession, cfg: Mapping[str, Any]) -> DataFrame:
    if not cfg.get("path"):
        raise ValueError("a path input needs path")
    reader = spark.read.format(cfg.get("file_format") or "parquet").options(**(cfg.get("options") or {}))
    if cfg.get("schema"):
        reader = reader.schema(cfg["schema"])
    try:
        return reader.load(cfg["path"])
    except Exception as e:
        # Spark says so in several ways, by format.
        if any(said in str(e) for said in ("DATA_SOURCE_NOT_FOUND", "Failed to find", "ClassNotFoundException")):
            raise ValueError(f"format {cfg.get('file_format')} needs its package on Spark's class path") from e
        raise


def read_table(spark: SparkSession, cfg: Mapping[str, Any]) -> DataFrame:
    """``sql`` wins over a table name; ``args`` are bound, not pasted in."""
    if cfg.get("sql"):
        return spark.sql(cfg["sql"], args=cfg.get("args"))
    return spark.table(table_name(cfg))


def read_jdbc(spark: SparkSession, cfg: Mapping[str, Any]) -> DataFrame:
    """A table, or a query wrapped as one so that a partitioned read works with it too.
    Bounds only set the stride of the partitions; no row is filtered by them."""
    target = cfg.get("table") or cfg.get("dbtable") or (f"({cfg['sql']}) AS q" if cfg.get("sql") else None)
    if not cfg.get("url") or not target:
        raise ValueError("a jdbc input needs url and one of table and sql")
    options = {"url": cfg["url"], "dbtable": target}
    for key in ("driver", "user", "password", "fetchsize"):
        if cfg.get(key) is not None:
            options[key] = cfg[key]
    if cfg.get("partitionColumn"):
        missing = [k for k in ("lowerBound", "upperBound", "numPartitions") if cfg.get(k) is None]
        if missing:
            raise ValueError(f"a partitioned jdbc read also needs {', '.join(missing)}")
        options |= {k: cfg[k] for k in ("partitionColumn", "lowerBound", "upperBound", "numPartitions")}
    return spark.read.format("jdbc").options(**(options | (cfg.get("options") or {}))).load()


def read_binary(spark: SparkSession, cfg: Mapping[str, Any]) -> DataFrame:
    if not cfg.get("path"):
        raise ValueError("a binary input needs path")
    return spark.read.format("binaryFile").options(**(cfg.get("options") or {})).load(cfg["path"])


def delta_format(spark: SparkSession) -> str:
    """delta where its package is on Spark's class path; else parquet, which takes all of a delta port's modes
    but has no versions, and a warning."""
    try:
        spark._jvm.java.lang.Thread.currentThread().getContextClassLoader().loadClass("io.delta.sql.DeltaSparkSessionExtension")
        return "delta"
    except Exception:
        log.warning("the delta package is not on the class path: delta ports are kept as parquet")
        return "parquet"


def read_delta(spark: SparkSession, cfg: Mapping[str, Any]) -> DataFrame:
    if cfg.get("path"):
        return read_path(spark, {**cfg, "file_format": delta_format(spark)})
    return spark.table(table_name(cfg))


READERS = {
    "path": read_path, "s3": read_path, "hive": read_table, "unity": read_table, "table": read_table,
    "jdbc": read_jdbc, "binary": read_binary, "delta": read_delta, "rest_api": read_rest,
}
