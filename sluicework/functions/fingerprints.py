"""Fingerprints of schemas, rows, tables, files and settings."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def schema_fingerprint(df: DataFrame) -> str:
    """sha256 of names, types and nullability in column order: reordering columns changes it."""
    fields = [[f.name, f.dataType.simpleString(), f.nullable] for f in df.schema.fields]
    return hashlib.sha256(json.dumps(fields).encode()).hexdigest()


def row_text(*columns: str) -> Column:
    """The row as one text, nulls marked so that they differ from empty texts."""
    return F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns))


def row_number_of(text: Column) -> Column:
    """The first 32 bits of the row's md5, a number that sums without overflow."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def table_fingerprint_columns(df: DataFrame) -> list[Column]:
    """Count and order-free sum over all rows: cheap enough to observe while a write runs."""
    return [F.count(F.lit(1)).alias("row_count"), F.coalesce(F.sum(row_number_of(row_text(*df.columns))), F.lit(0)).alias("row_sum")]


def combine(schema_hash: str, row_count: int, row_sum: int) -> str:
    return hashlib.sha256(f"{schema_hash}\n{row_count}\n{row_sum}".encode()).hexdigest()


def config_fingerprint(config: Mapping[str, Any]) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()


def file_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of the files under ``path``, hashed where they are read."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))
