"""Writers: DataFrames to named outputs."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator, Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import upsert
from . import embedded
from .readers import delta_format, table_name
from .rest import Client

MODES = ("overwrite", "append", "ignore", "error", "errorifexists", "merge")


def mode_of(cfg: Mapping[str, Any], default: str) -> str:
    mode = cfg.get("mode") or default
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; known: {', '.join(MODES)}")
    return mode


def _columns(value: Any) -> list[str]:
    return [value] if isinstance(value, str) else list(value or [])


def _writer(df: DataFrame, cfg: Mapping[str, Any], mode: str):
    out = df.write.mode(mode).options(**(cfg.get("options") or {}))
    if cfg.get("partition_overwrite"):
        out = out.option("partitionOverwriteMode", cfg["partition_overwrite"])
    by = _columns(cfg.get("partitionBy") or cfg.get("partition_by"))
    return out.partitionBy(*by) if by else out


def write_path(df: DataFrame, cfg: Mapping[str, Any]) -> None:
    if not cfg.get("path"):
        raise ValueError("a path output needs path")
    mode, kind = mode_of(cfg, "overwrite"), cfg.get("file_format") or "parquet"
    if mode == "merge":
        return merge_path(df, cfg, kind)
    _writer(df, cfg, mode).format(kind).save(cfg["path"])


def merge_path(df: DataFrame, cfg: Mapping[str, Any], kind: str) -> None:
    """Upsert into files: the new state is written beside the target and then takes its place. A failed
    write leaves the target as it was; if the second of the two renames fails, the first is undone.
    Between the two, for the time of a rename, the path is absent: files have no exchange in one step."""
    keys = _columns(cfg.get("merge_keys"))
    if not keys:
        raise ValueError("mode merge needs merge_keys")
    spark, path = df.sparkSession, cfg["path"].rstrip("/")
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(target):
        return _writer(df, cfg, "error").format(kind).save(path)
    old = spark.read.format(kind).options(**(cfg.get("options") or {})).load(path)
    staged = jvm.org.apache.hadoop.fs.Path(f"{path}.staged-{uuid.uuid4().hex}")
    aside = jvm.org.apache.hadoop.fs.Path(f"{path}.replaced-{uuid.uuid4().hex}")
    _writer(upsert(old, df, keys), cfg, "error").format(kind).save(staged.toString())
    if not fs.rename(target, aside):
        fs.delete(staged, True)
        raise OSError(f"{path} could not be moved aside")
    moved = False
    try:
        moved = fs.rename(staged, target)
    finally:
        if not moved:
            fs.rename(aside, target)
    if not moved:
        raise OSError(f"the new state could not take the place of {path}")
    fs.delete(aside, True)


def _in_schema(name: str) -> str:
    """A table's name without its catalog, as a rename takes it."""
    return ".".join(name.split(".")[-2:])


def write_table(df: DataFrame, cfg: Mapping[str, Any]) -> None:
    name, mode, spark = table_name(cfg), mode_of(cfg, "append"), df.sparkSession
    kind = cfg.get("file_format") or "parquet"
    if mode == "merge":
        keys = _columns(cfg.get("merge_keys"))
        if not keys:
            raise ValueError("mode merge needs merge_keys")
        if spark.catalog.tableExists(name):
            staged, aside = f"{name}_staged_{uuid.uuid4().hex[:8]}", f"{name}_replaced_{uuid.uuid4().hex[:8]}"
            plain = {k: v for k, v in cfg.items() if k != "options"} | {"options": {k: v for k, v in (cfg.get("options") or {}).items() if k != "path"}}
            _writer(upsert(spark.table(name), df, keys), plain, "error").format(kind).saveAsTable(staged)
            # The old table keeps existing under another name until the new one has its place.
            spark.sql(f"ALTER TABLE {name} RENAME TO {_in_schema(aside)}")
            try:
                spark.sql(f"ALTER TABLE {staged} RENAME TO {_in_schema(name)}")
            except BaseException:
                spark.sql(f"ALTER TABLE {aside} RENAME TO {_in_schema(name)}")
                raise
            spark.sql(f"DROP TABLE {aside}")
        else:
            _writer(df, cfg, "error").format(kind).saveAsTable(name)
    else:
        _writer(df, cfg, mode).format(kind).saveAsTable(name)
    quoted = lambda text: str(text).replace("\\", "\\\\").replace("'", "\\'")
    if cfg.get("comment"):
        spark.sql(f"COMMENT ON TABLE {name} IS '{quoted(cfg['comment'])}'")
    if cfg.get("properties"):
        pairs = ", ".join(f"'{quoted(k)}' = '{quoted(v)}'" for k, v in cfg["properties"].items())
        spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ({pairs})")


def compact(df: DataFrame, path: str, columns: list[str], files: int, kind: str = "parquet") -> None:
    """Rewrite into ``files`` files of ranges of ``columns``, sorted, so that scans skip most."""
    df.repartitionByRange(files, *columns).sortWithinPartitions(*columns).write.mode("overwrite").format(kind).save(path)


def write_jdbc(df: DataFrame, cfg: Mapping[str, Any]) -> None:
    if not cfg.get("url") or not cfg.get("table"):
        raise ValueError("a jdbc output needs url and table")
    options = {"url": cfg["url"], "dbtable": cfg["table"]}
    for key in ("driver", "user", "password"):
        if cfg.get(key) is not None:
            options[key] = cfg[key]
    mode, options = mode_of(cfg, "append"), options | (cfg.get("options") or {})
    if not embedded.is_embedded(cfg["url"]):
        df.write.format("jdbc").mode(mode).options(**options).save()
        return
    # No row goes this way, but the driver makes or empties the table as for any other database.
    there = mode == "ignore" and _jdbc_table_exists(df.sparkSession, options)
    df.limit(0).write.format("jdbc").mode(mode).options(**options).save()
    if not there:
        embedded.import_rows(df, cfg)


def _jdbc_table_exists(spark: SparkSession, options: Mapping[str, Any]) -> bool:
    try:
        return bool(spark.read.format("jdbc").options(**options).load().schema)
    except Exception as e:
        if "does not exist" in str(e):
            return False
        raise


def write_rest(df: DataFrame, cfg: Mapping[str, Any]) -> None:
    """POST the rows in batches from where they are. A batch that fails does not stop the
    others; failures are counted and raised once at the end. A task that runs again sends its batches
    again: each carries the hash of its records as Idempotency-Key, by which a server can tell."""
    if not cfg.get("url"):
        raise ValueError("a rest_api output needs url")
    plain = {k: v for k, v in cfg.items() if k != "format"}
    size, key = int(cfg.get("batch_size", 100)), cfg.get("body_key", "records")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import requests

        client, sent, failed, batch = Client(plain), 0, 0, []

        def flush() -> None:
            nonlocal sent, failed, batch
            try:
                body = [json.loads(text) for text in batch]
                name = hashlib.sha256("\n".join(batch).encode()).hexdigest()
                client.send(plain["url"], client.params, {key: body}, plain.get("method", "POST"), (429, 500, 503), {"Idempotency-Key": name})
                sent += 1
            except requests.RequestException:
                failed += 1
            batch = []

        for rows in batches:
            for text in rows.column(0).to_pylist():
                batch.append(text)
                if len(batch) == size:
                    flush()
        if batch:
            flush()
        yield pa.RecordBatch.from_pydict({"sent": pa.array([sent], pa.int64()), "failed": pa.array([failed], pa.int64())})

    payload = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("record"))
    failed = payload.mapInArrow(send, "sent long, failed long").agg(F.sum("failed")).first()[0]
    if failed:
        raise RuntimeError(f"{failed} batches were refused by {cfg['url']}")


def write_delta(df: DataFrame, cfg: Mapping[str, Any]) -> None:
    """As delta where its package is there, else as parquet; ``merge`` needs merge_keys either way."""
    kind = delta_format(df.sparkSession)
    if cfg.get("path"):
        return write_path(df, {**cfg, "file_format": kind})
    write_table(df, {**cfg, "file_format": kind})


WRITERS = {
    "path": write_path, "s3": write_path, "hive": write_table, "unity": write_table, "table": write_table,
    "jdbc": write_jdbc, "rest_api": write_rest, "delta": write_delta,
}
