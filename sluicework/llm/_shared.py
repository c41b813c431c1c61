"""Scratch tables in the cluster's shared folder, Arrow row maps and small helpers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space, as the contracts define it: the space and U+0009 to U+000D.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where the setting is absent, a local session gets a folder of this machine; a cluster
    must name a folder that every executor sees, so there a missing setting is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith(("local[", "local-cluster", "local")) or "cluster" in spark.sparkContext.master:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/sluicework-scratch"


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    _open_paths.add(path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return a scan of what was written.

    This cuts the lineage and survives lost executors; it is what iterations and reused
    intermediate tables go through.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(_nullable(df.schema)).parquet(path)
    out._scratch_path = path
    return out


#: Paths handed out and not deleted yet.
_open_paths: set[str] = set()


def release(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_scratch_path", None)
        if path:
            delete_path(df.sparkSession, path)


#: What each open scope keeps, the innermost last.
_scopes: list[set[str]] = []


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """What is written to scratch inside is deleted at the end, but for what ``keep`` names. Results
    are lazy, so they must have been written or collected by then."""
    before = set(_open_paths)
    _scopes.append(set())
    try:
        yield
    finally:
        for path in _open_paths - before - _scopes.pop():
            delete_path(spark, path)


def keep(df: DataFrame) -> DataFrame:
    """Let a scratch table outlive the scope that it was written in; the one around it has it then."""
    if _scopes:
        _scopes[-1].add(df._scratch_path)
    return df


def delete_path(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    _open_paths.discard(path)


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # another C library than glibc
    _trim = None


def hand_back() -> None:
    """Give the system what this worker has freed. Workers wait between tasks, beside others and the
    executor's own memory, with all that Arrow and the C library kept for later."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


_held: dict[str, object] = {}


def worker_table(key: str, build: Callable[[], object]) -> object:
    """A table that a worker process keeps between its tasks. A worker holds one at a time:
    the next operator's takes the place of the last one's, so memory does not add up over the
    stages of a pipeline."""
    if key not in _held:
        _held.clear()
        hand_back()
        _held[key] = build()
    return _held[key]


def drop_worker_tables() -> None:
    """Let go of the table that an operator before left in this worker."""
    if _held:
        _held.clear()
        hand_back()


def row_map(df: DataFrame, columns: list[str], fn: Callable[..., list], out: T.StructType) -> DataFrame:
    """Append ``out``'s columns to ``df``: ``fn`` gets one Arrow array per name in ``columns``
    and returns one array per output field. All other columns pass through untouched; a column
    of ``df`` that has the name of one of ``out``'s gives way to it."""
    made_names = {n.lower() for n in out.fieldNames()}
    kept = [i for i, f in enumerate(df.schema.fields) if f.name.lower() not in made_names]
    read = [df.columns.index(c) for c in columns]
    names = [*(df.columns[i] for i in kept), *out.fieldNames()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = fn(*(batch.column(i) for i in read))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), *made], names=names)
            del batch, made
            hand_back()

    return df.mapInArrow(run, T.StructType([df.schema.fields[i] for i in kept] + out.fields))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or the first of it with more underscores that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: A key of a join counts as heavy from this many rows, or one in HEAVY_KEYS of all, on. So there are
#: never more than HEAVY_KEYS heavy keys, whatever the size of the table.
HEAVY_ROWS, HEAVY_KEYS = 1_000, 100_000


def heavy_join(rows: DataFrame, table: DataFrame, key: str | list[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """Join ``rows`` with ``table``, which has one row for each value of ``key`` and in ``count`` how many of the ``total`` rows have that value. ``table`` is read twice, so it
    should be a table that was written. Column ``count`` is dropped.

    The rows of heavy keys never meet in one task: their part of ``table``, of at most HEAVY_KEYS
    rows, is broadcast. All others, and null keys, go the way of a sorted shuffle.
    """
    limit = max(HEAVY_ROWS, total // HEAVY_KEYS)
    plain = table.drop(count).hint("merge")
    if total < limit:
        return rows.join(plain, key, how)
    heavy = materialize(table.filter(F.col(count) >= limit).drop(count), "heavy-keys")
    if heavy.isEmpty():
        release(heavy)
        return rows.join(plain, key, how)
    many = rows.join(F.broadcast(heavy), key)
    return many.unionByName(rows.join(F.broadcast(heavy.select(*([key] if isinstance(key, str) else key))), key, "left_anti").join(plain, key, how))


def open_uri(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI as workers reach it, and the path in it."""
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


def binary_texts(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text; a null is an empty text."""
    if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    for value in column:
        yield value.as_py() or b""


def plain_texts(column: pa.Array) -> Iterator[str]:
    """Each text as ``str``; a null is an empty text."""
    for value in column:
        yield value.as_py() or ""


def text_groups(column: pa.Array, chars: int = 2_000_000) -> Iterator[list[str]]:
    """The texts in order, in groups of about ``chars`` characters."""
    group, size = [], 0
    for text in plain_texts(column):
        group.append(text)
        size += len(text)
        if size >= chars:
            yield group
            group, size = [], 0
    if group:
        yield group


def ascii_lower(text: Column) -> Column:
    """Lower-case A to Z only. Pure ASCII takes the byte-wise path of ``lower``."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``: the folds of the contracts."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(modulus)
