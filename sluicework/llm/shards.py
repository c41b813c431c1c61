"""Key-value tables in sorted shards that workers look up without holding the whole table.

A table of distinct 64-bit keys is range-partitioned into shards of bounded size in the shared
folder. A worker finds the shards of the keys it asks for, reads those, and keeps the ones used
last up to a number of rows. A small table is read once a worker, a large one is streamed; the
way is the same at every size and nothing but the list of shards passes through the driver.
"""

from __future__ import annotations

from collections import OrderedDict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import delete_path, open_uri, scratch_path

#: Rows of a shard, about, and of the shards that a worker keeps.
SHARD_ROWS = 500_000
HELD_ROWS = 2_000_000


@dataclass
class ShardList:
    """Where the shards are: one file each, the first key of each, ascending, and the number of
    rows of the whole table."""

    path: str
    files: list[str]
    firsts: list[int]
    n_rows: int
    width: int
    held_rows: int = HELD_ROWS

    def delete(self, spark) -> None:
        delete_path(spark, self.path)


def write_shards(table: DataFrame, values: list[str], label: str, held_rows: int = HELD_ROWS) -> ShardList:
    """Write ``table`` (key long, the columns ``values`` as doubles), its keys distinct and not
    null. Null values are kept as NaN. An empty table has no shards."""
    spark = table.sparkSession
    path, whole = scratch_path(spark, label), scratch_path(spark, f"{label}-rows")
    rows = table.select(F.col("key").cast("long").alias("key"), *(F.col(v).cast("double").alias(f"v{i}") for i, v in enumerate(values)))
    rows.write.parquet(whole)
    rows = spark.read.schema(rows.schema).parquet(whole)
    n = rows.count()
    rows.repartitionByRange(max(1, -(-n // SHARD_ROWS)), "key").sortWithinPartitions("key").write.parquet(path)
    # One row a shard.
    found = spark.read.schema(rows.schema).parquet(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min("key").alias("first")).orderBy("first").collect()
    delete_path(spark, whole)
    return ShardList(path, [r["file"] for r in found], [r["first"] for r in found], n, len(values), held_rows)


class HashTable:
    """Open addressing over distinct 64-bit keys, looked up for whole arrays at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2))))
        size = 1 << self.bits
        self.keys, self.values = keys, values
        self.rows = np.full(size, -1, np.int32)
        left, at = np.arange(len(keys), dtype=np.int32), self._at(keys)
        while len(left):
            spot = at[left]
            free = self.rows[spot] < 0
            first = np.zeros(len(left), bool)
            first[np.unique(spot, return_index=True)[1]] = True
            take = free & first
            self.rows[spot[take]] = left[take]
            left = left[~take]
            at[left] = (at[left] + 1) & (size - 1)

    def _at(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 for a key that is not there."""
        at = self._at(keys)
        out = self.rows[at]
        left = np.flatnonzero(out >= 0)
        left = left[self.keys[out[left]] != keys[left]]
        while len(left):
            at[left] = (at[left] + 1) & (len(self.rows) - 1)
            here = self.rows[at[left]]
            out[left] = here
            left = left[here >= 0]
            left = left[self.keys[out[left]] != keys[left]]
        return out


class Shards:
    """A worker's view of a table."""

    def __init__(self, listed: ShardList):
        self.listed, self.firsts = listed, np.array(listed.firsts, np.int64)
        self._kept: OrderedDict[int, HashTable] = OrderedDict()
        self._rows = 0

    def _shard(self, k: int) -> HashTable:
        if k in self._kept:
            self._kept.move_to_end(k)
            return self._kept[k]
        where, path = open_uri(self.listed.files[k])
        with where.open_input_file(path) as f:
            read = pq.read_table(f)
        keys = read.column("key").to_numpy()
        values = np.stack([read.column(f"v{i}").to_numpy() for i in range(self.listed.width)], axis=1) if self.listed.width else np.empty((len(keys), 0))
        del read
        pa.default_memory_pool().release_unused()
        while self._kept and self._rows + len(keys) > self.listed.held_rows:
            self._rows -= len(self._kept.popitem(last=False)[1].keys)
        self._kept[k] = HashTable(np.ascontiguousarray(keys), values)
        self._rows += len(keys)
        return self._kept[k]

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of each key as rows, NaN for a key that the table lacks, and which keys
        it has."""
        keys = np.ascontiguousarray(keys).view(np.int64)
        out, found = np.full((len(keys), self.listed.width), np.nan), np.zeros(len(keys), bool)
        if not len(keys) or not len(self.firsts):
            return out, found
        if len(self.firsts) == 1:
            groups = [(0, np.arange(len(keys)))]
        else:
            shard = np.searchsorted(self.firsts, keys, side="right") - 1
            order = np.argsort(shard, kind="stable")
            cuts = np.flatnonzero(np.diff(shard[order])) + 1
            groups = [(int(shard[part[0]]), part) for part in np.split(order, cuts)]
            # What is held comes first, so that a table a little too large is not read anew.
            groups.sort(key=lambda g: g[0] not in self._kept)
        for k, at in groups:
            if k < 0:
                continue
            table = self._shard(k)
            rows = table.find(keys[at])
            hit = rows >= 0
            out[at[hit]], found[at[hit]] = table.values[rows[hit]], True
        return out, found
