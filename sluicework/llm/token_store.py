"""Token-id shards with a minimal perfect hash index.

A shard is one file: raw little-endian unsigned ids of documents in ascending key
order, behind them the index. The index gives every key of the shard its own slot by a cascade
of bit levels: a key sits in the first level where its hash meets no other key, its slot is the
number of bits set before it. A slot stores a 32-bit fingerprint of its key, the document's
first id and its number of ids, so a lookup reads a constant number of places and an absent key
is refused.

File layout, all integers little-endian:
    ids                      n_ids x uint16 if all ids of the shard fit, else uint32
    keys in document order   n_docs x int64
    ids in each document     n_docs x int64
    slot table               n_slots x (uint32 fingerprint, uint32 unused, int64 start, int64 count)
    level bits               for each level: uint64 bit count, packed bits
    footer                   10 x int64: magic, version, bytes of an id, n_ids, n_docs, n_slots, n_levels, n_loose, n_nulls, bytes of levels
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as pads
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import binary_texts, delete_path, materialize, open_uri, scratch_path
from .token_ids import ID_BYTES, encoded_groups

MAGIC, VERSION, FOOTER = 0x5357494458, 1, 10
LOAD, MAX_LEVELS = 2.0, 24
#: Ids in a shard, about.
SHARD_IDS = 8 * 1024 * 1024
_SLOT = np.dtype([("fingerprint", "<u4"), ("unused", "<u4"), ("start", "<i8"), ("count", "<i8")])


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of int64 keys (the finaliser of splitmix64 over key and seed)."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.int64).view(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_FINGERPRINT_SEED = 1 << 20


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, _FINGERPRINT_SEED) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """A minimal perfect hash function of distinct int64 keys."""

    def __init__(self, levels: list[np.ndarray], loose: np.ndarray):
        self.levels = levels  # arrays of bool
        self.loose = loose  # sorted keys that met others on every level
        bases = np.cumsum([0, *(int(x.sum()) for x in levels)])
        self.before = [base + np.concatenate([[0], np.cumsum(x)]) for base, x in zip(bases, levels)]
        self.size = int(bases[-1]) + len(loose)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, levels = np.asarray(keys, np.int64), []
        while len(left) and len(levels) < MAX_LEVELS:
            width = max(64, int(len(left) * LOAD))
            at = (mix(left, len(levels)) % np.uint64(width)).astype(np.int64)
            met = np.bincount(at, minlength=width)
            levels.append(met == 1)
            left = left[met[at] != 1]
        return cls(levels, np.sort(left))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; for a key that was not built in, some slot or -1."""
        keys = np.asarray(keys, np.int64)
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for k, (bits, before) in enumerate(zip(self.levels, self.before)):
            if not len(left):
                break
            at = (mix(keys[left], k) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[left[hit]] = before[at[hit]]
            left = left[~hit]
        if len(left) and len(self.loose):
            at = np.minimum(np.searchsorted(self.loose, keys[left]), len(self.loose) - 1)
            hit = self.loose[at] == keys[left]
            out[left[hit]] = self.size - len(self.loose) + at[hit]
        return out


def shard_bytes(keys: list[int | None], ids: list[bytes]) -> bytes:
    """One shard. Documents without a key come first and are reached by scan only; of
    documents that repeat a key, the first is the one the index finds."""
    nulls = sum(k is None for k in keys)
    counts = np.fromiter((len(x) // ID_BYTES for x in ids), np.int64, len(ids))
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(ids) else np.empty(0, np.int64)
    numbers = np.array([0 if k is None else k for k in keys], "<i8")
    distinct, first = np.unique(numbers[nulls:], return_index=True)
    function = PerfectHash.build(distinct)
    table = np.zeros(function.size, _SLOT)
    at = function.slots(distinct)
    table["fingerprint"][at], table["start"][at], table["count"][at] = fingerprints(distinct), starts[nulls:][first], counts[nulls:][first]
    levels = b"".join(np.array([len(x)], "<u8").tobytes() + np.packbits(x).tobytes() for x in function.levels) + function.loose.astype("<i8").tobytes()
    payload = np.frombuffer(b"".join(ids), "<u4")
    width = 2 if payload.max(initial=0) < 1 << 16 else ID_BYTES
    footer = np.array([MAGIC, VERSION, width, int(counts.sum()), len(ids), function.size, len(function.levels), len(function.loose), nulls, len(levels)], "<i8")
    return b"".join([payload.astype(f"<u{width}").tobytes(), numbers.tobytes(), counts.astype("<i8").tobytes(), table.tobytes(), levels, footer.tobytes()])


class Shard:
    """A shard file, read place by place through ``read(start, size)``: opening reads the footer and
    the level bits, a lookup one slot, a payload its own ids."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        footer = np.frombuffer(read(max(0, size - 8 * FOOTER), 8 * FOOTER), "<i8") if size >= 8 * FOOTER else np.zeros(FOOTER, np.int64)
        magic, version, self.width, n_ids, self.n_docs, self.n_slots, n_levels, n_loose, self.nulls, n_bytes = footer.tolist()
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token-id shard")
        self._read, self._keys_at = read, n_ids * self.width
        self._table_at = self._keys_at + 16 * self.n_docs
        levels_at = self._table_at + _SLOT.itemsize * self.n_slots
        if levels_at + n_bytes + 8 * FOOTER != size:
            raise ValueError("the shard is cut short")
        raw, at, levels = read(levels_at, n_bytes), 0, []
        for _ in range(n_levels):
            width = int(np.frombuffer(raw, "<u8", 1, at)[0])
            levels.append(np.unpackbits(np.frombuffer(raw, np.uint8, -(-width // 8), at + 8), count=width).astype(bool))
            at += 8 + -(-width // 8)
        self.hash = PerfectHash(levels, np.frombuffer(raw, "<i8", n_loose, at))

    @classmethod
    def of_bytes(cls, raw: bytes) -> Shard:
        return cls(lambda start, size: raw[start : start + size], len(raw))

    def documents(self) -> tuple[np.ndarray, np.ndarray]:
        """The keys and the numbers of ids of all documents in their order."""
        raw = self._read(self._keys_at, 16 * self.n_docs)
        return np.frombuffer(raw, "<i8", self.n_docs), np.frombuffer(raw, "<i8", self.n_docs, 8 * self.n_docs)

    def locate(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First id and number of ids of each key; -1 and 0 for a key that the shard lacks."""
        slots = self.hash.slots(keys)
        ok = slots >= 0
        if len(keys) > self.n_slots // 64:
            table = np.frombuffer(self._read(self._table_at, _SLOT.itemsize * self.n_slots), _SLOT)[slots[ok]]
        else:
            table = np.frombuffer(b"".join(self._read(self._table_at + _SLOT.itemsize * s, _SLOT.itemsize) for s in slots[ok].tolist()), _SLOT)
        same = table["fingerprint"] == fingerprints(np.asarray(keys)[ok])
        start, count = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        hit = np.flatnonzero(ok)[same]
        start[hit], count[hit] = table["start"][same], table["count"][same]
        return start, count

    def payload(self, start: int, count: int) -> bytes:
        """``count`` ids from ``start`` on, as little-endian unsigned 32-bit integers."""
        raw = self._read(start * self.width, count * self.width)
        return raw if self.width == ID_BYTES else np.frombuffer(raw, f"<u{self.width}").astype("<u4").tobytes()

    def get(self, key: int) -> bytes | None:
        start, count = (x[0] for x in self.locate(np.array([key])))
        return None if start < 0 else self.payload(int(start), int(count))


def _put(folder: str, name: str, raw: bytes) -> None:
    """Write a whole file and then name it: a task that dies leaves no half file by that
    name, and a task that runs again names the same bytes."""
    where, path = open_uri(folder)
    where.create_dir(path, recursive=True)
    draft = f"{path}/.{name}.{hashlib.sha1(repr(id(raw)).encode() + raw[-64:]).hexdigest()}"
    with where.open_output_stream(draft) as f:
        f.write(raw)
    where.move(draft, f"{path}/{name}")


def write_store(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into shards under ``folder`` and return the manifest.

    Rows are dealt by ranges of doc_id and written in ascending order, rows without one
    first; a null text is empty; each document ends with ``end_id``. The manifest
    (shard, name, first_key, last_key, n_docs, n_ids, base) is also kept as Parquet under
    ``folder``/manifest; base counts the ids of all shards before.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    # Rows without an id, or with one id, are dealt by their texts.
    by = F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()
    ordered = rows.repartitionByRange(*by).sortWithinPartitions(*by, "text")
    names = ["part", "name", "first_key", "last_key", "n_docs", "n_ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        keys, ids, size = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal keys, ids, size, made
            name = f"ids-{part:06d}-{made:06d}.bin"
            _put(folder, name, shard_bytes(keys, ids))
            known = [k for k in keys if k is not None]
            row = [part * 1_000_000 + made, name, known[0] if known else None, known[-1] if known else None, len(keys), size]
            keys, ids, size, made = [], [], 0, made + 1
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()])], names=names)

        for batch in batches:
            for key, made_ids in zip(batch.column(0).to_pylist(), encoded_groups(binary_texts(batch.column(1)), end_id, tokenizer_path)):
                if ids and size >= shard_ids and key != keys[-1]:
                    yield flush()
                keys.append(key)
                ids.append(made_ids)
                size += len(made_ids) // ID_BYTES
        if ids:
            yield flush()

    shards = materialize(ordered.mapInArrow(run, "part long, name string, first_key long, last_key long, n_docs long, n_ids long"), "token-shards")
    order = Window.orderBy("part")
    manifest = shards.select(
        (F.row_number().over(order) - 1).cast("long").alias("shard"), "name", "first_key", "last_key", "n_docs", "n_ids",
        F.coalesce(F.sum("n_ids").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long").alias("base"),
    )
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest")
    delete_path(docs.sparkSession, shards._scratch_path)
    return docs.sparkSession.read.schema("shard long, name string, first_key long, last_key long, n_docs long, n_ids long, base long").parquet(f"{folder}/manifest")


@contextmanager
def _shard(folder: str, name: str, whole: bool = False) -> Iterator[Shard]:
    """A shard of the folder, read by seeking, or at once."""
    where, path = open_uri(folder)
    with where.open_input_file(f"{path}/{name}") as f:
        if whole:
            yield Shard.of_bytes(f.read())
        else:
            yield Shard(lambda start, size: f.read_at(size, start), f.size())


def read_store(manifest: DataFrame, folder: str) -> DataFrame:
    """Read every document back through the index: (doc_id, start, n_tokens, ids_crc32), start
    counting the ids of all documents before it. Shards are read one at a time; an empty store gives
    no row; documents without an id come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with _shard(folder, name, whole=True) as shard:
                    keys, sizes = shard.documents()
                    starts, counts = shard.locate(keys)
                # Documents without a key, or behind the first of a repeated one, have no slot
                # of their own; the document order gives their place.
                first = np.ones(len(keys), bool)
                first[1:] = keys[1:] != keys[:-1]
                first[: shard.nulls + 1] = np.arange(min(len(keys), shard.nulls + 1)) == shard.nulls
                ordered = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                starts, counts = np.where(first, starts, ordered), np.where(first, counts, sizes)
                crcs = [zlib.crc32(shard.payload(a, n)) for a, n in zip(starts.tolist(), counts.tolist())]
                ids = pa.array(keys, pa.int64(), mask=np.arange(len(keys)) < shard.nulls)
                yield pa.RecordBatch.from_arrays([ids, pa.array(starts + base), pa.array(counts), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    named = manifest.select("name", "base").repartition("name")
    return named.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


class Store:
    """Keyed access to a store: the manifest, one row a shard, is read once; each lookup then reads the
    footer, the level bits, one slot and the document's own ids, wherever the shard lies."""

    def __init__(self, folder: str):
        where, path = open_uri(f"{folder}/manifest")
        found = pads.dataset(path, filesystem=where, format="parquet").to_table(columns=["shard", "name", "first_key", "last_key"]).sort_by("shard")
        found = found.filter(pc.is_valid(found.column("first_key")))
        self.folder, self.names = folder, found.column("name").to_pylist()
        self.firsts, self.lasts = (found.column(c).to_numpy() for c in ("first_key", "last_key"))

    def get(self, key: int) -> bytes | None:
        """The ids of the document of this key, the first of those that repeat it."""
        at = int(np.searchsorted(self.lasts, key))
        if at == len(self.names) or self.firsts[at] > key:
            return None
        with _shard(self.folder, self.names[at]) as shard:
            return shard.get(key)


def lookup(folder: str, key: int) -> bytes | None:
    """The ids of one document; for many, keep a ``Store``."""
    return Store(folder).get(key)


def new_folder(spark) -> str:
    return scratch_path(spark, "token-store")
