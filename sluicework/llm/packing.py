"""Sequence packing by non-negative least squares over shallow length combinations.

Documents become ids and are cut at multiples of the window, so at most one piece of each is
shorter. Piece lengths are rounded up to ``grain`` tokens and counted: a histogram of at most
window / grain bins, whatever the size of the corpus. Combinations of up to ``depth`` bins that
fill a window are enumerated, their repeat counts are solved against the histogram by
non-negative least squares, rounded down, and what is left is packed greedily, longest first.
The histogram is all the driver sees; pieces find their place by their rank within their bin.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ._shared import binary_texts, drop_worker_tables, free_name, hand_back, materialize
from .token_ids import ID_BYTES, encoded_groups

WINDOW = 4096
GRAIN = 16
DEPTH = 3
#: Pieces of one bin that are ranked in one task, about; a bin's other pieces go to further salts.
RANKED_TOGETHER = 1_000_000
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"


def cut_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, window: int = WINDOW, keep_ids: bool = True) -> DataFrame:
    """The pieces of every document of ``docs`` (doc_id, text): (doc_id, start, length,
    ids_crc32, doc_tokens, ids). A null text is empty; every document ends with ``end_id``
    and so has at least one piece. Without ``keep_ids`` the ids column is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoded_groups(binary_texts(batch.column(1)), end_id, tokenizer_path)):
                total = len(ids) // ID_BYTES
                for start in range(0, total, window):
                    part = ids[start * ID_BYTES : (start + window) * ID_BYTES]
                    rows.append((doc_id, start, len(part) // ID_BYTES, zlib.crc32(part), total, part if keep_ids else None))
            kinds = [pa.int64()] * 5 + [pa.binary()]
            columns = zip(*rows) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])
            del batch, rows, columns
            hand_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, _PIECES)


def combinations(bins: int, depth: int) -> list[tuple[int, ...]]:
    """All multisets of 1 to ``depth`` bins (numbered from 1, in descending order) whose sum is
    exactly ``bins``."""
    out: list[tuple[int, ...]] = []

    def grow(left: int, most: int, taken: tuple[int, ...]) -> None:
        if not left:
            out.append(taken)
        elif len(taken) < depth:
            least = -(-left // (depth - len(taken)))
            for b in range(min(left, most), least - 1, -1):
                grow(left - b, b, (*taken, b))

    grow(bins, bins, ())
    return out


def nnls(matrix: np.ndarray, target: np.ndarray, rounds: int = 0) -> np.ndarray:
    """Least squares of matrix @ x - target under x >= 0, by an active set that takes in
    several columns a round. Ends at the optimality conditions or after ``rounds``."""
    columns = matrix.shape[1]
    x, active = np.zeros(columns), np.zeros(columns, bool)
    scale = max(1.0, float(np.abs(target).max(initial=0.0)))
    for _ in range(rounds or 3 * matrix.shape[0]):
        gain = matrix.T @ (target - matrix @ x)
        gain[active] = -np.inf
        if gain.max(initial=-np.inf) <= 1e-9 * scale:
            break
        best = [c for c in np.argsort(-gain)[: max(1, matrix.shape[0] // 32)] if gain[c] > 1e-9 * scale]
        active[best] = True
        while active.any():
            at = np.flatnonzero(active)
            trial = np.linalg.lstsq(matrix[:, at], target, rcond=None)[0]
            if (trial > 0).all():
                x[:] = 0
                x[at] = trial
                break
            low = trial <= 0
            step = np.min(np.where(low, x[at] / np.maximum(x[at] - trial, 1e-300), np.inf))
            x[at] = np.maximum(x[at] + min(1.0, step) * (trial - x[at]), 0)
            drop = at[low & (x[at] <= 1e-12 * scale)]
            if not len(drop):
                drop = at[low]
            x[drop] = 0
            active[drop] = False
    return x


def plan(histogram: dict[int, int], bins: int, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """Packs and their repeat counts that use every piece of the histogram exactly once."""
    left = np.zeros(bins + 1, np.int64)
    for b, n in histogram.items():
        left[b] = n
    packs: list[tuple[tuple[int, ...], int]] = []
    if left[bins]:
        packs.append(((bins,), int(left[bins])))
        left[bins] = 0
    # A long tail of tiny pieces never fills a window with few of them; those go greedily.
    shallow = [c for c in combinations(bins, depth) if all(left[b] for b in c)]
    if shallow:
        matrix = np.zeros((bins, len(shallow)))
        for k, combo in enumerate(shallow):
            for b in combo:
                matrix[b - 1, k] += 1
        repeats = nnls(matrix, left[1:].astype(float), rounds=bins)
        for k in np.argsort(-repeats):
            combo = shallow[k]
            need = {b: combo.count(b) for b in combo}
            times = min(int(repeats[k]), *(int(left[b]) // n for b, n in need.items()))
            if times > 0:
                packs.append((combo, times))
                for b, n in need.items():
                    left[b] -= n * times
    while left.any():
        # The longest piece left, then again and again the longest that still fits; the same
        # pack repeats as often as its pieces last.
        space, combo, rest = bins, [], left.copy()
        while space:
            fits = np.flatnonzero(rest[1 : space + 1])
            if not len(fits):
                break
            b = int(fits[-1]) + 1
            n = int(min(rest[b], space // b))
            combo += [b] * n
            rest[b] -= n
            space -= n * b
        used = np.bincount(combo, minlength=bins + 1)
        times = int(min(left[b] // used[b] for b in set(combo)))
        packs.append((tuple(combo), times))
        left -= used * times
    return packs


def pack(pieces: DataFrame, window: int = WINDOW, grain: int = GRAIN, depth: int = DEPTH) -> DataFrame:
    """Append sequence_id and offset to ``pieces`` (doc_id, start, length, ...).

    Every piece lands in exactly one sequence of at most ``window`` tokens; offsets within a
    sequence are gapless from 0. Repeated rows are pieces of their own; null ids are ids. All other
    columns pass through, columns named sequence_id or offset give way. ``pieces`` is written once with a
    number for each row. An empty table gives an empty result.
    """
    bins = window // grain
    pieces = pieces.drop("sequence_id", "offset")
    number, bin_, salt, base, rank = (free_name(pieces, c) for c in ("_number", "_bin", "_salt", "_base", "_rank"))
    # The stored number deals equal rows over the salts, however many there are.
    binned = materialize(pieces.select("*", F.monotonically_increasing_id().alias(number), F.ceil(F.col("length") / grain).cast("int").alias(bin_)), "packing-pieces")
    histogram = {r[0]: r[1] for r in binned.groupBy(bin_).count().collect()}
    salts = max(8, -(-max(histogram.values(), default=0) // RANKED_TOGETHER))
    binned = binned.withColumn(salt, F.pmod(F.xxhash64(number), F.lit(salts)).cast("int"))
    counts = binned.groupBy(bin_, salt).agg(F.count("*").alias(number))
    before = Window.partitionBy(bin_).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(bin_, salt, F.coalesce(F.sum(number).over(before), F.lit(0)).alias(base))
    inside = F.row_number().over(Window.partitionBy(bin_, salt).orderBy("doc_id", "start", "ids_crc32", number)) - 1
    ranked = binned.withColumn(rank, inside).join(bases, [bin_, salt]).withColumn(rank, F.col(rank) + F.col(base))

    # For each bin, in the order of the packs: from which rank on a pack takes its pieces, how
    # many a sequence takes, and the pack's first sequence.
    taken, steps, sequence = {}, {}, 0
    for combo, times in plan(histogram, bins, depth):
        for b in sorted(set(combo), reverse=True):
            n = combo.count(b)
            steps.setdefault(b, []).append((taken.get(b, 0), n, sequence))
            taken[b] = taken.get(b, 0) + n * times
        sequence += times
    table = {b: tuple(np.array(c, np.int64) for c in zip(*rows)) for b, rows in steps.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_worker_tables()
        for batch in batches:
            bin_of = batch.column(batch.schema.get_field_index(bin_)).to_numpy()
            ranks = batch.column(batch.schema.get_field_index(rank)).to_numpy()
            out = np.empty(len(ranks), np.int64)
            for b in np.unique(bin_of).tolist():
                rows = np.flatnonzero(bin_of == b)
                starts, each, first = table[b]
                k = np.searchsorted(starts, ranks[rows], side="right") - 1
                out[rows] = first[k] + (ranks[rows] - starts[k]) // each[k]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "sequence_id"])

    placed = ranked.mapInArrow(place, T.StructType([*ranked.schema.fields, T.StructField("sequence_id", T.LongType())]))
    order = Window.partitionBy("sequence_id").orderBy(F.col("length").desc(), "doc_id", "start", "ids_crc32", number).rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0)).cast("long")).drop(number, bin_, salt, base, rank)


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, window: int = WINDOW, keep_ids: bool = False) -> DataFrame:
    """Encode, cut and pack ``docs`` (doc_id, text): one row per piece with its place. Other columns
    of ``docs`` are ignored; a null text is empty; repeated rows and null ids are documents of
    their own; an empty table gives an empty result."""
    return pack(cut_pieces(docs, tokenizer_path, end_id, window, keep_ids), window)


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from pieces with their ids: (sequence_id, n_tokens,
    ids), ids as little-endian unsigned 32-bit integers."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.aggregate(parts, F.lit(b""), lambda x, y: F.concat(x, y["ids"])).alias("ids"))
