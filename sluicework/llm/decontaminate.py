"""Benchmark decontamination by SimHash windows of the items' own sizes.

Of each document, every window of as many words as an item that could match is looked at: a
match at 0.8 shares eight ninths of the item's shingles, so it holds one of the item's rarest ones
(its anchors) and eight ninths of its shingles are known from the benchmark. Such windows get
SimHash fingerprints from running sums of shingle-hash bits. A multi-index over blocks of the item
fingerprints finds all items within the radius: of BLOCKS blocks one must differ in at most
RADIUS // BLOCKS bits, so every value that near is looked up in the block's table. Candidates within
the radius are then verified by the exact weighted similarity of their shingles, each weighted by
how often it occurs.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import free_name, materialize, plain_texts, row_map, worker_table

WORDS = 5
SIMILARITY = 0.8
#: Fingerprints of 128 bits in blocks of 16. Windows just at the least similarity differ by more than
#: the radius in 3 of 1,000 cases at most, by item size; more similar ones hardly ever.
BITS, BLOCK_BITS, RADIUS = 128, 16, 31
BLOCKS = BITS // BLOCK_BITS
#: Bytes of item text that one pass over the documents checks against. Items beyond it make
#: further passes, so what workers load is bounded and every item is checked.
PASS_BYTES = 16_000_000
_WORD = regex.compile(r"[\p{L}\p{N}\p{M}]+")
_VALUES = np.arange(1 << BLOCK_BITS, dtype=np.uint32)
#: All flips of a block within its share of the radius.
_FLIPS = _VALUES[np.bitwise_count(_VALUES) <= RADIUS // BLOCKS]
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def normal_words(text: str) -> list[str]:
    """Words of letters, marks and numerals, lower-cased; punctuation and layout are no part."""
    return _WORD.findall(text.lower())


class WordHasher:
    """64-bit word hashes, remembered within a bound."""

    def __init__(self, most: int = 200_000):
        self._known: dict[str, int] = {}
        self._most = most

    def __call__(self, words: list[str]) -> np.ndarray:
        known = self._known
        if len(known) > self._most:
            known.clear()
        out = list(map(known.get, words))
        if None in out:
            for i, w in enumerate(words):
                if out[i] is None:
                    out[i] = known[w] = xxhash.xxh64_intdigest(w)
        return np.array(out, np.uint64)


def shingle_hashes(words: np.ndarray, size: int = WORDS) -> np.ndarray:
    """Hashes of the word shingles in order; fewer words than a shingle form one."""
    if not len(words):
        return words
    n = max(1, len(words) - size + 1)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for k in range(min(size, len(words))):
            out = (out ^ (words[k : k + n] * _MULTIPLIERS[k % len(_MULTIPLIERS)])) * np.uint64(0xFF51AFD7ED558CCD)
            out ^= out >> np.uint64(32)
    return out


def weighted_similarity(a: Counter, b: Counter) -> float:
    """Shared weight over joint weight, weights being numbers of occurrences."""
    shared = sum(min(n, b[s]) for s, n in a.items() if s in b)
    total = sum(a.values()) + sum(b.values()) - shared
    return shared / total if total else 0.0


def window_fingerprints(hashes: np.ndarray, size: int) -> np.ndarray:
    """SimHash fingerprints of all windows of ``size`` consecutive shingles, two words each."""
    with np.errstate(over="ignore"):
        more = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    bits = np.unpackbits(np.stack([hashes, more ^ (more >> np.uint64(32))], axis=1).view(np.uint8), axis=1)
    sums = np.zeros((len(hashes) + 1, BITS), np.int32)
    np.cumsum(bits, axis=0, dtype=np.int32, out=sums[1:])
    return np.packbits((sums[size:] - sums[:-size]) * 2 > size, axis=1).view(np.uint64)


def least_shared(n: int) -> int:
    """Shingles that two windows of ``n`` share at least at the least similarity: eight ninths."""
    return -(-8 * n // 9)


class MultiIndex:
    """The fingerprints of items, by size and block value."""

    def __init__(self, sizes: np.ndarray, fingerprints: np.ndarray):
        self.fingerprints = fingerprints
        blocks = fingerprints.view(np.uint16).astype(np.uint64)
        self.taken, self.keys, self.items = [], [], []
        for b in range(BLOCKS):
            taken = np.zeros(1 << BLOCK_BITS, bool)
            taken[blocks[:, b].astype(np.int64)] = True
            keys = (sizes.astype(np.uint64) << np.uint64(BLOCK_BITS)) | blocks[:, b]
            order = np.argsort(keys, kind="stable")
            self.taken.append(taken)
            self.keys.append(keys[order])
            self.items.append(order)

    def pairs(self, size: int, windows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Block by block the (window, item) pairs that meet in it, items of ``size`` only."""
        blocks = windows.view(np.uint16)
        for b in range(BLOCKS):
            near = blocks[:, b].astype(np.uint32)[:, None] ^ _FLIPS[None, :]
            row, column = np.nonzero(self.taken[b][near])
            key = (np.uint64(size) << np.uint64(BLOCK_BITS)) | near[row, column].astype(np.uint64)
            first, last = (np.searchsorted(self.keys[b], key, side) for side in ("left", "right"))
            times = last - first
            row, first, times = row[times > 0], first[times > 0], times[times > 0]
            spread = np.repeat(first - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(int(times.sum())) if len(times) else first
            yield np.repeat(row, times), self.items[b][spread]

    def candidates(self, size: int, windows: np.ndarray, at_once: int = 1_024) -> tuple[np.ndarray, np.ndarray]:
        """Windows and items of ``size`` within the radius of one another, all of them."""
        rows, items = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for low in range(0, len(windows), at_once):
            part = windows[low : low + at_once]
            for row, item in self.pairs(size, part):
                close = np.bitwise_count(part[row] ^ self.fingerprints[item]).sum(axis=1) <= RADIUS
                rows.append(row[close] + low)
                items.append(item[close])
        met = np.unique(np.stack([np.concatenate(rows), np.concatenate(items)], axis=1), axis=0)
        return met[:, 0], met[:, 1]


class ItemIndex:
    """Benchmark items, ready to be looked for in documents. Items without a word never match."""

    def __init__(self, items: list[tuple[int, str]]):
        self.hash = WordHasher()
        # Items shorter than a shingle are one shingle of their own number of words.
        self.short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        self.ids, self.hashes = [], []
        for item_id, text in items:
            words = normal_words(text or "")
            hashes = shingle_hashes(self.hash(words))
            if 0 < len(words) < WORDS:
                self.short[len(words)][int(hashes[0])].append(item_id)
            elif len(words):
                self.ids.append(item_id)
                self.hashes.append(hashes)
        sizes = np.fromiter(map(len, self.hashes), np.int64, len(self.hashes))
        prints = np.array([window_fingerprints(h, len(h))[0] for h in self.hashes], np.uint64).reshape(-1, 2)
        self.index = MultiIndex(sizes, prints)
        owner, pool = np.repeat(np.arange(len(sizes)), sizes), np.concatenate([*self.hashes, np.empty(0, np.uint64)])
        self.known, place = np.unique(pool, return_inverse=True)
        # In how many items each shingle is; an item's anchors are its rarest shingles, so many that what is left
        # of the item could not match alone.
        pairs, weight = np.unique(np.stack([owner, place], axis=1), axis=0, return_counts=True)
        items_with = np.bincount(pairs[:, 1], minlength=len(self.known))
        order = np.lexsort((self.known[pairs[:, 1]], items_with[pairs[:, 1]], pairs[:, 0]))
        pairs, weight = pairs[order], weight[order]
        before = np.cumsum(weight) - weight
        before -= before[np.searchsorted(pairs[:, 0], pairs[:, 0])]
        # A document shorter than the item has at least four fifths of its shingles, and shares as many.
        anchors = pairs[before <= sizes[pairs[:, 0]] - -(-4 * sizes[pairs[:, 0]] // 5)]
        met = np.unique(np.stack([anchors[:, 1], sizes[anchors[:, 0]]], axis=1), axis=0)
        self.sizes_from, self.sizes_of = np.searchsorted(met[:, 0], np.arange(len(self.known) + 1)), met[:, 1]

    def find(self, text: str) -> list[tuple[int, int, float]]:
        """(item_id, first word of the best window, similarity) of every item that a window of
        its size matches; of equal windows the first."""
        words = self.hash(normal_words(text))
        best: dict[int, tuple[float, int]] = {}
        for n, table in self.short.items():
            if len(words) >= n:
                for at, h in enumerate(shingle_hashes(words, n).tolist()):
                    for item in table.get(h, ()):
                        best.setdefault(item, (1.0, -at))
        hashes = shingle_hashes(words) if len(words) >= WORDS else np.empty(0, np.uint64)
        if len(hashes) and len(self.known):
            places = np.searchsorted(self.known, hashes)
            places[places == len(self.known)] = 0
            shared = self.known[places] == hashes
            spans: dict[int, list[int]] = defaultdict(list)
            for p in np.flatnonzero(shared & (self.sizes_from[places + 1] > self.sizes_from[places])).tolist():
                for n in self.sizes_of[self.sizes_from[places[p]] : self.sizes_from[places[p] + 1]].tolist():
                    spans[n].append(p)
            covered = np.concatenate([[0], np.cumsum(shared)])
            for n, at in spans.items():
                if len(hashes) < n:
                    # A document shorter than the item is a window by itself.
                    if 9 * covered[-1] >= 4 * (n + len(hashes)):
                        self._check(hashes, np.zeros(1, np.int64), len(hashes), n, best)
                    continue
                starts = np.concatenate([np.arange(a, b) for a, b in _merged(at, n, len(hashes))])
                starts = starts[covered[starts + n] - covered[starts] >= least_shared(n)]
                if len(starts):
                    self._check(hashes, starts, n, n, best)
        return [(i, -at, s) for i, (s, at) in sorted(best.items())]

    def _check(self, hashes: np.ndarray, starts: np.ndarray, width: int, size: int, best: dict) -> None:
        """Windows of ``width`` shingles from the ascending ``starts`` against the items of ``size``."""
        for run in np.split(starts, np.flatnonzero(np.diff(starts) > width) + 1):
            for low in range(0, len(run), 50_000):
                part = run[low : low + 50_000]
                prints = window_fingerprints(hashes[part[0] : part[-1] + width], width)[part - part[0]]
                for row, k in zip(*(c.tolist() for c in self.index.candidates(size, prints))):
                    self._verify(hashes[part[row] : part[row] + width], int(part[row]), k, best)

    def _verify(self, window: np.ndarray, at: int, k: int, best: dict) -> None:
        value = weighted_similarity(Counter(window.tolist()), Counter(self.hashes[k].tolist()))
        if value >= SIMILARITY and (value, -at) > best.get(self.ids[k], (0.0, 0)):
            best[self.ids[k]] = (value, -at)


def _merged(at: list[int], n: int, total: int) -> list[tuple[int, int]]:
    """The starts of all windows of n shingles that hold one of the ascending places."""
    out: list[list[int]] = []
    for p in at:
        a, b = max(0, p - n + 1), min(p, total - n) + 1
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out if b > a]


def _passes(benchmark: DataFrame) -> list[DataFrame]:
    """The benchmark in parts of at most about PASS_BYTES of text."""
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // PASS_BYTES) or 1
    return [benchmark.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else benchmark for k in range(n)]


_MATCH = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("first_word", T.LongType()), T.StructField("similarity", T.DoubleType())]))


def with_matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", out: str = "matches") -> DataFrame:
    """Append to every row of ``docs`` the array of (item_id, first_word, similarity) of the
    items of ``benchmark`` (item_id, text) that it holds, empty if none. Whole texts are
    read; null and empty texts hold nothing; items without an id, a text or a word are left out; of
    items that repeat an id the best match counts. Other columns pass through, one named ``out``
    gives way. Where the items need several passes, each pass but the last is written to the shared
    folder, so that no task holds two indexes.
    """
    spark = docs.sparkSession
    items = benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    docs = docs.drop(out)
    parts, passes = [], _passes(items)
    for k, part in enumerate(passes):
        index = spark.sparkContext.broadcast([(r["item_id"], r["text"]) for r in part.collect()])
        parts.append(free_name(docs, f"{out}_{k}"))
        docs = _one_pass(docs, text, parts[-1], index)
        if k < len(passes) - 1:
            docs = materialize(docs, "matches")
    joined = F.concat(*parts) if len(parts) > 1 else F.col(parts[0])
    return docs.select(*(c for c in docs.columns if c not in parts), joined.alias(out))


def _one_pass(docs: DataFrame, text: str, out: str, items) -> DataFrame:
    token = uuid.uuid4().hex

    def run(column: pa.Array) -> list[pa.Array]:
        index = worker_table(f"items {token}", lambda: ItemIndex(items.value))
        found = [[{"item_id": i, "first_word": at, "similarity": s} for i, at, s in index.find(t)] for t in plain_texts(column)]
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("first_word", pa.int64()), ("similarity", pa.float64())]))
        return [pa.array(found, kind)]

    return row_map(docs, [text], run, T.StructType([T.StructField(out, _MATCH)]))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per match: (doc_id, item_id, first_word, similarity). Rows of ``docs`` that repeat each
    have theirs; documents without a match, and empty tables, give no row."""
    found = with_matches(docs.select("doc_id", "text"), benchmark).filter(F.size("matches") > 0)
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.item_id", "m.first_word", "m.similarity")
