"""SimHash near-duplicate groups by pigeonring candidate chains.

A 64-bit fingerprint is a ring of four 16-bit segments. Two fingerprints at 3 or fewer
differing bits have, for some start segment, a chain of consecutive segments whose cumulative
differences stay within the proportional budgets 0, 1, 2 and 3. The first two links of that
chain are made equality keys (the second segment's single flips are enumerated on the side with
odd parity), so a key holds 32 bits and the number of candidates stays linear far beyond the
size at which plain 16-bit blocks turn quadratic. The other links prune before the full check.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import binary_texts, drop_worker_tables, heavy_join, keep, materialize, release, row_map, scratch_scope
from .components import connected_components
from .decontaminate import WordHasher, shingle_hashes

RADIUS = 3
SEGMENTS = 4
SEGMENT_BITS = 16
#: A key with more distinct fingerprints than this leaves the in-task forest for the distributed one.
FOREST_LIMIT = 32_768
_CHUNK = 65_536


def fingerprint(text: bytes, words_per_shingle: int = 3) -> int:
    """The SimHash of one text as a signed 64-bit integer.

    Words are runs of bytes other than ASCII white space, A to Z lower-cased. Shingles repeat
    as often as they occur; a text shorter than a shingle is one shingle, an empty text is 0.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_digest
    if len(words) <= words_per_shingle:
        return int.from_bytes(digest(joined, 42), "big", signed=True)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    total = len(words) - words_per_shingle + 1
    counts = np.zeros(64, np.int64)
    for at in range(0, total, _CHUNK):
        to = min(total, at + _CHUNK)
        hashes = b"".join([digest(joined[a : b - 1], 42) for a, b in zip(starts[at:to], ends[at + words_per_shingle - 1 : to + words_per_shingle - 1])])
        counts += np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(counts * 2 > total).tobytes(), "big", signed=True)


def with_fingerprints(docs: DataFrame, text: str = "text", out: str = "fp", words_per_shingle: int = 3) -> DataFrame:
    """Append the fingerprint of ``text`` as a long. A null text counts as an empty one."""

    def run(column: pa.Array) -> list[pa.Array]:
        return [pa.array([fingerprint(t, words_per_shingle) for t in binary_texts(column)], pa.int64())]

    return row_map(docs, [text], run, T.StructType([T.StructField(out, T.LongType())]))


def _ring(fp: Column, start: int) -> Column:
    """The fingerprint rotated so that segment ``start`` comes first."""
    bits = SEGMENT_BITS * start
    return fp if not bits else F.shiftleft(fp, bits).bitwiseOR(F.shiftrightunsigned(fp, 64 - bits))


def chain_keys(fp: Column) -> Column:
    """All keys of a fingerprint: start segment, its 16 bits and the next segment's 16 bits.

    Fingerprints whose next segment has odd parity also give the 16 single flips of it: two
    next segments one bit apart have different parity, so exactly one side flips.
    """
    arrays = []
    for start in range(SEGMENTS):
        key = F.shiftrightunsigned(_ring(fp, start), 32).bitwiseOR(F.lit(start << 32).cast("long"))
        odd = (F.bit_count(key.bitwiseAND(F.lit(0xFFFF).cast("long"))) % 2) == 1
        flips = F.array(key, *(key.bitwiseXOR(F.lit(1 << b).cast("long")) for b in range(SEGMENT_BITS)))
        arrays.append(F.when(odd, flips).otherwise(F.array(key)))
    return F.concat(*arrays)


def chain_viable(difference: np.ndarray, start: np.ndarray | int) -> np.ndarray:
    """Which XORs keep every prefix of the chain from ``start`` within its budget, then the
    whole Hamming distance within the radius. Later links are only looked at where the
    earlier ones hold."""
    start = np.broadcast_to(np.asarray(start, np.uint64), difference.shape)
    turn = start * np.uint64(SEGMENT_BITS)
    back = (np.uint64(64) - turn) & np.uint64(63)
    ring = np.where(turn == 0, difference, (difference << turn) | (difference >> back))
    ok = np.ones(difference.shape, bool)
    for links in range(1, SEGMENTS + 1):
        live = np.flatnonzero(ok)
        part = ring[live] >> np.uint64(64 - SEGMENT_BITS * links)
        ok[live] = np.bitwise_count(part) <= RADIUS * links // SEGMENTS
    return ok


def spanning_forest(fps: np.ndarray, start: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that connect exactly what the viable pairs of one key connect, one less than the
    members of each connected set: never all pairs of a group."""
    ends_a, ends_b = [], []
    left = fps
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            near = chain_viable(left ^ queue[-1], start)
            at = queue.pop()
            if near.any():
                hit = left[near]
                ends_a.append(np.full(len(hit), at, np.uint64))
                ends_b.append(hit)
                queue.extend(hit)
                left = left[~near]
    return ends_a, ends_b


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64())])


def _links_of_runs(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by key: a row per link, and the rows of runs of more than ``limit`` with b null."""
    none = np.empty(0, np.uint64)
    keys, fps, spilling = none, none, None

    def emit(a: list, b: list) -> pa.RecordBatch:
        a, b = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], schema=_LINKS)

    def spilled(values: np.ndarray, key: np.uint64) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.nulls(len(values), pa.int64()), pa.array(np.full(len(values), key, np.uint64).view(np.int64))], schema=_LINKS)

    def settle(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        first = np.concatenate([[0], cuts]).astype(np.int64)
        size = np.diff(np.concatenate([first, [len(keys)]]))
        twos = first[size == 2]
        ok = chain_viable(fps[twos] ^ fps[twos + 1], keys[twos] >> np.uint64(32))
        a, b = [fps[twos][ok]], [fps[twos + 1][ok]]
        for at, n in zip(first[size > 2].tolist(), size[size > 2].tolist()):
            more_a, more_b = spanning_forest(fps[at : at + n], int(keys[at]) >> 32)
            a += more_a
            b += more_b
        yield emit(a, b)

    for batch in batches:
        new_keys = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        new_fps = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        if spilling is not None:
            n = int(np.searchsorted(new_keys, spilling, side="right"))
            yield spilled(new_fps[:n], spilling)
            new_keys, new_fps = new_keys[n:], new_fps[n:]
            if not len(new_keys):
                continue
            spilling = None
        keys, fps = np.concatenate([keys, new_keys]), np.concatenate([fps, new_fps])
        last = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
        if last:
            yield from settle(keys[:last], fps[:last])
            keys, fps = keys[last:], fps[last:]
        if len(keys) > limit:
            spilling = keys[0]
            yield spilled(fps, spilling)
            keys, fps = none, none
    if len(keys):
        yield from settle(keys, fps)


def _ring_from(fp: Column, start: Column) -> Column:
    ring = F.when(start == 0, fp)
    for k in range(1, SEGMENTS):
        ring = ring.when(start == k, _ring(fp, k))
    return ring


def _smaller_keys(rows: DataFrame) -> DataFrame:
    """The members of large keys under keys of their own: members of a key agree on the start
    segment, and of four equal parts of the other 48 bits, two within the radius agree on one."""
    start = F.shiftright("key", 32)
    parts = F.array(*(F.struct(F.lit(j).alias("j"), F.shiftrightunsigned("ring", 12 * j).bitwiseAND(F.lit(0xFFF).cast("long")).alias("bits")) for j in range(4)))
    each = rows.select("a", "key", start.alias("start"), _ring_from(F.col("a"), start).alias("ring")).select("a", "key", "start", F.explode(parts).alias("p"))
    low = F.xxhash64("key", "p.j", "p.bits").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    return each.select(F.shiftleft(F.col("start").cast("long"), 32).bitwiseOR(low).alias("key"), F.col("a").alias("fp"))


def _large_key_links(rows: DataFrame) -> DataFrame:
    """The exact way for keys that are too large for one task even when parted. Members of a key agree on the start
    segment; each is dealt under every choice of 3 of the other 48 bits, cleared. Members
    dealt alike differ in those bits only, so all are linked to the smallest of them: rows
    grow with the members, not with their pairs."""
    start = F.shiftright("key", 32)
    dealt = (
        rows.select("a", start.alias("start"), _ring_from(F.col("a"), start).alias("ring")).distinct()
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(45))))
        .withColumn("j", F.explode(F.sequence(F.col("i") + 1, F.lit(46))))
        .withColumn("k", F.explode(F.sequence(F.col("j") + 1, F.lit(47))))
    )
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.col(c))
    mask = bit("i").bitwiseOR(bit("j")).bitwiseOR(bit("k"))
    dealt = dealt.select("a", "start", mask.alias("mask"), F.col("ring").bitwiseAND(F.bitwise_not(mask)).alias("rest"))
    hubs = dealt.groupBy("start", "mask", "rest").agg(F.min("a").alias("b"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return dealt.join(hubs, ["start", "mask", "rest"]).filter("a <> b").select("a", "b")


def fingerprint_links(fps: DataFrame, forest_limit: int = FOREST_LIMIT) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect exactly what all pairs at
    RADIUS or fewer differing bits connect. A key of more than ``forest_limit`` fingerprints is
    parted into smaller ones, and what is still too large goes the way without runs."""

    def linked(keyed: DataFrame) -> DataFrame:
        dealt = keyed.repartition("key").sortWithinPartitions("key")
        return materialize(dealt.mapInArrow(lambda batches: _links_of_runs(batches, forest_limit), "a long, b long, key long"), "simhash-links")

    found = linked(fps.select(F.explode(chain_keys(F.col("fp"))).alias("key"), "fp"))
    links = found.filter("b is not null").select("a", "b")
    large = found.filter("b is null").select("a", "key")
    if large.isEmpty():
        return links
    parted = linked(_smaller_keys(large).distinct())
    links = links.unionByName(parted.filter("b is not null").select("a", "b"))
    rest = parted.filter("b is null").select("a", "key")
    return links if rest.isEmpty() else links.unionByName(_large_key_links(rest))


def near_duplicate_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words_per_shingle: int = 3) -> DataFrame:
    """One row per document: (doc_id, fingerprint as 16 hex digits, component_id).

    component_id is the smallest doc_id that links at RADIUS or fewer bits can reach. Exact
    copies meet as one fingerprint before any join. Null and empty texts share fingerprint 0
    and so one component. A row without a doc_id has no component and links nothing; rows
    that repeat a doc_id each keep their row. Other columns are ignored; an empty table gives
    an empty result.
    """
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    with scratch_scope(docs.sparkSession):
        hashed = keep(materialize(with_fingerprints(texts, "text", words_per_shingle=words_per_shingle).select("doc_id", "fp"), "simhash-fp"))
        named, nameless = hashed.filter("doc_id is not null"), hashed.filter("doc_id is null")
        total = named.count()
        groups = materialize(named.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "simhash-groups")
        links = fingerprint_links(groups.select("fp"))
        reps = groups.select("fp", "rep")
        met = (
            links.join(reps.select(F.col("fp").alias("a"), F.col("rep").alias("rep_a")), "a")
            .join(reps.select(F.col("fp").alias("b"), F.col("rep").alias("rep_b")), "b")
            .select("rep_a", "rep_b")
        )
        # A repeated doc_id with different texts is one node: its fingerprints belong together.
        repeats = named.groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi"), F.count("*").alias("n")).filter("lo <> hi").select("doc_id", "n")
        repeats = materialize(repeats, "simhash-repeats")
        mine = heavy_join(named, repeats, "doc_id", "n", total).distinct().join(reps, "fp").select(F.col("doc_id").alias("rep_a"), F.col("rep").alias("rep_b"))
        roots = connected_components(met.unionByName(mine), "rep_a", "rep_b")
        placed = groups.join(roots, groups["rep"] == roots["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"), "n")
        placed = keep(materialize(placed, "simhash-placed"))
    hex_digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    # Empty texts, or copies of one text, may be a third of all rows.
    out = heavy_join(named, placed, "fp", "n", total).unionByName(nameless.select("doc_id", "fp", F.lit(None).cast(placed.schema["component_id"].dataType).alias("component_id")))
    return out.select("doc_id", hex_digits.alias("fingerprint"), "component_id")


# -- texts by similarity -------------------------------------------------------------------------

#: Least similarity of linked texts: shared distinct shingles over all distinct shingles.
SIMILARITY = 0.8
#: Bands of rows of least hashes: texts at the least similarity share a band in 99.9 % of cases.
BANDS, BAND_ROWS = 20, 5
#: Cells of the sketch that prunes candidates, and how far below the mark it may read: more than
#: four of its deviations. What it leaves is compared shingle by shingle.
CELLS, SKETCH_SLACK = 1024, 0.06
#: Texts at the least similarity differ in 10 of 64 fingerprint bits on average, and by more than
#: this once in 100,000 pairs; what lies beyond is pruned before the sketches are compared. Texts
#: of few shingles scatter more, so no pair with one of FEW_SHINGLES or fewer is pruned.
TEXT_RADIUS, FEW_SHINGLES = 22, 128
_MIX = np.random.default_rng(0x51).integers(1, 2**63, (2, BANDS * BAND_ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
_TEXT = pa.schema([("doc_id", pa.int64()), ("content", pa.int64()), ("keys", pa.list_(pa.int64())), ("text", pa.binary())])


def text_shingles(text: bytes, hasher: WordHasher, words_per_shingle: int = 5) -> np.ndarray:
    """The sorted distinct shingle hashes of a whole text."""
    return np.unique(shingle_hashes(hasher(text.lower().split()), words_per_shingle))


def text_keys(text: bytes, hasher: WordHasher, words_per_shingle: int = 5) -> tuple[int, list[int]]:
    """(content, band keys) of a whole text; content is alike where the words are. A text
    without words has content 0 and no keys."""
    words = text.lower().split()
    if not words:
        return 0, []
    content = int.from_bytes(xxhash.xxh3_64_digest(b" ".join(words)), "big", signed=True)
    distinct = text_shingles(text, hasher, words_per_shingle)
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(distinct), 2_048):
        np.minimum(least, ((distinct[at : at + 2_048] ^ _MIX[0]) * _MIX[1]).min(axis=1), out=least)
    band = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, BAND_ROWS).T:
        band = (band ^ column) * np.uint64(0x9E3779B97F4A7C15)
        band ^= band >> np.uint64(29)
    return content, band.view(np.int64).tolist()


def set_fingerprint(distinct: np.ndarray) -> int:
    """The SimHash of a set of shingle hashes: over distinct ones, as the similarity is, so that
    repeats do not move it."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(distinct), _CHUNK):
        counts += np.unpackbits(distinct[at : at + _CHUNK].view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(counts * 2 > len(distinct)).tobytes(), "big", signed=True)


def set_sketch(distinct: np.ndarray) -> np.ndarray:
    """Of each cell of the hash range the least of the sorted hashes, as a byte; 0 where the
    cell is empty."""
    sketch = np.zeros(CELLS, np.uint8)
    cells = (distinct >> np.uint64(54)).astype(np.int64)
    first = np.flatnonzero(np.diff(cells, prepend=-1))
    sketch[cells[first]] = distinct[first] % np.uint64(255) + np.uint64(1)
    return sketch


def sketch_similarity(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The similarity of a sketch with others, over the cells that either text fills."""
    filled = (many | one) != 0
    same = ((many == one) & filled).sum(axis=1)
    return (same / np.maximum(filled.sum(axis=1), 1) - 1 / 255) / (1 - 1 / 255)


def ring_viable(difference: np.ndarray, radius: int) -> np.ndarray:
    """Which XORs have, from some start segment, a chain around the ring whose cumulative
    differences all stay within their proportional budgets. All within the radius have one."""
    parts = np.stack([np.bitwise_count((difference >> np.uint64(SEGMENT_BITS * s)) & np.uint64(0xFFFF)) for s in reversed(range(SEGMENTS))]).astype(np.int64)
    ok = np.zeros(difference.shape, bool)
    for start in range(SEGMENTS):
        chain = np.cumsum(np.roll(parts, -start, axis=0), axis=0)
        ok |= (chain <= np.array([radius * n // SEGMENTS for n in range(1, SEGMENTS + 1)])[:, None]).all(axis=0)
    return ok


def exact_similarity(one: np.ndarray, many: list[np.ndarray]) -> np.ndarray:
    """Shared over all shingles of a sorted set with each of some others, none empty."""
    sizes = np.array([len(m) for m in many])
    pool = np.concatenate(many)
    same = one[np.minimum(np.searchsorted(one, pool), len(one) - 1)] == pool
    shared = np.add.reduceat(same, np.cumsum(sizes) - sizes, dtype=np.int64)
    return shared / (sizes + len(one) - shared)


class TextRows:
    """Texts to compare: content, fingerprint, sketch and shingle set of each."""

    def __init__(self, contents: np.ndarray, fps: np.ndarray, sets: list[np.ndarray]):
        self.contents, self.fps, self.sets = contents, fps, sets
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.sketches = np.stack([set_sketch(s) for s in sets]) if sets else np.empty((0, CELLS), np.uint8)

    def similar(self, at: int, others: np.ndarray, similarity: float) -> np.ndarray:
        """Which of ``others``, by place in it, are similar to the text at ``at``. Fingerprint
        and sketch only prune; the shingles decide."""
        near = np.flatnonzero(ring_viable(self.fps[others] ^ self.fps[at], TEXT_RADIUS) | (np.minimum(self.sizes[others], self.sizes[at]) <= FEW_SHINGLES))
        near = near[sketch_similarity(self.sketches[at], self.sketches[others[near]]) >= similarity - SKETCH_SLACK]
        hit = [near[:0]]
        for to in range(0, len(near), 256):
            part = near[to : to + 256]
            hit.append(part[exact_similarity(self.sets[at], [self.sets[i] for i in others[part]]) >= similarity])
        return np.concatenate(hit)


_SIMILAR = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64())])
#: Members of a key that are compared in one task. A larger key is dealt in parts of about this
#: size, then one text of each set that a part links is compared with those of the other parts.
#: What is not one component after that is compared text by text, in blocks.
RUN_LIMIT = 2_048
#: Bytes of text of a key, or of a block, that one task holds.
RUN_BYTES = 32 << 20


def _similar_of_runs(similarity: float):
    """Over rows (key, part, content, fp, shingles, again) sorted by key and part: links (a, b) that
    connect what the similar pairs of a part connect, and, where ``again``, a row (root, null,
    key) for each connected set. A run that is longer than planned goes on with its roots."""

    def forest(rows: TextRows, left: np.ndarray, links: list) -> np.ndarray:
        roots = []
        while len(left):
            roots.append(left[0])
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                at = queue.pop()
                near = rows.similar(at, left, similarity)
                if len(near):
                    hit = left[near]
                    links.append((np.full(len(hit), rows.contents[at]), rows.contents[hit]))
                    queue.extend(hit.tolist())
                    left = np.delete(left, near)
        return np.array(roots)

    def ends(rows: tuple) -> np.ndarray:
        return np.flatnonzero((rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.int64)
        held = (none, none, none, none.view(np.uint64), none.astype(object), none.astype(bool))
        goal = 2 * RUN_LIMIT

        def settle(rows: tuple, links: list) -> tuple:
            cuts = ends(rows).tolist()
            kept = []
            for at, end in zip([0, *cuts], [*cuts, len(rows[0])]):
                texts = TextRows(rows[2][at:end], rows[3][at:end], list(rows[4][at:end]))
                kept.append(at + forest(texts, np.arange(end - at), links))
            kept = np.concatenate(kept)
            return tuple(c[kept] for c in rows)

        def out(links: list, done: list) -> pa.RecordBatch:
            a, b = (np.concatenate(c) for c in zip(*links)) if links else (none, none)
            roots, keys = (np.concatenate(c) for c in zip(*((r[2][r[5]], r[0][r[5]]) for r in done))) if done else (none, none)
            columns = [np.concatenate([a, roots]), pa.concat_arrays([pa.array(b), pa.nulls(len(roots), pa.int64())]), pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(keys)])]
            return pa.RecordBatch.from_arrays([pa.array(columns[0]), *columns[1:]], schema=_SIMILAR)

        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            new[3] = new[3].view(np.uint64)
            new += [_sets(batch.column(4)), batch.column(5).to_numpy(zero_copy_only=False)]
            held = tuple(np.concatenate(c) for c in zip(held, new))
            links, done = [], []
            cuts = ends(held)
            if len(cuts):
                last = int(cuts[-1])
                done.append(settle(tuple(c[:last] for c in held), links))
                held, goal = tuple(c[last:] for c in held), 2 * RUN_LIMIT
            if len(held[0]) > goal:
                held = settle(held, links)
                goal = len(held[0]) + 2 * RUN_LIMIT
            yield out(links, done)
        links, done = [], []
        if len(held[0]):
            done.append(settle(held, links))
        yield out(links, done)

    return run


def _similar_of_blocks(similarity: float):
    """Over rows (key, part, content, fp, shingles, block, component) sorted by key and part, a part
    being one or two blocks: links that connect all components that similar pairs connect. Pairs
    of two blocks are compared across, those of one block among themselves."""

    def settle(rows: list[tuple], links: list) -> None:
        contents, fps, sets, blocks, components = zip(*rows)
        texts = TextRows(np.array(contents), np.array(fps, np.int64).view(np.uint64), list(sets))
        blocks, components = np.array(blocks), np.array(components)
        low, high = np.flatnonzero(blocks == blocks.min()), np.flatnonzero(blocks == blocks.max())
        for place, at in enumerate(low):
            others = high if blocks.min() != blocks.max() else low[place + 1 :]
            others = others[components[others] != components[at]]
            if len(others):
                for hit in others[texts.similar(at, others, similarity)]:
                    if components[hit] != components[at]:
                        links.append((contents[at], contents[hit]))
                        components[components == components[hit]] = components[at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            links: list = []
            columns = [batch.column(i).to_pylist() for i in (0, 1, 2, 3, 5, 6)]
            for key, part, content, fp, block, component, shingles in zip(*columns, _sets(batch.column(4))):
                if (key, part) != now:
                    if held:
                        settle(held, links)
                    now, held = (key, part), []
                held.append((content, fp, shingles, block, component))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*links) if links else ((), ()))], names=["a", "b"])
        links = []
        if held:
            settle(held, links)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*links) if links else ((), ()))], names=["a", "b"])

    return run


def _block_places(members: DataFrame) -> DataFrame:
    """Places (c, rep, key, part, block, component) in which all pairs of a key's members (key, c,
    rep, size, component) meet that differ in component.

    The largest component of a key needs no comparison with itself, so it is dealt once for each
    block of the others, and a key of one component has no place at all.
    """
    sizes = members.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    split = sizes.groupBy("key").agg(F.max(F.struct("n", "component", "bytes")).alias("most"), F.count("*").alias("sets"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).filter("sets > 1")
    blocks = lambda n, size: F.expr(f"greatest(({n}) div {2 * RUN_LIMIT}, ({size}) div {RUN_BYTES}) + 1")
    split = split.select("key", F.col("most.component").alias("main"), blocks("most.n", "most.bytes").alias("large"), blocks("n - most.n", "bytes - most.bytes").alias("rest"))
    rows = members.join(split.hint("merge"), "key").withColumn("is_main", F.col("component") == F.col("main"))
    # Blocks of the rest come first: each of them meets itself and every later block.
    rows = rows.withColumn("block", F.when(F.col("is_main"), F.col("rest") + F.pmod(F.xxhash64("c"), "large")).otherwise(F.pmod(F.xxhash64("c"), "rest")))
    last = F.when(F.col("is_main"), F.col("rest") - 1).otherwise(F.col("rest") + F.col("large") - 1)
    met = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    part = F.least("block", "other") * (F.col("rest") + F.col("large")) + F.greatest("block", "other")
    return met.select("c", "rep", "key", part.alias("part"), "block", "component")


def _sets(column: pa.Array) -> np.ndarray:
    """The shingle sets of a binary column, each an array of its own."""
    out = np.empty(len(column), object)
    for i, value in enumerate(column):
        out[i] = np.frombuffer(value.as_py(), np.uint64)
    return out


def similar_text_groups(docs: DataFrame, words_per_shingle: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document with an id: (doc_id, component_id), texts linked where they share
    ``similarity`` of their distinct word shingles.

    A fingerprint radius of 3 is far below what such texts differ by, and segment keys for a radius
    that is not would select next to nothing. So candidates share a band of least hashes; the ring
    filter at TEXT_RADIUS and a sketch of CELLS cells prune them, and the shingles of both texts
    decide. A key of more than RUN_LIMIT texts is compared in parts, then the parts by one text of
    each set found, then all texts that are not in one component. Texts of the same words meet as one before any
    join; null and empty texts are alike. Rows without an id are left out, rows that repeat an
    id are one document. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_worker_tables()
        hasher = WordHasher()
        for batch in batches:
            made = [text_keys(t, hasher, words_per_shingle) for t in binary_texts(batch.column(1))]
            contents, keys = zip(*made) if made else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(contents, pa.int64()), pa.array(keys, pa.list_(pa.int64())), batch.column(1)], schema=_TEXT)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_worker_tables()
        hasher = WordHasher()
        for batch in batches:
            sets = [text_shingles(t, hasher, words_per_shingle) for t in binary_texts(batch.column(1))]
            columns = [batch.column(0), pa.array([set_fingerprint(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()), batch.column(2)]
            yield pa.RecordBatch.from_arrays(columns, names=["content", "fp", "shingles", "places"])

    rows = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    written = materialize(rows.mapInArrow(run, "doc_id long, content long, keys array<long>, text binary"), "similar-texts")
    copies = materialize(written.groupBy("content").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "similar-reps")
    total, reps = written.count(), copies.select("content", "rep")
    # Joined by document as well, so that copies of one text are dealt over all partitions.
    owned = [F.col("content") == F.col("c"), F.col("doc_id") == F.col("rep")]
    owner = reps.select(F.col("content").alias("c"), "rep").hint("merge")
    sized = written.select("doc_id", "content", "keys", F.octet_length("text").cast("long").alias("size"))
    keys = materialize(sized.join(owner, owned, "left_semi").select("content", "doc_id", "keys", "size").dropDuplicates(["content", "doc_id"]), "similar-keys")
    keyed = keys.select(F.explode("keys").alias("key"), "content", F.col("doc_id").alias("rep"), "size")
    members = keyed.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.bit_xor("content").alias("x"), F.bit_xor(F.xxhash64("content")).alias("y"))
    # Keys with the same members have the same pairs: one of them is enough.
    many = members.filter("n > 1").groupBy("n", "x", "y").agg(F.min(F.struct("key", "bytes")).alias("m")).select("m.*", "n")
    parts = F.expr(f"greatest(n div {RUN_LIMIT + 1}, bytes div {RUN_BYTES}) + 1").alias("parts")
    met = keyed.join(many.hint("merge"), "key").select("key", F.col("content").alias("c"), "rep", "size", parts)
    texts = written.select("doc_id", "content", "text").dropDuplicates(["content", "doc_id"])

    def measured(places: DataFrame) -> DataFrame:
        """The columns of ``places`` (c, rep, key, part and more) with content, fp and shingles.
        A text is measured once, however many places it has."""
        others = [c for c in places.columns if c not in ("c", "rep")]
        listed = places.groupBy("c", "rep").agg(F.collect_list(F.struct(*others)).alias("places"))
        met = texts.join(listed.hint("merge"), owned).select("content", "text", "places")
        out = T.StructType([T.StructField("content", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("shingles", T.BinaryType()), met.schema["places"]])
        made = met.mapInArrow(measure, out)
        return made.select(F.explode("places").alias("p"), "content", "fp", "shingles").select("p.*", "content", "fp", "shingles")

    run_columns = ["key", "part", "content", "fp", "shingles", "again"]
    compare = "a long, b long, key long"
    first = measured(met.select("c", "rep", "key", F.pmod(F.xxhash64("c"), "parts").alias("part"), (F.col("parts") > 1).alias("again")))
    first = first.select(*run_columns).repartition("key", "part").sortWithinPartitions("key", "part")
    found = materialize(first.mapInArrow(_similar_of_runs(similarity), compare).distinct(), "similar-links")
    links = found.filter("b is not null").select("a", "b")
    large = met.filter("parts > 1").drop("parts")
    roots = found.filter("b is null").select(F.col("a").alias("c"), "key").join(large.hint("merge"), ["key", "c"])
    dealt = not roots.isEmpty()
    if dealt:
        left = roots.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).select("key", parts)
        part = F.pmod(F.xxhash64("c", F.lit(1)), "parts").alias("part")
        rest = measured(roots.join(left.hint("merge"), "key").select("c", "rep", "key", part, F.lit(False).alias("again"))).select(*run_columns)
        links = links.unionByName(rest.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(_similar_of_runs(similarity), compare).select("a", "b"))

    def by_rep(links: DataFrame) -> DataFrame:
        ends = links.join(reps.select(F.col("content").alias("a"), F.col("rep").alias("rep_a")), "a")
        return ends.join(reps.select(F.col("content").alias("b"), F.col("rep").alias("rep_b")), "b").select("rep_a", "rep_b")

    # Documents of the same words, and one id with several texts, are links of their own.
    mine = heavy_join(written.select("doc_id", "content"), copies, "content", "n", total).filter("doc_id <> rep").select(F.col("doc_id").alias("rep_a"), F.col("rep").alias("rep_b"))
    roots = connected_components(by_rep(links).unionByName(mine), "rep_a", "rep_b")
    if dealt:
        named = large.join(roots.hint("merge"), F.col("rep") == F.col("node"), "left").select("key", "c", "rep", "size", F.coalesce("component", "rep").alias("component"))
        blocks = measured(_block_places(named)).select("key", "part", "content", "fp", "shingles", "block", "component")
        across = blocks.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(_similar_of_blocks(similarity), "a long, b long")
        across = materialize(across, "similar-across")
        if not across.isEmpty():
            known = roots.select(F.col("node").alias("rep_a"), F.col("component").alias("rep_b"))
            roots = connected_components(known.unionByName(by_rep(across)), "rep_a", "rep_b")
        release(across)
    ids = written.select("doc_id").distinct()
    placed = materialize(ids.join(roots, ids["doc_id"] == roots["node"], "left").select("doc_id", F.coalesce("component", "doc_id").alias("component_id")), "similar-groups")
    release(written, copies, keys, found)
    return placed
