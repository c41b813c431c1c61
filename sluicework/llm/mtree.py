"""Exact top-k inner products by best-first search over M-trees.

Inner products become distances by one more coordinate: a vector v gets sqrt(M^2 - |v|^2), M the
greatest length in its tree, a query gets 0; then |q - v|^2 = |q|^2 + M^2 - 2 q.v, and the
nearest vectors are those with the greatest products. Vectors are dealt into blocks of bounded
size, each with a paged M-tree: every node keeps a routing object, a covering radius and
the distances of its members to the routing object. A block of queries searches a tree together:
nodes are taken in the order of the least distance they can hold for any query still open there,
the stored distances rule out queries, nodes and members by the triangle inequality before their
own distance is computed, and what is left of a page is one matrix product.

The first tree is searched before the others; the k-th score that it gives each query is the limit
with which the others begin.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import materialize

SCALE = 64
PAGE = 128
#: Vectors in a tree and queries in a block, about.
TREE_VECTORS, QUERY_VECTORS = 8_192, 512
#: Slack of all distance bounds, relative to the greatest length: far above rounding errors.
_SLACK = 1e-7
#: Vectors of this squared length or more have products that a double may not hold exactly. They
#: are no part of the trees and are compared by whole numbers.
EXACT_SQUARE = 2.0**52
_LONG = np.iinfo(np.int64)


class Node:
    """A page: rows, or child pages with their routing objects and radii as arrays."""

    __slots__ = ("center", "radius", "children", "centers", "radii", "to_parent", "rows")

    def __init__(self, center, rows=None, children=None, radius=0.0, to_parent=None):
        self.center, self.rows, self.children, self.radius, self.to_parent = center, rows, children, radius, to_parent
        if children:
            self.centers, self.radii = np.array([c.center for c in children]), np.array([c.radius for c in children])


class MTree:
    """An M-tree over integer vectors, bulk-loaded: a page of more than PAGE members is split
    around members far from one another. ``computed`` counts the products that searches took."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        squares = (self.vectors**2).sum(axis=1)
        self.top = float(squares.max(initial=0.0))
        self._points = np.hstack([self.vectors, np.sqrt(np.maximum(self.top - squares, 0))[:, None]])
        self.same = _SLACK * (1.0 + np.sqrt(self.top))
        self.computed = 0
        self.root = self._load(np.arange(len(ids)))
        del self._points

    def _load(self, rows: np.ndarray) -> Node:
        points = self._points[rows]
        center = int(np.argmin(((points - points.mean(axis=0)) ** 2).sum(axis=1)))
        far = np.sqrt(((points - points[center]) ** 2).sum(axis=1))
        if len(rows) <= PAGE or far.max() <= self.same:
            return Node(int(rows[center]), rows=rows, radius=float(far.max(initial=0.0)), to_parent=far)
        # Pivots far apart, then every member to its nearest pivot.
        pivots, nearest, owner = [int(np.argmax(far))], None, np.zeros(len(rows), np.int64)
        for k in range(min(16, 1 + len(rows) // PAGE)):
            if k:
                if nearest.max() <= self.same:
                    break
                pivots.append(int(np.argmax(nearest)))
            d = np.sqrt(((points - points[pivots[-1]]) ** 2).sum(axis=1))
            closer = d < nearest if nearest is not None else np.ones(len(rows), bool)
            owner[closer] = k
            nearest = np.where(closer, d, nearest) if nearest is not None else d
        parts = [rows[owner == k] for k in range(len(pivots))]
        children = [self._load(part) for part in parts if len(part)]
        if len(children) == 1:
            return Node(int(rows[center]), rows=rows, radius=float(far.max()), to_parent=far)
        home = self._points[rows[center]]
        return Node(int(rows[center]), children=children, radius=float(far.max()), to_parent=np.array([np.sqrt(((self._points[c.center] - home) ** 2).sum()) for c in children]))

    def search(self, queries: np.ndarray, k: int, skip: np.ndarray, floors: np.ndarray | None = None) -> Best:
        """The k best rows of each query, greatest score first, ties to the smaller id. A row
        with a query's id in ``skip`` takes no part in that query, nor does one below its floor."""
        best = Best(len(queries), k, floors)
        base = (queries**2).sum(axis=1) + self.top
        slack = _SLACK * (1.0 + np.sqrt(base))

        def limits(who: np.ndarray) -> np.ndarray:
            # A tie may still come from exactly this distance; the slack lets it in.
            return np.where(np.isneginf(best.least[who]), np.inf, np.sqrt(np.maximum(0.0, base[who] - 2.0 * np.where(np.isneginf(best.least[who]), 0.0, best.least[who]))) + slack[who])

        def apart(who: np.ndarray, rows: np.ndarray) -> np.ndarray:
            self.computed += len(who) * len(rows)
            return np.sqrt(np.maximum(0.0, base[who][:, None] - 2.0 * (queries[who] @ self.vectors[rows].T)))

        everyone = np.arange(len(queries))
        at_root = apart(everyone, np.array([self.root.center]))[:, 0]
        queue, tick = [(0.0, 0, self.root, everyone, at_root, np.maximum(0.0, at_root - self.root.radius))], 0
        while queue:
            _, _, node, who, here, least = heapq.heappop(queue)
            open_ = least <= limits(who)
            who, here = who[open_], here[open_]
            if not len(who):
                continue
            # |d(q, parent) - d(parent, child)| bounds d(q, child) without computing it.
            limit = limits(who)[:, None]
            bound = np.abs(here[:, None] - node.to_parent[None, :])
            if node.rows is None:
                open_ = bound - node.radii <= limit
                some, places = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
                if not len(some):
                    continue
                d = apart(who[some], node.centers[places])
                least = np.maximum(0.0, d - node.radii[places])
                good = open_[np.ix_(some, places)] & (least <= limit[some])
                for j, place in enumerate(places.tolist()):
                    mine = np.flatnonzero(good[:, j])
                    if len(mine):
                        tick += 1
                        heapq.heappush(queue, (float(least[mine, j].min()), tick, node.children[place], who[some[mine]], d[mine, j], least[mine, j]))
                continue
            open_ = bound <= limit
            some, places = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
            if len(some):
                who, rows = who[some], node.rows[places]
                self.computed += len(who) * len(rows)
                best.offer(who, self.ids[rows], queries[who] @ self.vectors[rows].T, skip)
        return best


class Best:
    """The best (score, id) of each of some queries, kept as the search goes on."""

    def __init__(self, queries: int, k: int, floors: np.ndarray | None = None):
        self.k = k
        self.scores, self.ids = np.full((queries, k), -np.inf), np.zeros((queries, k), np.int64)
        self._floors = np.full(queries, -np.inf) if floors is None else floors
        self.least = self._floors.copy()

    def offer(self, who: np.ndarray, ids: np.ndarray, scores: np.ndarray, skip: np.ndarray) -> None:
        """Scores of the queries ``who`` with the rows of ``ids``."""
        row, column = np.nonzero((scores >= self.least[who][:, None]) & (ids[None, :] != skip[who][:, None]))
        if not len(row):
            return
        asked = np.unique(row)
        kept = self.scores[who[asked]]
        old_row, old_column = np.nonzero(~np.isneginf(kept))
        q = np.concatenate([row, asked[old_row]])
        s = np.concatenate([scores[row, column], kept[old_row, old_column]])
        i = np.concatenate([ids[column], self.ids[who[asked]][old_row, old_column]])
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        first = np.searchsorted(q, q)
        place = np.arange(len(q)) - first
        q, s, i, place = (x[place < self.k] for x in (q, s, i, place))
        self.scores[who[asked]] = -np.inf
        self.scores[who[q], place], self.ids[who[q], place] = s, i
        self.least[who[asked]] = np.maximum(self._floors[who[asked]], self.scores[who[asked], -1])

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, id, score) of all that is kept."""
        q, place = np.nonzero(~np.isneginf(self.scores))
        return q, self.ids[q, place], self.scores[q, place].astype(np.int64)


def exact_products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """The inner products of integer vectors of any size, beyond a long's range its ends."""
    bound = np.sqrt((rows.astype(float) ** 2).sum(axis=1)) * np.sqrt((query.astype(float) ** 2).sum())
    out = np.zeros(len(rows), np.int64)
    small = bound < 2.0**62
    out[small] = rows[small] @ query
    for n in np.flatnonzero(~small).tolist():
        out[n] = min(_LONG.max, max(_LONG.min, sum(a * b for a, b in zip(rows[n].tolist(), query.tolist()))))
    return out


def search_block(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, k: int, made: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query_id, vec_id, score): candidates of a block of queries among a block of rows, among
    them the k best of each query that are not below its floor. ``made`` keeps the tree of the
    rows between calls."""
    large, asked_large = ((v.astype(float) ** 2).sum(axis=1) >= EXACT_SQUARE for v in (vectors, queries))
    if not made:
        made = made if made is not None else []
        made.append(MTree(ids[~large], vectors[~large].astype(float)) if (~large).any() else None)
    out = []
    plain = np.flatnonzero(~asked_large)
    if made[0] is not None and len(plain):
        q, i, s = made[0].search(queries[plain].astype(float), k, query_ids[plain], floors[plain]).found()
        out.append((query_ids[plain][q], i, s))
    for n, (query_id, query) in enumerate(zip(query_ids.tolist(), queries)):
        mine = np.flatnonzero((ids != query_id) if asked_large[n] else large & (ids != query_id))
        if len(mine):
            scores = exact_products(vectors[mine], query)
            best = np.lexsort((ids[mine], -scores.astype(object) if scores.min(initial=0) == _LONG.min else -scores))[:k]
            out.append((np.full(len(best), query_id), ids[mine][best], scores[best]))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.empty(0, np.int64),) * 3


def top_k(rows: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """For each query the ``k`` greatest integer inner products with the rows of other ids.

    ``rows`` and ``queries`` have (vec_id, embedding); other columns are ignored. Components x
    count as floor(64 * x), beyond a long's range as its ends. Rows with a null id, a null vector, or
    null or non-finite components take no part; a shorter vector counts as padded with zeros. Vectors
    too long for exact products of doubles are compared by whole numbers; a score beyond a long's
    range counts as its end. Returns (query_id, rank, vec_id, score), ties to the smaller vec_id;
    rows that repeat an id each count, of queries that repeat one the least vector asks. An empty
    table gives an empty result. Queries and rows meet as blocks of bounded size: each pair of a tree
    and a query block is one search, nothing is gathered beyond ``k`` rows a query and tree.
    """
    x = F.transform("embedding", lambda v: F.floor(v.cast("double") * SCALE))
    fine = F.coalesce(~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf"))), F.lit(False))

    def usable(table: DataFrame) -> DataFrame:
        return table.filter(fine & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("v"))

    def dealt(table: DataFrame, n: int) -> DataFrame:
        placed = table.select(F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("long").alias("block"), F.struct(*table.columns).alias("row"))
        return placed.groupBy("block").agg(F.collect_list("row").alias("rows"))

    good, asking = materialize(usable(rows), "mtree-rows"), materialize(usable(queries).groupBy("vec_id").agg(F.min("v").alias("v")), "mtree-queries")
    n_trees, n_blocks = max(1, -(-good.count() // TREE_VECTORS)), max(1, -(-asking.count() // QUERY_VECTORS))
    trees = dealt(good, n_trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, tree, width = None, [], 0
        for batch in batches:
            for n in range(batch.num_rows):
                key = batch.column(0)[n].as_py()
                (ids, lists), (query_ids, query_lists) = _members(batch.column(1), n), _members(batch.column(2), n)
                floors = batch.column(2)[n].values.field(2).to_numpy(zero_copy_only=False).astype(float)
                wide = max(_width(lists), _width(query_lists))
                if key != name or wide != width:
                    name, tree, width = key, [], wide
                found = search_block(ids, _matrix(lists, wide), query_ids, _matrix(query_lists, wide), np.where(np.isnan(floors), -np.inf, floors), k, tree)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names=["query_id", "vec_id", "score"])

    def searched(asked: DataFrame, first: int, last: int) -> DataFrame:
        """The candidates of ``asked`` (vec_id, v, floor) in the trees from ``first`` to ``last``."""
        tasks = dealt(asked, n_blocks).select(F.col("rows").alias("questions"), F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"))).alias("block"))
        # Sorted by block at every size: the tasks repeat the queries for each tree, which no estimate
        # of their size counts, so a broadcast of them has no bound.
        met = trees.filter(F.col("block").between(first, last)).join(tasks.hint("merge"), "block").select("block", "rows", "questions")
        return met.mapInArrow(run, "query_id long, vec_id long, score long")

    found = materialize(searched(asking.withColumn("floor", F.lit(None).cast("double")), 0, 0), "mtree-first")
    if n_trees > 1:
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc()))
        # A double may round a score up; the double below the rounded one is surely not above it.
        floor = F.col("score").cast("double") - F.abs(F.col("score").cast("double")) * 1e-15
        kth = found.withColumn("_place", place).filter(F.col("_place") == k).select(F.col("query_id").alias("vec_id"), floor.alias("floor"))
        found = found.unionByName(searched(asking.join(kth, "vec_id", "left").select("vec_id", "v", "floor"), 1, n_trees - 1))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)


def _members(column: pa.ListArray, n: int) -> tuple[np.ndarray, pa.ListArray]:
    inside = column[n].values
    return inside.field(0).to_numpy(zero_copy_only=False), inside.field(1)


def _width(lists: pa.ListArray) -> int:
    return max(1, pc.max(lists.value_lengths()).as_py() or 0)


def _matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    """The vectors as rows of whole numbers, shorter ones padded with zeros."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out
