"""Document quality by an interpolated modified Kneser-Ney character n-gram model.

The model is trained on trusted texts: n-grams of ORDER characters are counted over all of
them, lower orders take continuation counts (how many different characters precede), and each
order's probabilities come from joins of count tables sharded by context and by suffix. The
model stays in shards, one sorted table an order; the n-grams of each block of documents are
joined with the shards that hold them, the same way at every size. Each half of the documents is
scored by the model of the trusted ones in the other half, so that no text is met by a model that has
seen it, and a document's perplexity is compared with a quantile of all trusted documents of its
language.

An n-gram is one long: 16 bits a character, so contexts and suffixes are shifts and masks. A
character beyond the basic plane is two units, as in UTF-16; a text begins with ORDER - 1 marks.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import heavy_join, keep, materialize, row_map, scratch_scope, text_groups, worker_table
from .shards import HELD_ROWS, ShardList, Shards, write_shards

ORDER = 4
BITS = 16
START = 0x0002
_COMPACT = 4_000_000
HALVES = 2
#: How many documents of its own a language needs to count for as much as all languages together.
LEAN = 50


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2")


def gram_keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The highest-order n-gram that ends at each unit of each text, and the number of units of
    each text."""
    coded, pads = [_codes(t) for t in texts], ORDER - 1
    sizes = np.fromiter(map(len, coded), np.int64, len(texts))
    line = np.full(int(sizes.sum()) + pads * len(texts), START, np.uint64)
    real = np.ones(len(line), bool)
    at = 0
    for units, n in zip(coded, sizes.tolist()):
        real[at : at + pads] = False
        line[at + pads : at + pads + n] = units
        at += pads + n
    ends = np.flatnonzero(real)
    keys = np.zeros(len(ends), np.uint64)
    for k in range(ORDER):
        keys = (keys << np.uint64(BITS)) | line[ends - (ORDER - 1 - k)]
    return keys, sizes


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over (text, half): rows (half, gram, n), a few for each n-gram of a half."""
    open_: dict[int, tuple[list, list]] = {}
    for batch in batches:
        halves = batch.column(1).to_numpy(zero_copy_only=False)
        for half in np.unique(halves).tolist():
            keys, counts = open_.setdefault(half, ([], []))
            for group in text_groups(batch.column(0).filter(pa.array(halves == half))):
                k, n = np.unique(gram_keys(group)[0], return_counts=True)
                keys.append(k)
                counts.append(n)
                if sum(map(len, keys)) > _COMPACT:
                    k, n = _merge(keys, counts)
                    keys.clear()
                    counts.clear()
                    if len(k) > _COMPACT // 2:
                        yield _counted(half, k, n)
                    else:
                        keys.append(k)
                        counts.append(n)
    for half, (keys, counts) in open_.items():
        if keys:
            yield _counted(half, *_merge(keys, counts))


def _merge(keys: list, counts: list) -> tuple[np.ndarray, np.ndarray]:
    k, where = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(where, np.concatenate(counts), len(k)).astype(np.int64)


def _counted(half: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), half)), pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], names=["half", "gram", "n"])


def discounts(of_counts: dict[int, int]) -> tuple[float, float, float]:
    """D1, D2 and D3+ from the numbers of n-grams seen once to four times; where one of them is
    missing, half of the usual bound, so that a tiny corpus still leaves mass to the lower order."""
    n1, n2, n3, n4 = (of_counts.get(k, 0) for k in (1, 2, 3, 4))
    if not (n1 and n2 and n3 and n4):
        return 0.5, 0.75, 1.0
    y = n1 / (n1 + 2 * n2)
    bounded = lambda d, k: min(max(d, 0.05), k - 0.05)
    return bounded(1 - 2 * y * n2 / n1, 1), bounded(2 - 3 * y * n3 / n2, 2), bounded(3 - 4 * y * n4 / n3, 3)


def _suffix(gram: Column, order: int) -> Column:
    return gram.bitwiseAND(F.lit((1 << (BITS * (order - 1))) - 1).cast("long"))


def gram_counts(texts: DataFrame) -> DataFrame:
    """How often each highest-order n-gram occurs in each half of ``texts`` (text, half): (half, gram,
    n). Null texts count nothing."""
    counted = texts.filter("text is not null").select("text", F.col("half").cast("long").alias("half"))
    return counted.mapInArrow(_count, "half long, gram long, n long").groupBy("half", "gram").agg(F.sum("n").alias("n"))


def train(texts: DataFrame) -> DataFrame:
    """The model of all ``texts`` (text); see ``model_of``."""
    return model_of(gram_counts(texts.select("text", F.lit(0).alias("half"))).select("gram", "n"))


def model_of(counts: DataFrame) -> DataFrame:
    """The model of n-gram ``counts`` (gram, n) as one table (level, gram, logp, backoff).

    For an n-gram of level k characters, logp is its log probability if it was seen as one
    (null for one that is only a context) and backoff the log of the mass that its contexts
    leave to the lower order (null if it is no context). Level 0 has one row: the empty
    context, logp being that of a character never seen before the empty context's share.
    No n-gram at all gives an empty model.
    """
    with scratch_scope(counts.sparkSession):
        levels = {ORDER: materialize(counts, "kn-counts")}
        for k in range(ORDER - 1, 0, -1):
            levels[k] = materialize(levels[k + 1].groupBy(_suffix(F.col("gram"), k + 1).alias("gram")).agg(F.count("*").alias("n")), "kn-counts")
        lower, parts = None, []
        for k in range(1, ORDER + 1):
            counted = levels[k]
            of_counts = {r["n"]: r["count"] for r in counted.filter("n <= 4").groupBy("n").count().collect()}
            d1, d2, d3 = discounts(of_counts)
            discount = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
            context = F.shiftrightunsigned("gram", BITS)
            contexts = counted.groupBy(context.alias("ctx")).agg(F.sum("n").alias("total"), F.sum(discount).alias("kept"))
            contexts = materialize(contexts.select("ctx", "total", (F.col("kept") / F.col("total")).alias("gamma")), "kn-contexts")
            own = counted.select("gram", "n", context.alias("ctx"), _suffix(F.col("gram"), k).alias("suffix")).join(contexts, "ctx")
            if lower is None:
                size = counted.count() + 1
                below, own = F.lit(1.0 / size), own
            else:
                own = own.join(lower.select(F.col("gram").alias("suffix"), F.col("p").alias("p_low")), "suffix")
                below = F.col("p_low")
            p = (F.greatest(F.col("n") - discount, F.lit(0.0)) / F.col("total")) + F.col("gamma") * below
            lower = materialize(own.select("gram", p.alias("p")), "kn-p")
            parts.append(lower.select(F.lit(k).alias("level"), "gram", F.log("p").alias("logp"), F.lit(None).cast("double").alias("backoff")))
            unseen = F.lit(-math.log(size)) if k == 1 else F.lit(None).cast("double")
            parts.append(contexts.select(F.lit(k - 1).alias("level"), F.col("ctx").alias("gram"), unseen.cast("double").alias("logp"), F.log("gamma").alias("backoff")))
        model = reduce(DataFrame.unionByName, parts)
        return keep(materialize(model.groupBy("level", "gram").agg(F.max("logp").alias("logp"), F.max("backoff").alias("backoff")), "kn-model"))


def sharded(model: DataFrame, held_rows: int = HELD_ROWS) -> dict[int, ShardList]:
    """The model as one sorted table of shards for each level from 1 on, and level 0."""
    level = lambda k: model.filter(F.col("level") == k).select(F.col("gram").alias("key"), "logp", "backoff")
    return {k: write_shards(level(k), ["logp", "backoff"], f"kn-level-{k}", held_rows=held_rows if k == ORDER else min(held_rows, HELD_ROWS)) for k in range(ORDER + 1)}


class Scorer:
    """A worker's view of the model."""

    def __init__(self, levels: dict[int, ShardList]):
        self.levels = {k: Shards(v) for k, v in levels.items()}
        root = self.levels[0].get(np.zeros(1, np.int64))
        self.unseen = float(np.nansum(root[0])) if root[1].all() else 0.0

    def log_probabilities(self, keys: np.ndarray) -> np.ndarray:
        out, left = np.zeros(len(keys)), np.arange(len(keys))
        for k in range(ORDER, 0, -1):
            grams = keys[left] & np.uint64((1 << (BITS * k)) - 1)
            value = self.levels[k].get(grams)[0][:, 0]
            seen = ~np.isnan(value)
            out[left[seen]] += value[seen]
            left, grams = left[~seen], grams[~seen]
            if not len(left):
                break
            # The mass that the context leaves; one never met leaves all of it.
            out[left] += np.nan_to_num(self.levels[k - 1].get(grams >> np.uint64(BITS))[0][:, 1]) if k > 1 else self.unseen
        return out


def with_log_likelihood(docs: DataFrame, model: DataFrame, text: str = "text", held_rows: int = HELD_ROWS) -> DataFrame:
    """Append loglik (the sum over the whole text) and n_symbols (its UTF-16 units) to each row; a
    null or empty text has 0 and 0. Columns of these names give way.

    The n-grams of each group of texts are joined with the shards that hold them. A worker keeps
    the shards used last, up to ``held_rows`` rows of the highest order; a larger model is streamed.
    """
    levels = sharded(model, held_rows)
    token = uuid.uuid4().hex

    def run(column: pa.Array) -> list[pa.Array]:
        scorer = worker_table(f"model {token}", lambda: Scorer(levels))
        sums, sizes = [], []
        for group in text_groups(column):
            keys, n = gram_keys(group)
            p = np.concatenate([[0.0], np.cumsum(scorer.log_probabilities(keys))])
            ends = np.cumsum(n)
            sums.append(p[ends] - p[ends - n])
            sizes.append(n)
        return [pa.array(np.concatenate(sums) if sums else [], pa.float64()), pa.array(np.concatenate(sizes) if sizes else [], pa.int64())]

    return row_map(docs, [text], run, T.StructType([T.StructField("loglik", T.DoubleType()), T.StructField("n_symbols", T.LongType())]))


def _half(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(HALVES))


def perplexities(docs: DataFrame, trusted: DataFrame, held_rows: int = HELD_ROWS) -> DataFrame:
    """(doc_id, lang, n_symbols, perplexity) of every row of ``docs``: a half of the documents, by the hash
    of the id, is scored by the model of the ``trusted`` ones in the other half. A null or empty
    text has no perplexity; nor has any in a half whose other half holds no trusted text."""
    rows, scored = docs.select("doc_id", "text", "lang"), []
    perplexity = F.when((F.col("n_symbols") > 0) & (F.col("loglik") < 0), F.exp(-F.col("loglik") / F.col("n_symbols")))
    with scratch_scope(docs.sparkSession):
        counts = materialize(gram_counts(trusted.select("text", _half().alias("half"))), "kn-halves")
        for half in range(HALVES):
            with scratch_scope(docs.sparkSession):
                model = model_of(counts.filter(F.col("half") == 1 - half).select("gram", "n"))
                mine = with_log_likelihood(rows.filter(_half() == half), model, held_rows=held_rows)
                scored.append(keep(materialize(mine.select("doc_id", "lang", "n_symbols", perplexity.alias("perplexity")), "kn-scored")))
        for part in scored:
            keep(part)
    return reduce(DataFrame.unionByName, scored)


def quality(docs: DataFrame, trusted: DataFrame, quantile: float = 0.99, lean: int = LEAN, held_rows: int = HELD_ROWS) -> DataFrame:
    """Perplexity and decision for every row of ``docs`` (doc_id, text, lang).

    ``trusted`` (doc_id, text) are rows of ``docs`` or like them; they train the models and, each scored by
    the model that has not seen it, set the thresholds. A row is kept if its perplexity is at most
    the ``quantile`` of all trusted documents of its language. That leans on the quantile over all
    languages as if ``lean`` documents stood at it, so a language of few documents goes by it mostly,
    and a null language entirely. Returns (doc_id, lang, n_symbols, perplexity, threshold, keep); a
    null or empty text has no perplexity and is not kept; without trusted texts, or where
    all of them are in one half, nothing is. Repeated rows are each judged; other columns are ignored;
    an empty table gives an empty result.
    """
    scored = perplexities(docs, trusted, held_rows)
    # The list of trusted ids grows with the corpus, so the join is by sorted shuffle at any size.
    known = scored.filter("perplexity is not null").join(trusted.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi")
    mark = F.percentile_approx("perplexity", quantile, 10_000)
    overall = F.lit(known.agg(mark).first()[0]).cast("double")
    by_lang = known.filter("lang is not null").groupBy("lang").agg(mark.alias("q"), F.count("*").alias("n"))
    lent = (F.col("q") * F.col("n") + overall * lean) / (F.col("n") + lean)
    sizes = scored.filter("lang is not null").groupBy("lang").agg(F.count("*").alias("rows"))
    marks = materialize(sizes.join(by_lang, "lang", "left").select("lang", F.coalesce(lent, overall).alias("threshold"), "rows"), "kn-marks")
    # One language may have most of the rows, and so may none.
    out = heavy_join(scored.filter("lang is not null"), marks, "lang", "rows", scored.count())
    out = out.unionByName(scored.filter("lang is null").withColumn("threshold", overall))
    return out.select("doc_id", "lang", "n_symbols", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False)).alias("keep"))
