"""Language identification by words first, then ever shorter character n-grams."""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import materialize, plain_texts, release, row_map, text_groups, worker_table
from .shards import HELD_ROWS, ShardList, Shards, write_shards

UNDETERMINED = "und"
_RUN = re.compile(r"[^\W\d_]+")
_COUNTS = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])
#: Distinct (language, word) pairs a training task holds before it passes their counts on.
_FLUSH_PAIRS = 200_000
_MEMO_WORDS = 200_000
SMOOTHING = 0.5


def words_of(text: str) -> list[str]:
    """Runs of letters, lower-cased. Digits and other numerals alone make no word."""
    found = _RUN.findall(text.lower())
    return [w for w in found if w.isalpha() or any(map(str.isalpha, w))]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], schema=_COUNTS)

    counts: dict[str, Counter] = {}
    flat = lambda: Counter({(lang, w): n for lang, c in counts.items() for w, n in c.items()})
    for batch in batches:
        for text, lang in zip(plain_texts(batch.column(0)), batch.column(1).to_pylist()):
            counts.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, counts.values())) > _FLUSH_PAIRS:
                yield out(flat())
                counts = {}
    if counts:
        yield out(flat())


@dataclass
class BackoffModel:
    """Per-language counts of words and of character n-grams, in shards.

    A known word scores by its own log frequencies. Any other word, marked at both ends, scores by
    the mean log frequency of its n-grams of the greatest length of which one is known; a word
    of which not even a single character is known counts for no language. Units are keyed by
    their 64-bit hashes.
    """

    langs: list[str]
    totals: list[int]
    #: By length of the n-gram, the number of them in each language.
    gram_totals: dict[int, list[int]]
    words: ShardList
    grams: ShardList
    max_n: int


def unit_keys(units: list[str]) -> np.ndarray:
    """The keys of words or n-grams, as Spark's xxhash64 gives them."""
    return np.fromiter((xxhash.xxh64_intdigest(u.encode(), 42) for u in units), np.uint64, len(units)).view(np.int64)


class Scorer:
    """A worker's view of a model, with the words it met, within a bound."""

    def __init__(self, model: BackoffModel):
        self.model, self.langs = model, model.langs
        self.words, self.grams = Shards(model.words), Shards(model.grams)
        self._forget()

    def _forget(self) -> None:
        """Row 0 is all zero: words that count for no language."""
        self._at: dict[str, int] = {}
        self._matrix = np.zeros((1, len(self.langs)))

    def _logs(self, counts: np.ndarray, totals: np.ndarray, size: int) -> np.ndarray:
        return np.log((counts + SMOOTHING) / (totals + SMOOTHING * max(1, size)))

    def scores(self, words: list[str]) -> np.ndarray:
        """One row a word; a word of which nothing is known has zeros."""
        out = np.zeros((len(words), len(self.langs)))
        counts, known = self.words.get(unit_keys(words))
        out[known] = self._logs(counts[known], np.array(self.model.totals, float), self.model.words.n_rows)
        left = np.flatnonzero(~known)
        for n in range(self.model.max_n, 0, -1):
            if not len(left):
                break
            place, units = [], []
            for k, at in enumerate(left.tolist()):
                marked = f"^{words[at]}$"
                found = [marked[i : i + n] for i in range(len(marked) - n + 1)] if n > 1 else list(words[at])
                place += [k] * len(found)
                units += found
            if not units:
                continue
            different = {u: i for i, u in enumerate(dict.fromkeys(units))}
            counts, known = self.grams.get(unit_keys(list(different)))
            row = np.fromiter(map(different.__getitem__, units), np.int64, len(units))
            place = np.array(place)[known[row]]
            logs = self._logs(np.nan_to_num(counts), np.array(self.model.gram_totals.get(n, [0] * len(self.langs)), float), self.model.grams.n_rows)[row[known[row]]]
            times = np.bincount(place, minlength=len(left))
            hit = times > 0
            sums = np.stack([np.bincount(place, logs[:, j], len(left)) for j in range(len(self.langs))], axis=1)
            out[left[hit]] = sums[hit] / times[hit][:, None]
            left = left[~hit]
        return out

    def _learn(self, words: list[str]) -> None:
        made = self.scores(words)
        known = made.any(axis=1)
        places = np.zeros(len(words), np.int64)
        places[known] = len(self._matrix) + np.arange(int(known.sum()))
        self._at.update(zip(words, places.tolist()))
        self._matrix = np.vstack([self._matrix, made[known]])

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """The likeliest language of each text and its share of the likelihood, flat priors. ``und``
        and 0 for a text without a letter or a model without a language; ties go to the
        first language by name."""
        counted = [Counter(_RUN.findall(t.lower())) for t in texts]
        words = [[w for w in c if w.isalpha() or any(map(str.isalpha, w))] for c in counted]
        if not self.langs:
            return [(UNDETERMINED, 0.0)] * len(texts)
        if len(self._at) > _MEMO_WORDS:
            self._forget()
        if new := list({w for some in words for w in some if w not in self._at}):
            self._learn(new)
        out = []
        for some, counts in zip(words, counted):
            if not some:
                out.append((UNDETERMINED, 0.0))
                continue
            times = np.fromiter(map(counts.__getitem__, some), float, len(some))
            total = times @ self._matrix[list(map(self._at.__getitem__, some))]
            best = int(np.argmax(total))
            out.append((self.langs[best], float(1.0 / np.exp(np.maximum(total - total[best], -700.0)).sum())))
        return out


def train(docs: DataFrame, max_rows: int = 1_000_000, max_n: int = 4, held_rows: int = HELD_ROWS) -> BackoffModel:
    """Learn from the rows of ``docs`` (text, lang) that have both; repeated rows each count.

    The fit takes a sample of about ``max_rows`` labelled rows, chosen by hash, or all rows if there
    are fewer. Every word of those rows, whole texts, and every n-gram of its distinct words is
    counted and kept: the model is a table in shards, of which a worker holds ``held_rows`` rows.
    """
    rows = docs.filter("lang is not null").select("text", F.col("lang").cast("string").alias("lang"))
    total = rows.count()
    if total > max_rows:
        rows = rows.filter(F.pmod(F.xxhash64("text", "lang"), F.lit(1_000_000_000)) < int(1_000_000_000 * max_rows / total))
    rows = rows.filter("text is not null")
    words = materialize(rows.mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "langid-words")
    by_lang = {r["lang"]: r["n"] for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(by_lang)
    marked = F.concat(F.lit("^"), "word", F.lit("$"))
    starts = F.sequence(F.lit(1), F.greatest(F.char_length("marked") - F.col("size") + 1, F.lit(1)))
    grams = materialize(
        words.select("lang", marked.alias("marked"), "n")
        .withColumn("size", F.explode(F.sequence(F.lit(1), F.lit(max_n))))
        .filter(F.col("size") <= F.char_length("marked"))
        .select("lang", "n", "size", F.explode(F.transform(starts, lambda i: F.substr("marked", i, F.col("size")))).alias("gram"))
        .filter(~((F.col("size") == 1) & F.col("gram").isin("^", "$")))
        .groupBy("lang", "size", "gram").agg(F.sum("n").alias("n")),
        "langid-grams",
    )
    gram_totals: dict[int, list[int]] = {}
    for r in grams.groupBy("lang", "size").agg(F.sum("n").alias("n")).collect():
        gram_totals.setdefault(r["size"], [0] * len(langs))[langs.index(r["lang"])] = r["n"]

    def table(counted: DataFrame, unit: str, label: str) -> ShardList:
        names = [f"n{i}" for i in range(len(langs))]
        counts = [F.coalesce(F.sum(F.when(F.col("lang") == lang, F.col("n"))), F.lit(0)).cast("double").alias(n) for lang, n in zip(langs, names)]
        key = F.xxhash64(unit).alias("key")
        wide = counted.groupBy(key).agg(*counts) if counts else counted.select(key)
        return write_shards(wide, names, label, held_rows=held_rows)

    made = BackoffModel(langs, [by_lang[k] for k in langs], gram_totals, table(words, "word", "langid-word-shards"), table(grams, "gram", "langid-gram-shards"), max_n)
    release(words, grams)
    return made


def identify(docs: DataFrame, model: BackoffModel, text: str = "text") -> DataFrame:
    """Append lang_pred and score (0 to 1) to every row. Only the text is looked at, the
    whole of it; a null or empty text, or one without a letter, gives ``und`` and 0. Columns of
    these names give way; other columns pass through."""
    token = uuid.uuid4().hex

    def run(column: pa.Array) -> list[pa.Array]:
        scorer = worker_table(f"languages {token}", lambda: Scorer(model))
        made: list[tuple[str, float]] = []
        for group in text_groups(column):
            made += scorer.predict(group)
        return [pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())]

    return row_map(docs, [text], run, T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
