"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words map to classes: insult, threat, target, negation, report, other. Three transducers read
the classes of a clause: negation turns insults and threats in its scope into negated ones,
reported speech turns those behind a reporting verb into reported ones, and the last one weighs
what is left: an insult, more where the clause has named a target, and a threat only there. Composed
once into a single table, they score a clause in one walk. Insult patterns (words and word
beginnings) are learned from labelled texts as what toxic texts hold anywhere, threat patterns
as what marks them only behind a target; the factors of the clause readings and the logistic curve that
turns the summed weight of a text into a score are fitted to the same texts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import drop_worker_tables, hand_back, materialize, plain_texts, release, row_map

# Closed-class words in English, German, French and Spanish.
TARGETS = frozenset("you your he she him her they them it this that who du dich dir ihr sie er tu toi te vous il elle lui ils tú ti usted él ella ellos".split())
NEGATIONS = frozenset("not no never neither nor without nicht kein keine nie ohne ne pas jamais sans nunca jamás sin".split())
REPORTS = frozenset("said says say told claimed called wrote quoted reported alleged sagte sagt behauptete nannte schrieb dit disait affirme écrit appelle dijo dice afirmó llamó escribió".split())
# Stems of threats with their endings, by language.
_THREAT_FORMS = (
    ("kill destroy shoot stab burn hurt beat", ("", "s", "ed", "ing", "er")),
    ("töt schlag schläg vernicht", ("en", "e", "et", "t", "st", "te", "est")),
    ("tu frapp", ("er", "e", "es", "ez", "ent", "era", "erai", "é")),
    ("détrui", ("re", "s", "t", "ra", "rai")),
    ("mat golpe", ("ar", "o", "as", "a", "an", "ó", "ará", "aré")),
    ("destru", ("ir", "yo", "ye", "yó", "irá", "iré")),
)
THREATS = frozenset(stem + ending for stems, endings in _THREAT_FORMS for stem in stems.split() for ending in endings)

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, NEGATED, REPORTED = range(8)
CLASSES = 8
NEGATION_SCOPE = 3
#: The readings of a matched word, and how much each counts before the fit: plainly, with a target in
#: its clause, negated, reported.
PLAIN, TARGETED, WHEN_NEGATED, WHEN_REPORTED = range(4)
FACTORS = (1.0, 1.25, 0.3, 0.4)
#: Of a threat of the fixed forms; learned ones have their own weight.
THREAT_WEIGHT = 0.5
REJECT_AT = 0.7

_TOKEN = re.compile(r"[^\W\d_]+|[.!?;\n]")
_WORD = re.compile(r"[^\W\d_]+")
_MEMO_WORDS = 50_000


#: Letters of the beginnings looked at; a longer one rarely says more than the whole word does.
SHORTEST, LONGEST = 4, 12


class Transducer:
    """A deterministic transducer: (state, class) -> (state, output)."""

    def __init__(self, step):
        self.step = step

    def then(self, after: Transducer) -> Transducer:
        """Composition: ``after`` reads what this one writes."""

        def step(state, symbol):
            mine, out = self.step(state[0], symbol)
            other, out = after.step(state[1], out)
            return (mine, other), out

        return Transducer(step)

    def compiled(self, start) -> tuple[list[list[int]], list[list[int | None]]]:
        """Tables by state number and class: next state, output."""
        number, queue, tables = {start: 0}, [start], ([], [])
        for state in queue:
            rows = ([], [])
            for symbol in range(CLASSES):
                to, out = self.step(state, symbol)
                if to not in number:
                    number[to] = len(number)
                    queue.append(to)
                rows[0].append(number[to])
                rows[1].append(out)
            for table, row in zip(tables, rows):
                table.append(row)
        return tables


def _negation(state: int, symbol: int):
    if symbol == NEGATION:
        return NEGATION_SCOPE, symbol
    out = NEGATED if state and symbol in (INSULT, THREAT) else symbol
    return max(0, state - 1), out


def _reported(state: int, symbol: int):
    if symbol == REPORT:
        return 1, symbol
    return state, REPORTED if state and symbol in (INSULT, THREAT) else symbol


def _weigh(state: int, symbol: int):
    """State 1: the clause has named a target. The output is a reading, or None."""
    if symbol == TARGET:
        return 1, None
    readings = {INSULT: TARGETED if state else PLAIN, THREAT: TARGETED if state else None, NEGATED: WHEN_NEGATED, REPORTED: WHEN_REPORTED}
    return state, readings.get(symbol)


GRAMMAR = Transducer(_negation).then(Transducer(_reported)).then(Transducer(_weigh)).compiled(((0, 0), 0))


class Grammar:
    """The learned patterns with the fixed grammar, the factors of its readings and the curve."""

    def __init__(self, words: dict[str, float], beginnings: dict[str, float], threats: dict[str, float] | None = None, factors: tuple[float, ...] = FACTORS, slope: float = 1.0, shift: float = -2.0):
        self.words, self.beginnings, self.factors, self.slope, self.shift = words, beginnings, factors, slope, shift
        self.threats = {t: THREAT_WEIGHT for t in THREATS} | (threats or {})
        self._exact = {*words, *self.threats}
        #: How beginnings begin: most words are told by this alone to match none.
        self._lengths, self._starts = sorted({len(b) for b in beginnings}), {b[:SHORTEST] for b in beginnings}
        self._memo: dict[str, tuple[int, float]] = {}

    def _begins(self, word: str) -> float:
        if word[:SHORTEST] not in self._starts:
            return 0.0
        return max(self.beginnings.get(word[:n], 0.0) for n in self._lengths)

    def classify(self, word: str) -> tuple[int, float]:
        """The class of a lower-cased word and, for insults and threats, its weight."""
        if (known := self._memo.get(word)) is not None:
            return known
        if w := max(self.words.get(word, 0.0), self._begins(word)):
            known = INSULT, w
        elif word in TARGETS:
            known = TARGET, 0.0
        elif word in NEGATIONS:
            known = NEGATION, 0.0
        elif word in REPORTS:
            known = REPORT, 0.0
        elif w := self.threats.get(word):
            known = THREAT, w
        else:
            known = OTHER, 0.0
        if len(self._memo) >= _MEMO_WORDS:
            self._memo.clear()
        self._memo[word] = known
        return known

    def readings(self, text: str) -> list[float]:
        """The summed weight of all matched words by reading. Texts without a pattern word are
        not parsed further."""
        low = text.lower()
        total = [0.0] * len(FACTORS)
        words = set(_WORD.findall(low))
        if words.isdisjoint(self._exact) and not any(map(self._begins, words)):
            return total
        follow, outputs = GRAMMAR
        state = 0
        for token in _TOKEN.findall(low):
            if token in ".!?;\n":
                state = 0
                continue
            kind, weight = self.classify(token)
            if (reading := outputs[state][kind]) is not None:
                total[reading] += weight
            state = follow[state][kind]
        return total

    def evidence(self, text: str) -> float:
        """The summed weight of all matched clauses."""
        return sum(f * w for f, w in zip(self.factors, self.readings(text)))

    def score(self, text: str) -> float:
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, self.slope * math.log1p(self.evidence(text)) + self.shift))))


_PATTERNS = pa.schema([("pattern", pa.string()), ("kind", pa.int32()), ("toxic", pa.int64()), ("clean", pa.int64())])
#: Kinds of patterns: a word, a word's beginning, a word behind a target in its clause.
WHOLE, BEGINNING, BEHIND = range(3)
_FLUSH = 150_000


def _behind_targets(low: str) -> set[str]:
    """The words that follow a target in their clause."""
    found, open_ = set(), False
    for token in _TOKEN.findall(low):
        if token in ".!?;\n":
            open_ = False
        elif token in TARGETS:
            open_ = True
        elif open_:
            found.add(token)
    return found


def _count_patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many toxic and clean texts hold each pattern."""
    drop_worker_tables()
    counts: dict[tuple[str, int], list[int]] = {}

    def out() -> pa.RecordBatch:
        columns = [k[0] for k in counts], [k[1] for k in counts], [v[1] for v in counts.values()], [v[0] for v in counts.values()]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PATTERNS)], schema=_PATTERNS)

    for batch in batches:
        for text, label in zip(plain_texts(batch.column(0)), batch.column(1).to_pylist()):
            low = text.lower()
            words = set(_WORD.findall(low))
            keys = {(w, WHOLE) for w in words} | {(w[:n], BEGINNING) for w in words for n in range(SHORTEST, min(LONGEST, len(w)) + 1)} | {(w, BEHIND) for w in _behind_targets(low)}
            for key in keys:
                counts.setdefault(key, [0, 0])[label] += 1
            if len(counts) > _FLUSH:
                yield out()
                counts.clear()
                hand_back()
    if counts:
        yield out()
        counts.clear()
    hand_back()


def train(labelled: DataFrame, max_rows: int = 30_000, min_gain: float = 22.0, min_weight: float = 2.5) -> Grammar:
    """Learn from ``labelled`` (doc_id, text, toxic 0/1); rows with a null text or label teach nothing,
    repeated rows each count.

    A sample of about ``max_rows`` rows by the hash of the id, or all rows if fewer, bounds
    the fit. A pattern needs a log-odds weight of ``min_weight`` and a likelihood gain over chance of
    ``min_gain``; of beginnings that contain one another the shortest that qualifies is kept. A word
    that qualifies only where it follows a target is a threat. Without any toxic row nothing is
    learned and every text scores low.
    """
    rows = labelled.filter("text is not null and toxic in (0, 1)").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))
    known = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    total = sum(known.values())
    if total > max_rows:
        rows = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * max_rows / total))
    rows = materialize(rows.select("text", "toxic"), "toxicity-rows")
    try:
        sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
        toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
        if not toxic or not clean:
            return Grammar({}, {})
        weight = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
        share = F.col("toxic") / ((F.col("toxic") + F.col("clean")) * F.lit(toxic / (toxic + clean)))
        # As many as the sample gives: each needs four toxic texts of it.
        found = (
            rows.mapInArrow(_count_patterns, "pattern string, kind int, toxic long, clean long")
            .groupBy("pattern", "kind").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
            .filter("toxic > 3").withColumn("weight", weight).filter(F.col("weight") >= min_weight)
            .withColumn("gain", 2 * F.col("toxic") * F.log(share)).filter(F.col("gain") >= min_gain)
            .select("pattern", "kind", "weight").collect()
        )
        beginnings: dict[str, float] = {}
        for r in sorted((r for r in found if r["kind"] == BEGINNING), key=lambda r: (len(r["pattern"]), r["pattern"])):
            if not any(r["pattern"][:n] in beginnings for n in range(SHORTEST, len(r["pattern"]))):
                beginnings[r["pattern"]] = r["weight"]
        fresh = lambda p: not any(p[:n] in beginnings for n in range(SHORTEST, len(p) + 1))
        words = {r["pattern"]: r["weight"] for r in found if r["kind"] == WHOLE and fresh(r["pattern"])}
        threats = {r["pattern"]: r["weight"] for r in found if r["kind"] == BEHIND and fresh(r["pattern"]) and r["pattern"] not in words}
        grammar = Grammar(words, beginnings, threats)
        grammar.factors, grammar.slope, grammar.shift = _fit(rows, grammar)
        return grammar
    finally:
        release(rows)


def _fit(rows: DataFrame, grammar: Grammar) -> tuple[tuple[float, ...], float, float]:
    """The factors and the curve: logistic regression of the label on the log of the evidence, the
    factors moved from where they start as far as the texts ask for it. At most one line a row of
    the bounded sample comes here; texts with the same readings share one."""

    def run(column: pa.Array) -> list[pa.Array]:
        return [pa.array([[round(w, 3) for w in grammar.readings(t)] for t in plain_texts(column)], pa.list_(pa.float64()))]

    seen = row_map(rows, ["text"], run, T.StructType([T.StructField("readings", T.ArrayType(T.DoubleType()))]))
    counts = seen.groupBy("readings", "toxic").count().collect()
    weights, y, n = np.array([r["readings"] for r in counts], float), np.array([r["toxic"] for r in counts], float), np.array([r["count"] for r in counts], float)

    def curve(factors: np.ndarray) -> tuple[float, np.ndarray]:
        """The loss with these factors, and the curve's slope and shift."""
        design = np.stack([np.log1p(weights @ factors), np.ones(len(y))], axis=1)
        theta = np.zeros(2)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
            gradient = design.T @ (n * (y - p)) - 1e-2 * theta
            hessian = (design * (n * p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
            step = np.linalg.solve(hessian, gradient)
            theta += np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
        z = np.clip(design @ theta, -30, 30)
        moved = np.log(factors / np.array(FACTORS))
        return float((n * (np.log1p(np.exp(z)) - y * z)).sum() + 2.0 * (moved**2).sum()), theta

    factors = np.array(FACTORS)
    best, theta = curve(factors)
    # The plain reading stays the unit; the others go up or down by ever smaller steps.
    for step in (2.0, 1.4, 1.1):
        for _ in range(8):
            tried = [(reading, factors * np.where(np.arange(len(factors)) == reading, by, 1.0)) for reading in (TARGETED, WHEN_NEGATED, WHEN_REPORTED) for by in (step, 1 / step)]
            loss, other, made = min(((*curve(f), f) for _, f in tried), key=lambda t: t[0])
            if loss >= best - 1e-6:
                break
            best, theta, factors = loss, other, made
    return tuple(factors.tolist()), float(theta[0]), float(theta[1])


def with_scores(docs: DataFrame, grammar: Grammar, text: str = "text", out: str = "score") -> DataFrame:
    """Append the score (0 to 1) of the whole text of every row; a null text scores as an
    empty one. Only the text is looked at; other columns pass through, one named ``out`` gives way."""
    spread = docs.sparkSession.sparkContext.broadcast(grammar)

    def run(column: pa.Array) -> list[pa.Array]:
        drop_worker_tables()
        return [pa.array([spread.value.score(t) for t in plain_texts(column)], pa.float64())]

    return row_map(docs, [text], run, T.StructType([T.StructField(out, T.DoubleType())]))


def labelled_rows(docs: DataFrame, labels: DataFrame, max_rows: int = 30_000) -> DataFrame:
    """Texts with their labels, (doc_id, text, toxic). The labels are first cut to about
    ``max_rows`` by the hash of their id, so that side of the join is small by construction. An id labelled
    more than once counts with its highest label."""
    known = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = known.count()
    if total > max_rows:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * max_rows / total))
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
