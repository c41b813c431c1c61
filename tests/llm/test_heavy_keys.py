"""One key that holds most rows: the same results, and no task that gets them all."""

import random

from pyspark.sql import functions as F
from test_operators import DOCS, brute_close, brute_lines, docs, words

from sluicework.llm import _shared, kneser_ney, line_dedup, packing, simhash
from sluicework.llm.components import connected_components
from sluicework.llm.queries import tokenizer_path


def test_heavy_join(spark, monkeypatch):
    rows = spark.range(0, 8000, numPartitions=8).select(F.when(F.col("id") % 10 > 0, 7).otherwise(F.when(F.col("id") % 100 > 0, F.col("id"))).alias("k"), "id")
    counts = rows.filter("k is not null and k <> 30").groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("most"))
    table = _shared.materialize(counts, "test-counts")
    for how in ("inner", "left"):
        want = rows.join(table.drop("n"), "k", how).collect()
        got = _shared.heavy_join(rows, table, "k", "n", 8000, how)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want), key=repr)
        by_task = [r["count"] for r in got.filter("k = 7").groupBy(F.spark_partition_id()).count().collect()]
        assert sum(by_task) == 7200 and max(by_task) <= 7200 / 6


def test_components_of_a_hub(spark, monkeypatch):
    monkeypatch.setattr(_shared, "HEAVY_ROWS", 50)
    rng = random.Random(21)
    pairs = [(1000, i) for i in range(1001, 1900)] + [(5, 1500), (2, 3), (1899, 2000)] + [(rng.randrange(3000, 3100), rng.randrange(3000, 3100)) for _ in range(90)]
    nodes = {x for p in pairs for x in p}
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert {n: got.get(n, n) for n in nodes} == brute_close(set(pairs), nodes)


def test_operators_with_one_heavy_text(spark, monkeypatch):
    monkeypatch.setattr(_shared, "HEAVY_ROWS", 20)
    rng = random.Random(22)
    texts = ["same line\nof one text that is the third of all rows"] * 150 + [""] * 50 + [words(rng, 12) + "\nsame line" for _ in range(100)]
    rows = [(i if i % 3 else None, t, "en") for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, DOCS)
    first = {t: min(i for i, u, _ in rows if u == t and i is not None) for t in {u for i, u, _ in rows if i is not None}}
    for r in simhash.near_duplicate_groups(table).join(table.select("doc_id", "text").distinct(), "doc_id").collect():
        if r["text"] in (texts[0], ""):
            assert r["component_id"] == first[r["text"]]
    groups = {r["doc_id"]: r["component_id"] for r in simhash.similar_text_groups(table).collect()}
    assert all(groups[i] == first[t] for i, t, _ in rows if i is not None and t in (texts[0], ""))
    kept, _ = brute_lines(texts, 10)
    got = line_dedup.apply_bitmaps(docs(spark, texts), line_dedup.keep_bitmaps(docs(spark, texts), min_docs=10))
    assert {r["doc_id"]: (r["text"] or "").split("\n") for r in got.collect()} == {i: k or [""] for i, k in enumerate(kept)}
    alike = spark.createDataFrame([(None, "a b", "en")] * 3000 + [(1, "c", "en")], DOCS)
    placed = packing.pack_documents(alike, tokenizer_path(), 2)
    assert placed.count() == placed.select("sequence_id", "offset").distinct().count() == 3001


def test_quality_of_one_heavy_language(spark, monkeypatch):
    rng = random.Random(23)
    rows = [(i, words(rng, 12), "en" if i % 10 < 7 else None if i % 10 < 9 else "de") for i in range(200)] + [(300, "no trusted text has its language", "xx"), (None, "", "en")]
    table = spark.createDataFrame(rows, DOCS)
    decided = lambda: sorted(map(tuple, kneser_ney.quality(table, table.filter("doc_id < 150")).collect()), key=repr)
    want = decided()
    monkeypatch.setattr(_shared, "HEAVY_ROWS", 50)
    assert decided() == want and len(want) == len(rows)
    marks = {lang: {r[4] for r in want if r[1] == lang} for lang in ("en", "de", "xx", None)}
    assert all(len(m) == 1 for m in marks.values()) and marks["xx"] == marks[None]
