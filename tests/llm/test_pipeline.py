"""The corpus pipeline, stage by stage, against brute force."""

from conftest import SMALL
from test_operators import brute_close, brute_lines, brute_matches, brute_similarity

import corpus_pipeline
from sluicework.llm._shared import materialize


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        after = materialize(stage(spark, docs, SMALL), "test-stage")
        if name != "packing":
            assert after.columns == docs.columns
        rows = after.collect()
        if name == "toxicity":
            assert len(rows) > 0.8 * len(before)
        if name == "line_dedup":
            kept, _ = brute_lines(list(before.values()), 10)
            assert {r["doc_id"]: r["text"] for r in rows} == {i: "\n".join(k) for i, k in zip(before, kept)}
        if name == "near_dedup":
            kept, ids = {r["doc_id"] for r in rows}, list(before)
            shares = brute_similarity(list(before.values()))
            low, high = (set(brute_close({(ids[i], ids[j]) for (i, j), s in shares.items() if s >= mark}, ids).values()) for mark in (0.77, 0.83))
            assert low <= kept <= high
        if name == "decontamination":
            assert {r["doc_id"] for r in rows} == {i for i, t in before.items() if not brute_matches(bench, t)}
        if name == "packing":
            assert {r["doc_id"] for r in rows} == set(before)
        docs = after


def test_odd_tables(spark):
    kind = spark.read.parquet(f"{SMALL}/documents.parquet").schema
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "a b c d e f g", None, None, 13), (2, "a b c d e f g", None, None, 13)]
    for data in (rows, []):
        more = ("fp", "_rank", "n_lines", "n_dropped", "_keep", "_toxicity", "_matches", "matches", "content", "component_id")
        docs = spark.createDataFrame(data, kind).selectExpr("*", *(f"'x' AS {c}" for c in more))
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = materialize(stage(spark, docs, SMALL), "test-odd")
            assert docs.columns == [*kind.names, *more]
            assert all(r[c] == "x" for r in docs.collect() for c in more)
        assert docs.count() == (3 if data else 0)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() == (3 if data else 0)


def test_run_leaves_only_what_its_result_reads(spark):
    from sluicework.llm import _shared

    before = set(_shared._open_paths)
    made = corpus_pipeline.run(spark, SMALL)
    left = {p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in _shared._open_paths - before}
    assert left == {"pipeline-decontamination", "packing-pieces"}
    assert made.count() > 0
