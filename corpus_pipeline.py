"""The corpus pipeline: toxicity, line dedup, near-dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir), docs being what the stage before kept. All but the
last return the columns of docs, whatever they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicework.llm import decontaminate, line_dedup, packing, simhash, toxicity
from sluicework.llm._shared import free_name, keep, materialize, release, scratch_scope
from sluicework.llm.queries import tokenizer_path

#: Part of the stages has no form in SQL; tests/llm holds the run against a brute-force version.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar scores at the rejection mark or above go.

    A null text scores as an empty one, and stays; repeated rows and rows without an id are each
    scored; of labels that repeat an id the highest counts; without labels nothing goes. Columns of
    any name pass through; an empty table gives an empty result.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    grammar = toxicity.train(toxicity.labelled_rows(docs, labels))
    score = free_name(docs, "_toxicity")
    return toxicity.with_scores(docs, grammar, out=score).filter(F.col(score) < toxicity.REJECT_AT).select(*docs.columns)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten or more documents go, n_chars follows the text; the documents stay.

    A null text stays null. Rows that repeat a doc_id with other texts are documents of their own,
    exact repetitions are one document and all keep the same lines; rows without an id with one text are
    one document. Columns of any name pass through; an empty table gives an empty result.
    """
    aside = {c: free_name(docs, f"_{c}") for c in ("n_lines", "n_dropped") if c in docs.columns}
    named = docs.withColumnsRenamed(aside)
    kept = line_dedup.apply_bitmaps(named, line_dedup.keep_bitmaps(docs.select("doc_id", "text"), min_docs=10))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return kept.select(*(F.col(aside.get(c, c)).alias(c) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share 0.8 or more of their five-word shingles, directly or through
    others, the one with the smallest doc_id stays. Null and empty texts are alike. Of rows that repeat
    that doc_id one stays; rows without a doc_id all stay. Columns of any name pass through; an
    empty table gives an empty result."""
    groups = simhash.similar_text_groups(docs.select("doc_id", "text"), words_per_shingle=5)
    kept_ids = groups.filter("doc_id = component_id").select("doc_id")
    # The list of kept ids grows with the corpus, so the join is by sorted shuffle at any size.
    kept = docs.join(kept_ids.hint("merge"), "doc_id", "left_semi").select(*docs.columns)
    again = docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    again = materialize(again, "pipeline-again")
    if not again.isEmpty():
        once = kept.join(again, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"])
        kept = kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(once)
    if docs.filter("doc_id is null").isEmpty():
        return kept
    return kept.unionByName(docs.filter("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts hold none; repeated rows go or stay together; items without an id, a text or a
    word match nothing. Columns of any name pass through; an empty table gives an empty result.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    matches = free_name(docs, "_matches")
    return decontaminate.with_matches(docs, benchmark, out=matches).filter(F.size(matches) == 0).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents, packed: one row per piece.

    A null text is empty, an empty one is its end id alone; repeated rows and rows without an id are
    documents of their own; columns but doc_id and text are ignored; an empty table gives an
    empty result.
    """
    placed = packing.pack_documents(docs, tokenizer_path(), end_id=2)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_common_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read by the next. What a
    stage wrote on its way is deleted once its result is written, and that once the next one is."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before = docs
        with scratch_scope(spark):
            docs = keep(materialize(stage(spark, docs, sf_dir), f"pipeline-{name}"))
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
