"""The queries of this subpackage: each operator over its whole intended table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, kneser_ney, langid, line_dedup, mtree, packing, simhash, token_store, toxicity
from ._shared import id_remainder

WORD_TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = WORD_TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document. Null and empty texts have fingerprint 0 and are one
    component; a row without an id has no component; repeated rows each give a row; other columns
    are ignored; an empty table gives an empty result."""
    return simhash.near_duplicate_groups(_table(spark, sf_dir, "documents"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and conversation -1, formatted and read back. Null roles and texts are empty;
    rows that repeat a turn all count, ordered by role and text; rows without a conv_id are one
    conversation; other columns are ignored; an empty table gives conversation -1 alone."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    made = chat.format_reply_trees(chat.linear_messages(turns))
    read = made.select(F.col("tree").alias("conv_id"), "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said_back = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said_back, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document. A null text, or one without a letter, is ``und`` with score 0; rows
    without a language or text teach nothing; a row without an id is not held out; repeated rows each give
    a row and each count in the fit; other columns are ignored; an empty table gives an empty result."""
    docs = _table(spark, sf_dir, "documents")
    held_out = id_remainder(F.col("doc_id"), 5) == 0
    model = langid.train(docs.filter(~held_out).select("text", "lang"))
    rows = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    return langid.identify(rows, model).drop("text")


def op4_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as packed pieces. A null text is empty, an empty one is its end id alone; repeated rows
    and rows without an id are documents of their own; other columns are ignored; an empty table gives
    an empty result."""
    docs = _table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, tokenizer_path(), end_id=2).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every match of a document with a benchmark item. Null and empty texts, and items without an id or a
    word, match nothing; repeated rows each have their matches; other columns are ignored; an empty
    table gives an empty result."""
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as read back from the id files. A null text is empty; documents without an id come
    first; repeated ids each keep their row; other columns are ignored; an empty table gives an
    empty result."""
    folder = token_store.new_folder(spark)
    manifest = token_store.write_store(_table(spark, sf_dir, "documents"), folder, tokenizer_path(), end_id=1)
    return token_store.read_store(manifest, folder)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its common lines. A null text is one empty line; rows that repeat an id with
    other texts are documents of their own, exact repetitions count as one document and each give a row;
    rows without an id go by their text; an empty table gives an empty result."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs, min_docs=10))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of every query. Null vectors, null or non-finite components and rows without an id take
    no part; shorter vectors count as padded with zeros; repeated ids each count as candidates and ask
    once; ties go to the smaller id; an empty table gives an empty result."""
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return mtree.top_k(rows, rows.filter(F.col("vec_id") % 20 == 0), k=20)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document. A null text scores as an empty one; labels that are null teach nothing,
    of labels that repeat an id the highest counts; a row without an id is not held out; repeated rows
    each give a row; without labels every text scores low; an empty table gives an empty result."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = id_remainder(F.col("doc_id"), 3) == 1
    labels = _table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~held_out)
    grammar = toxicity.train(toxicity.labelled_rows(docs, labels))
    rows = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    scored = toxicity.with_scores(rows, grammar).drop("text")
    return scored.withColumn("predicted", (F.col("score") >= toxicity.REJECT_AT).cast("int"))


def op10_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity and decision of every document. A null or empty text has no perplexity and is not kept; a
    null language takes the threshold over all; repeated rows each give a row; without trusted texts in
    both halves of the documents nothing is kept; an empty table gives an empty result."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = id_remainder(F.col("doc_id"), 5) == 0
    good = _table(spark, sf_dir, "labels").filter((F.col("quality") == 1) & ~held_out).select("doc_id")
    # The list of trusted ids grows with the corpus, so the join is by sorted shuffle at any size.
    trusted = docs.select("doc_id", "text").join(good.hint("merge"), "doc_id", "left_semi")
    out = kneser_ney.quality(docs, trusted)
    return out.withColumn("held_out", F.coalesce(held_out, F.lit(False)))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents that the five stages keep; each stage says in its own docstring what
    it does with nulls, repeats, clashing columns and empty tables."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_simhash_near_dedup, op2_chat_format, op3_language_id, op4_nnls_packing, op5_decontamination, op6_token_store, op7_line_dedup, op8_exact_top_k, op9_toxicity, op10_kneser_ney_quality)
    return {f.__name__: f for f in ops} | {"pipeline": pipeline}


_SPACE = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _escaped(text: str) -> str:
    out = f"replace({text}, '\\', '\\\\')"
    for c in chat.CONTROLS:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


def oracle_sql() -> dict[str, str]:
    return {
        "op2_chat_format": f"""
            WITH turns AS (
                SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
                UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
            SELECT conv_id, count(*) AS n_turns,
                sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
                CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
                sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
                CAST(sum(length({_escaped('role')}) + length({_escaped('text')}) + {sum(map(len, chat.CONTROLS))}) AS BIGINT) AS formatted_chars
            FROM turns GROUP BY conv_id""",
        "op7_line_dedup": f"""
            WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
            each AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM split),
            keyed AS (SELECT doc_id, line, pos, translate(trim(line, {_SPACE}), '{_UPPER}', '{_LOWER}') AS key FROM each),
            common AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
            marked AS (SELECT k.*, c.key IS NOT NULL AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key)
            SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
                sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
            FROM marked GROUP BY doc_id""",
        "op8_exact_top_k": """
            WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
                WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
            s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
                FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
            r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
            SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    }
