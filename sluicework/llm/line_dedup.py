"""Line deduplication that returns keep bitmaps, in DataFrame operations only.

Every line becomes a 128-bit hash of its key with its document and position. Hashes are first
gathered per salt of the document, so that a line of a third of all documents is a few rows,
then range-partitioned and sorted by hash, first document and position; a window streams over
that order, takes the first occurrence of each key and the number of documents that hold it.
Per document the decision is a run-length compressed bitmap of the lines that stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import ASCII_SPACE, ascii_lower, free_name, heavy_join, materialize

SALTS = 32


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A to Z lower-cased."""
    return ascii_lower(F.trim(line, F.lit(ASCII_SPACE)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def occurrences(docs: DataFrame, min_key_chars: int = 1) -> DataFrame:
    """One row per line with a key of ``min_key_chars`` code points or more: (doc_id, text_hash,
    pos, n_lines, h1, h2). Written once, since all that follows reads it."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), _lines(F.col("text")).alias("lines")).select(
        "doc_id", "text_hash", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("pos", "line")
    )
    keyed = lines.select("doc_id", "text_hash", "n_lines", "pos", line_key(F.col("line")).alias("key"))
    if min_key_chars > 0:
        keyed = keyed.filter(F.char_length("key") >= min_key_chars)
    return materialize(keyed.select("doc_id", "text_hash", "pos", "n_lines", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(0x5EED), "key").alias("h2")), "line-occurrences")


def key_statistics(found: DataFrame) -> DataFrame:
    """(h1, h2, n_docs, n_rows, first_doc, first_text, first_pos) of every key."""
    own = found.groupBy("h1", "h2", "doc_id", "text_hash").agg(F.min("pos").alias("pos"), F.count("*").alias("rows"))
    salted = own.groupBy("h1", "h2", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(SALTS)).alias("salt")).agg(
        F.count("*").alias("n"), F.sum("rows").alias("rows"), F.min(F.struct("doc_id", "text_hash", "pos")).alias("first")
    )
    ordered = salted.repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2", "first")
    key = Window.partitionBy("h1", "h2")
    streamed = ordered.select("h1", "h2", "first", F.row_number().over(key.orderBy("first")).alias("at"), F.sum("n").over(key).alias("n_docs"), F.sum("rows").over(key).alias("n_rows"))
    return streamed.filter("at = 1").select("h1", "h2", "n_docs", "n_rows", F.col("first.doc_id").alias("first_doc"), F.col("first.text_hash").alias("first_text"), F.col("first.pos").alias("first_pos"))


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, keep_first: bool = False, min_key_chars: int = 1) -> DataFrame:
    """Which lines stay, for every document that loses one.

    A line goes if its key is found in ``min_docs`` or more documents; with ``keep_first`` the
    first occurrence of the key, by doc_id, text and position, stays. Returns (doc_id, text_hash, n_lines,
    n_dropped, keep): keep is the bitmap of kept lines as runs (start, length). text_hash is
    the text's xxhash64; together with a doc_id it names rows, so that rows which repeat a
    doc_id with other texts are documents of their own, and exact repetitions are one. A null
    text has one empty line.
    """
    found = occurrences(docs, min_key_chars)
    common = materialize(key_statistics(found).filter(F.col("n_docs") >= min_docs), "line-common")
    total = found.count()
    if keep_first:
        hit = heavy_join(found, common.drop("n_docs"), ["h1", "h2"], "n_rows", total)
        first = F.col("doc_id").eqNullSafe(F.col("first_doc")) & F.col("text_hash").eqNullSafe(F.col("first_text")) & (F.col("pos") == F.col("first_pos"))
        gone = hit.filter(~first)
    else:
        gone = heavy_join(found, common.select("h1", "h2", "n_rows"), ["h1", "h2"], "n_rows", total)
    per_doc = gone.groupBy("doc_id", "text_hash", "n_lines").agg(F.array_sort(F.collect_set("pos")).alias("gone"))

    def run(k: Column) -> Column:
        start = F.when(k == 0, F.lit(0)).otherwise(F.get("gone", k - 1) + 1)
        end = F.coalesce(F.get("gone", k), F.col("n_lines"))
        return F.struct(start.alias("start"), (end - start).alias("length"))

    runs = F.transform(F.sequence(F.lit(0), F.size("gone")), run)
    return per_doc.select("doc_id", "text_hash", "n_lines", F.size("gone").alias("n_dropped"), F.filter(runs, lambda r: r["length"] > 0).alias("keep"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with the text cut down to its kept lines, plus n_lines and n_dropped. Rows
    without a bitmap keep their text as it is, a null one included. All other columns pass
    through; columns named n_lines or n_dropped give way."""
    docs = docs.drop("n_lines", "n_dropped")
    by, digest, gone, keep = (free_name(docs, c) for c in ("_id", "_hash", "_gone", "_keep"))
    marks = bitmaps.select(F.col("doc_id").alias(by), F.col("text_hash").alias(digest), F.col("n_dropped").alias(gone), F.col("keep").alias(keep))
    joined = docs.join(marks, docs["doc_id"].eqNullSafe(marks[by]) & (F.xxhash64(docs["text"]) == marks[digest]), "left")
    lines = _lines(docs["text"])
    kept = F.array_join(F.flatten(F.transform(keep, lambda r: F.slice(lines, r["start"] + 1, r["length"]))), "\n")
    columns = [F.when(F.col(keep).isNull(), docs[c]).otherwise(kept).alias(c) if c == "text" else docs[c] for c in docs.columns]
    return joined.select(*columns, F.size(lines).cast("long").alias("n_lines"), F.coalesce(gone, F.lit(0)).cast("long").alias("n_dropped"))
