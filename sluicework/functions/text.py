"""Text functions: markup to text, overlapping word chunks, hashed embeddings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def html_to_text(html: Column) -> Column:
    """Scripts, styles and tags out, white space collapsed and trimmed."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"\s+", " "))


def chunks(df: DataFrame, doc_id: str, text: str, size: int = 512, overlap: int = 64) -> DataFrame:
    """Windows of ``size`` words that start every ``size - overlap`` words: (doc_id,
    chunk_index, text). A text without a word gives no chunk; the last chunks may lie wholly
    in the one before."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    step = size - overlap
    words = F.filter(F.split(F.col(text), r"\s+"), lambda w: w != "")
    parted = df.select(F.col(doc_id).alias("doc_id"), words.alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.floor((F.size("words") - 1) / step).cast("int"))
    return parted.select("doc_id", "words", F.explode(starts).alias("chunk_index")).select(
        "doc_id", "chunk_index", F.array_join(F.slice("words", F.col("chunk_index") * step + 1, size), " ").alias("text")
    )


def hashed_embedding(texts: pd.Series, width: int = 32) -> pd.Series:
    """A deterministic stand-in for a model: signed counts of hashed words, unit length."""
    import numpy as np
    import xxhash

    def one(text: str | None) -> list[float]:
        v = np.zeros(width)
        for w in (text or "").lower().split():
            h = xxhash.xxh64_intdigest(w)
            v[h % width] += 1.0 if h >> 63 else -1.0
        n = float(np.linalg.norm(v))
        return (v / n if n else v).tolist()

    return texts.map(one)


def embed(df: DataFrame, text: str, out: str = "embedding", model: Callable[[pd.Series], pd.Series] = hashed_embedding) -> DataFrame:
    """Append ``model``'s vectors batch by batch, by Arrow."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{out: model(batch[text])})

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{kinds}, `{out}` array<double>")
