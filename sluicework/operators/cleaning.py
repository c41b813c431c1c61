"""Row-wise operators: contracts, nulls, duplicates, casts, derived columns, sampling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def select_contract(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return require_columns(df, *names).select(*names)


def normalise_names(df: DataFrame, lower: bool = False) -> DataFrame:
    names = [c.strip().lower() if lower else c.strip() for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError("column names collide once trimmed")
    return df.toDF(*names)


def not_null(df: DataFrame, *names: str) -> DataFrame:
    require_columns(df, *names)
    return df.dropna(subset=list(names))


def cast_columns(df: DataFrame, kinds: Mapping[str, str], strict: bool = True) -> DataFrame:
    """Casts in place; without ``strict`` what does not fit becomes null."""
    require_columns(df, *kinds)
    return df.withColumns({c: F.col(c).cast(k) if strict else F.col(c).try_cast(k) for c, k in kinds.items()})


def choose(branches: Sequence[tuple[Column | str, object]], otherwise: object) -> Column:
    """The value of the first branch whose condition is true; a null condition is not true."""
    out = None
    for condition, value in branches:
        condition = F.expr(condition) if isinstance(condition, str) else condition
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


def encode(column: Column, codes: Mapping[object, int], otherwise: int = 0) -> Column:
    return choose([(column == k, v) for k, v in codes.items()], otherwise)


def bin_right_closed(column: Column, edges: Sequence[float]) -> Column:
    """The number of the interval (edges[i], edges[i+1]] that holds the value; null outside."""
    out = F.when(column <= edges[0], F.lit(None).cast("int"))
    for i, edge in enumerate(edges[1:]):
        out = out.when(column <= edge, F.lit(i))
    return out


def impute_median(df: DataFrame, *names: str) -> DataFrame:
    """Nulls become the column's exact median, all columns' in one pass; a column without a value
    stays null."""
    from .statistics import quantiles

    found = quantiles(df, names, [0.5])
    # One row whatever the data: an aggregation without groups.
    medians = found.agg(*(F.max(F.when(F.col("feature") == c, F.col("value"))).alias(f"_median_{c}") for c in names))
    joined = df.join(F.broadcast(medians))
    return joined.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_median_{c}")) for c in names}).drop(*(f"_median_{c}" for c in names))


def dedup_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], copies: str | None = None) -> DataFrame:
    """The first row per key in ``order``, by one aggregation with map-side combining, and with
    ``copies`` the number of the key's rows in a column of that name. ``order`` must tell the
    rows of a key apart, or any of its firsts is kept."""
    rest = [c for c in df.columns if c not in keys]
    counted = [F.count("*").alias(copies)] if copies else []
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    return df.groupBy(*keys).agg(best, *counted).select(*keys, *(F.col(f"_first.{c}").alias(c) for c in rest), *([copies] if copies else [])).select(*df.columns, *([copies] if copies else []))


def tag(df: DataFrame, **values: object) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def sample_by_hash(df: DataFrame, keys: Sequence[str], percent: int) -> DataFrame:
    """The rows whose key hash falls below ``percent`` of 100: the same on any layout."""
    text = F.concat_ws("|", *(F.col(k).cast("string") for k in keys))
    return df.filter(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % 100 < percent)


def split_by_hash(df: DataFrame, key: str, stratum: str, share: float = 0.8) -> DataFrame:
    """Mark the first ``share`` of each stratum, in the order of the key's md5, as train.

    md5 spreads evenly, so its first three digits part each stratum into 4,096 ranges that are
    ordered apart; a range's place is its own plus the rows of the ranges before.
    """
    placed = df.withColumn("_md5", F.md5(F.col(key).cast("string"))).withColumn("_range", F.coalesce(F.substring("_md5", 1, 3), F.lit("")))
    counts = placed.groupBy(stratum, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(stratum).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(F.col(stratum).alias("_stratum"), F.col("_range").alias("_at"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"), F.sum("_n").over(Window.partitionBy(stratum)).alias("_size"))
    place = F.row_number().over(Window.partitionBy(stratum, "_range").orderBy("_md5", key))
    ranked = placed.withColumn("_place", place).join(bases, F.col(stratum).eqNullSafe(F.col("_stratum")) & (F.col("_range") == F.col("_at")))
    split = F.when(F.col("_place") + F.col("_base") <= F.floor(F.col("_size") * share), "train").otherwise("test")
    return ranked.select(*(F.col(c) for c in df.columns), split.alias("split"))


def flatten_structs(df: DataFrame, between: str = "_") -> DataFrame:
    """Every field of every struct column as a column of its own, however deep, named by its path."""

    def leaves(column: Column, kind: T.DataType, name: str) -> list[Column]:
        if not isinstance(kind, T.StructType):
            return [column.alias(name)]
        return [leaf for f in kind.fields for leaf in leaves(column[f.name], f.dataType, f"{name}{between}{f.name}")]

    return df.select(*(leaf for f in df.schema.fields for leaf in leaves(F.col(f"`{f.name}`"), f.dataType, f.name)))


def null_counts(df: DataFrame) -> DataFrame:
    """(column_name, n_null) of every column, counted in one pass."""
    counts = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in df.columns))
    pairs = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_null")) for c in df.columns))
    return counts.select(F.inline(pairs))


def route(df: DataFrame, condition: Column | str) -> tuple[DataFrame, DataFrame]:
    """All rows, and those for which the condition holds."""
    return df, df.filter(condition)
