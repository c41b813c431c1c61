"""Point-in-time joins, latest rows, comparisons and upserts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def dimension(df: DataFrame, dim: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Left join to the named columns only; Spark picks the strategy from the sizes."""
    return df.join(dim.select(key, *columns), key, "left")


def as_of(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, columns: Sequence[str], how: str = "left") -> DataFrame:
    """For each left row the right row of the same key with the latest time up to the left
    one's; equal times take the greatest of ``columns``.

    Both sides go through one shuffle by key and one ordered window that carries the last right row
    forward: linear in the rows, without a range join. ``how`` is "left" or "inner".
    """
    carried = F.struct(F.col(right_ts).alias("_at"), *(F.col(c) for c in columns))
    kind = carried_type(right, right_ts, columns)
    events = left.select(F.col(key).alias("_k"), F.col(left_ts).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(kind).alias("_r"))
    facts = right.select(F.col(key).alias("_k"), F.col(right_ts).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(events.schema["_row"].dataType).alias("_row"), carried.alias("_r")).filter("_t is not null and _k is not null")
    order = Window.partitionBy("_k").orderBy("_t", "_side", "_r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = events.unionByName(facts).withColumn("_hit", F.last("_r", ignorenulls=True).over(order)).filter("_side = 1")
    if how == "inner":
        filled = filled.filter("_hit is not null")
    return filled.select("_row.*", F.col("_hit._at").alias(f"matched_{right_ts}"), *(F.col(f"_hit.{c}").alias(f"matched_{c}") for c in columns))


def carried_type(right: DataFrame, right_ts: str, columns: Sequence[str]):
    return right.select(F.struct(F.col(right_ts).alias("_at"), *(F.col(c) for c in columns)).alias("s")).schema["s"].dataType


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the greatest ``order`` per key, by one aggregation."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")
    return df.groupBy(*keys).agg(best).select(*keys, *(F.col(f"_last.{c}").alias(c) for c in rest))


def newest(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The ``n`` newest rows per key with their place."""
    by = Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in order))
    return df.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= n)


def compare(a: DataFrame, b: DataFrame, key: str, value: str, digits: int = 6) -> DataFrame:
    """Full outer comparison: (key, value_a, value_b, delta), delta null where a side lacks it."""
    left, right = a.select(key, F.col(value).alias("value_a")), b.select(key, F.col(value).alias("value_b"))
    return left.join(right, key, "full_outer").withColumn("delta", F.round(F.col("value_b") - F.col("value_a"), digits))


def once_per_key(source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``source`` as it is; a key that comes twice is an error when the rows are read. Rows with a null
    in their key are no one's double."""
    whole = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    rest = [c for c in source.columns if c not in keys]
    grouped = source.filter(whole).groupBy(*keys).agg(F.count("*").alias("_times"), F.any_value(F.struct(*rest) if rest else F.lit(1)).alias("_rest"))
    said = F.concat(F.lit("the source of a merge repeats the key "), F.to_json(F.struct(*keys)))
    checked = grouped.filter(F.when(F.col("_times") > 1, F.raise_error(said).cast("boolean")).otherwise(True))
    single = checked.select(*keys, *(F.col(f"_rest.{c}").alias(c) for c in rest)).select(*source.columns)
    return single.unionByName(source.filter(~whole))


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``target`` without the rows whose key ``source`` has, and all of ``source``.

    As in a MERGE, a null in a key matches nothing: such rows of either side all stay. A key that
    ``source`` repeats is an error when the result is read. Repeated keys of ``target`` are replaced together.
    """
    fresh = once_per_key(source.select(*target.columns), keys)
    return target.join(fresh.select(*keys), list(keys), "left_anti").select(*target.columns).unionByName(fresh)
