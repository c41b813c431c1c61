"""Aggregates: rates, quantiles, drift, classification metrics, rolling frames, similarity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TINY = 1e-8
#: Ranges of values in which running counts are taken.
RANGES = 64


def rate(df: DataFrame, by: Sequence[str], key: str, hit: Column, names: tuple[str, str, str] = ("n", "hits", "rate")) -> DataFrame:
    """Rows, hits and their ratio to four digits per group."""
    n, hits, ratio = names
    counted = df.groupBy(*by).agg(F.count(key).alias(n), F.sum(hit.cast("long")).alias(hits))
    return counted.withColumn(ratio, F.round(F.try_divide(F.col(hits), F.col(n)), 4))


def long_form(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, v) of all values that are not null."""
    cells = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns))
    return df.select(F.inline(cells)).filter("v is not null")


def running_counts(counts: DataFrame, group: str, value: str, n: str) -> DataFrame:
    """Append _before, the sum of ``n`` over the smaller values of the group, and _total, over all of it, to
    ``counts`` (group, value, n), one row a value. Values are dealt into ranges between approximate
    quantiles, so that no task orders a whole group."""
    # One short list a group.
    cuts = counts.groupBy(group).agg(F.percentile_approx(value, [i / RANGES for i in range(1, RANGES)], 10_000).alias("_cuts"))
    placed = counts.join(F.broadcast(cuts), group).withColumn("_range", F.size(F.filter("_cuts", lambda x: x <= F.col(value)))).drop("_cuts")
    ranges = placed.groupBy(group, "_range").agg(F.sum(n).alias("_n"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = ranges.select(group, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"), F.sum("_n").over(Window.partitionBy(group)).alias("_total"))
    inside = Window.partitionBy(group, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.withColumn("_before", F.coalesce(F.sum(n).over(inside), F.lit(0)))
    # At most RANGES rows a group.
    return ranked.join(F.broadcast(bases), [group, "_range"]).withColumn("_before", F.col("_before") + F.col("_base")).drop("_range", "_base")


def quantiles(df: DataFrame, columns: Sequence[str], points: Sequence[float], accuracy: int | None = None) -> DataFrame:
    """(feature, i, value): the percentiles of each column at ``points``, linear between neighbours.

    Values are counted first, then the counts are walked range by range, so the exact result needs
    no task that holds all values. With ``accuracy`` the approximate percentile of that accuracy is
    taken instead, by one aggregation. A column without a value has no row.
    """
    long = long_form(df, columns)
    if accuracy is not None:
        found = long.groupBy("feature").agg(F.percentile_approx("v", list(points), accuracy).alias("q"))
        return found.select("feature", F.posexplode("q").alias("i", "value"))
    counted = running_counts(long.groupBy("feature", "v").agg(F.count("*").alias("n")), "feature", "v", "n")
    at = F.array(*(F.struct(F.lit(i).alias("i"), (F.lit(float(p)) * (F.col("_total") - 1)).alias("at")) for i, p in enumerate(points)))
    held = F.filter(at, lambda a: (F.ceil(a["at"]) >= F.col("_before")) & (F.floor(a["at"]) < F.col("_before") + F.col("n")))
    met = counted.select("feature", "v", "_before", "n", F.explode(held).alias("a"))
    ends = met.groupBy("feature", F.col("a.i").alias("i"), F.col("a.at").alias("at")).agg(F.min("v").alias("low"), F.max("v").alias("high"))
    return ends.select("feature", "i", (F.col("low") + (F.col("high") - F.col("low")) * (F.col("at") - F.floor("at"))).alias("value"))


def quantile_breaks(df: DataFrame, column: str, parts: int = 10, accuracy: int | None = None) -> DataFrame:
    """(q, value): percentiles at 0, 1/parts, ... 1."""
    return quantiles(df, [column], [i / parts for i in range(parts + 1)], accuracy).select((F.col("i") / parts).alias("q"), "value")


def quantile_cuts(df: DataFrame, columns: Sequence[str], bins: int, accuracy: int | None = None) -> DataFrame:
    """(feature, cuts): the interior cuts of ``bins`` buckets of equal share."""
    found = quantiles(df, columns, [i / bins for i in range(1, bins)], accuracy)
    return found.groupBy("feature").agg(F.array_sort(F.collect_list(F.struct("i", "value"))).alias("cuts")).select("feature", F.col("cuts.value").alias("cuts"))


def width_cuts(df: DataFrame, columns: Sequence[str], bins: int) -> DataFrame:
    """(feature, cuts): the interior cuts of ``bins`` buckets of equal width."""
    ends = long_form(df, columns).groupBy("feature").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    return ends.select("feature", F.array(*(F.col("low") + (F.col("high") - F.col("low")) * F.lit(i / bins) for i in range(1, bins))).alias("cuts"))


def shares(reference: DataFrame, current: DataFrame, columns: Sequence[str], bins: int = 10, width: bool = False, accuracy: int | None = None) -> DataFrame:
    """(feature, bucket, ref, cur): both tables' shares per bucket of the reference, buckets of equal
    share or, with ``width``, of equal width.

    All features share one plan: values are unpivoted, cuts and buckets come from grouped
    aggregations. The outer buckets are open, so values outside the reference's range count.
    """
    cuts = width_cuts(reference, columns, bins) if width else quantile_cuts(reference, columns, bins, accuracy)
    # One row a feature: as small as the list of features.
    both = long_form(reference, columns).withColumn("side", F.lit("r")).unionByName(long_form(current, columns).withColumn("side", F.lit("c")))
    placed = both.join(F.broadcast(cuts), "feature")
    bucket = F.size(F.filter("cuts", lambda x: x <= F.col("v")))
    counts = placed.groupBy("feature", bucket.alias("bucket")).agg(F.count_if(F.col("side") == "r").alias("r"), F.count_if(F.col("side") == "c").alias("c"))
    every = cuts.select("feature", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bucket"))
    full = every.join(counts, ["feature", "bucket"], "left").na.fill(0, ["r", "c"])
    whole = Window.partitionBy("feature")
    return full.select("feature", "bucket", F.try_divide("r", F.sum("r").over(whole)).alias("ref"), F.try_divide("c", F.sum("c").over(whole)).alias("cur"))


def psi(shared: DataFrame, limit: float = 0.2) -> DataFrame:
    """(feature, psi, status) from ``shares``."""
    term = (F.col("cur") - F.col("ref")) * F.log((F.col("cur") + TINY) / (F.col("ref") + TINY))
    return shared.groupBy("feature").agg(F.round(F.sum(term), 6).alias("psi")).withColumn("status", F.when(F.col("psi") < limit, "PASS").otherwise("FAIL"))


def kl(shared: DataFrame) -> DataFrame:
    """(feature, kl): the divergence of current from reference."""
    term = F.col("ref") * F.log((F.col("ref") + TINY) / (F.col("cur") + TINY))
    return shared.groupBy("feature").agg(F.round(F.sum(term), 6).alias("kl"))


def accuracy_f1(df: DataFrame, label: str, predicted: str) -> DataFrame:
    y, p = F.col(label) == 1, F.col(predicted) == 1
    counts = df.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    total = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return counts.select(F.round(F.try_divide(F.col("tp") + F.col("tn"), total), 6).alias("accuracy"), F.round(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 6).alias("f1"))


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """The rank-sum AUC, ties counting half. Scores are counted first, then the negatives below each
    are summed range by range, so no task orders all rows."""
    counts = df.groupBy(F.lit(0).alias("_all"), F.col(score).cast("double").alias("s")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n")).filter("s is not null")
    ranked = running_counts(counts, "_all", "s", "n")
    wins = F.sum(F.col("p") * (F.col("_before") + F.col("n") / 2))
    return ranked.agg(F.round(F.try_divide(wins, F.sum("p") * F.sum("n")), 6).alias("auc"))


def rolling(df: DataFrame, key: str, ts: str, value: Column, days: int) -> DataFrame:
    """Sum, count and mean over the ``days`` days up to each row, its own instant included."""
    seconds = F.unix_seconds(F.col(ts).cast("timestamp"))
    frame = Window.partitionBy(key).orderBy(seconds).rangeBetween(-days * 86_400, 0)
    return df.withColumns({f"sum_{days}d": F.sum(value).over(frame), f"count_{days}d": F.count(value).over(frame), f"avg_{days}d": F.try_divide(F.sum(value).over(frame).cast("double"), F.count(value).over(frame))})


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def most_similar(df: DataFrame, key: str, vector: str, query: Sequence[float], k: int, digits: int = 6) -> DataFrame:
    """The ``k`` rows nearest to ``query`` by cosine, ties to the smaller key: one pass, top-k per
    partition first. The order is that of the similarity itself; only what is returned is rounded."""
    scored = df.select(key, cosine(F.col(vector), F.array(*(F.lit(float(x)) for x in query))).alias("similarity"))
    return scored.orderBy(F.col("similarity").desc(), key).limit(k).withColumn("similarity", F.round("similarity", digits))
