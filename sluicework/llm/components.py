"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import heavy_join, materialize, release


def _stars(edges: DataFrame, total: int, large: bool) -> DataFrame:
    """One step. ``edges`` has (u, v) with v < u, ``total`` rows at most. The minimum neighbour is found
    by an aggregation with map-side combining; it comes back to a hub's neighbours by a join that
    spreads them, so they never meet in one task."""
    if large:
        pairs = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
    else:
        pairs = edges
    mins = materialize(pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "mins")
    joined = heavy_join(pairs, mins, "u", "n", 2 * total if large else total)
    if large:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = out.unionByName(mins.select("u", F.col("m").alias("v")))
    return out.filter(F.col("v") < F.col("u")).distinct()


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Map every linked node to the smallest node of its component.

    ``links`` may hold repeated links, both directions and self links; links with a null end
    are ignored. Returns (node, component) for every node that is not itself the smallest of
    its component. Each round is written to the shared folder, so the plan stays flat; the
    number of rounds grows with the logarithm of the largest component.
    """
    edges = materialize(
        links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges"
    )
    state, total = None, edges.count()
    while True:
        half = materialize(_stars(edges, total, large=True), "edges")
        after = materialize(_stars(half, half.count(), large=False), "edges")
        release(edges, half)
        edges = after
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state, total = now, now[0]
