"""Connected components over an edge table, by alternating large-star and small-star rounds (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang every neighbour on the smallest one. ``edges``: (u, v), u > v."""
    both = edges.select("u", "v")
    if large:
        both = both.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    hung = both.join(least, "u")
    out = hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node with an edge; root is the smallest node of its component.

    ``edges`` has the columns ``a`` and ``b``; loops, repeats and nulls in it are
    ignored. Only two numbers a round reach the driver. The rounds stop when the
    edge set no longer changes, which takes about log2 of the diameter.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    print_of = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    seen = print_of(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        old, now = now, materialize(_star(_star(now, True), False))
        discard(old)
        if (then := print_of(now)) == seen:
            break
        seen = then
    else:
        raise RuntimeError("connected components did not converge")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
