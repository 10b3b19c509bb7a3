"""Metrics of cumulative citation snapshots; every snapshot advances in the same job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def snapshots(edges: DataFrame, first: int, last: int) -> DataFrame:
    """(year, src, dst): the distinct edges known by the end of each year. ``edges``: src, dst, year."""
    known = edges.where(F.col("year") <= last).groupBy("src", "dst").agg(F.min("year").alias("since"))
    return known.select(F.explode(F.sequence(F.greatest("since", F.lit(first)), F.lit(last))).alias("year"), "src", "dst")


def nodes(snaps: DataFrame) -> DataFrame:
    return snaps.select("year", F.col("src").alias("node")).unionByName(snaps.select("year", F.col("dst").alias("node"))).distinct()


def in_degree(snaps: DataFrame) -> DataFrame:
    """(year, node, in_degree), 0 included."""
    got = snaps.groupBy("year", F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("in_degree"))
    return nodes(snaps).join(got, ["year", "node"], "left").na.fill(0, ["in_degree"])


def pagerank(snaps: DataFrame, alpha: float = 0.85, rounds: int = 20) -> DataFrame:
    """(year, node, pagerank) by power iteration; the mass of nodes without references is spread evenly (Brin and Page 1998)."""
    snaps = materialize(snaps)
    out = snaps.groupBy("year", "src").agg(F.count(F.lit(1)).alias("deg"))
    size = nodes(snaps).groupBy("year").agg(F.count(F.lit(1)).alias("n"))
    base = materialize(nodes(snaps).join(size, "year").join(out.withColumnRenamed("src", "node"), ["year", "node"], "left"))
    rank = base.select("year", "node", (F.lit(1.0) / F.col("n")).alias("r"))
    for _ in range(rounds):
        state = base.join(rank, ["year", "node"])
        lost = state.where("deg IS NULL").groupBy("year").agg(F.sum("r").alias("lost"))
        given = snaps.join(state.where("deg IS NOT NULL").select("year", F.col("node").alias("src"), (F.col("r") / F.col("deg")).alias("g")), ["year", "src"]).groupBy("year", F.col("dst").alias("node")).agg(F.sum("g").alias("g"))
        rank = base.join(given, ["year", "node"], "left").join(lost, "year", "left").select("year", "node", ((1 - alpha) / F.col("n") + alpha * (F.coalesce("g", F.lit(0.0)) + F.coalesce("lost", F.lit(0.0)) / F.col("n"))).alias("r"))
        rank = materialize(rank)
    return rank.withColumnRenamed("r", "pagerank")


def hits(snaps: DataFrame, rounds: int = 20) -> DataFrame:
    """(year, node, hub, authority), each adding up to 1 per year (Kleinberg 1999)."""
    snaps = materialize(snaps)
    everyone = materialize(nodes(snaps))
    hub = everyone.withColumn("hub", F.lit(1.0))
    authority = None

    def scaled(df: DataFrame, col: str) -> DataFrame:
        total = df.groupBy("year").agg(F.sum(col).alias("t"))
        return df.join(total, "year").select("year", "node", (F.col(col) / F.col("t")).alias(col))

    for _ in range(rounds):
        authority = scaled(snaps.join(hub.withColumnRenamed("node", "src"), ["year", "src"]).groupBy("year", F.col("dst").alias("node")).agg(F.sum("hub").alias("authority")), "authority")
        authority = materialize(authority)
        hub = materialize(scaled(snaps.join(authority.withColumnRenamed("node", "dst"), ["year", "dst"]).groupBy("year", F.col("src").alias("node")).agg(F.sum("authority").alias("hub")), "hub"))
    return everyone.join(hub, ["year", "node"], "left").join(authority, ["year", "node"], "left").na.fill(0.0, ["hub", "authority"])


def load_centrality(snaps: DataFrame, max_depth: int = 100) -> DataFrame:
    """(year, node, load_centrality): the packets between all pairs that pass a node when each splits evenly over its shortest ways (Goh et al. 2001).

    Searches from all sources advance together, one level a join; then packets run back
    level by level. Normalised by the ordered pairs of other nodes. The state is a row for each
    reached pair of a year, which the measure itself asks for, so it is meant for snapshots of
    up to some hundred thousand nodes.
    """
    snaps = materialize(snaps)
    everyone = materialize(nodes(snaps))
    reached = materialize(everyone.select("year", F.col("node").alias("s"), F.col("node").alias("v"), F.lit(0).alias("d")))
    front, depth = reached, 0
    while depth < max_depth:
        step = snaps.join(front.select("year", "s", F.col("v").alias("src")), ["year", "src"]).select("year", "s", F.col("dst").alias("v")).distinct()
        front = materialize(step.join(reached, ["year", "s", "v"], "left_anti").withColumn("d", F.lit(depth + 1)))
        if front.isEmpty():
            break
        depth += 1
        reached = materialize(reached.unionByName(front))
    ways = snaps.join(reached.select("year", "s", F.col("v").alias("src"), F.col("d").alias("du")), ["year", "src"]).join(reached.select("year", "s", F.col("v").alias("dst"), F.col("d").alias("dv")), ["year", "s", "dst"]).where("dv = du + 1")
    ways = materialize(ways.withColumn("k", F.count(F.lit(1)).over(_by("year", "s", "dst"))))
    got = reached.where("d > 0").select("year", "s", "v", "d", F.lit(1.0).alias("x"))
    for level in range(depth, 1, -1):
        back = ways.where(F.col("dv") == level).join(got.where(F.col("d") == level).select("year", "s", F.col("v").alias("dst"), "x"), ["year", "s", "dst"]).groupBy("year", "s", F.col("src").alias("v")).agg(F.sum(F.col("x") / F.col("k")).alias("more"))
        got = materialize(got.join(back, ["year", "s", "v"], "left").select("year", "s", "v", "d", (F.col("x") + F.coalesce("more", F.lit(0.0))).alias("x")))
    load = got.groupBy("year", F.col("v").alias("node")).agg(F.sum(F.col("x") - 1).alias("load"))
    size = everyone.groupBy("year").agg(F.count(F.lit(1)).alias("n"))
    scale = F.when(F.col("n") > 2, 1.0 / ((F.col("n") - 1) * (F.col("n") - 2))).otherwise(1.0)
    return everyone.join(load, ["year", "node"], "left").join(size, "year").select("year", "node", (F.coalesce("load", F.lit(0.0)) * scale).alias("load_centrality"))


def _by(*cols: str):
    from pyspark.sql import Window

    return Window.partitionBy(*cols)


def node_metrics(edges: DataFrame, first: int, last: int, rounds: int = 20) -> DataFrame:
    """(year, node, pagerank, in_degree, hub, authority, load_centrality)."""
    snaps = materialize(snapshots(edges, first, last))
    out = in_degree(snaps)
    for part in (pagerank(snaps, rounds=rounds), hits(snaps, rounds=rounds), load_centrality(snaps)):
        out = out.join(part, ["year", "node"])
    return out
