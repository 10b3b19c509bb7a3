"""Joins that locate: contexts in papers, annotations at contexts, values as of a year, keys by prefix."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx


def rewrites(cite) -> list:
    """The citing string and its rewrites, in the order in which they are tried."""
    rep = lambda c, a, b: F.replace(c, F.lit(a), F.lit(b))
    etal_year = lambda a: F.contains(cite, F.lit(f"{a} 1")) | F.contains(cite, F.lit(f"{a} 2"))
    return [
        cite,
        F.when(F.contains(cite, F.lit("et al ")), rep(cite, "et al ", "et al. ")),
        F.when(etal_year("et al."), rep(cite, "et al. ", "et al. , ")),
        F.when(etal_year("et al"), rep(cite, "et al ", "et al. , ")),
        F.when(F.contains(cite, F.lit(" , ")), rep(cite, " , ", " ,")),
        F.regexp_replace(cite, r"([a-z]) ([0-9]+)", "$1 , $2"),
    ]


def locate(contexts: DataFrame, sentences: DataFrame) -> DataFrame:
    """Contexts (ctx, paper_id, cite, context) with the sentence that is most like their context.

    Candidates have the citing string, or its first rewrite that any sentence of the
    paper has; the earliest place wins ties. Located contexts get ``citation_id``, the
    paper and their number among them in order.
    """
    tries = contexts.select("ctx", "paper_id", "context", F.posexplode(F.array(*rewrites(F.col("cite")))).alias("k", "string")).where("string IS NOT NULL AND string <> ''")
    hit = tries.join(sentences.select("paper_id", "section", "subsection", "sentence", "text"), "paper_id").where(F.contains("text", "string"))
    hit = hit.withColumn("score", tx.quick_ratio(F.col("context"), F.col("text")))
    best = Window.partitionBy("ctx").orderBy("k", F.desc("score"), "section", "subsection", "sentence")
    found = hit.withColumn("n", F.row_number().over(best)).where("n = 1").select("ctx", "paper_id", F.col("string").alias("cite"), "section", "subsection", "sentence", "score")
    place = Window.partitionBy("paper_id").orderBy("ctx")
    return found.withColumn("citation_id", F.concat("paper_id", F.lit("_"), F.row_number().over(place) - 1))


def attach_annotations(marks: DataFrame, contexts: DataFrame, least_cite: float = 0.95, least_context: float = 0.8) -> DataFrame:
    """(mark, citation_id, score): annotations (mark, paper_id, cite, line) at the context of their paper that fits best."""
    pairs = marks.join(contexts.select("paper_id", "citation_id", F.col("cite").alias("c"), "context"), "paper_id")
    pairs = pairs.where(tx.quick_ratio(F.col("cite"), F.col("c")) >= least_cite).where(tx.ratio("cite", "c") >= least_cite)
    pairs = pairs.withColumn("score", tx.quick_ratio(F.col("line"), F.col("context"))).where(F.col("score") >= least_context)
    return pairs.withColumn("n", F.row_number().over(Window.partitionBy("mark").orderBy(F.desc("score"), "citation_id"))).where("n = 1").select("mark", "citation_id", "score")


def best_paper(contexts: DataFrame, candidates: DataFrame, least: int = 80) -> DataFrame:
    """(ctx, paper_id) by the best whole-percent ratio within a document; the last one wins ties."""
    pairs = contexts.join(candidates, "doc").withColumn("score", tx.fuzz_ratio("context", "known")).where(F.col("score") >= least)
    return pairs.withColumn("n", F.row_number().over(Window.partitionBy("ctx").orderBy(F.desc("score"), F.desc("pos")))).where("n = 1").select("ctx", "paper_id")


def at_year(facts: DataFrame, metrics: DataFrame, keys: list[str], year: str, values: list[str], as_of: bool = False) -> DataFrame:
    """Metrics of the same year (0 where there are none), or of the latest year not after it."""
    if not as_of:
        return facts.join(metrics.select(*keys, year, *values), [*keys, year], "left").na.fill(0, values)
    both = facts.select(*keys, F.col(year).alias("_y")).distinct().join(metrics.select(*keys, F.col(year).alias("_m"), *values), keys).where("_m <= _y")
    last = both.groupBy(*keys, "_y").agg(*(F.max_by(v, "_m").alias(v) for v in values))
    return facts.join(last.withColumnRenamed("_y", year), [*keys, year], "left")


def nearest(rows: DataFrame, points: DataFrame, most: float) -> DataFrame:
    """(id, key) of the point of a row's group with the least distance, ``most`` at most; the smallest key wins ties.

    rows: (id, grp, v), points: (key, grp, v), v double. Different values are put in order within
    cells wider than ``most``, points in three cells each, and each one looks at the last
    point on either side, so rows and points never meet as pairs. Two values on one side of a
    row count as ties only if they are equal.
    """
    width = 2.0 ** (math.floor(math.log2(most)) + 1)
    real = lambda df: df.where(F.col("v").isNotNull() & F.col("grp").isNotNull() & (F.abs("v") < float("inf")))
    cell = F.floor(F.col("v") / width).cast("double")
    at = real(rows).select("grp", "v").distinct().select("grp", cell.alias("cell"), "v", F.lit(None).alias("point"))
    marks = real(points).groupBy("grp", "v").agg(F.min("key").alias("key")).select("grp", F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"), "v", F.struct("v", "key").alias("point"))
    own = Window.partitionBy("grp", "cell")
    side = lambda order: F.last("point", ignorenulls=True).over(own.orderBy(order, F.col("point").isNull()).rowsBetween(Window.unboundedPreceding, 0))
    seen = at.unionByName(marks).withColumn("low", side(F.asc("v"))).withColumn("high", side(F.desc("v"))).where("point IS NULL")
    gaps = F.transform(F.array("low", "high"), lambda p: F.when(F.abs(p["v"] - F.col("v")) <= most, F.struct(F.abs(p["v"] - F.col("v")).alias("gap"), p["key"].alias("key"))))
    found = seen.select("grp", "v", F.array_min(gaps).alias("best")).where("best IS NOT NULL")
    return rows.join(found, ["grp", "v"]).groupBy("id").agg(F.min("best")["key"].alias("key"))


def longest_prefix(ids: DataFrame, table: DataFrame, longest: int = 6, shortest: int = 3) -> DataFrame:
    """(id, value) of the longest prefix of ``id`` in ``table`` (prefix, value); null without one."""
    tries = ids.select("id").distinct().select("id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(shortest), F.lit(longest)), lambda n: F.left("id", n)))).alias("prefix"))
    hit = tries.join(table, "prefix").groupBy("id").agg(F.max_by("value", F.length("prefix")).alias("value"))
    return ids.join(hit, "id", "left")


def elsewhere(sentences: DataFrame, places: DataFrame) -> DataFrame:
    """The sentences outside the given places."""
    return sentences.join(places, ["paper_id", "section", "subsection", "sentence"], "left_anti")


def indirect_mentions(sentences: DataFrame, names: DataFrame, cited_at: DataFrame) -> DataFrame:
    """(paper_id, cited, n): sentences that have a cited name without a year in the next 25 characters, away from its citations."""
    free = names.join(sentences, "paper_id").join(cited_at, ["paper_id", "cited", "section", "subsection", "sentence"], "left_anti")
    tail = F.substring(F.col("text"), F.position("name", "text") + F.length("name"), F.lit(25))
    return free.where(F.contains("text", "name") & ~tail.rlike("[0-9]{4}")).select("paper_id", "cited", "section", "subsection", "sentence").distinct().groupBy("paper_id", "cited").agg(F.count(F.lit(1)).alias("n"))
