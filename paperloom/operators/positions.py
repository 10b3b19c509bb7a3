"""Window features of sentences in their papers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

SUBSECTION = ("paper_id", "section", "subsection")


def first_hit(df: DataFrame, keys: list[str], order: str, hit: Column, ahead: int = 4, none: int = 100) -> DataFrame:
    """``distance`` to the first of the next rows with a hit."""
    w = Window.partitionBy(*keys).orderBy(order)
    df = df.withColumn("_n", F.row_number().over(w))
    near = F.min(F.when(hit, F.col("_n"))).over(w.rowsBetween(1, ahead))
    return df.withColumn("distance", F.coalesce(near - F.col("_n"), F.lit(none))).drop("_n")


def around(df: DataFrame, keys: list[str], order: str, value: str, behind: int = 2, ahead: int = 4) -> DataFrame:
    """``preceding`` (this row and those behind, newest first) and ``following``."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("preceding", F.reverse(F.collect_list(value).over(w.rowsBetween(-behind, 0)))).withColumn("following", F.collect_list(value).over(w.rowsBetween(1, ahead)))


def token_frame(tokens: Column, at: Column, size: int = 4) -> tuple[Column, Column]:
    """Up to ``size`` tokens before and after place ``at`` (from 0), clamped to the sentence."""
    start = F.greatest(at - size, F.lit(0))
    return F.slice(tokens, start + 1, F.greatest(at - start, F.lit(0))), F.slice(tokens, at + 2, F.lit(size))


def relative(df: DataFrame) -> DataFrame:
    """Shares of the subsection, section and paper that lie before a sentence, and the sections that are left."""
    out = df
    for name, keys in (("subsection", SUBSECTION), ("section", SUBSECTION[:2]), ("paper", SUBSECTION[:1])):
        w = Window.partitionBy(*keys).orderBy("section", "subsection", "sentence")
        out = out.withColumn(f"relative_pos_in_{name}", (F.row_number().over(w) - 1) / F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    return out.withColumn("Sections_Left", F.max("section").over(Window.partitionBy("paper_id")) + 1 - F.col("section"))


def connectors(df: DataFrame, keys: list[str], order: str, value: str, ahead: int = 8, none: int = 100) -> DataFrame:
    """map of connector to the distance (1 for the row itself) of the last of ``ahead`` rows that opens with it, or ``none``."""
    w = Window.partitionBy(*keys).orderBy(order)
    df = df.withColumn("_n", F.row_number().over(w))
    pairs = []
    for c in tx.CONNECTORS:
        last = F.max(F.when(tx.connector_hit(F.col(value), c), F.col("_n"))).over(w.rowsBetween(0, ahead - 1))
        pairs += [F.lit(f"Connector_{c}"), F.coalesce(last - F.col("_n") + 1, F.lit(none))]
    return df.withColumn("connectors", F.create_map(*pairs)).drop("_n")


def smoothed(df: DataFrame, keys: list[str], order: str, value: str, span: int) -> DataFrame:
    """Exponentially weighted mean with adjusted weights, alpha = 2 / (span + 1).

    Rows so far back that their weight is below the precision of a double are left out, so
    the work for a row does not grow with its place.
    """
    keep = 1 - 2.0 / (span + 1)
    back = math.ceil(math.log(1e-18) / math.log(keep)) if keep > 0 else 0
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-back, 0)
    state = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("n"))
    return df.withColumn("ewm", F.aggregate(F.collect_list(F.col(value).cast("double")).over(w), state, lambda a, x: F.struct((a["s"] * keep + x).alias("s"), (a["n"] * keep + 1.0).alias("n")), lambda a: a["s"] / a["n"]))


def densify(df: DataFrame, keys: list[str], year: str, value: str, groups: list[str]) -> DataFrame:
    """Every year between a key's first and last, every group, 0 filled; years without anything are dropped."""
    span = df.groupBy(*keys).agg(F.min(year).alias("a"), F.max(year).alias("z")).select(*keys, F.explode(F.sequence("a", "z")).alias(year))
    grid = span.withColumn("group", F.explode(F.array(*map(F.lit, groups))))
    full = grid.join(df.select(*keys, year, "group", value), [*keys, year, "group"], "left").na.fill(0, [value])
    return full.withColumn("_s", F.sum(value).over(Window.partitionBy(*keys, year))).where("_s > 0").drop("_s")


def sorted_places(df: DataFrame, keys: list[str], value: str, **places: tuple[int, int]) -> DataFrame:
    """For each name its sorted[num * n // den] of a group, found from counts per value, so no group is gathered."""
    n = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    upto = n.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*keys).orderBy(value))).withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys)))
    at = lambda num, den: F.min(F.when(F.col("_upto") > F.floor(F.col("_all") * num / den), F.col(value)))
    return upto.groupBy(*keys).agg(*(at(*p).alias(name) for name, p in places.items()))


def upper_median(values: Column) -> Column:
    """sorted[n // 2]."""
    return F.get(F.sort_array(values), F.floor(F.size(values) / 2).cast("int"))


def index_percentile(values: Column, num: int, den: int) -> Column:
    """sorted[num * n // den]."""
    return F.get(F.sort_array(values), F.floor(F.size(values) * num / den).cast("int"))
