"""Distributions, bootstraps, similarity trends and regressions over the typed graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression, LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors
from ..session import ship_package


def shares(df: DataFrame, parent: list[str], child: str) -> DataFrame:
    """A1, A2: (parent, child, n, share)."""
    n = df.groupBy(*parent, child).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*parent)))


def wide(df: DataFrame, keys: list[str], column: str, values: list[str]) -> DataFrame:
    """A3: one count column per value, 0 filled."""
    return df.groupBy(*keys).pivot(column, values).count().na.fill(0)


def typed_citations(df: DataFrame) -> DataFrame:
    """A5: (citing, functions): the distinct (cited, function) of each citing paper."""
    return df.groupBy("citing").agg(F.array_sort(F.collect_set(F.struct("cited", "function"))).alias("functions"))


def bootstrap_shares(counts: DataFrame, keys: list[str], column: str, n: str = "n", draws: int = 1000, seed: int = 3) -> DataFrame:
    """(keys, column, low, mid, high): 5, 50 and 95 % places of each value's share in ``draws`` samples with replacement.

    A sample of counts is a multinomial draw, so a group costs its number of values and
    never its rows; the seed is the group's.
    """
    ship_package(counts.sparkSession)
    schema = ", ".join([*(f"{k} {t}" for k, t in counts.dtypes if k in [*keys, column]), "low double, mid double, high double"])
    names = [c for c in counts.columns if c in [*keys, column]]

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(column)
        total = int(f[n].sum())
        rng = np.random.default_rng([seed, *(abs(hash_text(str(f[k].iloc[0]))) for k in keys)])
        drawn = np.sort(rng.multinomial(total, f[n] / total, size=draws) / total, axis=0)
        return f[names].assign(low=drawn[draws // 20], mid=drawn[draws // 2], high=drawn[19 * draws // 20])

    return counts.groupBy(*keys).applyInPandas(run, schema)


def hash_text(x: str) -> int:
    out = 0
    for c in x.encode():
        out = (out * 131 + c) % (1 << 31)
    return out


def bootstrap_mean(df: DataFrame, keys: list[str], value: str, draws: int = 1000, seed: int = 3) -> DataFrame:
    """(keys, mean, low, high): 2.5 and 97.5 % places of the mean over Poisson-weighted draws.

    Each row is weighed by Poisson(1) numbers from a hash of its own, which makes the
    draws sums that add up over partitions; no group is gathered. Weights are summed where
    they are drawn, 256 rows and 256 groups at a time, so neither they nor rows times draws are kept.
    """
    ship_package(df.sparkSession)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"), F.xxhash64(*df.columns).alias("_h"))
    sums = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema), "_s array<double>, _n array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        types: list[pa.DataType] = []

        def out() -> pa.RecordBatch:
            columns = [pa.array([g[i] for g in held], t) for i, t in enumerate(types)]
            flat = [pa.array(np.concatenate([h[j] for h in held.values()]) if held else np.zeros(0)) for j in (0, 1)]
            places = pa.array(np.arange(len(held) + 1, dtype=np.int32) * draws, pa.int32())
            return pa.RecordBatch.from_arrays([*columns, *(pa.ListArray.from_arrays(places, f) for f in flat)], names=[*keys, "_s", "_n"])

        for batch in batches:
            types = [batch.column(k).type for k in keys]
            places: dict[tuple, list[int]] = {}
            for i, g in enumerate(zip(*(batch.column(k).to_pylist() for k in keys), strict=True) if keys else [()] * len(batch)):
                places.setdefault(g, []).append(i)
            v, h = batch.column("_v").to_numpy(zero_copy_only=False), batch.column("_h").to_pylist()
            for g, at in places.items():
                if g not in held and len(held) == 256:
                    yield out()
                    held.clear()
                total = held.setdefault(g, np.zeros((2, draws)))
                for low in range(0, len(at), 256):
                    some = at[low : low + 256]
                    w = np.array([np.random.default_rng([seed, h[i] & 0x7FFFFFFFFFFFFFFF]).poisson(1.0, draws) for i in some], dtype=float)
                    # draws without this group's rows add nothing, not even a value that is no number
                    total[0] += np.where(w > 0, w * v[some][:, None], 0.0).sum(axis=0)
                    total[1] += w.sum(axis=0)
        if held:
            yield out()

    each = rows.mapInArrow(run, sums).select(*keys, F.posexplode(F.arrays_zip("_s", "_n")).alias("_d", "_z")).groupBy(*keys, "_d").agg(F.sum("_z._s").alias("_s"), F.sum("_z._n").alias("_n")).where("_n > 0").select(*keys, (F.col("_s") / F.col("_n")).alias("_m"))
    ends = each.groupBy(*keys).agg(F.sort_array(F.collect_list("_m")).alias("_a")).select(*keys, F.get("_a", F.floor(F.size("_a") * 0.025).cast("int")).alias("low"), F.get("_a", F.least(F.floor(F.size("_a") * 0.975).cast("int"), F.size("_a") - 1)).alias("high"))
    return df.groupBy(*keys).agg(F.avg(value).alias("mean")).join(ends, keys)


def similarity_trend(counts: DataFrame, group: str, year: str, column: str, values: list[str], reference: str) -> DataFrame:
    """(group, year, cosine, jsd) of each group's yearly vector of counts with the reference group's."""
    table = wide_sum(counts, [group, year], column, values)
    ref = table.where(F.col(group) == reference).select(year, F.col("v").alias("r"))
    return table.where(F.col(group) != reference).join(ref, year).select(group, year, vectors.cosine(F.col("v"), F.col("r")).alias("cosine"), vectors.jensen_shannon(F.col("v"), F.col("r")).alias("jsd"))


def wide_sum(counts: DataFrame, keys: list[str], column: str, values: list[str], n: str = "n") -> DataFrame:
    return counts.groupBy(*keys).agg(F.array(*(F.sum(F.when(F.col(column) == v, F.col(n)).otherwise(0)).cast("double") for v in values)).alias("v"))


def trend(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, slope, intercept, r2)."""
    return df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def robust_trend(df: DataFrame, x: str, y: str, rounds: int = 20, tune: float = 1.345) -> tuple[float, float]:
    """Slope and intercept by Huber weights; each round is one aggregation."""
    slope, cut = df.select(F.regr_slope(y, x), F.regr_intercept(y, x)).first()
    for _ in range(rounds):
        r = F.col(y) - (F.lit(slope) * F.col(x) + F.lit(cut))
        scale = df.select(F.percentile_approx(F.abs(r), 0.5)).first()[0] / 0.6745 or 1e-9
        w = F.least(F.lit(1.0), F.lit(tune * scale) / F.greatest(F.abs(r), F.lit(1e-12)))
        s = df.select(F.sum(w), F.sum(w * F.col(x)), F.sum(w * F.col(y)), F.sum(w * F.col(x) * F.col(x)), F.sum(w * F.col(x) * F.col(y))).first()
        slope = (s[0] * s[4] - s[1] * s[2]) / (s[0] * s[3] - s[1] ** 2)
        cut = (s[2] - slope * s[1]) / s[0]
    return slope, cut


def partial_residuals(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """``residual`` of a linear fit of y on xs."""
    ready = VectorAssembler(inputCols=xs, outputCol="_x").transform(df)
    return LinearRegression(featuresCol="_x", labelCol=y, predictionCol="_p").fit(ready).transform(ready).withColumn("residual", F.col(y) - F.col("_p")).drop("_x", "_p")


def inflation(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Variance inflation of each column, 1 / (1 - r2) on the others."""
    out = {}
    for c in columns:
        ready = VectorAssembler(inputCols=[k for k in columns if k != c], outputCol="_x").transform(df)
        r2 = LinearRegression(featuresCol="_x", labelCol=c).fit(ready).summary.r2
        out[c] = float("inf") if r2 >= 1 else 1 / (1 - r2)
    return out


def drop_collinear(df: DataFrame, columns: list[str], most: float = 10.0) -> list[str]:
    """Columns that stay when the most inflated one goes until none is above ``most``."""
    left = list(columns)
    while len(left) > 1:
        got = inflation(df, left)
        worst = max(left, key=lambda c: (got[c], c))
        if got[worst] <= most:
            break
        left.remove(worst)
    return left


def poisson_fit(df: DataFrame, y: str, xs: list[str]):
    """A Poisson regression; compare two by their deviance. Mixed, hurdle and zero-inflated models are not offered."""
    ready = VectorAssembler(inputCols=xs, outputCol="_x").transform(df)
    return GeneralizedLinearRegression(family="poisson", link="log", featuresCol="_x", labelCol=y).fit(ready)


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n) of equal widths, empty ones included; values outside go to bins 0 and bins + 1."""
    got = df.where(F.col(value).isNotNull()).groupBy(F.expr(f"width_bucket(CAST({value} AS double), {low}D, {high}D, {bins})").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return df.sparkSession.range(bins + 2).select(F.col("id").alias("bin")).join(got, "bin", "left").na.fill(0, ["n"])


def active_workshops(df: DataFrame) -> DataFrame:
    """(prefix, name, kind) of workshops (line, name, prefixes).

    A name with five different prefixes or more is Long-Running; of several with one
    prefix the last line counts. A name with exactly one prefix is One-off, if it has
    no digit and no ordinal from second to seventh in it, and its prefix is no
    long-running one; of several the first line counts.
    """
    own = df.withColumn("prefixes", F.array_distinct("prefixes"))
    of = lambda rows, pick: rows.select("line", "name", F.explode("prefixes").alias("prefix")).groupBy("prefix").agg(pick("name", "line").alias("name"))
    long = of(own.where(F.size("prefixes") >= 5), F.max_by).withColumn("kind", F.lit("Long-Running"))
    plain = ~F.col("name").rlike("[0-9]") & ~F.lower("name").rlike("second|third|fourth|fifth|sixth|seventh")
    once = of(own.where((F.size("prefixes") == 1) & plain), F.min_by).withColumn("kind", F.lit("One-off"))
    return long.unionByName(once.join(long, "prefix", "left_anti"))
