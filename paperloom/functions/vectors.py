"""Vector arithmetic on array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def unit_sum(a: Column) -> Column:
    total = F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))
    return F.when(total > 0, F.transform(a, lambda x: x / total)).otherwise(F.transform(a, lambda x: F.lit(0.0)))


def jensen_shannon(a: Column, b: Column) -> Column:
    """mean divergence of the two shares from their middle, in nats; 0 log 0 is 0."""
    part = lambda x, m: F.when((x > 0) & (m > 0), x * F.log(x / m)).otherwise(0.0)
    return F.aggregate(F.zip_with(unit_sum(a), unit_sum(b), lambda x, y: (part(x, (x + y) / 2) + part(y, (x + y) / 2)) / 2), F.lit(0.0), lambda s, x: s + x)


def sum_vectors(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Element-wise sum per key, as partial sums per element; (keys, vector)."""
    parts = df.select(*keys, F.posexplode(vector).alias("_i", "_x")).groupBy(*keys, "_i").agg(F.sum("_x").alias("_x"))
    return parts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda s: s["_x"]).alias(vector))
