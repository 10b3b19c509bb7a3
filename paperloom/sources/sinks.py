"""Writers: tables, delimited text, models, and idempotent appends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_tsv(df: DataFrame, path: str, header: bool = False) -> None:
    """S18."""
    df.write.mode("overwrite").option("sep", "\t").option("header", str(header).lower()).csv(path)


def write_partitioned(df: DataFrame, path: str, *by: str) -> None:
    """Parquet, replacing only the partitions that ``df`` has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def append_new(df: DataFrame, path: str, key: str) -> None:
    """Append the rows whose key the target does not have; reading the folder is their union.

    Only a folder that is not there counts as empty; a table without the key raises.
    """
    context = df.sparkSession.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(context._jsc.hadoopConfiguration()).exists(place)
    done = df.sparkSession.read.parquet(path).select(key).distinct() if there else None
    (df if done is None else df.join(done, key, "left_anti")).write.mode("append").parquet(path)


def read_delimited(spark, path: str, schema: str, sep: str = "\t") -> DataFrame:
    """Typed delimited text; rows that do not fit are dropped."""
    return spark.read.schema(schema).option("sep", sep).option("mode", "DROPMALFORMED").csv(path)


def insert_absent(base: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """``base`` with the rows of ``more`` whose key it lacks."""
    return base.unionByName(more.join(base.select(key).distinct(), key, "left_anti"))


def with_totals(df: DataFrame, keys: list[str], parent: list[str]) -> DataFrame:
    """A1, A2: counts per key and their share of the parent's total."""
    from pyspark.sql import Window

    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*parent)))
