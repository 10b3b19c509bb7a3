"""Streaming forms of the snapshot and append operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.sinks import append_new


def file_stream(spark: SparkSession, path: str, schema, pattern: str | None = None) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).parquet(path)


def windowed_counts(events: DataFrame, time: str, keys: list[str], size: str = "1 day", slide: str | None = None, late: str = "2 days") -> DataFrame:
    """W13 on a stream: counts per window and key; rows later than ``late`` are dropped with their closed windows."""
    ts = F.col(time).cast("timestamp")
    w = F.window("_ts", size, slide) if slide else F.window("_ts", size)
    return events.withColumn("_ts", ts).withWatermark("_ts", late).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, time: str, key: str, gap: str = "6 hours", late: str = "2 days") -> DataFrame:
    """Runs of a key's events without a longer gap: start, end, n."""
    return events.withColumn("_ts", F.col(time).cast("timestamp")).withWatermark("_ts", late).groupBy(F.session_window("_ts", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def append_stream(stream: DataFrame, path: str, key: str, checkpoint: str) -> StreamingQuery:
    """S19 on a stream: every batch appends only keys that the table lacks, so a replayed batch changes nothing."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: append_new(df.dropDuplicates([key]), path, key)).trigger(availableNow=True).start()
