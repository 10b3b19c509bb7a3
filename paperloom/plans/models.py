"""Learning, evaluation, bootstraps and trends."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ..operators import analytics, learn, patterns, topics
from .base import query, table


@query(
    """WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2), x AS (SELECT event_type, date_diff('day', DATE '2024-01-01', day) AS x, n AS y FROM d)
    SELECT event_type, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(regr_r2(y, x), 6) AS r2 FROM x GROUP BY 1"""
)
def trend_slope(spark, sf_dir):
    d = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("y"))
    got = analytics.trend(d.withColumn("x", F.datediff("day", F.lit("2024-01-01"))), ["event_type"], "x", "y")
    return got.withColumns({c: F.round(c, 6) for c in ("slope", "intercept", "r2")})


@query("SELECT quality AS label, toxic AS predicted, count(*) AS n FROM labels GROUP BY 1, 2")
def confusion(spark, sf_dir):
    return learn.confusion(table(spark, sf_dir, "labels"), "quality", "toxic").select(F.col("quality").alias("label"), F.col("toxic").alias("predicted"), "n")


@query(
    """WITH c AS (SELECT k AS class, count(*) FILTER (quality = k) AS support, count(*) FILTER (toxic = k) AS given, count(*) FILTER (quality = k AND toxic = k) AS hit FROM labels, (SELECT unnest([0, 1]) AS k) GROUP BY 1)
    SELECT class, round(hit / given, 6) AS precision, round(hit / support, 6) AS recall, round(2.0 * hit / (given + support), 6) AS f1, support FROM c WHERE given > 0 AND support > 0"""
)
def class_scores(spark, sf_dir):
    got = learn.class_scores(table(spark, sf_dir, "labels"), "quality", "toxic")
    return got.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(
    """WITH n AS (SELECT o_orderpriority AS g, CAST(year(o_orderdate) AS INT) AS year, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1, 2)
    SELECT a.g, a.year, round((a.f * b.f + a.o * b.o + a.p * b.p) / (sqrt(a.f * a.f + a.o * a.o + a.p * a.p) * sqrt(b.f * b.f + b.o * b.o + b.p * b.p)), 6) AS cosine FROM n a JOIN n b ON a.year = b.year AND b.g = '1-URGENT' WHERE a.g <> '1-URGENT'"""
)
def similarity_trend(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("g"), F.year("o_orderdate").alias("year"), "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    got = analytics.similarity_trend(n, "g", "year", "o_orderstatus", ["F", "O", "P"], "1-URGENT")
    return got.select("g", "year", F.round("cosine", 6).alias("cosine"))


@query()
def bootstrap_share(spark, sf_dir):
    n = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return analytics.bootstrap_shares(n, ["day"], "event_type")


@query()
def bootstrap_mean_ci(spark, sf_dir):
    return analytics.bootstrap_mean(table(spark, sf_dir, "events").select("event_type", "event_id", "value"), ["event_type"], "value")


@query()
def pattern_features(spark, sf_dir):
    """M3 to M10 on conversations, whose words stand for their lemmas; the citation is the first word."""
    c = table(spark, sf_dir, "conversations").withColumn("tokens", patterns.plain_tokens(F.col("text"))).withColumn("cite_index", F.lit(0))
    got = patterns.sentence_features(c).select("conv_id", "turn", F.explode("features").alias("feature", "offset"))
    return got.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.sum("offset").alias("offsets"))


@query()
def forest_by_group(spark, sf_dir):
    """Classes of vectors, groups as folds, weights against imbalance."""
    e = table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("label"), (F.col("vec_id") % 50).alias("paper"), array_to_vector(F.col("embedding").cast("array<double>")).alias("x"))
    e = e.join(F.broadcast(learn.class_weights(e, "label")), "label")  # one row a class
    return learn.summary(learn.cross_validate(e, "label", "paper", weight="weight"))


@query()
def smote(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("label") == 0, "rare").otherwise("common").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    return learn.smote(e, "label", "v", "vec_id")


@query()
def lda_topics(spark, sf_dir):
    d = table(spark, sf_dir, "conversations").select(F.concat_ws("_", "conv_id", "turn").alias("id"), F.split(F.lower("text"), " ").alias("words"))
    trimmed = topics.trim(d, common=50)
    got = topics.document_topics(trimmed)
    return got.select("id", F.array_position("topics", F.array_max("topics")).alias("topic"))


@query()
def vif_columns(spark, sf_dir):
    """The columns that stay."""
    li = table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", (F.col("l_quantity") * 2 + F.col("l_discount") / 10).alias("double_quantity"))
    left = analytics.drop_collinear(li, li.columns)
    return spark.createDataFrame([(c,) for c in left], "kept string")
