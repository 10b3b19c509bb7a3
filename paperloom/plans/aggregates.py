"""Counts, shares, distributions and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics, learn, positions
from .base import query, table

EVENTS = ["click", "error", "purchase", "signup", "view"]


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY CAST(ts AS DATE)), 6) AS share FROM events GROUP BY 1, 2")
def share_by_type_day(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "event_type")
    return analytics.shares(ev, ["day"], "event_type").withColumn("share", F.round("share", 6))


@query("SELECT CAST(ts AS DATE) AS day, " + ", ".join(f"count(*) FILTER (event_type = '{e}') AS {e}" for e in EVENTS) + " FROM events GROUP BY 1")
def pivot_types(spark, sf_dir):
    return analytics.wide(table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "event_type"), ["day"], "event_type", EVENTS)


@query("SELECT l_suppkey, CAST(year(o_orderdate) AS INT) AS year, count(DISTINCT o_custkey) AS buyers FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2")
def distinct_buyers_by_supplier_year(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    edges = o.join(li, o.o_orderkey == li.l_orderkey).select("l_suppkey", F.year("o_orderdate").alias("year"), "o_custkey")
    return edges.groupBy("l_suppkey", "year").agg(F.countDistinct("o_custkey").alias("buyers"))


@query("SELECT user_id, list_count(f) AS n, array_to_string(list_sort(f), ',') AS types FROM (SELECT user_id, list(DISTINCT event_type) AS f FROM events GROUP BY 1)")
def typed_sets(spark, sf_dir):
    got = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("f"))
    return got.select("user_id", F.size("f").cast("long").alias("n"), F.array_join("f", ",").alias("types"))


@query("SELECT o_orderpriority, round(avg(o_totalprice), 4) AS mean, round(var_samp(o_totalprice) / 1e6, 4) AS var_m FROM orders GROUP BY 1")
def mean_and_variance(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.round(F.avg("o_totalprice"), 4).alias("mean"), F.round(F.var_samp("o_totalprice") / 1e6, 4).alias("var_m"))


@query("SELECT day, var_samp(n) AS var FROM (SELECT event_type AS day, CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1".replace("AS var FROM", "AS v FROM").replace("var_samp(n) AS v", "round(var_samp(n), 6) AS v"))
def var_counts(spark, sf_dir):
    n = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("day"), F.to_date("ts").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("day").agg(F.round(F.var_samp("n"), 6).alias("v"))


@query("SELECT o_orderpriority, list_sort(list(o_totalprice))[len(list(o_totalprice)) // 2 + 1] AS median FROM orders GROUP BY 1")
def upper_median_price(spark, sf_dir):
    return positions.sorted_places(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", median=(1, 2))


@query(
    "SELECT l_returnflag, s[n // 20 + 1] AS p5, s[n // 2 + 1] AS p50, s[19 * n // 20 + 1] AS p95 FROM (SELECT l_returnflag, list_sort(list(l_quantity)) AS s, count(*) AS n FROM lineitem GROUP BY 1)"
)
def pct_5_50_95(spark, sf_dir):
    return positions.sorted_places(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", p5=(1, 20), p50=(1, 2), p95=(19, 20))


@query(
    "SELECT quality AS label, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)) * CASE WHEN quality = 0 THEN 1.5 ELSE 1.0 END, 6) AS weight FROM labels GROUP BY quality"
)
def class_weights(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select(F.col("quality").alias("label"))
    return learn.class_weights(rows, "label", {0: 1.5}).withColumn("weight", F.round("weight", 6))


@query("SELECT nation, CAST(min(y) AS INT) AS first, CAST(max(y) AS INT) AS last FROM (SELECT c_nationkey AS nation, year(o_orderdate) AS y FROM orders JOIN customer ON c_custkey = o_custkey) GROUP BY 1")
def first_and_last_year(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_nationkey").alias("nation")).agg(F.min(F.year("o_orderdate")).alias("first"), F.max(F.year("o_orderdate")).alias("last"))


@query(
    "SELECT b AS bin, coalesce(n, 0) AS n FROM (SELECT unnest(range(0, 12)) AS b) LEFT JOIN (SELECT CAST(CASE WHEN p < 0 THEN 0 WHEN p >= 500000 THEN 11 ELSE floor(p / 50000) + 1 END AS BIGINT) AS b, count(*) AS n FROM (SELECT o_totalprice AS p FROM orders) GROUP BY 1) USING (b)"
)
def price_histogram(spark, sf_dir):
    return analytics.histogram(table(spark, sf_dir, "orders"), "o_totalprice", 0, 500000, 10)


@query("SELECT o_custkey, round(1.0 / count(DISTINCT l_suppkey), 6) AS total_refs, count(*) AS occurrences FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def document_totals(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return o.join(li, o.o_orderkey == li.l_orderkey).groupBy("o_custkey").agg(F.round(1.0 / F.countDistinct("l_suppkey"), 6).alias("total_refs"), F.count(F.lit(1)).alias("occurrences"))


@query(
    """SELECT l_suppkey AS cited, f AS feature, round(CASE WHEN f LIKE 'DISTANCE%' THEN min(abs(v)) WHEN f LIKE 'NUM_%' THEN avg(v) ELSE max(v) END, 6) AS value
    FROM (SELECT l_suppkey, unnest(['DISTANCE_discount', 'NUM_quantity', 'max_tax']) AS f, unnest([l_discount - 0.05, l_quantity, l_tax]) AS v FROM lineitem) GROUP BY 1, 2"""
)
def merged_features(spark, sf_dir):
    """One aggregation; the rule is the feature's name."""
    li = table(spark, sf_dir, "lineitem")
    rows = li.select(F.col("l_suppkey").alias("cited"), F.explode(F.create_map(F.lit("DISTANCE_discount"), F.col("l_discount") - 0.05, F.lit("NUM_quantity"), F.col("l_quantity"), F.lit("max_tax"), F.col("l_tax"))).alias("feature", "v"))
    rule = F.when(F.col("feature").startswith("DISTANCE"), F.min(F.abs("v"))).when(F.col("feature").startswith("NUM_"), F.avg("v")).otherwise(F.max("v"))
    return rows.groupBy("cited", "feature").agg(F.round(rule, 6).alias("value"))


@query("SELECT 'c' || c_custkey AS id, c_nationkey AS nation FROM customer UNION ALL SELECT 's' || s_suppkey, s_nationkey FROM supplier")
def union_sources(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_nationkey").alias("nation"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"))
    return c.unionByName(s)


@query("SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def node_union(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    return c.select(F.col("c_nationkey").alias("nation")).unionByName(s.select(F.col("s_nationkey").alias("nation"))).distinct()


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def never_ordered(spark, sf_dir):
    """Difference as an anti join."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


@query(
    """WITH e AS (SELECT DISTINCT o_custkey AS c, l_suppkey AS s, CAST(year(o_orderdate) AS INT) AS y FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
    SELECT a.c, CAST(count(*) AS BIGINT) AS common FROM (SELECT DISTINCT c, s FROM e WHERE y = 1996) a JOIN (SELECT DISTINCT c, s FROM e WHERE y = 1997) b ON a.c = b.c AND a.s = b.s GROUP BY 1"""
)
def common_suppliers(spark, sf_dir):
    """Size of the intersection of two years' supplier sets."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    e = o.join(li, o.o_orderkey == li.l_orderkey).select(F.col("o_custkey").alias("c"), F.col("l_suppkey").alias("s"), F.year("o_orderdate").alias("y")).where("y IN (1996, 1997)")
    both = e.groupBy("c", "s").agg(F.countDistinct("y").alias("k")).where("k = 2")
    return both.groupBy("c").agg(F.count(F.lit(1)).alias("common"))


@query("SELECT event_type, n FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1) ORDER BY n DESC, event_type LIMIT 3")
def top_groups(spark, sf_dir):
    """Explicit order with a tie key."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "event_type").limit(3)


@query("SELECT label, round(list_sum(s[1:3]) / 3, 5) AS top3 FROM (SELECT label, list_reverse_sort(list(CAST(embedding[1] AS DOUBLE))) AS s FROM embeddings GROUP BY 1)")
def top_three_scores(spark, sf_dir):
    """The three best of each group by rank, without gathering the group."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "embeddings").select("label", F.col("embedding")[0].cast("double").alias("x"))
    best = e.withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("x")))).where("n <= 3")
    return best.groupBy("label").agg(F.round(F.sum("x") / 3, 5).alias("top3"))
