"""Windows over ordered rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import locate as joins_by_time
from ..operators import positions
from ..sources.readers import number_sections
from .base import query, table


@query("SELECT conv_id, turn, conv_id || '_' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS id FROM conversations")
def ordinal_ids(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.concat_ws("_", "conv_id", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).alias("id"))


@query(
    """SELECT conv_id, turn, CAST(coalesce(min(CASE WHEN role = 'assistant' THEN n END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) - n, 100) AS INT) AS distance
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)"""
)
def first_hit_within_4(spark, sf_dir):
    return positions.first_hit(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", F.col("role") == "assistant").select("conv_id", "turn", "distance")


@query(
    """SELECT conv_id, turn, CAST(coalesce(len(list(role) OVER p), 0) AS INT) AS before, CAST(coalesce(len(list(role) OVER f), 0) AS INT) AS after
    FROM conversations WINDOW p AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), f AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING)"""
)
def context_window(spark, sf_dir):
    got = positions.around(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "role")
    return got.select("conv_id", "turn", F.size("preceding").alias("before"), F.size("following").alias("after"))


@query(
    """SELECT conv_id, turn, array_to_string(w[greatest(1, 4 - 4):3], ' ') AS before, array_to_string(w[5:8], ' ') AS after
    FROM (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations) WHERE len(w) > 8"""
)
def token_frames(spark, sf_dir):
    """W5 around the fourth word."""
    c = table(spark, sf_dir, "conversations").withColumn("w", F.split("text", " ")).where("size(w) > 8")
    before, after = positions.token_frame(F.col("w"), F.lit(3))
    return c.select("conv_id", "turn", F.array_join(before, " ").alias("before"), F.array_join(after, " ").alias("after"))


@query("SELECT conv_id, turn, round((row_number() OVER w - 1) / count(*) OVER (PARTITION BY conv_id), 6) AS pos FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def relative_position(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("paper_id"), F.lit(0).alias("section"), F.lit(0).alias("subsection"), F.col("turn").alias("sentence"))
    return positions.relative(c).select(F.col("paper_id").alias("conv_id"), F.col("sentence").alias("turn"), F.round("relative_pos_in_paper", 6).alias("pos"))


@query("SELECT conv_id, turn, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS section FROM conversations")
def running_section(spark, sf_dir):
    """A user turn opens a section."""
    c = table(spark, sf_dir, "conversations").withColumn("kind", F.when(F.col("role") == "user", "section").otherwise("body"))
    return number_sections(c, ["conv_id"], "turn").select("conv_id", "turn", "section")


@query(
    """WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, avg(value) AS v, row_number() OVER (PARTITION BY event_type ORDER BY CAST(ts AS DATE)) AS n FROM events GROUP BY 1, 2)
    SELECT a.event_type, a.day, round(sum(b.v * pow(0.5, a.n - b.n)) / sum(pow(0.5, a.n - b.n)), 6) AS ewm FROM d a JOIN d b ON a.event_type = b.event_type AND b.n <= a.n GROUP BY 1, 2"""
)
def ewm_value(spark, sf_dir):
    d = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))
    return positions.smoothed(d, ["event_type"], "day", "v", 3).select("event_type", "day", F.round("ewm", 6).alias("ewm"))


@query(
    """WITH n AS (SELECT o_custkey AS c, CAST(year(o_orderdate) AS INT) AS y, o_orderstatus AS g, count(*) AS n FROM orders GROUP BY 1, 2, 3),
    s AS (SELECT c, unnest(range(min(y), max(y) + 1)) AS y FROM n GROUP BY 1),
    f AS (SELECT s.c, CAST(s.y AS INT) AS y, g.g, coalesce(n.n, 0) AS n FROM s CROSS JOIN (SELECT unnest(['F', 'O', 'P']) AS g) g LEFT JOIN n ON n.c = s.c AND n.y = s.y AND n.g = g.g)
    SELECT c, y, g AS "group", CAST(n AS BIGINT) AS n FROM (SELECT *, sum(n) OVER (PARTITION BY c, y) AS t FROM f) WHERE t > 0"""
)
def calendar_densify(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c"), F.year("o_orderdate").alias("y"), F.col("o_orderstatus").alias("group")).agg(F.count(F.lit(1)).alias("n"))
    return positions.densify(n, ["c"], "y", "n", ["F", "O", "P"]).select("c", "y", "group", "n")


@query(
    """WITH m AS (SELECT l_suppkey AS s, CAST(year(l_shipdate) AS INT) AS y, round(sum(l_quantity), 2) AS q FROM lineitem WHERE l_suppkey % 3 = year(l_shipdate) % 3 GROUP BY 1, 2)
    SELECT f.s, f.y, m.q FROM (SELECT DISTINCT l_suppkey AS s, CAST(year(l_shipdate) AS INT) AS y FROM lineitem) f ASOF LEFT JOIN m ON f.s = m.s AND f.y >= m.y"""
)
def asof_metric(spark, sf_dir):
    """J13 as of: the latest known metric of a year not after the fact's."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s"), F.year("l_shipdate").alias("y"), "l_quantity")
    known = li.where("s % 3 = y % 3").groupBy("s", "y").agg(F.round(F.sum("l_quantity"), 2).alias("q"))
    return joins_by_time.at_year(li.select("s", "y").distinct(), known, ["s"], "y", ["q"], as_of=True).select("s", "y", "q")


@query(
    """WITH m AS (SELECT l_suppkey AS s, CAST(year(l_shipdate) AS INT) AS y, count(*) AS n FROM lineitem WHERE l_suppkey % 3 = year(l_shipdate) % 3 GROUP BY 1, 2)
    SELECT f.s, f.y, coalesce(m.n, 0) AS n FROM (SELECT DISTINCT l_suppkey AS s, CAST(year(l_shipdate) AS INT) AS y FROM lineitem) f LEFT JOIN m ON f.s = m.s AND f.y = m.y"""
)
def same_year_metric(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s"), F.year("l_shipdate").alias("y"))
    known = li.where("s % 3 = y % 3").groupBy("s", "y").agg(F.count(F.lit(1)).alias("n"))
    return joins_by_time.at_year(li.distinct(), known, ["s"], "y", ["n"]).select("s", "y", "n")


@query(
    """SELECT c_custkey, p AS closest FROM (SELECT c_custkey, p_partkey AS p, row_number() OVER (PARTITION BY c_custkey ORDER BY abs(p_retailprice - c_acctbal), p_partkey) AS n
    FROM customer JOIN part ON p_size = c_nationkey WHERE abs(p_retailprice - c_acctbal) <= 500) WHERE n = 1"""
)
def closest_value(spark, sf_dir):
    """Nearest within a bound, first key wins."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("grp"), F.col("c_acctbal").alias("v"))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_size").alias("grp"), F.col("p_retailprice").alias("v"))
    return joins_by_time.nearest(c, p, 500.0).select(F.col("id").alias("c_custkey"), F.col("key").alias("closest"))
