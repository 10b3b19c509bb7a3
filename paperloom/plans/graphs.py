"""Yearly snapshots of a customer-to-supplier graph and their metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph
from .base import query, table

FIRST, LAST, ROUNDS = 1995, 2001, 20

_EDGES = "SELECT DISTINCT cn.n_nationkey AS src, sn.n_nationkey AS dst, CAST(min(year(o_orderdate)) AS INT) AS since FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation cn ON cn.n_nationkey = c_nationkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation sn ON sn.n_nationkey = s_nationkey GROUP BY 1, 2"
_SNAPS = f"e AS MATERIALIZED ({_EDGES}), s AS MATERIALIZED (SELECT y AS year, src, dst FROM e JOIN (SELECT CAST(unnest(range({FIRST}, {LAST + 1})) AS INT) AS y) ON since <= y), v AS MATERIALIZED (SELECT year, src AS node FROM s UNION SELECT year, dst FROM s)"


def nation_edges(spark, sf_dir):
    """(src, dst, year): a customer's nation buys from a supplier's nation."""
    o, li, c, s = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "customer", "supplier"))
    rows = o.join(li, o.o_orderkey == li.l_orderkey)
    rows = rows.join(c, rows.o_custkey == c.c_custkey).join(s, rows.l_suppkey == s.s_suppkey)
    return rows.select(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst"), F.year("o_orderdate").alias("year"))


def _snaps(spark, sf_dir):
    return graph.snapshots(nation_edges(spark, sf_dir), FIRST, LAST)


@query(f"WITH {_SNAPS} SELECT v.year, v.node, count(s.src) AS in_degree FROM v LEFT JOIN s ON s.year = v.year AND s.dst = v.node GROUP BY 1, 2")
def cumulative_indegree(spark, sf_dir):
    return graph.in_degree(_snaps(spark, sf_dir))


def _pagerank_sql() -> str:
    parts = [f"WITH {_SNAPS}, b AS MATERIALIZED (SELECT v.year, v.node, count(*) OVER (PARTITION BY v.year) AS n, d.deg FROM v LEFT JOIN (SELECT year, src, count(*) AS deg FROM s GROUP BY 1, 2) d ON d.year = v.year AND d.src = v.node), r0 AS (SELECT year, node, 1.0 / n AS r FROM b)"]
    for i in range(ROUNDS):
        parts.append(f"""r{i + 1} AS MATERIALIZED (WITH t AS (SELECT b.*, r FROM b JOIN r{i} USING (year, node)), l AS (SELECT year, sum(CASE WHEN deg IS NULL THEN r ELSE 0 END) AS lost FROM t GROUP BY 1),
        g AS (SELECT s.year, s.dst AS node, sum(r / deg) AS g FROM s JOIN t ON t.year = s.year AND t.node = s.src GROUP BY 1, 2)
        SELECT b.year, b.node, 0.15 / n + 0.85 * (coalesce(g, 0) + lost / n) AS r FROM b LEFT JOIN g USING (year, node) JOIN l USING (year))""")
    return ", ".join(parts) + f" SELECT year, node, round(r, 8) AS pagerank FROM r{ROUNDS}"


@query(_pagerank_sql())
def pagerank_by_year(spark, sf_dir):
    return graph.pagerank(_snaps(spark, sf_dir), rounds=ROUNDS).withColumn("pagerank", F.round("pagerank", 8))


def _hits_sql() -> str:
    parts = [f"WITH {_SNAPS}, h0 AS (SELECT year, node, 1.0 AS hub FROM v)"]
    for i in range(ROUNDS):
        parts.append(f"a{i + 1} AS MATERIALIZED (SELECT year, node, x / sum(x) OVER (PARTITION BY year) AS authority FROM (SELECT s.year, s.dst AS node, sum(hub) AS x FROM s JOIN h{i} h ON h.year = s.year AND h.node = s.src GROUP BY 1, 2))")
        parts.append(f"h{i + 1} AS MATERIALIZED (SELECT year, node, x / sum(x) OVER (PARTITION BY year) AS hub FROM (SELECT s.year, s.src AS node, sum(authority) AS x FROM s JOIN a{i + 1} a ON a.year = s.year AND a.node = s.dst GROUP BY 1, 2))")
    return ", ".join(parts) + f" SELECT v.year, v.node, round(coalesce(hub, 0), 8) AS hub, round(coalesce(authority, 0), 8) AS authority FROM v LEFT JOIN h{ROUNDS} USING (year, node) LEFT JOIN a{ROUNDS} USING (year, node)"


@query(_hits_sql())
def hits_by_year(spark, sf_dir):
    return graph.hits(_snaps(spark, sf_dir), rounds=ROUNDS).withColumns({c: F.round(c, 8) for c in ("hub", "authority")})


@query()
def load_centrality(spark, sf_dir):
    return graph.load_centrality(_snaps(spark, sf_dir)).withColumn("load_centrality", F.round("load_centrality", 8))


@query(
    f"""WITH {_SNAPS}, l AS (SELECT * FROM s WHERE year = {LAST} AND src <> dst),
    t AS (SELECT src AS origin, dst AS b, 'buys' AS p FROM l UNION ALL SELECT dst, src, 'inv-buys' FROM l)
    SELECT path, count(*) AS n FROM (SELECT p AS path FROM t UNION ALL SELECT t.p || ' ' || u.p FROM t JOIN t u ON u.origin = t.b WHERE u.b <> t.origin) GROUP BY 1"""
)
def two_step_paths(spark, sf_dir):
    """G6 on the last snapshot: one node is one sentence's origin, edges are dependencies."""
    from ..operators.dependencies import paths

    s = _snaps(spark, sf_dir).where((F.col("year") == LAST) & (F.col("src") != F.col("dst")))
    deps = s.select(F.lit(0).alias("sid"), F.lit("buys").alias("dep"), F.col("src").alias("gov"), F.col("dst").alias("tok"))
    every = deps.select("sid", F.col("gov").alias("tok")).unionByName(deps.select("sid", "tok")).distinct()
    got = paths(deps, every.withColumn("lemma", F.col("tok").cast("string")), every.select("sid", F.col("tok").alias("origin")))
    return got.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
