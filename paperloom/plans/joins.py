"""Lookups, blocked fuzzy joins and entity resolution on analogues of papers and references."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import locate, resolve
from .base import query, table


@query(
    """WITH ids AS (SELECT p_partkey AS id, 'P' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS k FROM part), pre AS (SELECT DISTINCT left('P' || lpad(CAST(p_partkey AS VARCHAR), 7, '0'), 3 + CAST(p_partkey % 4 AS INT)) AS prefix FROM part)
    SELECT k AS id, max_by(prefix, length(prefix)) AS value FROM ids LEFT JOIN pre ON starts_with(k, prefix) AND length(prefix) BETWEEN 3 AND 6 GROUP BY 1"""
)
def longest_prefix(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("P"), F.lpad(F.col("p_partkey").cast("string"), 7, "0")).alias("id"))
    pre = p.select(F.expr("left(id, 3 + CAST(p_partkey % 4 AS INT))").alias("prefix")).distinct()
    return locate.longest_prefix(p.select("id"), pre.withColumn("value", F.col("prefix"))).select("id", "value")


@query("SELECT conv_id, turn FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations s WHERE s.role = 'system' AND s.conv_id = c.conv_id AND s.turn = c.turn)")
def anti_location(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("paper_id"), F.lit(0).alias("section"), F.lit(0).alias("subsection"), F.col("turn").alias("sentence"), "role")
    out = locate.elsewhere(c, c.where("role = 'system'").drop("role"))
    return out.select(F.col("paper_id").alias("conv_id"), F.col("sentence").alias("turn"))


_LCP = "list_max(list_transform(range(0, least(length({a}), length({b})) + 1), lambda i: CASE WHEN left({a}, i) = left({b}, i) THEN i ELSE 0 END))"


@query(
    f"""WITH n AS (SELECT DISTINCT p_name AS t FROM part), p AS (SELECT a.t AS a, b.t AS b, replace(a.t, ' ', '') AS x, replace(b.t, ' ', '') AS y FROM n a JOIN n b ON left(a.t, 3) = left(b.t, 3) AND a.t < b.t)
    SELECT a, b, round({_LCP.format(a="x", b="y")} / greatest(1, least(length(x), length(y))), 6) AS share FROM p"""
)
def blocked_title_pairs(spark, sf_dir):
    """Pairs in a block of three letters, with their shared prefix over the shorter one."""
    n = table(spark, sf_dir, "part").select(F.col("p_name").alias("t")).distinct().withColumn("block", F.left("t", F.lit(3)))
    pairs = n.select("block", F.col("t").alias("a")).join(n.select("block", F.col("t").alias("b")), "block").where("a < b")
    return pairs.select("a", "b", F.round(F.greatest(*tx.prefix_share(F.col("a"), F.col("b"))), 6).alias("share"))


@query(
    """WITH n AS (SELECT DISTINCT p_name AS t FROM part) SELECT a.t AS a, b.t AS b FROM n a JOIN n b ON a.t < b.t AND length(a.t) - length(b.t) BETWEEN -1 AND 1 AND levenshtein(a.t, b.t) <= 2"""
)
def levenshtein_close(spark, sf_dir):
    """few edits; names of six letters or more that two edits part share a pair of letters, so pairs are the block."""
    n = table(spark, sf_dir, "part").select(F.col("p_name").alias("t")).distinct()
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substring(F.col(c), i, F.lit(2))))
    g = n.withColumn("g", F.explode(grams("t")))
    pairs = g.select("g", F.col("t").alias("a")).join(g.select("g", F.col("t").alias("b")), "g").where("a < b AND abs(length(a) - length(b)) <= 1").select("a", "b").distinct()
    return pairs.where(F.levenshtein("a", "b", 2) >= 0)


@query(
    """WITH r AS (SELECT DISTINCT c_nationkey AS nation, c_mktsegment AS seg, c_custkey AS k FROM customer),
    a AS (SELECT nation, seg, max(k) AS id1 FROM r GROUP BY 1, 2), b AS (SELECT nation, max(k) AS id2 FROM r GROUP BY 1)
    SELECT s_suppkey, coalesce(a.id1, b.id2) AS matched FROM (SELECT s_suppkey, s_nationkey, CASE WHEN s_suppkey % 2 = 0 THEN 'BUILDING' ELSE 'NONE' END AS seg FROM supplier) s
    LEFT JOIN a ON a.nation = s_nationkey AND a.seg = s.seg LEFT JOIN b ON b.nation = s_nationkey"""
)
def key_cascade(spark, sf_dir):
    """A sharp key, then a blunt one; the last of equal keys wins."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("s_nationkey"), F.col("c_mktsegment").alias("seg"), "c_custkey")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", F.when(F.col("s_suppkey") % 2 == 0, "BUILDING").otherwise("NONE").alias("seg"))
    a = c.groupBy("s_nationkey", "seg").agg(F.max("c_custkey").alias("id1"))
    b = c.groupBy("s_nationkey").agg(F.max("c_custkey").alias("id2"))
    return s.join(a, ["s_nationkey", "seg"], "left").join(b, "s_nationkey", "left").select("s_suppkey", F.coalesce("id1", "id2").alias("matched"))


@query(
    """WITH q AS (SELECT p_partkey AS id, p_name AS t FROM part WHERE p_partkey % 20 = 0), n AS (SELECT DISTINCT p_name AS u FROM part),
    s AS (SELECT id, u, t, list_sum(list_transform(list_distinct(string_split(t, '')), lambda c: least(length(t) - length(replace(t, c, '')), length(u) - length(replace(u, c, ''))))) AS m FROM q JOIN n ON split_part(t, ' ', 2) = split_part(u, ' ', 2) AND t <> u)
    SELECT id, u AS best, round(2.0 * m / (length(t) + length(u)), 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY 2.0 * m / (length(t) + length(u)) DESC, u) AS n FROM s) WHERE n = 1"""
)
def quick_ratio_best(spark, sf_dir):
    """Queries are every part whose id 20 divides, against all names that share the second word."""
    from pyspark.sql import Window

    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("t"))
    second = lambda c: F.split_part(F.col(c), F.lit(" "), F.lit(2))
    q = p.where("id % 20 = 0").withColumn("w", second("t"))
    n = p.select(F.col("t").alias("u")).distinct().withColumn("w", second("u"))
    s = q.join(n, "w").where("t <> u").withColumn("score", tx.quick_ratio(F.col("t"), F.col("u")))
    best = s.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "u"))).where("n = 1")
    return best.select("id", F.col("u").alias("best"), F.round("score", 6).alias("score"))


@query(
    """SELECT d.doc_id, CAST(min(b.item_id) AS BIGINT) AS item FROM documents d JOIN (SELECT item_id, array_to_string(string_split(text, ' ')[3:8], ' ') AS k FROM benchmark) b ON contains(d.text, b.k) GROUP BY 1"""
)
def contained_strings(spark, sf_dir):
    """Containment, the smallest id wins. The keys are six words of each item; a document's runs of six words meet them by equality."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    keys = table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.slice(F.split("text", " "), 3, 6), " ").alias("k"))
    # whole words inside a key stand between blanks; its first and last may be parts of words, so the four inner ones are the equality
    d = d.withColumn("w", F.split("text", " "))
    shifted = F.arrays_zip(*(F.slice("w", i, F.greatest(F.size("w") - i + 1, F.lit(0))).alias(f"w{i}") for i in range(1, 5)))
    runs = d.select("doc_id", F.explode(F.array_distinct(F.transform(shifted, lambda z: F.concat_ws(" ", *(z[f"w{i}"] for i in range(1, 5)))))).alias("r"))
    hit = runs.join(keys.withColumn("r", F.array_join(F.slice(F.split("k", " "), 2, 4), " ")), "r").select("doc_id", "item_id", "k").distinct()
    return hit.join(d.select("doc_id", "text"), "doc_id").where(F.contains("text", "k")).groupBy("doc_id").agg(F.min("item_id").alias("item"))


@query(
    """WITH RECURSIVE n AS (SELECT s_suppkey AS k, s_nationkey AS a, CAST(floor(s_acctbal / 500) AS BIGINT) AS b FROM supplier),
    e AS (SELECT x.k AS u, y.k AS v FROM n x JOIN n y ON x.a = y.a AND x.b = y.b),
    r(u, v) AS (SELECT k, k FROM n UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u)
    SELECT u AS node, min(v) AS root FROM r GROUP BY 1"""
)
def components(spark, sf_dir):
    """G1: suppliers of one nation whose balances fall into one step are linked, each to the least of its cell."""
    from pyspark.sql import Window

    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ref_id"), "s_nationkey", F.floor(F.col("s_acctbal") / 500).alias("b"))
    pairs = s.select(F.col("ref_id").alias("a"), F.min("ref_id").over(Window.partitionBy("s_nationkey", "b")).alias("b"))
    comps = resolve.connected_components(pairs)
    return s.select(F.col("ref_id").alias("node")).join(comps, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


@query(
    """WITH n AS (SELECT DISTINCT p_name AS t FROM part) SELECT t AS name, CASE WHEN count(*) = 1 THEN min(u) END AS known, count(*) AS n
    FROM (SELECT a.t, b.t AS u FROM n a JOIN n b ON split_part(a.t, ' ', 2) = split_part(b.t, ' ', 2) AND left(b.t, 1) = left(a.t, 1)) GROUP BY 1"""
)
def ambiguous_names(spark, sf_dir):
    """Last word as block, first letters as forenames; null where several fit."""
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    short = names.select(F.concat(F.left("name", F.lit(1)), F.lit(" "), F.element_at(F.split("name", " "), -1)).alias("known"), F.col("name").alias("person_id"))
    return resolve.find_name(names, short).select("name", F.col("person_id").alias("known"), "n")


@query()
def fuzzy_references(spark, sf_dir):
    """Part names and types as titles, brands as years and as citing papers: the references are all parts, the known papers all distinct titles of a year, which a brand's network has where it sells them."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ref_id"), F.concat(F.col("p_name"), F.lit(" "), F.lower("p_type")).alias("title"), F.substring("p_brand", 7, 2).cast("int").alias("year"), F.array("p_type").alias("authors"), F.col("p_brand").alias("citing"))
    papers = p.where("year % 2 = 0").groupBy("title", "year", "authors").agg(F.concat(F.lit("K"), F.min("ref_id")).alias("paper_id"))
    edges = p.join(papers.where("year % 4 = 0"), ["title", "year", "authors"]).select("citing", F.col("paper_id").alias("cited")).distinct()
    return resolve.resolve(p, edges, papers)


@query(
    """WITH p AS (SELECT p_partkey AS id, p_name || ' ' || lower(p_type) AS title, CAST(substr(p_brand, 7, 2) AS INT) AS year, p_type AS author FROM part),
    k AS (SELECT title, year, author, max(id) AS paper FROM p GROUP BY 1, 2, 3)
    SELECT id AS ref_id, paper AS matched FROM (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_name || ' missing' ELSE p_name || ' ' || lower(p_type) END AS title, CAST(substr(p_brand, 7, 2) AS INT) AS year, p_type AS author FROM part) r LEFT JOIN k USING (title, year, author)"""
)
def cascaded_references(spark, sf_dir):
    """J1, J2 by ``resolve.cascade``: of papers with one key the last wins; a third of the references have a title that no paper has."""
    title = F.concat(F.col("p_name"), F.lit(" "), F.lower("p_type"))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), title.alias("title"), "p_name", F.substring("p_brand", 7, 2).cast("int").alias("year"), F.array("p_type").alias("authors"))
    refs = p.select(F.col("id").alias("ref_id"), F.when(F.col("id") % 3 == 0, F.concat("p_name", F.lit(" missing"))).otherwise(F.col("title")).alias("title"), "year", "authors")
    return resolve.cascade(refs, p.select(F.col("id").alias("paper_id"), "title", "year", "authors")).select("ref_id", F.col("paper_id").alias("matched"))


@query(
    """WITH p AS (SELECT p_partkey AS id, p_name AS t, p_brand AS b FROM part), k AS (SELECT b, t, min(id) AS id FROM p GROUP BY b, t),
    r AS (SELECT id, b, split_part(t, ' ', 1) AS t FROM p)
    SELECT r.id AS ref_id, min('K' || lpad(CAST(k.id AS VARCHAR), 9, '0')) AS known FROM r JOIN k ON k.b = r.b AND (contains(k.t, r.t) OR contains(r.t, k.t)) GROUP BY 1"""
)
def network_references(spark, sf_dir):
    """J3 by ``resolve.in_network``: brands cite part names; a first word is a reference that its brand's names contain."""
    p = table(spark, sf_dir, "part")
    papers = p.groupBy("p_brand", "p_name").agg(F.concat(F.lit("K"), F.lpad(F.min("p_partkey").cast("string"), 9, "0")).alias("paper_id"))
    refs = p.select(F.col("p_partkey").alias("ref_id"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("title"), F.col("p_brand").alias("citing"))
    got = resolve.in_network(refs, papers.select(F.col("p_brand").alias("citing"), F.col("paper_id").alias("cited")), papers.select("paper_id", F.col("p_name").alias("title")))
    return got.select("ref_id", F.col("paper_id").alias("known"))


@query(
    f"""WITH n AS (SELECT DISTINCT p_name AS t FROM part), p AS (SELECT a.t AS a, b.t AS b, replace(a.t, ' ', '') AS x, replace(b.t, ' ', '') AS y FROM n a JOIN n b ON left(a.t, 3) = left(b.t, 3) AND a.t < b.t)
    SELECT a, b FROM p WHERE {_LCP.format(a="x", b="y")} / greatest(1, least(length(x), length(y))) > 0.5"""
)
def fuzzy_title_pairs(spark, sf_dir):
    """J5 by ``resolve.fuzzy_pairs``: equal authors, three letters as block, a shared prefix of more than half the shorter title."""
    n = table(spark, sf_dir, "part").select(F.col("p_name").alias("ref_id")).distinct()
    return resolve.fuzzy_pairs(n.select("ref_id", F.col("ref_id").alias("title"), F.array(F.lit("a kim")).alias("authors")), least=0.5)


@query(
    """SELECT conv_id, turn, CASE WHEN count(*) = 1 THEN min(known) END AS v FROM (SELECT c.conv_id, c.turn, s.role AS known FROM conversations c JOIN conversations s ON s.conv_id = c.conv_id AND s.role = 'system') GROUP BY 1, 2"""
)
def indicator_join(spark, sf_dir):
    """An inner lookup by id."""
    c = table(spark, sf_dir, "conversations")
    s = c.where("role = 'system'").select("conv_id", F.col("role").alias("known"))
    return c.select("conv_id", "turn").join(s, "conv_id").groupBy("conv_id", "turn").agg(F.when(F.count(F.lit(1)) == 1, F.min("known")).alias("v"))
