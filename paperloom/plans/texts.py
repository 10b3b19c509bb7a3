"""Titles, labels, text features, vectors and topic preparation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import labels, vectors
from ..functions import text as tx
from ..operators import topics
from ..sources import readers
from .base import query, table

_TITLE = r"(?is)<title>(.*?)</title>"


def _sql_section(t: str) -> str:
    rules = " ".join("WHEN " + " OR ".join(f"contains({t}, '{p}')" for p in parts) + f" THEN '{name}'" for name, parts in labels.SECTION_RULES)
    return f"CASE WHEN {t} = 'abstract' THEN 'InAbstract' {rules} WHEN starts_with({t}, 'reference') OR contains({t}, 'bibliography') THEN 'InReferences' END"


@query(
    f"""WITH t AS (SELECT page_id, replace(lower(regexp_extract(html, '{_TITLE}', 1)), ' ', '') AS t, CASE page_id % 9 WHEN 0 THEN 'intro' WHEN 1 THEN 'evaluation' WHEN 2 THEN 'previousmodel' WHEN 3 THEN 'conclusions' WHEN 4 THEN 'references' ELSE '' END AS s FROM pages)
    SELECT page_id, coalesce({_sql_section('s')}, {_sql_section('t')}, 'OtherSection') AS section FROM t"""
)
def section_cascade(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    k = F.col("page_id") % 9
    sub = F.when(k == 0, "Intro").when(k == 1, "Evaluation").when(k == 2, "Previous Model").when(k == 3, "Conclusions").when(k == 4, "References").otherwise("")
    return p.select("page_id", labels.section_of(sub, F.regexp_extract("html", _TITLE, 1)).alias("section"))


@query(
    r"""WITH r AS (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'Proceedings of the ' WHEN 1 THEN 'Workshop on ' WHEN 2 THEN 'Journal of ' WHEN 3 THEN 'vol (3)4 ' ELSE '' END || p_name AS s FROM part)
    SELECT id, CASE WHEN contains(s, 'Workshop') THEN 'WorkshopRef' WHEN contains(s, 'Proceedings') OR contains(s, 'Proc.') THEN 'ConferenceRef' WHEN contains(s, 'Journal') OR regexp_matches(s, '\([0-9]+\)[0-9]') THEN 'JournalRef' ELSE 'UnknownRefType' END AS kind FROM r"""
)
def ref_type(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 5
    lead = F.when(k == 0, "Proceedings of the ").when(k == 1, "Workshop on ").when(k == 2, "Journal of ").when(k == 3, "vol (3)4 ").otherwise("")
    return p.select(F.col("p_partkey").alias("id"), labels.reference_kind(F.concat(lead, "p_name")).alias("kind"))


@query(
    """WITH l AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'Reference' WHEN 'view' THEN 'Prior-Work' WHEN 'error' THEN 'CoCoN-x' WHEN 'signup' THEN 'Unknown' ELSE 'Uses' END AS s FROM events)
    SELECT CASE WHEN s = 'Reference' THEN 'Background' WHEN starts_with(s, 'Prior') THEN 'Extends' WHEN starts_with(s, 'Co') THEN 'CompareOrContrast' ELSE s END AS label,
           CASE WHEN s IN ('Reference') THEN 'Positional' ELSE 'Essential' END AS kind, count(*) AS n FROM l WHERE s <> 'Unknown' GROUP BY 1, 2"""
)
def label_map(spark, sf_dir):
    t = F.col("event_type")
    raw = F.when(t == "click", "Reference").when(t == "view", "Prior-Work").when(t == "error", "CoCoN-x").when(t == "signup", "Unknown").otherwise("Uses")
    got = table(spark, sf_dir, "events").select(labels.canonical_label(raw).alias("label")).where("label IS NOT NULL")
    return got.select("label", labels.role_type(F.col("label")).alias("kind")).groupBy("label", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH i AS (SELECT p_partkey, chr(65 + CAST(p_partkey % 26 AS INT)) || lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '0') || '-1' AS id FROM part)
    SELECT p_partkey, CAST(CASE WHEN CAST(substr(id, 2, 2) AS INT) < 50 THEN 2000 ELSE 1900 END + CAST(substr(id, 2, 2) AS INT) AS INT) AS year,
    CASE WHEN left(id, 1) IN ('J', 'Q') THEN 'Journal' WHEN left(id, 1) IN ('S', 'W') THEN 'Workshop' ELSE 'Conference' END AS kind,
    CASE left(id, 1) WHEN 'C' THEN 'COLING' WHEN 'P' THEN 'ACL' WHEN 'N' THEN 'NAACL' WHEN 'J' THEN 'Comp. Ling.' WHEN 'Q' THEN 'TACL' WHEN 'K' THEN 'CoNLL' WHEN 'E' THEN 'EACL' WHEN 'A' THEN 'ANLP' WHEN 'L' THEN 'LREC' WHEN 'I' THEN 'IJCNLP' WHEN 'S' THEN 'SemEval' WHEN 'W' THEN 'Workshop' ELSE 'Other' END AS venue FROM i"""
)
def ids_and_venues(spark, sf_dir):
    k = F.col("p_partkey")
    pid = F.concat(F.char((65 + k % 26)), F.lpad((k % 100).cast("string"), 2, "0"), F.lit("-1"))
    return table(spark, sf_dir, "part").select("p_partkey", labels.year_from_id(pid).alias("year"), labels.venue_kind(pid).alias("kind"), labels.venue(pid).alias("venue"))


@query(
    r"""SELECT p_partkey, regexp_replace(lower(trim('The ' || p_name || ', Part: "x"! ')), '[!-/:-@\[-`{-~]', '', 'g') AS title,
    regexp_replace(regexp_replace('12a' || p_name || '--(b)', '[^a-zA-Z0-9]+', ' ', 'g'), '^[0-9\-]+[a-f]?', '') AS reference FROM part"""
)
def clean_title(spark, sf_dir):
    name = F.col("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", tx.clean_title(F.concat(F.lit("The "), name, F.lit(', Part: "x"! '))).alias("title"), tx.clean_reference(F.concat(F.lit("12a"), name, F.lit("--(b)"))).alias("reference"))


@query(
    "SELECT doc_id, CAST(len(regexp_extract_all(text, '[0-9][0-9][0-9][0-9]')) AS INT) AS years, CAST(len(regexp_extract_all(text, '[^A-Za-z0-9]')) AS INT) AS odd, CAST(len(regexp_extract_all(text, '[0-9]+')) AS INT) AS numbers FROM documents"
)
def year_tokens(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", tx.year_mentions(t).alias("years"), tx.odd_characters(t).alias("odd"), tx.numbers_in(t).alias("numbers"))


@query(
    """WITH c AS (SELECT conv_id, turn, text, string_split(text, ' ')[4] AS w FROM conversations WHERE len(string_split(text, ' ')) > 6)
    SELECT conv_id, turn, round((instr(text, w) - 1) / length(text), 6) AS pos FROM c WHERE instr(text, w) > 0"""
)
def cite_positions(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("w", F.split("text", " ")).where("size(w) > 6").withColumn("w", F.col("w")[3])
    return c.where(F.position("w", "text") > 0).select("conv_id", "turn", F.round(tx.cite_position(F.col("text"), F.col("w")), 6).alias("pos"))


@query(
    r"""WITH t AS (SELECT conv_id, turn, text || ' ( see CITE , 1999 ) by 2001 .' AS s FROM conversations)
    SELECT conv_id, turn, regexp_replace(replace(s, 'CITE , 1999', CASE WHEN turn = 0 THEN 'SELFCITATION' ELSE 'CITATION' END), '\([^()]*[0-9]{4}[a-f]?[^()]*\)', 'CITANCE', 'g') AS masked FROM t"""
)
def masked_citations(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("s", F.concat("text", F.lit(" ( see CITE , 1999 ) by 2001 .")))
    return c.select("conv_id", "turn", tx.mask_citation(F.col("s"), F.lit("CITE , 1999"), F.col("turn") == 0).alias("masked"))


@query(
    r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[^\x00-\x7F]', '', 'g'), ' [0-9]{4} ', ' ', 'g'), '-(lrb|rrb|lsb|rsb)-|,|\.', '', 'g'), ' al[^\n] | al | et ', ' ', 'g')) AS scrubbed FROM documents"""
)
def scrubbed_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.scrub(F.col("text")).cast("binary")).alias("scrubbed"))


@query(
    """WITH t AS (SELECT doc_id, w, p FROM (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS w, unnest(range(0, len(string_split(lower(text), ' ')))) AS p FROM documents)),
    n AS (SELECT w, count(*) AS n FROM t GROUP BY 1), d AS (SELECT w FROM n WHERE n < 2 UNION (SELECT w FROM n ORDER BY n DESC, w LIMIT 200)),
    k AS (SELECT doc_id, count(*) AS kept FROM t WHERE w NOT IN (SELECT w FROM d) GROUP BY 1)
    SELECT documents.doc_id, CAST(coalesce(kept, 1) AS INT) AS words, kept IS NULL AS dummy FROM documents LEFT JOIN k USING (doc_id)"""
)
def vocab_trim(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.split(F.lower("text"), " ", -1).alias("words"))
    got = topics.trim(d)
    return got.select(F.col("id").alias("doc_id"), F.size("words").alias("words"), (F.col("words")[0] == "DUMMY").alias("dummy"))


@query(
    """WITH c AS (SELECT label, i, sum(CAST(x AS DOUBLE)) AS x FROM (SELECT label, unnest(embedding) AS x, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY 1, 2),
    v AS (SELECT label, list(x ORDER BY i) AS c FROM c GROUP BY 1)
    SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), c), 4) AS cosine FROM embeddings JOIN v USING (label)"""
)
def cosine_to_centroid(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    sums = vectors.sum_vectors(e, ["label"], "embedding").withColumnRenamed("embedding", "c")
    return e.join(sums, "label").select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("c")), 4).alias("cosine"))


@query(
    """WITH n AS (SELECT o_orderpriority AS p, count(*) FILTER (o_orderstatus = 'F') * 1.0 / count(*) AS f, count(*) FILTER (o_orderstatus = 'O') * 1.0 / count(*) AS o, count(*) FILTER (o_orderstatus = 'P') * 1.0 / count(*) AS q FROM orders GROUP BY 1)
    SELECT a.p AS a, b.p AS b, round((a.f * ln(2 * a.f / (a.f + b.f)) + a.o * ln(2 * a.o / (a.o + b.o)) + a.q * ln(2 * a.q / (a.q + b.q)) + b.f * ln(2 * b.f / (a.f + b.f)) + b.o * ln(2 * b.o / (a.o + b.o)) + b.q * ln(2 * b.q / (a.q + b.q))) / 2, 8) AS jsd FROM n a JOIN n b ON a.p < b.p"""
)
def jsd_segments(spark, sf_dir):
    from ..operators.analytics import wide_sum

    n = table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    v = wide_sum(n, ["o_orderpriority"], "o_orderstatus", ["F", "O", "P"])
    # five priorities: the pairs are a fixed few
    pairs = v.select(F.col("o_orderpriority").alias("a"), F.col("v").alias("x")).join(v.select(F.col("o_orderpriority").alias("b"), F.col("v").alias("y")), F.col("a") < F.col("b"))
    return pairs.select("a", "b", F.round(vectors.jensen_shannon(F.col("x"), F.col("y")), 8).alias("jsd"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def nested_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "long").alias("k"))


@query(
    r"""SELECT page_id, CAST(len(regexp_extract_all(html, '<a\s[^>]*?href="([^"]*)"', 1)) AS BIGINT) AS n, list_min(regexp_extract_all(html, '<a\s[^>]*?href="([^"]*)"', 1)) AS least FROM pages WHERE regexp_matches(html, '<a\s[^>]*?href="([^"]*)"')"""
)
def page_links(spark, sf_dir):
    return readers.links(table(spark, sf_dir, "pages")).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.min("href").alias("least"))


@query(
    """SELECT conv_id, turn, CAST(CASE WHEN ends_with(p, 'see') OR starts_with(a, ', for example,') THEN 1 ELSE 0 END AS INT) AS example
    FROM (SELECT conv_id, turn, text || CASE WHEN turn % 2 = 0 THEN ' see' ELSE ' by' END AS p, CASE WHEN turn % 3 = 0 THEN ', for example, x' ELSE ' then' END AS a FROM conversations)"""
)
def example_marks(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    pre = F.concat("text", F.when(F.col("turn") % 2 == 0, " see").otherwise(" by"))
    post = F.when(F.col("turn") % 3 == 0, ", for example, x").otherwise(" then")
    return c.select("conv_id", "turn", tx.is_example(pre, F.lit("CITE"), post, F.lit(False)).alias("example"))


@query(
    "SELECT conv_id, turn, CAST(coalesce(max(CASE WHEN starts_with(lower(text), 'so') THEN n END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) - n + 1, 100) AS INT) AS so FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)"
)
def connector_distance(spark, sf_dir):
    from ..operators.positions import connectors

    return connectors(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text").select("conv_id", "turn", F.element_at("connectors", "Connector_so").cast("int").alias("so"))


@query("SELECT doc_id, len(string_split(text, chr(10))) AS lines, string_split(text, chr(10))[1] AS first FROM documents")
def text_lines(spark, sf_dir):
    """Lines by their breaks."""
    parts = F.split("text", "\n", -1)
    return table(spark, sf_dir, "documents").select("doc_id", F.size(parts).cast("long").alias("lines"), F.get(parts, F.lit(0)).alias("first"))


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events QUALIFY n = 1")
def first_events(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.row_number().over(w).cast("long").alias("n")).where("n = 1")
