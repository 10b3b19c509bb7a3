"""The feature builder: one map of named numbers per citation in context, for training and prediction alike."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels, vectors
from ..functions import text as tx
from . import locate, patterns, positions

PLACE = ["paper_id", "section", "subsection", "sentence"]
_NUM = "map<string,double>"


def _flags(names: list[str], value: Column) -> Column:
    """Map of each name to 1 where it is the value."""
    return F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(n).alias("key"), F.lit(1.0).alias("value")) for n in names)), lambda e: e["key"] == value))


def _numbers(**values: Column) -> Column:
    """Map of the values that are not null."""
    return F.map_filter(F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v.cast("double")))), lambda k, v: v.isNotNull())


def verb_syntax(tokens: Column) -> Column:
    """voice, tense and modal of the root tokens, or ``no_verb_*`` where there is none.

    A token gives its own marks only: ``is_pass``, ``tense`` where it has one, ``has_aux``.
    """
    one = lambda name: F.struct(name.alias("key"), F.lit(1.0).alias("value"))
    yes = lambda mark: F.coalesce(mark, F.lit(False))

    def marks(t: Column) -> Column:
        voice = F.when(yes(t["is_pass"]), "verb_is_passive").otherwise("verb_is_active")
        modal = F.when(yes(t["has_aux"]), "verb_has_modal").otherwise("verb_has_no_modal")
        return F.array(one(voice), one(F.concat(F.lit("verb_tense_"), t["tense"])), one(modal))

    roots = F.filter(tokens, lambda t: yes(t["is_root"]))
    found = F.filter(F.array_distinct(F.flatten(F.transform(roots, marks))), lambda e: e["key"].isNotNull())
    none = F.array(*(one(F.lit(f"no_verb_for_{x}")) for x in ("modal", "voice", "tense")))
    return F.map_from_entries(F.when(F.size(found) > 0, found).otherwise(none))


def sentence_level(contexts: DataFrame, sentences: DataFrame, tables: patterns.Tables = patterns.DEFAULT, custom: dict | None = None) -> DataFrame:
    """(citation_id, f): features of a citation in its sentence, its neighbours and its paper.

    contexts: citation_id, paper_id, cited_paper_id, cite, raw_string, is_self_cite, place;
    sentences: place, sec_title, sub_title, text, tokens (word, lemma, pos, ArgType, and
    is_root, tense, is_pass, has_aux where known; segment_span for clauses).
    """
    keys = [F.col(c) for c in PLACE[:3]]
    s = positions.relative(sentences)
    s = positions.connectors(s, PLACE[:3], "sentence", "text")
    if custom:
        s = positions.around(s.withColumn("_custom", _custom(tables, custom)("tokens")), PLACE[:3], "sentence", "_custom")
    s = s.withColumn("sub_years", F.sum(tx.year_mentions(F.col("text"))).over(Window.partitionBy(*keys)))
    s = patterns.sentence_features(s.withColumn("_zero", F.lit(0)), tables, "tokens", "_zero").withColumnRenamed("features", "_marks")
    for kind in ("compare", "contrast"):
        s = positions.first_hit(s, PLACE[:3], "sentence", F.element_at("_marks", kind) == 1).withColumnRenamed("distance", f"distance_to_{kind}")
    c = contexts.join(s, PLACE)
    at = F.position("cite", "text")
    pre = F.when(at > 0, tx.before(F.col("text"), F.col("cite"))).otherwise(F.lit(""))
    post = F.when(at > 0, tx.after(F.col("text"), F.col("cite"))).otherwise(F.lit(""))
    parens = F.regexp_extract_all("text", F.lit(r"\([^()]*\)"), F.lit(0))
    full = F.coalesce(F.get(F.filter(parens, lambda p: F.contains(p, F.col("cite"))), F.lit(0)), F.lit(""))
    words = F.transform("tokens", lambda t: t["word"])
    index = F.greatest(F.array_position(words, F.split_part("cite", F.lit(" "), F.lit(1))) - 1, F.lit(0)).cast("int")
    c = c.withColumns({"_pre": pre, "_post": post, "_full": full, "_index": index, "_words": words})
    c = c.withColumn("_in_parens", F.col("_full") != "")
    span = F.get("tokens", F.col("_index"))
    clause = span["segment_span"] if "segment_span" in str(dict(sentences.dtypes)["tokens"]) else F.lit(None).cast("array<int>")
    size = F.size("tokens")
    start, end = F.coalesce(clause[0], F.lit(0)), F.coalesce(clause[1], size - 1)
    c = patterns.sentence_features(c, tables, "tokens", "_index").withColumnRenamed("features", "_full_sent")
    c = c.withColumn("_clause", F.slice("tokens", start + 1, F.greatest(end - start + 1, F.lit(0)))).withColumn("_clause_index", F.greatest(F.col("_index") - start, F.lit(0)))
    c = patterns.sentence_features(c, tables, "_clause", "_clause_index").withColumnRenamed("features", "_in_clause")
    before, after = positions.token_frame(F.col("tokens"), F.col("_index"))
    for name, part in (("_before", before), ("_after", after)):
        c = c.withColumn(name, part)
        c = patterns.sentence_features(c.withColumn("_at0", F.lit(0)), tables, name, "_at0").withColumnRenamed("features", f"{name}_f")
    lexical = set(tables.concepts) | set(tables.actions)
    named = lambda m, prefix, keep: F.transform_keys(F.transform_values(F.map_filter(m, keep), lambda k, v: v.cast("double")), lambda k, v: F.concat(F.lit(prefix), k))
    is_lexical = lambda k, v: k.isin(*lexical)
    is_pattern = lambda k, v: ~k.isin(*lexical, "contrast", "compare")
    not_concept = lambda k, v: ~k.isin(*tables.concepts, "contrast", "compare")
    sections = [n for n, _ in labels.SECTION_RULES] + ["InAbstract", "InReferences", "OtherSection"]
    form = _numbers(
        Section_Num=F.col("section"), Sections_Left=F.col("Sections_Left"), sentence_length=size, clause_length=end - start + 1,
        relative_pos_in_subsection=F.col("relative_pos_in_subsection"), relative_pos_in_section=F.col("relative_pos_in_section"), relative_pos_in_paper=F.col("relative_pos_in_paper"),
        CitePositionInSentence=tx.cite_position(F.col("text"), F.col("cite")), relative_clause_cite_position=F.col("_clause_index") / F.greatest(end - start + 1, F.lit(1)),
        IS_USED_AS_TEXT=(~F.col("_in_parens")).cast("int"), is_cite_in_parens=F.col("_in_parens").cast("int"), DOES_SENTENCE_START_WITH_CITATION=F.startswith("text", "cite").cast("int"),
        ALL_CAPS=F.when(F.col("_in_parens"), tx.caps_before(F.col("_pre"), "all")).otherwise(0), CAMELCASE=F.when(F.col("_in_parens"), tx.caps_before(F.col("_pre"), "camel")).otherwise(0),
        IS_EXAMPLE=tx.is_example(F.col("_pre"), F.col("_full"), F.col("_post"), F.col("_in_parens")), IS_SELF_CITE=F.col("is_self_cite").cast("int"),
        NUM_CITATIONS_IN_CITATION_SENTENCE=tx.year_mentions(F.col("text")), NUM_CITATIONS_IN_SUBSECTION=F.col("sub_years"), NUM_CITATIONS_IN_SAME_CITATION=tx.same_paren_years(F.col("text"), F.col("cite")),
        distance_to_compare=F.col("distance_to_compare"), distance_to_contrast=F.col("distance_to_contrast"),
    )
    citing = F.concat(F.lit("Is"), labels.venue_kind(F.col("paper_id")))
    cited = F.when(labels.is_external(F.col("cited_paper_id")), labels.reference_kind(F.coalesce("raw_string", F.lit("")))).otherwise(F.concat(labels.venue_kind(F.col("cited_paper_id")), F.lit("Ref")))
    section = labels.section_of(F.col("sub_title"), F.col("sec_title"))
    kinds = [f"{p}{k}{t}" for p, t in (("Is", ""), ("", "Ref")) for k in ("Journal", "Workshop", "Conference")] + ["UnknownRefType"]
    all_maps = [
        form, _flags(kinds, citing), _flags(kinds, cited), _flags(sections, section), F.transform_values("connectors", lambda k, v: v.cast("double")),
        named(F.col("_in_clause"), "InClause:", is_pattern), named(F.col("_full_sent"), "FullSent:", is_pattern), named(F.col("_full_sent"), "", is_lexical),
        named(F.col("_before_f"), "Preceding:", not_concept), named(F.col("_after_f"), "Following:", not_concept),
    ]
    if "is_root" in str(dict(sentences.dtypes)["tokens"]):
        all_maps.append(verb_syntax(F.col("tokens")))
    if custom:
        all_maps += [_counted(F.col("_custom"), "in_cite"), _counted(F.flatten("preceding"), "pre_cite"), _counted(F.flatten("following"), "post_cite")]
    return c.select("citation_id", "paper_id", "cited_paper_id", section.alias("in_section"), F.map_concat(*all_maps).alias("f"))


def _custom(tables: patterns.Tables, found: dict):
    """M8: names of the custom patterns that a sentence has."""

    @F.pandas_udf("array<string>")
    def run(sentences: pd.Series) -> pd.Series:
        return pd.Series([[n for n, p in found.items() if patterns.find(tables, p, list(s)) >= 0] for s in sentences])

    return run


def _counted(names: Column, place: str) -> Column:
    """Sentences by pattern, as ``class_place_n``."""
    key = lambda n: F.concat(F.regexp_replace(n, "_[^_]*$", ""), F.lit(f"_{place}_"), F.element_at(F.split(n, "_"), -1))
    return F.map_from_entries(F.transform(F.array_distinct(names), lambda n: F.struct(key(n).alias("key"), F.size(F.filter(names, lambda x: x == n)).cast("double").alias("value"))))


def paper_level(contexts: DataFrame, edges: DataFrame, topics: DataFrame | None = None) -> DataFrame:
    """(paper_id, cited_paper_id, g), A11, J17, U3: occurrences, cites by section, 1 / cited papers, shared citees, topic similarity.

    contexts need ``in_section``; edges: citing, cited; topics: id, vector.
    """
    per = contexts.groupBy("paper_id", "cited_paper_id", "in_section").agg(F.count(F.lit(1)).alias("n"))
    maps = per.groupBy("paper_id", "cited_paper_id").agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("Cites_in_"), "in_section"), F.col("n").cast("double")))).alias("by"))
    total = contexts.groupBy("paper_id").agg((1.0 / F.countDistinct("cited_paper_id")).alias("total"))
    e = edges.select("citing", "cited").distinct()
    pairs = maps.select("paper_id", "cited_paper_id")
    shared = pairs.join(e.select(F.col("citing").alias("paper_id"), "cited"), "paper_id").join(e.select(F.col("citing").alias("cited_paper_id"), "cited"), ["cited_paper_id", "cited"]).groupBy("paper_id", "cited_paper_id").agg(F.count(F.lit(1)).alias("common"))
    out = maps.join(total, "paper_id").join(shared, ["paper_id", "cited_paper_id"], "left")
    extra = F.create_map().cast(_NUM)
    if topics is not None:
        side = lambda k, v: topics.select(F.col("id").alias(k), F.col("vector").alias(v))
        out = out.join(side("paper_id", "_a"), "paper_id", "left").join(side("cited_paper_id", "_b"), "cited_paper_id", "left")
        both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
        extra = F.when(both, _numbers(topic_sim=vectors.cosine(F.col("_a"), F.col("_b")))).otherwise(_numbers(no_topic_sim=F.lit(1)))
    own = _numbers(NUM_OCCURRENCES=F.col("all"), total_refs=F.col("total"), num_citations_in_common=F.coalesce("common", F.lit(0)))
    return out.select("paper_id", "cited_paper_id", F.map_concat(own, "by", extra).alias("g"))


def graph_level(contexts: DataFrame, metrics: DataFrame) -> DataFrame:
    """(citation_id, h), J13, F32: year difference, and the cited paper's metrics in the citing year (0 where unknown)."""
    c = contexts.select("citation_id", labels.year_from_id(F.col("paper_id")).alias("year"), labels.year_from_id(F.col("cited_paper_id")).alias("cited_year"), F.col("cited_paper_id").alias("node"))
    got = locate.at_year(c, metrics, ["node"], "year", ["pagerank", "in_degree", "hub", "authority", "load_centrality"])
    values = _numbers(year_diff=F.col("year") - F.col("cited_year"), num_cites=F.col("in_degree"), page_rank=F.col("pagerank"), hub_score=F.col("hub"), authority_score=F.col("authority"), load_centrality=F.col("load_centrality"))
    return got.select("citation_id", values.alias("h"))


def build(contexts: DataFrame, sentences: DataFrame, edges: DataFrame, metrics: DataFrame, topics: DataFrame | None = None, preferences: DataFrame | None = None, tables: patterns.Tables = patterns.DEFAULT, custom: dict | None = None) -> DataFrame:
    """(citation_id, paper_id, cited_paper_id, features) of all groups; ``preferences``: citation_id, label, sim."""
    s = sentence_level(contexts, sentences, tables, custom)
    p = paper_level(s, edges, topics)
    out = s.join(p, ["paper_id", "cited_paper_id"]).join(graph_level(contexts, metrics), "citation_id")
    maps = ["f", "g", "h"]
    if preferences is not None:
        sims = preferences.groupBy("citation_id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat("label", F.lit("_sel_pref_sim")), F.col("sim").cast("double")))).alias("q"))
        out = out.join(sims, "citation_id", "left").withColumn("q", F.coalesce("q", F.create_map().cast(_NUM)))
        maps.append("q")
    return out.select("citation_id", "paper_id", "cited_paper_id", F.map_concat(*maps).alias("features"))


def training_rows(features: DataFrame, marks: DataFrame, second_corpus: str = "^[0-9]") -> DataFrame:
    """Labelled rows; Background of the second corpus, whose ids are numbers, is left out."""
    got = features.join(marks.select("citation_id", "label").where("label IS NOT NULL"), "citation_id")
    return got.where(~(F.col("paper_id").rlike(second_corpus) & (F.col("label") == "Background")))


def firing_counts(features: DataFrame, marks: DataFrame) -> DataFrame:
    """(feature, label, n)."""
    got = features.join(marks.select("citation_id", "label"), "citation_id")
    return got.select("label", F.explode(F.map_keys("features")).alias("feature")).groupBy("feature", "label").agg(F.count(F.lit(1)).alias("n"))
