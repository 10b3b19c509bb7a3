"""The feature builder on a paper made by hand."""

from pyspark.sql import functions as F

from paperloom.operators import features

TOKENS = "array<struct<word: string, lemma: string, pos: string, ArgType: string, is_root: boolean, tense: string, is_pass: boolean, has_aux: boolean, segment_span: array<int>>>"


def toks(text):
    out = []
    for w in text.split():
        out.append((w, {"used": "use"}.get(w, w.lower()), "VBD" if w in ("used", "proposed") else "NN", "subj" if w == "We" else None, w in ("used", "proposed"), "D" if w == "used" else None, False, w == "proposed", None))
    return out


def test_builder(spark):
    texts = ["We used SVM ( Kim , 1999 ; Lee , 2001 ) .", "However it failed .", "Unlike Kim , 1999 our model works in 2001 ."]
    sents = spark.createDataFrame([("P05-1001", 0, 0, i, "1 Introduction", "", t, toks(t)) for i, t in enumerate(texts)], f"paper_id string, section int, subsection int, sentence int, sec_title string, sub_title string, text string, tokens {TOKENS}")
    ctx = spark.createDataFrame(
        [("P05-1001_0", "P05-1001", "J99-1002", "Kim , 1999", "", False, 0, 0, 0), ("P05-1001_1", "P05-1001", "External_3", "Lee , 2001", "Proc. of X", True, 0, 0, 0), ("P05-1001_2", "P05-1001", "J99-1002", "Kim , 1999", "", False, 0, 0, 2)],
        "citation_id string, paper_id string, cited_paper_id string, cite string, raw_string string, is_self_cite boolean, section int, subsection int, sentence int",
    )
    edges = spark.createDataFrame([("P05-1001", "J99-1002"), ("P05-1001", "A"), ("J99-1002", "A")], "citing string, cited string")
    metrics = spark.createDataFrame([(2005, "J99-1002", 0.5, 3, 0.1, 0.2, 0.3)], "year int, node string, pagerank double, in_degree int, hub double, authority double, load_centrality double")
    topics = spark.createDataFrame([("P05-1001", [1.0, 0.0]), ("J99-1002", [1.0, 1.0])], "id string, vector array<double>")
    prefs = spark.createDataFrame([("P05-1001_0", "Uses", 0.25)], "citation_id string, label string, sim double")
    got = {r.citation_id: r.features for r in features.build(ctx, sents, edges, metrics, topics, prefs, custom={"Uses_0": ("@USE",)}).collect()}
    a, b, c = (got[f"P05-1001_{i}"] for i in range(3))
    assert a["IsConference"] == 1 and a["JournalRef"] == 1 and b["ConferenceRef"] == 1 and "JournalRef" not in b
    assert a["year_diff"] == 6 and a["page_rank"] == 0.5 and a["num_cites"] == 3 and b["page_rank"] == 0
    assert a["InIntroduction"] == 1 and a["Cites_in_InIntroduction"] == 2 and a["NUM_OCCURRENCES"] == 2 and a["total_refs"] == 0.5
    assert a["num_citations_in_common"] == 1 and b["num_citations_in_common"] == 0
    assert abs(a["topic_sim"] - 0.5**0.5) < 1e-9 and b["no_topic_sim"] == 1
    assert a["is_cite_in_parens"] == 1 and a["ALL_CAPS"] == 1 and a["NUM_CITATIONS_IN_SAME_CITATION"] == 2 and a["NUM_CITATIONS_IN_SUBSECTION"] == 4
    assert c["is_cite_in_parens"] == 0 and b["IS_SELF_CITE"] == 1 and a["IS_SELF_CITE"] == 0
    assert a["verb_is_active"] == 1 and a["verb_tense_D"] == 1 and c["no_verb_for_voice"] == 1
    assert a["Connector_however"] == 2 and c["Connector_however"] == 100
    assert a["distance_to_contrast"] == 2 and c["distance_to_contrast"] == 100
    assert a["Uses_sel_pref_sim"] == 0.25 and "Uses_sel_pref_sim" not in b
    assert a["FullSent:US_AGENT"] < 0 and any(k.startswith("InClause:") for k in c) and a["SELF"] < 0
    assert a["Uses_in_cite_0"] == 1 and a["Uses_pre_cite_0"] == 1 and "Uses_post_cite_0" not in a
    marks = spark.createDataFrame([("P05-1001_0", "Uses"), ("P05-1001_1", None)], "citation_id string, label string")
    built = features.build(ctx, sents, edges, metrics)
    assert features.training_rows(built, marks).count() == 1
    assert features.firing_counts(built, marks).where((F.col("feature") == "SELF") & (F.col("label") == "Uses")).first().n == 1


def test_verb_syntax(spark):
    kind = "array<struct<is_root: boolean, pos: string, tense: string, is_pass: boolean, has_aux: boolean>>"
    rows = [([(True, "NN", "P", True, None), (None, "MD", None, None, True)],), ([(True, "VB", None, None, True)],), ([(False, "VBD", "D", None, None)],), ([],)]
    got = [r[0] for r in spark.createDataFrame(rows, f"t {kind}").select(features.verb_syntax(F.col("t"))).collect()]
    none = {"no_verb_for_modal": 1, "no_verb_for_voice": 1, "no_verb_for_tense": 1}
    assert got == [{"verb_is_passive": 1, "verb_tense_P": 1, "verb_has_no_modal": 1}, {"verb_is_active": 1, "verb_has_modal": 1}, none, none]
