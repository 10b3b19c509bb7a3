"""Functions on rows made by hand."""

import difflib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperloom.functions import labels, vectors
from paperloom.functions import text as tx


def one(spark, expr, **row):
    return spark.createDataFrame([tuple(row.values())], list(row)).select(expr).first()[0]


def test_ids(spark):
    df = spark.createDataFrame([("P99-1001",), ("W05-0102",), ("X",), ("External_12",)], ["i"])
    got = df.select(labels.year_from_id(F.col("i")), labels.venue_kind(F.col("i")), labels.paper_key(F.concat("i", F.lit("-rest")))).collect()
    assert [tuple(r) for r in got] == [(1999, "Conference", "P99-1001"), (2005, "Workshop", "W05-0102"), (None, "Conference", "X-rest"), (None, "Conference", "External_12-rest")]


def test_sections_in_order(spark):
    rows = [("Abstract", "InAbstract"), ("1 Introduction", "InIntroduction"), ("Related Models", "InRelatedWork"), ("Final Remarks", None), ("References", "InReferences"), ("Data Analysis", "InEvaluation")]
    got = spark.createDataFrame(rows, "t string, want string").select(labels.section_class(F.col("t")), "want").collect()
    assert all(r[0] == r[1] for r in got)


def test_labels(spark):
    rows = [("Reference", "Background"), ("Prior-x", "Extends"), ("CoCoN-y", "CompareOrContrast"), ("Unknown", None), ("Uses-z", "Uses")]
    got = spark.createDataFrame(rows, "t string, want string").select(labels.canonical_label(F.col("t")), "want").collect()
    assert all(r[0] == r[1] for r in got)
    assert one(spark, labels.function_of_code(F.col("c")), c="PModi") == "Extends"
    assert one(spark, labels.function_of_code(F.col("c")), c="else") == "CompareOrContrast"


def test_names_and_ratios(spark):
    assert one(spark, tx.fold(F.col("n")), n="M&uuml;ller, J&ouml;rg") == "Jorg Muller"
    rows = [("", ""), ("abc", ""), ("parsing trees", "tree parsing"), ("a b", "a b")]
    df = spark.createDataFrame(rows, ["a", "b"]).select("a", "b", tx.quick_ratio(F.col("a"), F.col("b")).alias("q"), tx.real_quick_ratio(F.col("a"), F.col("b")).alias("r"), tx.ratio("a", "b").alias("m"), tx.token_set_ratio("a", "b").alias("s"))
    for r in df.collect():
        s = difflib.SequenceMatcher(None, r.a, r.b)
        assert abs(r.q - s.quick_ratio()) < 1e-9 and abs(r.r - s.real_quick_ratio()) < 1e-9 and abs(r.m - s.ratio()) < 1e-9
    assert [r.s for r in df.collect()][3] == 100


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.text("ab c", max_size=8), st.text("ab c", max_size=8)), min_size=1, max_size=20))
def test_quick_ratio_is_difflibs(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", tx.quick_ratio(F.col("a"), F.col("b")).alias("q")).collect():
        assert abs(r.q - difflib.SequenceMatcher(None, r.a, r.b).quick_ratio()) < 1e-9


def test_citation_form(spark):
    text = "Parsers (e.g. Kim, 1999; Lee, 2001) work like SVM (Ott, 2003)."
    assert one(spark, tx.same_paren_years(F.col("t"), F.lit("Lee, 2001")), t=text) == 2
    assert one(spark, tx.year_mentions(F.col("t")), t=text) == 3
    assert one(spark, tx.mask_citation(F.col("t"), F.lit("Lee, 2001"), F.lit(True)), t="as (Lee, 2001) and (Ott, 2003)") == "as (SELFCITATION) and CITANCE"
    assert one(spark, tx.caps_before(F.col("t"), "all"), t="trained with an SVM") == 1
    assert one(spark, tx.caps_before(F.col("t"), "all"), t="SVM, then trained it") == 0
    assert one(spark, tx.caps_before(F.col("t"), "camel"), t="with the Parser") == 1
    assert one(spark, tx.is_self_citation(F.lit("Kim and Lee 1999"), F.array(F.lit("lee"), F.lit("ott"))), t="") is True
    assert one(spark, tx.is_self_citation(F.lit("Kim 1999"), F.array(F.lit("ott"))), t="") is False


def test_vectors(spark):
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(2.0))
    assert one(spark, vectors.cosine(a, a), x=1) == 1.0
    assert one(spark, vectors.cosine(a, F.array(F.lit(0.0), F.lit(0.0))), x=1) == 0.0
    assert abs(one(spark, vectors.jensen_shannon(a, b), x=1) - 0.6931471805599453) < 1e-12
