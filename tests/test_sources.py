"""Readers, sinks and streams on files made here."""

from pyspark.sql import functions as F

from paperloom.operators import analytics
from paperloom.sources import readers, sinks
from paperloom.streaming import incremental

ANN = "T1\tReference 0 4\tKim1\nT2\tUses-x 10 14\tLee2\nT3\tUnknown 20 24\tOtt3\nA1\tIs-Perfunctory T2\n"


def test_annotations(spark, tmp_path):
    (tmp_path / "A00-1004-x.ann").write_text(ANN)
    got = {r.mark: r for r in readers.annotations(spark, str(tmp_path)).collect()}
    assert set(got) == {"T1", "T2"} and got["T1"].label == "Background" and not got["T1"].perfunctory and got["T2"].perfunctory and got["T2"].paper_id == "A00-1004"
    line = spark.createDataFrame([("one\ntwo three\nfour",)], ["t"]).select(readers.enclosing_line(F.col("t"), F.lit(8), F.lit(13))).first()[0]
    assert line == "two three"


def test_delimited(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("id\tname\n1\tx\nbad\n2\ty\n")
    assert [tuple(r) for r in readers.tsv(spark, str(tmp_path / "a.tsv"), ["id", "name"], header=True).collect()] == [("1", "x"), ("2", "y")]
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.txt").write_text("1\ta\tb\n2\tshort\n\trest\n3\tc\td\n")
    assert [r.value for r in readers.continued(spark, str(tmp_path / "b")).orderBy("line").collect()] == ["1\ta\tb", "2\tshort\trest", "3\tc\td"]
    (tmp_path / "e.txt").write_text("P1 ==> P2\nP1 ==> P2\nbroken\n")
    assert readers.edges(spark, str(tmp_path / "e.txt")).collect() == [("P1", "P2")]
    (tmp_path / "v.txt").write_text("cat 1.0 2.5\n")
    assert readers.embeddings(spark, str(tmp_path / "v.txt")).first().vector == [1.0, 2.5]
    (tmp_path / "p.tsv").write_text("@USE the -lrb-\tUses\t7\nplain\tUses\t2\n@X\tBackground\t1\n@Y  z\tUses\t1\n@Z\tFuture\t1\n")
    got = readers.patterns(spark, str(tmp_path / "p.tsv"), "in_cite").orderBy("name").collect()
    assert [(r.name, r["class"], r.pattern, r.tokens) for r in got] == [("Future_in_cite_1", "Future", "@Z", ["@Z"]), ("Uses_in_cite_1", "Uses", "@USE the (", ["@USE", "the", "("]), ("Uses_in_cite_2", "Uses", "@Y  z", ["@Y", "z"])]
    (tmp_path / "f.tsv").write_text("P1\tGood one\tpre\t200\nP1\tlow\tpre\t3\nP1\tRole\tpre\t300\nP2\t12\tpre\t300\nP2\tx\tpost\t300\nP2\tshort\tpre\nP2\tok\tpre\t150\n")
    assert sorted(tuple(r) for r in readers.phrases(spark, str(tmp_path / "f.tsv"), ["role"]).collect()) == [("P1", "Good one"), ("P2", "ok")]
    (tmp_path / "w.tsv").write_text("5\tLong\ta\tb\tc\td\te\n1\tOne\tf\n1\tLate\tf\n1\tThe Second Try\tg\n1\tIn 1999\th\n1\tOld\ta\n2\tTwo\ti\tj\n5\tLong 2\te\tk\tl\tm\tn\n")
    got = {r.prefix: (r.name, r.kind) for r in analytics.active_workshops(readers.workshops(spark, str(tmp_path / "w.tsv"))).collect()}
    assert got == {**{p: ("Long", "Long-Running") for p in "abcd"}, **{p: ("Long 2", "Long-Running") for p in "eklmn"}, "f": ("One", "One-off")}


def test_object_or_array_json(spark):
    one = '{"algorithms":{"algorithm":{"citationList":{"citation":{"title":"T","date":"1999","authors":{"author":"A"},"contexts":{"context":{"@citStr":"A 1999","@position":"7","#text":"see A 1999"}}}}}}}'
    two = '{"algorithms":{"algorithm":{"citationList":{"citation":[{"title":"U","authors":{"author":["B","C"]}},{"title":"V"}]}}}}'
    got = readers.citation_json(spark.createDataFrame([("x", one), ("y", two), ("z", "{}"), ("bad", "{no json")], ["name", "text"])).orderBy("name", "n").collect()
    assert [(r.name, r.n, r.title, r.authors) for r in got] == [("x", 0, "T", ["A"]), ("y", 0, "U", ["B", "C"]), ("y", 1, "V", [])]
    assert [tuple(c) for c in got[0].contexts] == [("A 1999", 7, "see A 1999")] and got[1].contexts == []


def test_xml(spark):
    xml = "<a><citation><title>T</title><date>1999</date><author>K</author><context citStr='K 1999'>see K 1999</context></citation><citation><title>no date</title></citation></a>"
    got = readers.citation_xml(spark.createDataFrame([("x", xml), ("y", "<broken")], ["name", "text"])).collect()
    assert [(r.name, r.title, r.authors, r.contexts[0].cite) for r in got] == [("x", "T", ["K"], "K 1999")]
    body = "<d><sectionHeader confidence='0.9'>1 Intro</sectionHeader><bodyText>b</bodyText><sectionHeader confidence='0.2'>x</sectionHeader><subsectionHeader confidence='1'>s</subsectionHeader><listItem>l</listItem></d>"
    got = readers.body_xml(spark.createDataFrame([("x", body)], ["name", "text"])).orderBy("pos").collect()
    assert [(r.kind, r.section, r.subsection) for r in got] == [("section", 1, 0), ("body", 1, 0), ("body", 1, 0), ("subsection", 1, 1), ("body", 1, 1)]
    paper = "<PAPER><TITLE>Tt</TITLE><YEAR>1996</YEAR><BODY><DIV><HEADER>Intro</HEADER><P><S>As <REF>Kim 1990</REF> say <EQN/>.</S></P><DIV><HEADER>Sub</HEADER><S>Then.</S></DIV></DIV></BODY></PAPER>"
    df = spark.createDataFrame([("9601001", paper)], ["name", "text"])
    got = readers.structured_xml(df).orderBy("section", "subsection", "sentence").collect()
    assert [(r.section, r.subsection, r.title, r.text, r.refs) for r in got] == [(1, 0, "Intro", "As Kim 1990 say EQN.", ["Kim 1990"]), (1, 1, "Sub", "Then.", [])]
    assert tuple(readers.paper_facts(df).first()) == ("9601001", "Tt", 1996)


def test_annotator_retries(spark):
    calls = spark.createDataFrame([("1", "ok"), ("2", "bad")], ["id", "text"])
    got = {r.id: r.parsed for r in readers.annotate(calls, lambda t: '{"n": 1}' if t == "ok" else "{", retries=2).collect()}
    assert got == {"1": '{"n": 1}', "2": None}


def test_idempotent_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    for _ in range(2):
        sinks.append_new(df, path, "k")
    assert spark.read.parquet(path).count() == 2
    sinks.write_partitioned(df, str(tmp_path / "p"), "k")
    sinks.write_partitioned(df.where("k = 1").withColumn("v", F.lit("z")), str(tmp_path / "p"), "k")
    assert {(r.k, r.v) for r in spark.read.parquet(str(tmp_path / "p")).collect()} == {(1, "z"), (2, "b")}


def test_streams(spark, small, tmp_path):
    schema = spark.read.parquet(f"{small}/events.parquet").schema
    stream = incremental.file_stream(spark, small, schema, "events.parquet")
    q = incremental.append_stream(stream.select("event_id", "event_type"), str(tmp_path / "out"), "event_id", str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1000
    counts = incremental.windowed_counts(incremental.file_stream(spark, small, schema, "events.parquet"), "ts", ["event_type"])
    q = counts.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.sql("SELECT sum(n) FROM w").first()[0] == 1000
