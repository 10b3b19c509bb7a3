"""Readers of the text shapes around a citation corpus."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels
from ..session import ship_package


def files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, name, text): one row per file under ``path`` whose name fits the glob ``pattern``."""
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path, wholetext=True)
    return read.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))


def lines(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(name, line, value): lines with their place in the file, from 0."""
    whole = files(spark, path, pattern)
    return whole.select("name", F.posexplode(F.split(F.regexp_replace("text", r"\r?\n\z", ""), r"\r?\n")).alias("line", "value"))


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """(paper_id, mark, label, start, end, text, perfunctory) of stand-off files; labels are canonical, unknown ones dropped."""
    raw = lines(spark, path, "*.ann").withColumn("c", F.split("value", "\t"))
    spans = raw.where("value LIKE 'T%' AND size(c) >= 3").withColumn("m", F.split(F.col("c")[1], " ")).where("size(m) = 3")
    spans = spans.select("name", F.col("c")[0].alias("mark"), F.col("m")[0].alias("raw"), F.col("m")[1].cast("int").alias("start"), F.col("m")[2].cast("int").alias("end"), F.col("c")[2].alias("text"))
    flags = raw.where("value LIKE 'A%' AND size(c) >= 2").withColumn("m", F.split(F.col("c")[1], " ")).where(F.col("m")[0] == "Is-Perfunctory").select("name", F.col("m")[1].alias("mark"), F.lit(1).alias("flag")).distinct()
    joined = spans.join(flags, ["name", "mark"], "left").withColumn("label", labels.canonical_label(F.col("raw"))).where("label IS NOT NULL")
    return joined.select(labels.paper_key(F.col("name")).alias("paper_id"), "mark", "label", "start", "end", "text", F.col("flag").isNotNull().alias("perfunctory"))


def enclosing_line(text: Column, start: Column, end: Column) -> Column:
    """The line of ``text`` around the span, by the breaks before and after it."""
    head = F.element_at(F.split(F.left(text, start), "\n"), -1)
    return F.concat(head, F.substring(text, start + 1, end - start), F.element_at(F.split(F.substring(text, end + 1, F.length(text)), "\n"), 1))


def edges(spark: SparkSession, path: str, separator: str = " ==> ") -> DataFrame:
    """(citing, cited) from lines with a literal separator; others are dropped."""
    parts = F.split("value", re.escape(separator))
    return spark.read.text(path).withColumn("c", parts).where("size(c) = 2").select(F.trim(F.col("c")[0]).alias("citing"), F.trim(F.col("c")[1]).alias("cited")).distinct()


def tsv(spark: SparkSession, path: str, columns: list[str], header: bool = False) -> DataFrame:
    """Rows with exactly these columns; ragged rows and, if asked, the header line are dropped."""
    rows = lines(spark, path) if header else spark.read.text(path).select(F.lit(1).alias("line"), "value")
    rows = (rows.where("line > 0") if header else rows).withColumn("c", F.split("value", "\t", -1)).where(F.size("c") == len(columns))
    return rows.select(*(F.col("c")[i].alias(n) for i, n in enumerate(columns)))


def continued(spark: SparkSession, path: str, least: int = 3) -> DataFrame:
    """(name, line, value): a line of fewer than ``least`` columns takes in the next one, which goes.

    The state is one bit carried along a file's lines, so it is folded over the file's array of lines.
    """
    whole = files(spark, path, "*").select("name", F.split(F.regexp_replace("text", r"\r?\n\z", ""), r"\r?\n").alias("l"))
    short = lambda v: F.size(F.split(v, "\t")) < least
    start = F.struct(F.expr("CAST(array() AS array<string>)").alias("done"), F.lit(None).cast("string").alias("open"))
    step = lambda s, v: F.when(s["open"].isNotNull(), F.struct(F.array_append(s["done"], F.concat(s["open"], v)).alias("done"), F.lit(None).cast("string").alias("open"))).when(short(v), F.struct(s["done"].alias("done"), v.alias("open"))).otherwise(F.struct(F.array_append(s["done"], v).alias("done"), F.lit(None).cast("string").alias("open")))
    end = lambda s: F.when(s["open"].isNotNull(), F.array_append(s["done"], s["open"])).otherwise(s["done"])
    return whole.select("name", F.posexplode(F.aggregate("l", start, step, end)).alias("line", "value"))


def embeddings(spark: SparkSession, path: str) -> DataFrame:
    """(word, vector) from lines of a word and numbers, blank-separated."""
    parts = F.split("value", " ")
    return spark.read.text(path).withColumn("c", parts).where("size(c) > 1").select(F.col("c")[0].alias("word"), F.transform(F.slice("c", 2, F.size("c") - 1), lambda x: x.try_cast("double")).alias("vector"))


def topic_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(id, vector) from an id, a tab and blank-separated numbers."""
    return tsv(spark, path, ["id", "v"]).select("id", F.transform(F.split(F.trim("v"), " +"), lambda x: x.try_cast("double")).alias("vector"))


def patterns(spark: SparkSession, path: str, label: str) -> DataFrame:
    """(name, class, pattern, tokens) from rows of a pattern, its class, and more; only patterns with a lexicon sign count.

    The class Background is left out. ``name`` is class_label_n, n counting the kept rows of
    a class from 1 in the order of the file.
    """
    from pyspark.sql import Window

    rows = lines(spark, path).withColumn("c", F.split("value", "\t")).where(F.col("value").contains("@") & (F.size("c") >= 2))
    rows = rows.select(F.col("name").alias("file"), "line", F.trim(F.col("c")[1]).alias("class"), F.replace(F.replace(F.col("c")[0], F.lit("-lrb-"), F.lit("(")), F.lit("-rrb-"), F.lit(")")).alias("pattern"))
    n = F.row_number().over(Window.partitionBy("class").orderBy("file", "line"))
    kept = rows.where(F.col("class") != "Background")
    return kept.select(F.concat_ws("_", "class", F.lit(label), n).alias("name"), "class", "pattern", F.split(F.trim("pattern"), r"\s+").alias("tokens"))


def phrases(spark: SparkSession, path: str, stop: list[str], least: float = 150.0) -> DataFrame:
    """(cited_id, phrase) of rows of a cited id, a phrase, its place and its tf-idf.

    Kept are rows with four columns, place ``pre`` and a weight from ``least``, whose phrase in
    lower case has a letter and is no stop phrase.
    """
    rows = spark.read.text(path).select(F.split(F.trim(F.col("value")), "\t").alias("c")).where("size(c) = 4")
    rows = rows.select(F.col("c")[0].alias("cited_id"), F.col("c")[1].alias("phrase"), F.col("c")[2].alias("place"), F.expr("try_cast(c[3] AS double)").alias("weight"))
    stops = spark.createDataFrame([(s,) for s in stop], "stop string")
    good = rows.where((F.col("place") == "pre") & (F.col("weight") >= least) & F.lower("phrase").rlike("[a-z]"))
    return good.join(stops, F.lower("phrase") == F.col("stop"), "left_anti").select("cited_id", "phrase").distinct()


def workshops(spark: SparkSession, path: str) -> DataFrame:
    """(line, name, prefixes) of ragged rows: a count, a name, and one prefix or more."""
    rows = lines(spark, path).withColumn("c", F.split(F.trim("value"), "\t")).where("size(c) >= 3")
    return rows.select("line", F.col("c")[1].alias("name"), F.slice("c", 3, F.size("c") - 2).alias("prefixes"))


def citation_json(docs: DataFrame, column: str = "text") -> DataFrame:
    """(name, n, title, date, raw, authors, contexts) of nested JSON in which one-element lists may stand as objects.

    The document is parsed as a variant; an object and a list of objects take the same road.
    A text that is no JSON has no rows. A context keeps its citation string, place and text.
    """
    v = F.try_parse_json(column)
    node = F.try_variant_get(v, "$.algorithms.algorithm.citationList.citation", "variant")
    as_list = lambda x: F.when(F.schema_of_variant(x).startswith("ARRAY"), F.try_variant_get(x, "$", "array<variant>")).otherwise(F.array(x))
    items = docs.withColumn("_node", node).where("_node IS NOT NULL").select("name", F.posexplode(as_list(F.col("_node"))).alias("n", "c"))
    people, around = F.try_variant_get("c", "$.authors.author", "variant"), F.try_variant_get("c", "$.contexts.context", "variant")
    context = lambda x: F.struct(*(F.try_variant_get(x, f"$['{k}']", t).alias(n) for n, k, t in (("cite", "@citStr", "string"), ("position", "@position", "int"), ("text", "#text", "string"))))
    none = F.expr("CAST(array() AS array<struct<cite: string, position: int, text: string>>)")
    return items.select(
        "name",
        "n",
        F.try_variant_get("c", "$.title", "string").alias("title"),
        F.try_variant_get("c", "$.date", "string").alias("date"),
        F.try_variant_get("c", "$.rawString", "string").alias("raw"),
        F.when(people.isNotNull(), F.transform(as_list(people), lambda a: F.try_variant_get(a, "$", "string"))).otherwise(F.array().cast("array<string>")).alias("authors"),
        F.when(around.isNotNull(), F.transform(as_list(around), context)).otherwise(none).alias("contexts"),
    )


_CITED = "name string, n int, title string, date string, raw string, authors array<string>, contexts array<struct<cite: string, text: string>>"


def citation_xml(docs: DataFrame) -> DataFrame:
    """Citations of parsed papers (name, text): title and date are required, broken XML is skipped."""
    ship_package(docs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for name, text in zip(f["name"], f["text"], strict=True):
                try:
                    root = ET.fromstring(text or "")
                except ET.ParseError:
                    continue
                kept = [c for c in root.iter("citation") if c.findtext("title") and c.findtext("date")]
                for n, c in enumerate(kept):
                    ctx = [{"cite": x.get("citStr") or "", "text": "".join(x.itertext())} for x in c.iter("context")]
                    out.append((name, n, c.findtext("title"), c.findtext("date"), c.findtext("rawString"), [a.text or "" for a in c.iter("author")], ctx))
            yield pd.DataFrame(out, columns=["name", "n", "title", "date", "raw", "authors", "contexts"])

    return docs.select("name", "text").mapInPandas(run, _CITED)


def _number(text: str | None) -> float:
    """The number that a text is, or 0."""
    try:
        return float(text or 0)
    except ValueError:
        return 0.0


def body_xml(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """(name, pos, kind, text, section, subsection) in document order.

    Elements are body text, list items, footnotes and headers; a header below the
    confidence counts as body. Sections and subsections are counted along the way.
    """
    ship_package(docs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for name, text in zip(f["name"], f["text"], strict=True):
                try:
                    root = ET.fromstring(text or "")
                except ET.ParseError:
                    continue
                pos = 0
                for e in root.iter():
                    if e.tag in ("bodyText", "listItem", "footnote") or "Header" in e.tag:
                        sure = _number(e.get("confidence")) >= least
                        kind = ("subsection" if "sub" in e.tag.lower() else "section") if "Header" in e.tag and sure else "body"
                        out.append((name, pos, kind, "".join(e.itertext()).strip()))
                        pos += 1
            yield pd.DataFrame(out, columns=["name", "pos", "kind", "text"])

    return number_sections(docs.select("name", "text").mapInPandas(run, "name string, pos int, kind string, text string"), ["name"], "pos")


def number_sections(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Running section number, and subsection number within it, from rows with ``kind`` section, subsection or body."""
    from pyspark.sql import Window

    run = Window.partitionBy(*keys).orderBy(order)
    df = df.withColumn("section", F.sum((F.col("kind") == "section").cast("int")).over(run))
    return df.withColumn("subsection", F.sum((F.col("kind") == "subsection").cast("int")).over(Window.partitionBy(*keys, "section").orderBy(order)))


_SENTENCE = "name string, section int, subsection int, sentence int, title string, text string, refs array<string>"


def structured_xml(docs: DataFrame) -> DataFrame:
    """Sentences of papers marked with DIV, HEADER, P and S: place, title of the nearest header, text with REF, CREF and EQN as words, REFs."""
    ship_package(docs.sparkSession)
    word = {"CREF": "CREF", "EQN": "EQN"}

    def flat(e: ET.Element, refs: list[str]) -> str:
        parts = [e.text or ""]
        for c in e:
            if c.tag == "REF":
                refs.append(" ".join("".join(c.itertext()).split()))
            parts.append(word.get(c.tag) or flat(c, refs))
            parts.append(c.tail or "")
        return "".join(parts)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for name, text in zip(f["name"], f["text"], strict=True):
                try:
                    root = ET.fromstring(text or "")
                except ET.ParseError:
                    continue
                place = [0, 0]

                def walk(e: ET.Element, depth: int, title: str, name: str = name, place: list[int] = place) -> None:
                    n = 0
                    for c in e:
                        if c.tag == "HEADER":
                            title = " ".join("".join(c.itertext()).split())
                        elif c.tag == "DIV":
                            place[:] = [place[0] + 1, 0] if depth == 0 else [place[0], place[1] + 1]
                            walk(c, depth + 1, title)
                        elif c.tag in ("S", "A-S"):
                            refs: list[str] = []
                            out.append((name, place[0], place[1], n, title, " ".join(flat(c, refs).split()), refs))
                            n += 1
                        else:
                            for s in c.iter():
                                if s.tag in ("S", "A-S"):
                                    refs = []
                                    out.append((name, place[0], place[1], n, title, " ".join(flat(s, refs).split()), refs))
                                    n += 1

                walk(root.find(".//BODY") if root.find(".//BODY") is not None else root, 0, "")
            yield pd.DataFrame(out, columns=["name", "section", "subsection", "sentence", "title", "text", "refs"])

    return docs.select("name", "text").mapInPandas(run, _SENTENCE)


def paper_facts(docs: DataFrame) -> DataFrame:
    """(name, title, year) with fall-backs: YEAR, then APPEARED's digits, then the id's year."""
    tag = lambda t: F.nullif(F.trim(F.regexp_extract("text", rf"(?s)<{t}[^>]*>(.*?)</{t}>", 1)), F.lit(""))
    year = F.coalesce(F.expr("try_cast(regexp_extract(text, '<YEAR[^>]*>\\\\s*([0-9]{4})', 1) AS int)"), F.expr("try_cast(regexp_extract(text, '(?s)<APPEARED>.*?([0-9]{4})', 1) AS int)"), labels.year_from_id(F.col("name")))
    return docs.select("name", tag("TITLE").alias("title"), year.alias("year"))


def bibliography_entry(surnames: Column, date: Column, citing_year: Column) -> tuple[Column, Column]:
    """Clean surnames, and the year; papers still to appear take the citing paper's year."""
    soon = date.rlike("ppear|press|orthcoming|in print")
    year = F.regexp_extract(date, "([0-9]{4})", 1)
    return F.transform(surnames, lambda s: F.trim(F.regexp_replace(s, "[.,;()]", ""))), F.when(soon, citing_year).when(year != "", year.cast("int"))


def links(pages: DataFrame) -> DataFrame:
    """(page_id, n, href, text) of the anchors of HTML pages."""
    pattern = r"(?is)<a\s[^>]*?href=\"([^\"]*)\"[^>]*>(.*?)</a>"
    hrefs, texts = F.regexp_extract_all("html", F.lit(pattern), F.lit(1)), F.regexp_extract_all("html", F.lit(pattern), F.lit(2))
    return pages.select("page_id", F.posexplode(F.arrays_zip(hrefs.alias("href"), texts.alias("text"))).alias("n", "a")).select("page_id", "n", "a.href", "a.text")


def annotate(sentences: DataFrame, call, retries: int = 4) -> DataFrame:
    """Hand each text to an external annotator, ``call(text) -> JSON string``, trying again on broken JSON; (id, parsed)."""
    ship_package(sentences.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for text in f["text"]:
                got = None
                for _ in range(retries):
                    try:
                        got = json.dumps(json.loads(call(text)))
                        break
                    except ValueError:
                        continue
                out.append(got)
            yield pd.DataFrame({"id": f["id"], "parsed": out})

    return sentences.select("id", "text").mapInPandas(run, "id string, parsed string")
