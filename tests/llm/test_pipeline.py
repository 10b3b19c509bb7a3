"""The corpus pipeline, stage by stage, on the smallest tables."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
import pytest
from paperloom.llm import decontam, quality, secret_scan, simhash
from paperloom.llm.common import materialize


def test_stages_take_effect(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(materialize(stage(spark, kept[-1], small)))
    assert all(k.columns == columns for k in kept[:-1])
    ids = [{r.doc_id for r in k.select("doc_id").collect()} for k in kept]
    assert all(b <= a for a, b in zip(ids, ids[1:])) and ids[-1]
    labels, bench = spark.read.parquet(f"{small}/labels.parquet"), spark.read.parquet(f"{small}/benchmark.parquet")
    assert ids[1] == {r.doc_id for r in quality.score_quality(docs, labels).where("predicted = 1").collect()}
    groups = simhash.similar_groups(kept[2])
    assert groups.where("doc_id <> component_id").isEmpty()
    assert {r.component_id for r in simhash.similar_groups(kept[1]).collect()} == ids[2]
    hit = {r.doc_id for r in decontam.decontaminate(kept[2], bench).where("n_items > 0").collect()}
    assert ids[3] == ids[2] - hit
    assert ids[4] == ids[3] and secret_scan.scan(kept[4], secret_scan.default_forest(spark)).where("is_secret").isEmpty()
    assert kept[4].where(F.length("text") != F.col("n_chars")).isEmpty()


NAMES = ("_mark", "_own", "_id", "_place", "_rows", "_p", "row_key", "stays", "n", "row", "text_key", "mark", "_n", "_topic", "key", "component_id", "w")


@pytest.mark.parametrize("kind", ["int"])
def test_stages_on_odd_tables(spark, tmp_path, kind):
    """Ids that are int, null or repeated, and columns that clash with anything."""
    rng = random.Random(4)
    words = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    leak, base = words(30), words(200)
    near = base.split()
    near[100] = "other"
    near = " ".join(near)
    texts = [(1, base), (2, near), (2, words(40)), (3, f"{words(20)} {leak} {words(20)}"), (4, words(60)), (4, words(60)), (5, base), (5, base), (None, words(50)), (None, words(50)), (None, None), (6, "")]
    df = spark.createDataFrame([(i, t, "en", "web", len(t or ""), *NAMES) for i, t in texts], f"doc_id {kind}, text string, lang string, source string, n_chars int, " + ", ".join(f"{c} string" for c in NAMES))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = simhash.keep_one(df, simhash.similar_groups(df))
    assert kept.columns == df.columns
    got = sorted(((r.doc_id or 0, r.text or "") for r in kept.collect()))
    assert got == sorted([(1, base), *((i or 0, t) for i, t in (texts[k] for k in (2, 3, 4, 5, 8, 9))), (6, "")])
    clean = corpus_pipeline.benchmark_decontamination(spark, kept, str(tmp_path))
    assert clean.columns == df.columns and {r.doc_id for r in kept.collect()} - {r.doc_id for r in clean.collect()} == {3} and clean.count() == kept.count() - 1
    same = corpus_pipeline.secret_scans(spark, clean, str(tmp_path))
    assert same.columns == df.columns and same.count() == clean.count()
    mixed = corpus_pipeline.mixing_to_weights(spark, same, str(tmp_path))
    assert mixed.columns == [*df.columns, "mix_probability"] and all(tuple(r[c] for c in NAMES) == NAMES for r in mixed.collect())


def test_pipeline_without_rows(spark, small, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{small}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
