"""Operators over dependency edges: paths, clauses, selectional preference."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from ..session import ship_package


def paths(deps: DataFrame, lemmas: DataFrame, origins: DataFrame) -> DataFrame:
    """(sid, path, leaf): all ways of one or two edges from the origin, incoming edges with ``inv-``; never back to the origin.

    deps: (sid, dep, gov, tok), from 1; lemmas: (sid, tok, lemma); origins: (sid, origin).
    The root edge and a sentence's final punctuation are left out.
    """
    last = lemmas.groupBy("sid").agg(F.max("tok").alias("last"))
    e = deps.where("dep <> 'ROOT'").join(last, "sid").where("NOT (dep = 'punct' AND tok = last)")
    step = e.select("sid", F.col("gov").alias("a"), "dep", F.col("tok").alias("b")).unionByName(e.select("sid", F.col("tok").alias("a"), F.concat(F.lit("inv-"), "dep").alias("dep"), F.col("gov").alias("b")))
    one = origins.join(step, (origins["origin"] == step["a"]) & (origins["sid"] == step["sid"])).select(origins["sid"], "origin", F.array("dep").alias("path"), "b")
    more = step.select("sid", F.col("a").alias("b"), F.col("dep").alias("d2"), F.col("b").alias("c"))
    two = one.join(more, ["sid", "b"]).where("c <> origin").select("sid", "origin", F.concat("path", F.array("d2")).alias("path"), F.col("c").alias("b"))
    return one.unionByName(two).join(lemmas.withColumnRenamed("tok", "b"), ["sid", "b"]).select("sid", F.array_join("path", " ").alias("path"), F.col("lemma").alias("leaf"))


def clauses(sentences: DataFrame, longest: int = 500) -> DataFrame:
    """``spans``, the clause (start, end) of each token, from ``tokens`` (pos) and ``deps`` (dep, governor, dependent; from 1).

    Clause roots are ROOT, advcl, ccomp, acl:*, list, parataxis, and verbs or IN joined to
    such by conj or cc. A clause spans its root's subtree without other roots; later
    roots overwrite. A sentence of ``longest`` tokens or more is one clause.
    """
    ship_package(sentences.sparkSession)

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def run(tokens: pd.Series, deps: pd.Series) -> pd.Series:
        out = []
        for toks, edges in zip(tokens, deps, strict=True):
            n = len(toks)
            spans: list[tuple[int, int]] = [(0, n - 1)] * n
            if n < longest:
                below: dict[int, list[int]] = {}
                roots = []
                verbal = lambda i, toks=toks: 0 < i <= len(toks) and ((toks[i - 1]["pos"] or "")[:1] == "V" or toks[i - 1]["pos"] == "IN")
                for d in edges:
                    kind, gov, tok = d["dep"], d["governor"], d["dependent"]
                    if kind != "ROOT" and not (kind == "punct" and tok == n):
                        below.setdefault(gov, []).append(tok)
                    if kind in ("ROOT", "advcl", "ccomp", "list", "parataxis") or kind.startswith("acl:") or (kind in ("conj", "cc") and verbal(tok) and verbal(gov)):
                        roots.append(tok)
                stops = set(roots)
                for r in roots:
                    todo, got = [r], {r}
                    while todo:
                        for c in below.get(todo.pop(), ()):
                            if c not in stops and c not in got:
                                got.add(c)
                                todo.append(c)
                    for i in got:
                        if 0 < i <= n:
                            spans[i - 1] = (min(got) - 1, max(got) - 1)
            out.append([{"start": a, "end": e} for a, e in spans])
        return pd.Series(out)

    return sentences.withColumn("spans", run("tokens", "deps"))


def selectional_preference(gold: DataFrame, words: DataFrame, paths_: DataFrame) -> DataFrame:
    """(file_id, sid, label, sim): mean cosine of each leaf's vector with the summed vectors of the label's leaves on its path.

    gold: (file_id, label, path, leaf) — rows with punct or det are dropped; words: (word,
    vector); paths_: (file_id, sid, path, leaf). A file's own gold rows do not count: its
    sums are taken off the totals, as sums can be.
    """
    clean = gold.where(~F.col("path").contains("punct") & ~F.col("path").contains("det"))
    known = clean.join(words.withColumnRenamed("word", "leaf"), "leaf")
    total = vectors.sum_vectors(known, ["path", "label"], "vector")
    own = vectors.sum_vectors(known, ["file_id", "path", "label"], "vector").withColumnRenamed("vector", "own")
    seen = paths_.join(words.withColumnRenamed("word", "leaf").withColumnRenamed("vector", "v"), "leaf").join(total, "path").join(own, ["file_id", "path", "label"], "left")
    rest = F.when(F.col("own").isNull(), F.col("vector")).otherwise(F.zip_with("vector", "own", lambda a, b: a - b))
    return seen.withColumn("sim", vectors.cosine(F.col("v"), rest)).groupBy("file_id", "sid", "label").agg(F.avg("sim").alias("sim"))
