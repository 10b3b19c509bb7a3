"""Benchmark decontamination: a prefix-filtered set join of document shingles against benchmark windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ALNUM, FILTER_BITS, Words, column_slices, discard, fixed_filter, free_names, in_filter, materialize, prepare, split_by_keys, text_key, words_of

#: Words of the shingles that windows are looked up by; shorter windows are looked up whole.
SHINGLE = 3


def item_windows(items: DataFrame, window: int = 8) -> DataFrame:
    """(item_id, text, n): the windows of each item, words joined by a space; an item shorter than a window is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, sizes = [], [], []
            for lo, hi, data, offs in column_slices(b.column(1)):
                w = words_of(data, offs, ALNUM)
                for r in range(hi - lo):
                    words = [w.word(i) for i in range(w.first[r], w.first[r + 1])]
                    k = min(window, len(words))
                    for t in sorted({b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)} if words else ()):
                        ids.append(b.column(0)[lo + r].as_py())
                        texts.append(t.decode())
                        sizes.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.string()), pa.array(sizes, pa.int32())], ["item_id", "text", "n"])

    return items.select(F.col("item_id").cast("string"), F.col("text").cast("string")).mapInArrow(run, "item_id string, text string, n int").distinct()


def window_shingles(windows: DataFrame) -> DataFrame:
    """(text, n, off, k, key): every shingle of each window with its place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {c: [] for c in ("text", "n", "off", "k", "key")}
            for lo, hi, data, offs in column_slices(b.column(0)):
                w = words_of(data, offs, ALNUM)
                h = w.hashes()
                for k in range(1, SHINGLE + 1):
                    at, keys = w.shingles(h, k)
                    rows = np.searchsorted(w.first, at, side="right") - 1
                    for i, r, key in zip(at.tolist(), rows.tolist(), keys.view(np.int64).tolist(), strict=True):
                        n = int(w.first[r + 1] - w.first[r])
                        if k == min(SHINGLE, n):
                            for c, v in zip(out, (b.column(0)[lo + r].as_py(), n, i - int(w.first[r]), k, key), strict=True):
                                out[c].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out["text"], pa.string()), *(pa.array(out[c], t) for c, t in (("n", pa.int32()), ("off", pa.int32()), ("k", pa.int32()), ("key", pa.int64())))], list(out))

    return windows.select("text").distinct().mapInArrow(run, "text string, n int, off int, k int, key long")


def _hits(w: Words, sizes: list[int], bitset: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    h = w.hashes()
    for k in sizes:
        at, keys = w.shingles(h, k)
        keep = in_filter(bitset, keys)
        yield at[keep], keys[keep]


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 8, min_items: int = 2) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of ``docs``.

    Words: A-Z lower-cased, then runs of letters, digits and whatever is not ASCII. A
    word inside an occurrence of an item's window of ``window`` consecutive words (the
    whole item, where that is shorter) counts as hit.

    Containment must be exact, so one shingle of a window is a sufficient prefix: the one
    that is rarest in the corpus (windows with a shingle that no document has are dropped
    at once). Documents give out only the places of such shingles, found through a filter
    of fixed size; a join on the shingle, the positional bound (the window begins inside
    the document) and the length bound (it ends there) leave candidates, whose words are
    compared one by one.

    Null and empty texts have no words and no hits; n_items 0 has the digest of the empty
    string. Null item ids are ignored. Items with equal ids count once. Each row of
    ``docs`` gives one row, whatever its doc_id. Other columns are ignored.
    """
    return _decontaminate(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), benchmark, window, min_items)


def _decontaminate(docs: DataFrame, benchmark: DataFrame, window: int, min_items: int) -> DataFrame:
    """``decontaminate`` for rows (doc_id, text) with ids of any type."""
    spark = docs.sparkSession
    prepare(spark)
    windows = materialize(item_windows(benchmark.where("item_id IS NOT NULL"), window))
    shingles = materialize(window_shingles(windows))
    sizes = [r.k for r in shingles.select("k").distinct().collect()]  # 1 to SHINGLE
    share = spark.sparkContext.broadcast
    wanted = share(fixed_filter(shingles.select("key").distinct(), FILTER_BITS >> 2))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [keys for _, _, data, offs in column_slices(b.column(0)) for _, keys in _hits(words_of(data, offs, ALNUM), sizes, wanted.value)]
            keys, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])

    counts = docs.select("text").mapInArrow(tally, "key long, n long").groupBy("key").agg(F.sum("n").alias("seen"))
    rarest = Window.partitionBy("text").orderBy("seen", "key", "off")
    prefix = materialize(shingles.join(counts, "key", "left").withColumn("seen", F.coalesce("seen", F.lit(0))).withColumn("rank", F.row_number().over(rarest)).where("rank = 1 AND seen > 0").select("key", "off", "text", "n"))
    probes = share(fixed_filter(prefix.select("key").distinct(), FILTER_BITS >> 2))
    longest = windows.agg(F.max(F.length("text"))).first()[0] or 0

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("key", pa.int64()), ("pos", pa.int32()), ("ctx_at", pa.int32()), ("ctx", pa.string())]))
        for b in batches:
            ids, sizes_, found = [], [], []
            for lo, hi, data, offs in column_slices(b.column(1)):
                w = words_of(data, offs, ALNUM)
                per: list[list[dict]] = [[] for _ in range(hi - lo)]
                for at, keys in _hits(w, sizes, probes.value):
                    rows = np.searchsorted(w.first, at, side="right") - 1
                    for i, r, key in zip(at.tolist(), rows.tolist(), keys.view(np.int64).tolist(), strict=True):
                        a, e = max(int(w.first[r]), i - window), min(int(w.first[r + 1]), i + window)
                        # a word longer than every window cannot be part of one
                        ctx = b" ".join(w.word(j) if w.ends[j] - w.starts[j] <= 4 * longest else b"." for j in range(a, e))
                        per[r].append({"key": key, "pos": i - int(w.first[r]), "ctx_at": a - int(w.first[r]), "ctx": ctx.decode()})
                ids.append(b.column(0).slice(lo, hi - lo))
                sizes_.append(w.counts())
                found += per
            if ids:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.array(np.concatenate(sizes_).astype(np.int64)), pa.array(found, kind)], ["doc_id", "n_words", "found"])

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, found array<struct<key: long, pos: int, ctx_at: int, ctx: string>>"
    rows = materialize(docs.mapInArrow(places, schema).withColumn("row", F.monotonically_increasing_id()))
    cand = rows.where(F.size("found") > 0).select("row", "n_words", F.explode("found").alias("f")).select("row", "n_words", "f.*")
    start = F.col("pos") - F.col("off")
    same = F.array_join(F.slice(F.split("ctx", " "), F.greatest(start - F.col("ctx_at") + 1, F.lit(1)), F.col("n")), " ") == F.col("text")
    met = cand.join(prefix, "key").where((start >= 0) & (start + F.col("n") <= F.col("n_words"))).where(same).select("row", start.alias("start"), "n", "text").distinct()
    met = materialize(met)
    order = Window.partitionBy("row").orderBy("start", "n")
    until = F.coalesce(F.max(F.col("start") + F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    covered = met.select("row", "start", "n").distinct().withColumn("until", until).groupBy("row").agg(F.sum(F.greatest(F.lit(0), F.col("start") + F.col("n") - F.greatest("until", "start"))).cast("long").alias("n_hit"))
    items = met.select("row", "text").distinct().join(windows.select("text", "item_id"), "text").groupBy("row").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    out = rows.select("row", "doc_id", "n_words").join(covered, "row", "left").join(items, "row", "left")
    none = F.array().cast("array<string>")
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("items", none), ",").cast("binary"), 256).alias("items_sha256"),
        (F.size(F.coalesce("items", none)) >= min_items).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 8, min_items: int = 1) -> DataFrame:
    """The rows of ``docs`` whose text has fewer than ``min_items`` items with occurring windows, with all their columns.

    Rows are told apart by their texts alone, so null, repeated or otherwise typed ids
    change nothing; only rows that may go are joined.
    """
    found = _decontaminate(docs.select(text_key(F.col("text")).alias("doc_id"), F.col("text").cast("string").alias("text")), benchmark, window, min_items)
    key = free_names(docs, "text_key")[0]
    found = materialize(found.where("contaminated").select(F.col("doc_id").alias(key)).distinct())
    others, maybe = split_by_keys(docs, text_key(F.col("text")), found, key)
    kept = maybe.join(found, key, "left_anti").drop(key)
    return kept if others is None else others.unionByName(kept)


#: The same for DuckDB.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(8, len(w)) AS n, array_to_string(w[i:i + least(8, len(w)) - 1], ' ') AS t FROM (SELECT item_id, w, unnest(range(1, len(w) - least(8, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS t FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT DISTINCT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.t = bw.t),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM m) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
