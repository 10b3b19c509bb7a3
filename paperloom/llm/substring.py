"""Substring dedup: factors of documents against the blocks that come before them, found by an index of windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import FILTER_BITS, PLAIN, Words, column_slices, filter_bits, fixed_filter, in_filter, materialize, mix, prepare, split_by_keys, words_of

#: Words of the shingles among which a window's anchor is chosen.
ANCHOR = 8
#: Bytes of text whose windows a worker compares with each other before it gives out any.
BLOCK_BYTES = 4 << 20
#: An anchor that more Arrow batches than this have is dealt out by window, so that no task gets all its windows.
HOT = 4096
_FLOOR = -(1 << 63)
#: Bytes of a window's digest.
_WIDTH = 16
_DIGEST = np.dtype([("a", "<u8"), ("b", "<u8")])


def window_digests(w: Words, starts: np.ndarray, window: int) -> np.ndarray:
    """BLAKE2b of the words of each window, joined by a space."""
    size = w.ends - w.starts
    at = np.cumsum(size + 1) - size - 1
    joined, letters = np.full(int((size + 1).sum()), 32, np.uint8), np.ones(int((size + 1).sum()), bool)
    letters[at + size] = False
    joined[letters] = w.data[PLAIN[0][w.data]]
    raw, to = joined.tobytes(), at + size
    digests = [hashlib.blake2b(raw[a:e], digest_size=_WIDTH).digest() for a, e in zip(at[starts].tolist(), to[starts + window - 1].tolist(), strict=True)]
    return np.frombuffer(b"".join(digests), _DIGEST)


def anchors(w: Words, hashes: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first words of all windows, place of each one's anchor, its hash).

    The anchor of a window is its leftmost shingle with the least hash, so equal windows
    have equal anchors at equal offsets, wherever they stand.
    """
    at, keys = w.shingles(hashes, anchor)
    span = window - anchor + 1
    size = w.counts()
    starts = np.flatnonzero(np.arange(len(hashes)) + window <= np.repeat(w.first[1:], size))
    if not len(starts):
        return starts, starts, np.zeros(0, np.uint64)
    least = np.full(len(hashes) + span, np.uint64(0xFFFFFFFFFFFFFFFF))
    least[at] = keys
    where = np.arange(len(least))
    width = 1
    while width < span:  # sliding minimum by doubling; the left one stays where both are equal
        step = min(width, span - width)
        right, pos = least[step:], where[step:]
        less = right < least[: len(right)]
        where = np.where(less, pos, where[: len(right)])
        least = np.where(less, right, least[: len(right)])
        width += step
    return starts, where[starts], least[starts]


def _anchor_counts(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for _, _, data, offs in column_slices(b.column(0)):
                w = words_of(data, offs, PLAIN)
                _, place, key = anchors(w, w.hashes(), window, anchor)
                new = np.concatenate(([True], place[1:] != place[:-1])) if len(place) else np.zeros(0, bool)
                found.append(key[new])
            keys, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int8))], ["key", "n"])

    return run


_ROW = "doc long, tk long, start int, n int, key long, hashes binary, ref_doc long, ref_tk long, ref_start int"


def _runs(*steps: tuple[np.ndarray, int]) -> np.ndarray:
    """Where a new run begins: each array must go on by its step."""
    n = len(steps[0][0])
    new = np.zeros(n, bool)
    new[:1] = True
    for x, by in steps:
        new[1:] |= x[1:] != x[:-1] + by
    return np.flatnonzero(new)


def _windows(window: int, anchor: int, repeated, hot):
    """Windows whose anchor may occur again, in runs; those of a hot anchor one by one, under a key of their own.

    Of equal windows in a block only the first is asked about, with others of its anchor
    in one row; for the others it is the reference, and they come as settled runs.
    """

    def settle(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        doc, tk, start, place, key, h = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((start, tk, doc, h["b"], h["a"]))
        doc, tk, start, place, key, h = doc[order], tk[order], start[order], place[order], key[order], h[order]
        head = np.concatenate(([True], h[1:] != h[:-1]))
        lead = np.flatnonzero(head)[np.cumsum(head) - 1]
        known = (doc != doc[lead]) | (tk != tk[lead]) | (start > start[lead])
        out = []
        at = np.flatnonzero(known)
        at = at[np.lexsort((start[at], tk[at], doc[at]))]
        at = at[np.append(True, (np.diff(doc[at]) != 0) | (np.diff(tk[at]) != 0) | (np.diff(start[at]) != 0))[: len(at)]]
        d, t, s, rd, rt, rs = doc[at], tk[at], start[at], doc[lead[at]], tk[lead[at]], start[lead[at]]
        first = _runs((d, 0), (t, 0), (s, 1), (rd, 0), (rt, 0), (rs, 1)) if len(at) else at
        size = np.diff(np.append(first, len(at))).astype(np.int32)
        none = pa.nulls(len(first))
        out.append([pa.array(d[first]), pa.array(t[first]), pa.array(s[first]), pa.array(size), none.cast(pa.int64()), none.cast(pa.binary()), pa.array(rd[first]), pa.array(rt[first]), pa.array(rs[first])])
        at = np.flatnonzero(head)  # the same place given twice is asked about once
        at = at[np.lexsort((start[at], tk[at], doc[at]))]
        d, t, s, p, k = doc[at], tk[at], start[at], place[at].astype(np.int64), key[at]
        if hot is not None:
            much = in_filter(hot.value, k)
            p = np.where(much, -2 * np.arange(1, len(p) + 1), p)
            k = np.where(much, mix(k ^ h["a"][at]), k)
        first = _runs((d, 0), (t, 0), (s, 1), (p, 0)) if len(at) else at
        ends = np.append(first, len(at))
        raw = np.ascontiguousarray(h[at]).tobytes()
        offsets = pa.array((ends * _WIDTH).astype(np.int32))
        hashes = pa.Array.from_buffers(pa.binary(), len(first), [None, offsets.buffers()[1], pa.py_buffer(raw)])
        none = pa.nulls(len(first))
        out.append([pa.array(d[first]), pa.array(t[first]), pa.array(s[first]), pa.array(np.diff(ends).astype(np.int32)), pa.array(k[first].view(np.int64)), hashes, none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.int32())])
        return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*out, strict=True)], ["doc", "tk", "start", "n", "key", "hashes", "ref_doc", "ref_tk", "ref_start"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        seen = 0
        for b in batches:
            ids, tks = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for lo, hi, data, offs in column_slices(b.column(2)):
                w = words_of(data, offs, PLAIN)
                starts, place, key = anchors(w, w.hashes(), window, anchor)
                maybe = in_filter(repeated.value, key)
                seen += len(data)
                if maybe.any():
                    starts, place, key = starts[maybe], place[maybe], key[maybe]
                    row = np.searchsorted(w.first, starts, side="right") - 1
                    parts.append((ids[lo:hi][row], tks[lo:hi][row], (starts - w.first[row]).astype(np.int32), (place - w.first[row]).astype(np.int32), key, window_digests(w, starts, window)))
                if seen >= BLOCK_BYTES and parts:
                    yield settle(parts)
                    parts, seen = [], 0
        if parts:
            yield settle(parts)

    return run


def repeated_windows(docs: DataFrame, window: int = 20, anchor: int = ANCHOR) -> DataFrame:
    """(doc, tk, start, n, ref_doc, ref_tk, ref_start): runs of n windows whose words also start earlier, with that earlier place.

    ``docs`` has doc and tk (longs, not null, together the name of a document) and text.
    Earlier means a smaller doc, then a smaller tk, or the same document and a smaller
    start. The filter of repeated anchors only saves work: where a corpus is so large that
    it is full, all windows are indexed.
    """
    prepare(docs.sparkSession)
    share = docs.sparkSession.sparkContext.broadcast
    counts = docs.select("text").mapInArrow(_anchor_counts(window, anchor), "key long, n byte")
    counts = materialize(counts.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key", (F.col("n") > HOT).alias("hot")))
    n, n_hot = counts.agg(F.count(F.lit(1)), F.count_if("hot")).first()
    repeated = share(fixed_filter(counts.select("key"), filter_bits(n)))
    hot = share(fixed_filter(counts.where("hot").select("key"), filter_bits(n_hot, FILTER_BITS >> 4))) if n_hot else None
    rows = docs.select("doc", "tk", "text").mapInArrow(_windows(window, anchor, repeated, hot), _ROW)
    # equal windows have equal keys, so the key's partition has all of them; settled runs only pass through and go anywhere
    rows = rows.withColumn("key", F.coalesce("key", F.xxhash64("doc", "start"))).repartition("key")
    each = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.substring("hashes", i * _WIDTH + 1, F.lit(_WIDTH)))
    place = ["doc", "tk", "start"]
    rows = rows.select(*place, "n", "key", "ref_doc", "ref_tk", "ref_start", F.posexplode(F.when(F.col("hashes").isNotNull(), each).otherwise(F.array(F.lit(None).cast("binary")))).alias("i", "h"))
    rows = rows.select("doc", "tk", (F.col("start") + F.col("i")).alias("start"), F.when(F.col("h").isNull(), F.col("n")).otherwise(1).alias("n"), "key", "h", "ref_doc", "ref_tk", "ref_start")
    same = Window.partitionBy("key", "h").orderBy(*place)
    first = rows.withColumn("first", F.first(F.struct(*place)).over(same.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ref = F.when(F.col("h").isNull(), F.struct(F.col("ref_doc").alias("doc"), F.col("ref_tk").alias("tk"), F.col("ref_start").alias("start"))).when(F.struct(*place) > F.col("first"), F.col("first"))
    return first.select(*place, "n", ref.alias("ref")).where("ref IS NOT NULL").select(*place, "n", F.col("ref.doc").alias("ref_doc"), F.col("ref.tk").alias("ref_tk"), F.col("ref.start").alias("ref_start"))


def factorise(runs: list[np.ndarray], window: int) -> list[tuple[int, int, int, int]]:
    """Greedy factors (start, words, ref_doc, ref_start) of one document from its runs (start, n, ref_doc, ref_tk, ref_start) of repeated windows.

    From left to right, a factor runs on while the reference advances with the document;
    where it ends, the next one begins at the next repeated window. Windows that lie
    across two factors are in the input themselves, so no repeat is lost at a boundary.
    """
    out: list[list[int]] = []
    for s, k, *ref, r in sorted(set(zip(*(x.tolist() for x in runs), strict=True))):
        if out and (s, ref, r) == (out[-1][0] + out[-1][1], out[-1][2], out[-1][3] + out[-1][1]):
            out[-1][1] += k
        else:
            out.append([s, k, ref, r])
    return [(s, k + window - 1, ref[0], r) for s, k, ref, r in out]


_OUT = "doc_id long, n_words long, n_removed long, kept string, spans array<struct<start: int, words: int, ref_doc: long, ref_start: int>>"
_RUN = ["start", "n", "ref_doc", "ref_tk", "ref_start"]


def remove_repeats(docs: DataFrame, window: int = 20, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by a space), spans (the factors) for each row of ``docs``.

    A word goes when a window of ``window`` words over it also starts earlier: in a
    document with a smaller doc_id, or before it in the same one. Windows are judged on
    the input, and told apart by 128 bits of BLAKE2b over their words.

    Reference blocks are indexed by windows. Only windows whose anchor shingle occurs at
    least twice (found through a filter of bounded size, which loses none) enter the
    index. Only documents with repeats are joined. Null and empty texts have no words. A
    row is a document of its own: of different texts with one doc_id the one with the
    smaller hash is earlier; rows with equal doc_id and text are one document given twice,
    and neither is earlier. A null doc_id comes before all others. Other columns are ignored.
    """
    prepare(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_FLOOR)).alias("doc"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("tk"), F.col("text").cast("string").alias("text"))
    found = repeated_windows(own.select("doc", "tk", "text"), window, anchor)
    per_doc = materialize(found.groupBy("doc", "tk").agg(F.collect_list(F.struct(*_RUN)).alias("w")).select(F.struct("doc", "tk").alias("name"), "w"))
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, _, _ in column_slices(b.column(1)):
                n_words, n_removed, kept, spans = [], [], [], []
                for r in range(lo, hi):
                    words = (b.column(1)[r].as_py() or "").encode().split()
                    stay = np.ones(len(words), bool)
                    factors = []
                    if b.num_columns > 2 and b.column(2)[r].is_valid:
                        factors = factorise([b.column(c)[r].values.to_numpy() for c in range(2, 7)], window)
                        for at, n, _, _ in factors:
                            stay[at : at + n] = False
                    n_words.append(len(words))
                    n_removed.append(int(len(words) - stay.sum()))
                    kept.append(b" ".join(words if stay.all() else [x for x, s in zip(words, stay.tolist(), strict=True) if s]).decode())
                    spans.append([dict(zip(("start", "words", "ref_doc", "ref_start"), f, strict=True)) for f in factors])
                kind = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32()), ("ref_doc", pa.int64()), ("ref_start", pa.int32())]))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, kind)], ["doc_id", "n_words", "n_removed", "kept", "spans"])

    others, maybe = split_by_keys(own, F.struct("doc", "tk"), per_doc.select("name"), "name", lambda batches: run(b.select([0, 3]) for b in batches), _OUT)
    cut = maybe.join(per_doc, "name", "left").select("doc_id", "text", *(f"w.{c}" for c in _RUN)).mapInArrow(run, _OUT)
    return cut if others is None else others.unionByName(cut)


def digests(cleaned: DataFrame) -> DataFrame:
    """The output of ``remove_repeats`` with the kept words as a digest."""
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]], window: int = 20) -> dict[int, tuple[int, int, str]]:
    """What ``digests(remove_repeats(...))`` must give for distinct ids, on small inputs."""
    words = {d: (t or "").encode().split() for d, t in rows}
    seen: set[tuple[bytes, ...]] = set()
    out = {}
    for d in sorted(words):
        w, stay = words[d], [True] * len(words[d])
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if key in seen:
                stay[i : i + window] = [False] * window
            seen.add(key)
        out[d] = (len(w), stay.count(False), hashlib.sha256(b" ".join(x for x, s in zip(w, stay, strict=True) if s)).hexdigest())
    return out


#: The same for DuckDB.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY t ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM rep),
word AS (SELECT doc_id, p, x FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS s FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
