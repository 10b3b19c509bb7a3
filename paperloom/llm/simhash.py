"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import FILTER_BITS, LOWER, Words, column_slices, discard, fixed_filter, free_names, in_filter, materialize, mix, prepare, split_by_keys, text_key, words_of

_CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of the XXH64 (seed 42) of all word shingles, repeats included. No words: 0."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and blanks \x20 \x09-\x0D only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) >= shingle:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    ones, h = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for i in range(0, len(starts), _CHUNK):
        part = np.array([h(joined[a:b], 42) for a, b in zip(starts[i : i + _CHUNK].tolist(), ends[i : i + _CHUNK].tolist(), strict=True)], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = ones * 2 > len(starts)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) for each row of ``docs``; ``fp`` is the fingerprint as a signed long."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _ball(key: Column, bits: int, radius: int) -> Column:
    """``key`` and the keys that set up to ``radius`` more of its bits.

    Of two keys that differ in one bit only the one without it looks for the other, so
    each pair is met once and the ball has half its size.
    """
    out = F.array(key)
    if radius >= 1:
        flips = F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i))
        out = F.concat(out, F.transform(F.filter(flips, lambda m: key.bitwiseAND(m) == 0), lambda m: key.bitwiseOR(m)))
    return out


def links(prints: DataFrame, distance: int = 3) -> DataFrame:
    """Pairs (a, b) of different fingerprints of ``prints`` (column ``fp``, distinct) that differ in at most ``distance`` bits.

    Multi-index hashing: the 64 bits fall into two segments of 32, so a pair within 3
    bits agrees to 1 bit in at least one of them. Each fingerprint looks up the ball of
    radius 1 around each of its segments in the table of segments, and the matches are
    verified over all 64 bits.
    """
    if not 0 <= distance <= 3:
        raise ValueError("two segments of 32 bits answer distances from 0 to 3")
    radius = distance // 2
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    parts = prints.select("fp", F.explode(F.array(F.struct(F.lit(0).alias("seg"), low.alias("key")), F.struct(F.lit(1).alias("seg"), high.alias("key")))).alias("s")).select("fp", "s.seg", "s.key")
    table = parts.select("seg", "key", F.col("fp").alias("b"))
    probes = parts.select("seg", F.explode(_ball(F.col("key"), 32, radius)).alias("key"), F.col("key").alias("own"), F.col("fp").alias("a"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    found = probes.join(table, (probes.seg == table.seg) & (probes.key == table.key) & near & ((probes.own != table.key) | (F.col("a") < F.col("b"))))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id, n_links.

    Rows are linked when their fingerprints differ in at most ``distance`` bits;
    ``component_id`` is the smallest doc_id that links lead to. ``n_links`` counts the
    other fingerprints within that distance. Null and empty texts have the fingerprint 0
    and link like any other. Rows with equal fingerprints count as one node, so copies
    are never paired. A null doc_id is never a component's name unless all its ids are
    null. Columns of ``docs`` besides doc_id and text are ignored.
    """
    fps = materialize(fingerprints(docs, shingle))
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    pairs = materialize(links(nodes, distance))
    comps = connected_components(pairs)
    named = nodes.join(comps.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    degree = pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).groupBy("fp").agg(F.count(F.lit(1)).alias("n_links"))
    # written, so that the join below has nothing but its two sides in a stage, and Spark splits fingerprints of many copies
    of = materialize(named.join(names, "root").join(degree, "fp", "left").select("fp", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links")))
    discard(nodes, pairs)
    return fps.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")


#: Bands of minimum hashes, and rows in each: two sets with a similarity of 0.8 share a band with probability 0.998.
BANDS, ROWS = 16, 5
_PERMUTE = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64)).reshape(2, -1) | np.uint64(1)


def _sets(w: Words, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each row, in order; a row of fewer words has one shingle, of all its words."""
    h = w.hashes()
    at, keys = w.shingles(h, shingle)
    rows = [np.searchsorted(w.first, at, side="right") - 1]
    parts = [keys]
    size = w.counts()
    for k in range(1, shingle):
        if (size == k).any():
            at, keys = w.shingles(h, k)
            of = np.searchsorted(w.first, at, side="right") - 1
            rows.append(of[size[of] == k])
            parts.append(keys[size[of] == k])
    row, key = np.concatenate(rows), np.concatenate(parts)
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    return row[new], key[new]


def _per_row(row: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(row, np.arange(n + 1))


def _signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, text_key, fp, sid, size, bands): fingerprint, identity and size of the shingle set, hashes of its bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offs in column_slices(b.column(2)):
                row, key = _sets(words_of(data, offs, LOWER), shingle)
                at = _per_row(row, hi - lo)
                sid = [xxhash.xxh3_128_hexdigest(key[i:j].tobytes()) for i, j in zip(at, at[1:], strict=False)]
                bands = np.zeros((BANDS, hi - lo), np.uint64)
                full = np.flatnonzero(at[1:] > at[:-1])
                for k in range(BANDS * ROWS if len(full) else 0):
                    least = np.minimum.reduceat(key * _PERMUTE[0, k] + _PERMUTE[1, k], at[:-1][full])
                    bands[k // ROWS, full] = mix(bands[k // ROWS, full] ^ mix(least))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * BANDS), pa.array(np.ascontiguousarray(bands.T).ravel().view(np.int64)))
                fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(2).slice(lo, hi - lo)], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(lo, hi - lo) for i in (0, 1)), pa.array(fps), pa.array(sid), pa.array(np.diff(at), pa.int64()), lists], ["doc_id", "text_key", "fp", "sid", "size", "bands"])

    return docs.select(F.col("doc_id").cast("long"), text_key(F.col("text")), F.col("text").cast("string")).mapInArrow(run, "doc_id long, text_key string, fp long, sid string, size long, bands array<long>")


def _candidate_sets(docs: DataFrame, shingle: int, wanted) -> DataFrame:
    """(sid, shingles) of the sets that ``wanted``, a broadcast filter, may have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offs in column_slices(b.column(0)):
                row, key = _sets(words_of(data, offs, LOWER), shingle)
                at = _per_row(row, hi - lo)
                found = {}
                for i, j in zip(at, at[1:], strict=False):
                    found.setdefault(xxhash.xxh3_128_hexdigest(key[i:j].tobytes()), (i, j))
                sid = list(found)
                ask = np.array([int(x[:16], 16) for x in sid], np.uint64)
                keep = np.flatnonzero(in_filter(wanted.value, ask)) if sid else []
                yield pa.RecordBatch.from_arrays([pa.array([sid[k] for k in keep], pa.string()), pa.array([key[slice(*found[sid[k]])].view(np.int64) for k in keep], pa.list_(pa.int64()))], ["sid", "shingles"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(run, "sid string, shingles array<long>")
    return rows.groupBy("sid").agg(F.first("shingles").alias("shingles"))


#: Shingles of the sets that a worker compares with each other; a bucket with more is split into blocks.
BLOCK_SHINGLES = 1 << 20


def _merges(similarity: float):
    """For the sets of a cell (i, j, side, sid, root, shingles): pairs with the similarity that bring different roots together, one for each merge.

    Every pair is decided: compared, or in one component already. A cell with i < j compares
    across its two sides only. Sets whose shingles are common in the cell go first, so the
    centre of a star leaves nothing to compare.
    """

    def run(cell: pa.Table) -> pa.Table:
        lists = cell["shingles"].combine_chunks()
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.chunk(0)
        flat, size = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        side, sid = cell["side"].to_numpy().astype(bool), np.array(cell["sid"].to_pylist(), object)
        comp = np.unique(np.array(cell["root"].to_pylist()), return_inverse=True)[1]
        across = cell["i"][0].as_py() < cell["j"][0].as_py()
        values, ids, often = np.unique(flat, return_inverse=True, return_counts=True)
        at = np.cumsum(size) - size
        order = np.argsort(-np.add.reduceat(often[ids], at) / size, kind="stable")
        ids = np.concatenate([ids[at[k] : at[k] + size[k]] for k in order])
        size, side, sid, comp = size[order], side[order], sid[order], comp[order]
        at = np.cumsum(size) - size
        mark, found = np.zeros(len(values), bool), []
        for p in range(len(size) - 1):
            if comp.min() == comp.max():
                break
            rest = slice(p + 1, None)
            far = (comp[rest] != comp[p]) & (np.minimum(size[rest], size[p]) >= similarity * np.maximum(size[rest], size[p]))
            if across:
                far &= side[rest] != side[p]
            if not far.any():
                continue
            own = ids[at[p] : at[p] + size[p]]
            mark[own] = True
            shared = np.add.reduceat(mark[ids[at[p + 1] :]], at[rest] - at[p + 1], dtype=np.int64)
            mark[own] = False
            hit = np.flatnonzero(far & (shared >= similarity * (size[rest] + size[p] - shared))) + p + 1
            merged, one = np.unique(comp[hit], return_index=True)
            found += [(sid[p], sid[h]) for h in hit[one]]
            comp[np.isin(comp, merged)] = comp[p]
        return pa.table({"a": pa.array([x for x, _ in found], pa.string()), "b": pa.array([y for _, y in found], pa.string())})

    return run


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, distance: int = 3) -> DataFrame:
    """doc_id, text_key, component_id, stays for each row of ``docs``: groups linked by a Jaccard similarity of distinct word shingles.

    A 64-bit SimHash cannot see such a similarity alone: sets at 0.8 lie 4 to 14 bits
    apart, and no Hamming ball of that radius can be enumerated. So pairs within
    ``distance`` bits are joined by candidates from bands of minimum hashes, and each
    candidate pair is verified on the whole sets. First each set of a bucket is compared
    with the first one and with the one before it, which links dense groups by few pairs.
    Buckets that still have sets of different components are then compared whole, in
    blocks of a bounded size, so that no pair of a bucket is left undecided. Equal sets are
    one node. Null and empty texts are equal. ``component_id`` is the smallest doc_id of the
    group. ``stays`` marks the row with it, and of rows with one id that with the least
    ``text_key``; a null id comes last. Ids do not link: rows that share one, or have none, are
    in one group only if their texts are.
    """
    prepare(docs.sparkSession)
    sigs = materialize(_signatures(docs, shingle))
    nodes = materialize(sigs.groupBy("sid").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("least"), F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("bands").alias("bands")))
    by_fp = materialize(nodes.groupBy("fp").agg(F.min("sid").alias("lead"), F.count_if(F.col("size") > 0).alias("n")))
    bits = materialize(links(by_fp, distance))
    lead = lambda c: by_fp.select(F.col("fp").alias(c), F.col("lead").alias(f"{c}_sid"), F.col("n").alias(f"{c}_n"))
    led = bits.join(lead("a"), "a").join(lead("b"), "b")
    near = led.select(F.col("a_sid").alias("a"), F.col("b_sid").alias("b"))
    same = nodes.join(by_fp, "fp").where("sid <> lead").select(F.col("lead").alias("a"), F.col("sid").alias("b"))
    whole = Window.partitionBy("band", "key")
    bucket = whole.orderBy("sid")
    placed = nodes.where("size > 0").select("sid", "size", F.posexplode("bands").alias("band", "key")).withColumns({"n": F.count(F.lit(1)).over(whole), "first": F.first("sid").over(bucket.rowsBetween(Window.unboundedPreceding, 0)), "prev": F.lag("sid").over(bucket)})
    placed = materialize(placed.where("n > 1"))
    banded = placed.where("prev IS NOT NULL").select(F.explode(F.array("first", "prev")).alias("a"), F.col("sid").alias("b"))
    pairs = near.unionByName(same).unionByName(banded).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    sizes = nodes.select("sid", "size")
    pairs = pairs.join(sizes.select(F.col("sid").alias("a"), F.col("size").alias("na")), "a").join(sizes.select(F.col("sid").alias("b"), F.col("size").alias("nb")), "b").where(F.least("na", "nb") >= similarity * F.greatest("na", "nb"))
    pairs = materialize(pairs.select("a", "b"))
    # Buckets that these pairs do not cover: more than three sets of a band, more than two of one fingerprint or of two near ones.
    filled = nodes.where("size > 0").select("fp", "sid", "size")
    crowded = by_fp.where("n > 2").select(F.lit(-1).alias("band"), F.col("fp").alias("key"), "fp")
    linked = led.where("a_n + b_n > 2").select(F.lit(-2).alias("band"), F.xxhash64("a", "b").alias("key"), F.explode(F.array("a", "b")).alias("fp"))
    large = placed.where("n > 3").select("band", "key", "sid", "size").unionByName(crowded.unionByName(linked).join(filled, "fp").select("band", "key", "sid", "size"))
    large = materialize(large)
    names = pairs.select(F.col("a").alias("s")).unionByName(pairs.select(F.col("b").alias("s"))).unionByName(large.select(F.col("sid").alias("s"))).distinct()
    high = F.conv(F.left("s", F.lit(16)), 16, -10).cast("long")
    wanted = docs.sparkSession.sparkContext.broadcast(fixed_filter(names.select(high.alias("key")), FILTER_BITS >> 3))
    sets = materialize(_candidate_sets(docs, shingle, wanted))
    both = pairs.join(sets.select(F.col("sid").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("sid").alias("b"), F.col("shingles").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    verified = materialize(both.where(shared >= similarity * (F.size("x") + F.size("y") - shared)).select("a", "b"))
    placed_large = large
    large = materialize(large.join(connected_components(verified).withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid")))
    h = F.xxhash64("sid")
    opened = large.groupBy("band", "key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("mass"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(38,0)")).alias("y")).where("lo <> hi")
    opened = opened.groupBy("n", "x", "y").agg(F.first(F.struct("band", "key", F.ceil(F.col("mass") / BLOCK_SHINGLES).cast("int").alias("blocks"))).alias("o")).select("o.*")  # buckets of the same sets count once
    block = large.join(opened, ["band", "key"]).withColumn("own", F.pmod(h, F.col("blocks")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    cells = block.select("band", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "sid", "root")
    more = cells.join(sets, "sid").groupBy("band", "key", "i", "j").applyInArrow(_merges(similarity), "a string, b string")
    edges = verified.unionByName(more)
    named = nodes.select("sid", "least").join(connected_components(edges).withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    of = materialize(named.join(named.groupBy("root").agg(F.min("least").alias("head")), "root").select("sid", "head"))
    joined = sigs.select("doc_id", "text_key", "sid").join(of, "sid")
    out = materialize(joined.select("doc_id", "text_key", F.col("head.doc_id").alias("component_id"), (F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("text_key") == F.col("head.text_key"))).alias("stays")))
    discard(sigs, nodes, by_fp, bits, placed, pairs, placed_large, large, sets, verified, of)
    return out


def keep_one(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay in ``groups`` (the output of ``similar_groups`` for them), with all their columns.

    Of rows with equal doc_id and text any one stays. Only rows that may have to go are
    joined and shuffled.
    """
    rid, stays, n, row = free_names(docs, "row_key", "stays", "n", "row")
    key = lambda text: F.concat_ws("/", F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), text)
    touched = groups.groupBy(key(F.col("text_key")).alias(rid)).agg(F.max("stays").alias(stays), F.count(F.lit(1)).alias(n)).where(f"NOT `{stays}` OR `{n}` > 1")
    touched = materialize(touched)
    others, maybe = split_by_keys(docs, key(text_key(F.col("text"))), touched.select(rid), rid)
    left = maybe.join(touched, rid, "left").where(f"coalesce(`{stays}`, true)")
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(row)
    many = left.where(f"`{n}` > 1").select(rid, whole).groupBy(rid).agg(F.first(row).alias(row)).select(f"{row}.*")
    kept = left.where(f"coalesce(`{n}`, 1) = 1").select(*(f"`{c}`" for c in docs.columns)).unionByName(many)
    return kept if others is None else others.unionByName(kept)
