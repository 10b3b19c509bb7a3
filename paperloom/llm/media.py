"""Media columns: texts as 8-bit sound, kept as content-defined chunks that are stored once."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FILTER_BITS, column_slices, fixed_filter, in_filter, materialize, prepare

#: Payloads are filled up with zeros to a positive multiple of this.
UNIT = 64
#: Sizes of chunks: least, most, and the bits of the rolling hash that are zero at a cut.
LEAST, MOST, CUT_BITS = 256, 8192, 10
#: Parquet codec of the store, whose size is the operator's disk.
CODEC = "zstd"
_RATE = 8000
_HEADER = struct.Struct("<4sI4s4sIHHIIHH4sI")
_GEAR = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.uint16)


def encode_wav(payload: bytes, rate: int = _RATE) -> bytes:
    """A RIFF/WAVE file with one channel of unsigned 8-bit samples."""
    return _HEADER.pack(b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload)) + payload


def decode_wav(media: bytes) -> bytes:
    """Samples of such a file; raises ValueError if it is none."""
    if len(media) < _HEADER.size:
        raise ValueError("too short for a header")
    riff, size, wave, fmt, _, pcm, channels, _, _, _, bits, data, n = _HEADER.unpack_from(media)
    if (riff, wave, fmt, data) != (b"RIFF", b"WAVE", b"fmt ", b"data") or (pcm, channels, bits) != (1, 1, 8) or size != 36 + n or len(media) != _HEADER.size + n:
        raise ValueError("not an 8-bit mono WAVE file")
    return media[_HEADER.size :]


def rolling(data: np.ndarray) -> np.ndarray:
    """Gear hash of the last 16 bytes at each byte, h = 2h + gear[byte] modulo 2**16, by doubling the window."""
    h = _GEAR[data]
    for width in (1, 2, 4, 8):
        more = h.copy()
        more[width:] += h[:-width] << np.uint16(width) if len(h) > width else 0
        h = more
    return h


def cuts(size: int, marks: np.ndarray) -> list[int]:
    """Ends of the chunks of ``size`` bytes; ``marks`` are the places, in order, where the rolling hash allows a cut."""
    ends, at, i = [], 0, 0
    marks = marks.tolist()
    while size - at > LEAST:
        while i < len(marks) and marks[i] < at + LEAST:
            i += 1
        end = min(marks[i] if i < len(marks) else size, at + MOST, size)
        ends.append(end)
        at = end
    if at < size:
        ends.append(size)
    return ends


def _chunked(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, bytes, list[int]]]:
    """(bytes of the text, payload, ends of its chunks) for each row."""
    mask = np.uint16(((1 << CUT_BITS) - 1) << (16 - CUT_BITS))
    marks = np.flatnonzero((rolling(data) & mask) == 0) + 1
    near = np.searchsorted(marks, offsets)
    raw = data.tobytes()
    for r in range(len(offsets) - 1):
        a, e = int(offsets[r]), int(offsets[r + 1])
        payload = raw[a:e] + bytes(-(e - a) % UNIT or (UNIT if e == a else 0))
        yield e - a, payload, cuts(len(payload), marks[near[r] : near[r + 1]] - a)


def features(samples: bytes) -> str:
    """Mean, root mean square, zero crossings a sample, peak, and shares of eight levels, of samples around 128."""
    x = np.frombuffer(samples, np.uint8)
    c = x.astype(np.int64) - 128
    n = len(x)
    crossings = int(np.count_nonzero((c[1:] < 0) != (c[:-1] < 0)))
    levels = np.bincount(x >> 5, minlength=8)
    return f"mean={c.sum() / n:.6f};rms={(int((c * c).sum()) / n) ** 0.5:.6f};zcr={crossings / n:.6f};peak={int(np.abs(c).max())};levels=" + ",".join(f"{v / n:.4f}" for v in levels.tolist())


def _read_back(media: bytes) -> dict:
    samples = decode_wav(media)
    return {
        "payload_bytes": len(samples), "payload_sha256": hashlib.sha256(samples).hexdigest(), "tail_crc32": zlib.crc32(samples[-UNIT:]),
        "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": features(samples),
    }


_FACTS = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
_FACTS_DDL = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_CHUNKS = pa.list_(pa.struct([("digest", pa.binary()), ("bytes", pa.binary())]))


def _key(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = []
        for _, _, data, offs in column_slices(b.column(0)):
            for _, payload, ends in _chunked(data, offs):
                keys += [_key(hashlib.sha256(payload[a:e]).digest()) for a, e in zip([0, *ends], ends, strict=False)]
        keys, n = np.unique(np.array(keys, np.int64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.minimum(n, 2).astype(np.int8))], ["key", "n"])


def write_store(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two written tables that hold all media: of documents, and of chunks that they share.

    The first has one row per row of ``docs``: row, doc_id, n_bytes, media_sha256, shared,
    and chunks, its ordered list of (digest, bytes); ``bytes`` is null where the chunk lies
    in the second table (digest, bytes), which has each SHA-256 digest once.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = docs.select("text").mapInArrow(_count, "key long, n byte")
    maybe = spark.sparkContext.broadcast(fixed_filter(counts.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key"), FILTER_BITS >> 3))

    def pieces(column: pa.Array) -> Iterator[tuple[int, int, list[tuple[int, bytes, list[tuple[bytes, bytes, bool]]]]]]:
        for lo, hi, data, offs in column_slices(column):
            found = []
            for n, payload, ends in _chunked(data, offs):
                parts = [payload[a:e] for a, e in zip([0, *ends], ends, strict=False)]
                digests = [hashlib.sha256(p).digest() for p in parts]
                away = in_filter(maybe.value, np.array([_key(d) for d in digests], np.int64)).tolist()
                found.append((n, payload, list(zip(digests, parts, away, strict=True))))
            yield lo, hi, found

    def write_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, found in pieces(b.column(0)):
                once = {d: p for _, _, parts in found for d, p, away in parts if away}
                yield pa.RecordBatch.from_arrays([pa.array(list(once), pa.binary()), pa.array(list(once.values()), pa.binary())], ["digest", "bytes"])

    def write_media(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, found in pieces(b.column(1)):
                sha = [hashlib.sha256(encode_wav(payload)).hexdigest() for _, payload, _ in found]
                lists = [[{"digest": d, "bytes": None if away else p} for d, p, away in parts] for _, _, parts in found]
                shared = [any(away for _, _, away in parts) for _, _, parts in found]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array([n for n, _, _ in found], pa.int64()), pa.array(sha), pa.array(shared), pa.array(lists, _CHUNKS)], ["doc_id", "n_bytes", "media_sha256", "shared", "chunks"])

    chunks = materialize(docs.select("text").mapInArrow(write_chunks, "digest binary, bytes binary").groupBy("digest").agg(F.first("bytes").alias("bytes")), CODEC)
    media = docs.mapInArrow(write_media, "doc_id long, n_bytes long, media_sha256 string, shared boolean, chunks array<struct<digest: binary, bytes: binary>>")
    return materialize(media.withColumn("row", F.monotonically_increasing_id()), CODEC), chunks


def read_store(media: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc_id, n_bytes, and facts about each medium, put together from its stored chunks; each chunk and the whole are verified."""
    prepare(media.sparkSession)

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                parts = b.column(3)[i].as_py()
                for p in parts:
                    if p["bytes"] is None or hashlib.sha256(p["bytes"]).digest() != p["digest"]:
                        raise ValueError(f"a chunk of document {b.column(0)[i]} differs from its digest")
                f = _read_back(encode_wav(b"".join(p["bytes"] for p in parts)))
                if f["media_sha256"] != b.column(2)[i].as_py():
                    raise ValueError(f"the medium of document {b.column(0)[i]} differs from its digest")
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), b.column(1).slice(i, 1), *(pa.array([f[c]], t) for c, t in _FACTS)], ["doc_id", "n_bytes", *(c for c, _ in _FACTS)])

    own = ["doc_id", "n_bytes", "media_sha256"]
    alone = media.where("NOT shared").select(*own, F.col("chunks").alias("parts"))
    entries = media.where("shared").select("row", *own, F.posexplode("chunks").alias("ord", "c")).select("row", *own, "ord", "c.digest", "c.bytes")
    fetched = entries.where("bytes IS NULL").drop("bytes").join(chunks, "digest", "left")
    every = entries.where("bytes IS NOT NULL").unionByName(fetched)
    whole = every.groupBy("row").agg(*(F.first(c).alias(c) for c in own), F.sort_array(F.collect_list(F.struct("ord", "digest", "bytes"))).alias("parts"))
    whole = whole.select(*own, F.transform("parts", lambda p: F.struct(p["digest"].alias("digest"), p["bytes"].alias("bytes"))).alias("parts"))
    out = f"doc_id long, n_bytes long, {_FACTS_DDL}"
    return alone.mapInArrow(rebuild, out).unionByName(whole.mapInArrow(rebuild, out))


def store_and_read(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, and facts about the media read back from its store.

    A text's UTF-8 bytes, with zeros up to a positive multiple of 64, are the samples of
    an 8-bit WAVE file. A rolling gear hash cuts payloads into chunks at places that
    only the bytes around them decide, so passages that texts share give equal chunks.
    Chunks that only one text has are written in its own list. Chunks that may occur again
    (a filter of fixed size tells, and never misses one) go to the chunk store, once for each
    SHA-256 digest. All media are put together again from the written lists and that store,
    and each chunk and medium is verified against its digest (``write_store``, ``read_store``).

    Null counts as the empty text, whose payload is 64 zeros. Equal texts give equal
    rows but for doc_id. Other columns are ignored.
    """
    return read_store(*write_store(docs))
