"""What the operators share: materialised steps, bounded Arrow slices, fixed-size filters and a vectorised word kernel."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, materialize, ship_package

#: Bytes of text that a Python worker looks at together; its arrays take about forty times as much.
SLICE_BYTES = 1 << 20
#: Bits in the filters that are broadcast: 16 MB whatever the size of the corpus.
FILTER_BITS = 1 << 27
_BUCKET = 32768

__all__ = ["FILTER_BITS", "SLICE_BYTES", "column_slices", "discard", "filter_bits", "fixed_filter", "free_names", "in_filter", "materialize", "mix", "prepare", "split_by_keys", "text_key", "words_of"]


def prepare(spark: SparkSession) -> None:
    """Before a step in Python: send the package, and bound the Arrow batches by bytes as well as by rows."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def column_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets from 0) of runs of rows of about ``limit`` bytes. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    n = len(column)
    if n == 0:
        return
    offsets = np.frombuffer(offs, dtype=np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to, raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


# --- filters of a fixed size -------------------------------------------------------------------


def slot(key: Column, bits: int = FILTER_BITS) -> Column:
    """Place of a 64-bit key in a filter of ``bits`` bits."""
    return F.shiftrightunsigned(key, 64 - (bits.bit_length() - 1))


def fixed_filter(keys: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bit set over the column ``key`` (well mixed 64-bit numbers), folded on the executors.

    At most ``bits / 8`` bytes reach the driver, however many keys there are. Use it
    only where a false positive costs work and not correctness.
    """
    place = slot(F.col("key"), bits)
    rows = keys.where("key IS NOT NULL").select((place / _BUCKET).cast("long").alias("bucket"), F.pmod(place, F.lit(_BUCKET)).alias("bit"))
    out = np.zeros(max(bits // 8, _BUCKET // 8), np.uint8)
    for r in rows.groupBy("bucket").agg(F.expr("bitmap_construct_agg(bit)").alias("bits")).toLocalIterator():
        out[r.bucket * (_BUCKET // 8) : (r.bucket + 1) * (_BUCKET // 8)] = np.frombuffer(r.bits, np.uint8)
    return out


def filter_bits(n: int, most: int = FILTER_BITS) -> int:
    """Bits of a filter over ``n`` keys: at least 64 a key, a power of two, from 2**15 to ``most``."""
    return min(most, max(_BUCKET, 1 << max(0, 64 * n - 1).bit_length()))


def in_filter(bitset: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = keys.astype(np.uint64) >> np.uint64(64 - ((len(bitset) * 8).bit_length() - 1))
    return (bitset[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names for temporary columns that ``df`` has not, however it is spelt."""
    have, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def text_key(text: Column) -> Column:
    """128 bits that stand for a text; null counts as empty."""
    return F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


def split_by_keys(docs: DataFrame, key: Column, keys: DataFrame, name: str, then: Callable | None = None, schema: str | None = None) -> tuple[DataFrame | None, DataFrame]:
    """``docs`` in two parts: rows whose ``key`` is surely not in the only column of ``keys``, and the few that may be, with ``name`` = key.

    Only the second part needs a join, so a decision about few rows does not shuffle the
    texts of all others. The filter that tells them apart is sized by the counted keys;
    where there are so many that one of FILTER_BITS would be full, there is no first part
    (None), and the join takes all rows. ``then`` is a step over Arrow batches that the first part
    goes through in the same Python worker; it gives ``schema``.
    """
    marked = docs.withColumn(name, key)
    n = keys.count()
    if 4 * n > FILTER_BITS:
        return None, marked
    prepare(docs.sparkSession)
    wanted = docs.sparkSession.sparkContext.broadcast(fixed_filter(keys.select(F.xxhash64(keys.columns[0]).alias("key")), filter_bits(n)))
    mark = free_names(marked, "mark")[0]
    hashed = marked.withColumn(mark, F.xxhash64(name))

    def part(inside: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = in_filter(wanted.value, b.column(b.num_columns - 1).to_numpy(zero_copy_only=False).view(np.uint64))
                yield b.filter(pa.array(found == inside)).select(list(range(b.num_columns - 1 - (not inside))))

        if then and not inside:
            return hashed.mapInArrow(lambda batches: then(run(batches)), schema)
        return hashed.mapInArrow(run, (marked if inside else docs).schema)

    return part(False), part(True)


# --- words ---------------------------------------------------------------------------------------


def _table(word: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    case = np.arange(256, dtype=np.uint8)
    if lower:
        case[65:91] += 32
    return word, case


_space = np.ones(256, bool)
_space[[32, 9, 10, 11, 12, 13]] = False
_alnum = np.zeros(256, bool)
_alnum[48:58] = _alnum[65:91] = _alnum[97:123] = _alnum[128:] = True
#: Words `[^\x20\x09-\x0D]+`, as they are and with A-Z lower-cased; words of letters, digits and what is not ASCII.
PLAIN, LOWER, ALNUM = _table(_space, False), _table(_space, True), _table(_alnum, True)

_BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
_powers: dict[tuple[int, str], np.ndarray] = {}
#: Longer words are hashed one by one: a polynomial modulo 2**64 has known collisions from 1024 letters.
_LONG = 512


def _power(base: int, n: int, kind: str = "up") -> np.ndarray:
    have = _powers.get((base, kind))
    if have is None or len(have) < n:
        b = base if kind == "up" else pow(base, -1, 1 << 64)
        size = 1 << max(12, int(n - 1).bit_length())
        have = np.full(size, b, np.uint64)
        have[0] = 1
        _powers[base, kind] = have = np.multiply.accumulate(have)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial of values[s:e] for each range, the same wherever the range stands."""
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * _power(base, n), out=sums[1:])
    return (sums[ends] - sums[starts]) * _power(base, n + 1, "down")[starts]


@dataclass
class Words:
    """Words of some rows: bytes, start and end of each word, first word of each row (one more at the end)."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        """Row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def hashes(self, which: int = 0) -> np.ndarray:
        if not len(self):
            return np.zeros(0, np.uint64)
        base = _BASES[which]
        raw = _ranges(self.data.astype(np.uint64) + np.uint64(1), self.starts, self.ends, base)
        size = (self.ends - self.starts).astype(np.uint64)
        out = mix(raw + size * np.uint64(0xD6E8FEB86659FD93))
        for i in np.flatnonzero(size > _LONG):
            out[i] = xxhash.xxh64_intdigest(self.data[self.starts[i] : self.ends[i]].tobytes(), seed=base & 0xFFFFFFFF)
        return out

    def shingles(self, hashes: np.ndarray, k: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of each run of ``k`` words within a row."""
        n = len(hashes)
        if n < k:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        last = np.repeat(self.first[1:], self.counts())
        at = np.flatnonzero(np.arange(n) + k <= last)
        return at, mix(_ranges(hashes, at, at + k, _BASES[which]) + np.uint64(k))

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def words_of(data: np.ndarray, offsets: np.ndarray, kind: tuple[np.ndarray, np.ndarray]) -> Words:
    """Split the bytes of some rows into words."""
    is_word, case = kind
    inside = is_word[data]
    begin, end = inside.copy(), inside.copy()
    if len(data):
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        full = offsets[:-1] < offsets[1:]
        head, tail = offsets[:-1][full], offsets[1:][full] - 1
        begin[head], end[tail] = inside[head], inside[tail]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return Words(case[data] if case[65] != 65 else data, starts, ends, np.searchsorted(starts, offsets).astype(np.int64))
