"""Language-model scores: a log-bilinear model over the two words before, trained by noise-contrastive estimation.

A word's probability is that of its class, given the two classes before, times its own in
the class, given the same. The most frequent words are classes of their own.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column_slices, discard, materialize, prepare

#: Words whose counts every executor holds; the others are joined.
HEAD = 1 << 17
#: Words that are classes of their own; other words fall into classes by their ending. Words
#: seen SEEN times or more have a vector in their class, up to HEAD of them.
OWN, SEEN = 1000, 10
#: Words with a vector that a class holds; the words of a fuller ending go to further classes.
FULL = 192
#: Length of vectors; noise words a batch of classes, and a word in a class; positions in the largest and the first batches; rounds of training, in the
#: last of which words learn their places in their classes.
DIM, NOISE, NOISE_IN, BATCH, LEAST_BATCH, ROUNDS = 16, 32, 1, 8192, 128, 2
#: Tokens of a shard. Shards are dealt by a hash of id and text, and each trains on its own from
#: the common model, so what is learnt does not depend on files, partitions or retries.
SHARD = 1 << 21
_FLUSH = 1 << 19
#: Bytes of text that are scored together: each class of a slice is one matrix product.
_SCORED = 3 << 20
_LN10 = float(np.log(10))


def held_out(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    """Whether crc32 of the id as text leaves ``fold``; a null id is for training."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def ending(word: bytes) -> int:
    """A number that words with equal last three bytes share."""
    return zlib.crc32(word[-3:])


def _split(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # bytes: A-Z only, and blanks \x20 \x09-\x0D only


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over the column ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()).cast(pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "c"])
            seen.clear()
            return batch

        for b in batches:
            for lo, hi, _, _ in column_slices(b.column(0)):
                for t in b.column(0).slice(lo, hi - lo).to_pylist():
                    seen.update(_split(t))
                if len(seen) > _FLUSH:
                    yield out()
        yield out()

    return docs.select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """The most frequent words, at most HEAD of them, and sums over all.

    A token is coded as a number: a word with a vector (``OWN`` classes first, then members
    of classes), the rest of a class, or the end. ``rank`` is the place in ``counts``.
    """

    index: dict[bytes, int]
    counts: np.ndarray
    own: int
    endings: int
    members: np.ndarray
    rest_count: np.ndarray
    rest_words: np.ndarray
    tokens: int
    distinct: int
    ends: int

    def __post_init__(self) -> None:
        """``members``: class (from 0) of each word with a vector behind the first ``own``; classes from ``endings`` on have no rest."""
        m, e = len(self.members), self.endings
        self.groups = max(e, int(self.members.max()) + 1 if m else 0)
        self.vectors = self.own + m
        self.end = self.vectors + e
        self.class_of = np.concatenate((np.arange(self.own), self.own + self.members, self.own + np.arange(e), [self.own + self.groups]))
        inside = np.concatenate((self.members, np.arange(e)))
        self.slots = np.argsort(inside, kind="stable")  # members and rests, class by class
        self.slot_of = np.empty(len(inside), np.int64)
        self.slot_of[self.slots] = np.arange(len(inside))
        self.class_at = np.searchsorted(inside[self.slots], np.arange(self.groups + 1))
        weight = np.concatenate((self.counts[self.own : self.vectors] + 1.0, self.rest_count + 1.0))[self.slots]
        self.slot_sum = np.cumsum(weight)
        whole = np.add.reduceat(weight, self.class_at[:-1]) if e else np.zeros(0)
        self.slot_share = weight / np.repeat(whole, np.diff(self.class_at))
        freq = np.ones(self.classes)
        freq[: self.own] += self.counts[: self.own]
        freq[self.own : -1] += whole
        freq[-1] += self.ends
        self.freq = freq / freq.sum()

    @property
    def classes(self) -> int:
        return self.own + self.groups + 1

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``counts`` or -1, token code) of each word."""
        at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        codes = at.copy()
        rest = np.flatnonzero((at < 0) | (at >= self.vectors))
        seen: dict[bytes, int] = {}
        e, base = self.endings, self.vectors
        for i in rest.tolist():
            tail = words[i][-3:]
            if (c := seen.get(tail)) is None:
                seen[tail] = c = base + zlib.crc32(tail) % e
            codes[i] = c
        return at, codes

    def stream(self, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Codes of documents one after the other, an end behind each."""
        out = np.full(len(codes) + len(sizes), self.end, np.int64)
        out[np.arange(len(codes)) + np.repeat(np.arange(len(sizes)), sizes)] = codes
        return out

    def contexts(self, stream: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(class, class before, second before) of each token of a stream; an end stands before each document."""
        w, end = self.class_of[stream], self.classes - 1
        one = np.append(end, w[:-1])
        two = np.where(one == end, end, np.append([end, end], w[:-2])[: len(w)])
        return w, one, two


def vocabulary(counts: DataFrame, n_docs: int, head: int = HEAD, own: int = OWN, seen: int = SEEN) -> tuple[Vocabulary, DataFrame]:
    """The vocabulary of a count table, and the table of the words that are not in its head."""
    band = F.floor(F.log2("c") * 8)
    bands = sorted(((r.band, r.n) for r in counts.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)  # fewer than 512
    cut, room = 1 << 20, head
    for b, n in bands:
        if n > room:
            break
        cut, room = b, room - n
    top = counts.where(band >= cut).toPandas().sort_values(["c", "word"], ascending=[False, True])
    words, c = [w.encode() for w in top["word"]], top["c"].to_numpy(np.int64)
    own = min(own, len(words))
    vectors = max(own, int((c >= seen).sum()))
    endings = 1 << min(10, max(7, ((vectors - own) // 128).bit_length()))
    tail3 = F.pmod(F.crc32(F.substring(F.col("word").cast("binary"), -3, 3)), F.lit(endings))
    rest, words_in = np.zeros(endings, np.int64), np.zeros(endings, np.int64)
    for r in counts.groupBy(tail3.alias("e")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect():
        rest[r.e], words_in[r.e] = r.c, r.n
    total, distinct = int(rest.sum()), int(words_in.sum())
    tails = np.array([ending(w) % endings for w in words[:vectors]], np.int64)
    np.subtract.at(rest, tails, c[:vectors])
    np.subtract.at(words_in, tails, 1)
    v = Vocabulary({w: i for i, w in enumerate(words)}, c, own, endings, spread_out(tails[own:], endings), rest, words_in, total + n_docs, distinct + (n_docs > 0), n_docs)
    return v, counts.where(band < cut)


def spread_out(tails: np.ndarray, endings: int, full: int = FULL) -> np.ndarray:
    """The class of each word with a vector: its ending's, or, beyond ``full`` words of one ending, further classes of as many, by frequency."""
    order = np.argsort(tails, kind="stable")
    begin = np.searchsorted(tails[order], np.arange(endings))
    turn = np.empty(len(tails), np.int64)
    turn[order] = (np.arange(len(tails)) - begin[tails[order]]) // full  # words come most frequent first
    more = np.maximum(np.bincount(tails, minlength=endings) - 1, 0) // full
    first = endings + np.cumsum(more) - more
    return np.where(turn > 0, first[tails] + turn - 1, tails)


def _step(p: np.ndarray, s: np.ndarray, g: np.ndarray, rate: float, n: int) -> None:
    """An Adagrad step by a gradient that is summed over ``n`` positions, in place; ``g`` is used up."""
    g *= n**-0.5
    s += g * g
    g *= rate / np.sqrt(s)
    p += g


def _less(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(x)), in place."""
    with np.errstate(over="ignore"):
        np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _sums(codes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct codes, sums of their rows)."""
    order = np.argsort(codes, kind="stable" if codes.itemsize == 2 else None)
    codes = codes.take(order)
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
    if 2 * len(first) < len(codes):
        return codes.take(first), np.add.reduceat(rows.take(order, axis=0), first, axis=0)
    out = rows.take(order.take(first), axis=0)  # most codes stand once or twice: add the second rows, the third, and so on
    size = np.diff(np.append(first, len(codes)))
    more, k = np.flatnonzero(size > 1), 1
    while 64 * len(more) > len(first):
        out[more] += rows.take(order.take(first.take(more) + k), axis=0)
        k += 1
        more = more[size.take(more) > k]
    for i in more.tolist():
        out[i] += rows.take(order[first[i] + k : first[i] + size[i]], axis=0).sum(0)
    return codes.take(first), out


@dataclass
class Model:
    """Vectors, one a row: of the class before and the one before that, of the class itself, of words in their classes (by slot); biases stand last in the latter two."""

    before: np.ndarray
    second: np.ndarray
    out: np.ndarray
    word: np.ndarray

    @classmethod
    def start(cls, v: Vocabulary, dim: int = DIM) -> Model:
        rng = np.random.default_rng(5)
        a, b, c = (rng.normal(0, 0.1, (v.classes, dim)).astype(np.float32) for _ in range(3))
        bias = lambda share: np.log(share).astype(np.float32)[:, None]
        return cls(a, b, np.hstack((c, bias(v.freq))), np.hstack((np.zeros((len(v.slots), dim), np.float32), bias(v.slot_share))))

    def parts(self) -> tuple[np.ndarray, ...]:
        return self.before, self.second, self.out, self.word

    def train(self, streams: Iterator[np.ndarray], v: Vocabulary, rate: float, seed: int, words: bool = True) -> int:
        """Noise-contrastive steps (Adagrad) over token streams, in place; returns the positions seen. ``words``: in classes too."""
        rng = np.random.default_rng(seed)
        size, dim, cum = v.classes, self.before.shape[1], np.cumsum(v.freq)
        log_noise = np.log(NOISE * v.freq).astype(np.float32)
        squares = [np.full(p.shape, 1e-3, np.float32) for p in self.parts()]
        seen = 0

        def push(p: np.ndarray, s: np.ndarray, codes: np.ndarray, rows: np.ndarray, step: float, n: int) -> None:
            used, g = _sums(codes, rows)
            part, square = p.take(used, axis=0), s.take(used, axis=0)
            _step(part, square, g, step, n)
            p[used], s[used] = part, square

        for tokens in streams:
            all_w, one, two = v.contexts(tokens)
            kind = np.int16 if size < 1 << 15 else np.int64  # few classes sort faster
            i = 0
            while i < len(tokens):
                size_now = min(BATCH, max(LEAST_BATCH, seen // 16))  # little text gives many small steps
                now = slice(i, i + size_now)
                w, c1, c2 = all_w[now], one[now], two[now]
                n = len(w)
                i += size_now
                noise = np.minimum(np.searchsorted(cum, rng.random(NOISE)), size - 1)
                q = np.ones((n, dim + 1), np.float32)  # a one stands where the bias is
                np.add(self.before.take(c1, axis=0), self.second.take(c2, axis=0), out=q[:, :dim])
                uw, un = self.out.take(w, axis=0), self.out.take(noise, axis=0)
                gain = _less(np.einsum("nd,nd->n", q, uw) - log_noise.take(w))
                loss = q @ -un.T
                loss += log_noise[noise]
                loss = _less(loss)
                if words:
                    self._within(tokens[now], q, v, 0.1, rng, push, squares[3])
                dq = uw * gain[:, None]
                dq -= loss @ un
                push(self.before, squares[0], c1.astype(kind), dq[:, :dim], rate, n)
                push(self.second, squares[1], c2.astype(kind), dq[:, :dim], rate, n)
                push(self.out, squares[2], np.append(w, noise).astype(kind), np.vstack((q * gain[:, None], -(loss.T @ q))), rate, n)
                seen += n
        return seen

    def _within(self, tokens: np.ndarray, q: np.ndarray, v: Vocabulary, rate: float, rng: np.random.Generator, push: Callable, squares: np.ndarray) -> None:
        """The step for words in their classes; noise comes from the same class."""
        hit = np.flatnonzero((tokens >= v.own) & (tokens < v.end))
        if not len(hit):
            return
        slot = v.slot_of[tokens[hit] - v.own]
        k = v.class_of[tokens[hit]] - v.own
        high = v.slot_sum[v.class_at[k + 1] - 1]
        low = np.where(v.class_at[k] > 0, v.slot_sum[v.class_at[k] - 1], 0.0)
        drawn = np.tile(low, NOISE_IN) + rng.random(len(hit) * NOISE_IN) * np.tile(high - low, NOISE_IN)
        order = np.argsort(drawn)
        noise = np.empty(len(drawn), np.int64)
        noise[order] = np.searchsorted(v.slot_sum, drawn.take(order), side="right")  # in order, which is kinder to caches
        slots = np.append(slot, np.minimum(noise, np.tile(v.class_at[k + 1] - 1, NOISE_IN))).astype(np.int32)
        own = q.take(np.tile(hit, NOISE_IN + 1), axis=0)
        z = np.log(NOISE_IN * v.slot_share.take(slots)).astype(np.float32)
        z -= np.einsum("nd,nd->n", own, self.word.take(slots, axis=0))
        up = -_less(z)
        up[: len(hit)] += 1
        own *= up[:, None]
        push(self.word, squares, slots, own, rate, len(tokens))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores by (class before, class) and (second before, class), and biases."""
        dim = self.before.shape[1]
        vectors = self.out[:, :dim].T
        return self.before @ vectors, self.second @ vectors, self.out[:, dim]

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What ``pairs`` gives, and the log normaliser of each context, by matrix products.

        The sum over w of exp(a[i, w] + b[j, w] + bias[w]) is a product of the matrices exp(a + bias) and exp(b).
        """
        one, two, bias = self.pairs()
        norm = np.empty(one.shape, np.float32)
        top2 = two.max(1)
        right = np.subtract(two.T, top2, dtype=np.float64)
        np.exp(right, out=right)
        for a in range(0, len(one), 256):
            left = (one[a : a + 256] + bias).astype(np.float64)
            top1 = left.max(1)
            norm[a : a + 256] = np.log(np.exp(left - top1[:, None]) @ right) + top1[:, None] + top2
        return one, two, bias, norm


def within(tokens: np.ndarray, one: np.ndarray, two: np.ndarray, v: Vocabulary, m: Model) -> np.ndarray:
    """Log probability of each token in its class, class by class in matrix products; 0 where a class is one word or the end."""
    out = np.zeros(len(tokens))
    hit = np.flatnonzero((tokens >= v.own) & (tokens < v.end))
    k = v.class_of[tokens[hit]] - v.own
    order = np.argsort(k, kind="stable")
    hit, k = hit[order], k[order]
    edges = np.searchsorted(k, np.arange(v.groups + 1))
    dim = m.before.shape[1]
    for c in np.flatnonzero(np.diff(edges)).tolist():
        span = slice(v.class_at[c], v.class_at[c + 1])
        for a in range(edges[c], edges[c + 1], BATCH):
            at = hit[a : min(a + BATCH, edges[c + 1])]
            z = (m.before.take(one[at], axis=0) + m.second.take(two[at], axis=0)) @ m.word[span, :dim].T
            z += m.word[span, dim]
            own = z[np.arange(len(at)), v.slot_of[tokens[at] - v.own] - v.class_at[c]]
            out[at] = own - np.log(np.exp(z, out=z).sum(1))
    return out


def _shards(train: DataFrame, v: Vocabulary) -> DataFrame:
    """A written table of token codes: one row a shard, or several where a shard is longer. ``train``: doc_id, text."""
    shared = train.sparkSession.sparkContext.broadcast(v)
    n = max(1, -(-v.tokens // SHARD))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for b in batches:
            for lo, hi, _, _ in column_slices(b.column(3)):
                docs = [_split(t) for t in b.column(3).slice(lo, hi - lo).to_pylist()]
                sizes = np.fromiter(map(len, docs), np.int64, len(docs))
                codes = v.stream(v.encode(list(chain.from_iterable(docs)))[1], sizes)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes + 1)), pa.int32()), pa.array(codes, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(lo, hi - lo) for i in range(3)), lists], ["shard", "doc_id", "key", "codes"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        now, size = None, 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.concatenate(held)], pa.list_(pa.int32()))], ["shard", "codes"])

        for b in batches:
            for shard, codes in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if held and (shard != now or size >= 2 * SHARD):
                    yield out()
                    held, size = [], 0
                now = shard
                held.append(codes.values.to_numpy())
                size += len(held[-1])
        if held:
            yield out()

    keyed = train.select(F.col("doc_id"), F.xxhash64("text").alias("key"), "text")
    keyed = keyed.select(F.pmod(F.xxhash64("doc_id", "key", F.lit("shard")), F.lit(n)).cast("int").alias("shard"), "doc_id", "key", "text")
    rows = keyed.mapInArrow(encode, "shard int, doc_id long, key long, codes array<int>")
    rows = rows.repartitionById(min(n, 2048), F.pmod("shard", F.lit(min(n, 2048)))).sortWithinPartitions("shard", "doc_id", "key").select("shard", "codes")
    return materialize(rows.mapInArrow(join, "shard int, codes array<int>"))


def _fit(train: DataFrame, v: Vocabulary, rounds: int = ROUNDS) -> Model:
    """Each shard trains on all its text from the common model; the models are averaged, weighted by text, on the executors."""
    context = train.sparkSession.sparkContext
    model = Model.start(v)
    if not v.tokens:
        return model
    shards = _shards(train, v)
    shared = context.broadcast(v)
    names = [f"v{i}" for i in range(DIM + 1)]
    classes = v.classes
    for k in range(rounds):
        now = context.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], now=now, k=k, last=k + 1 == rounds) -> Iterator[pa.RecordBatch]:
            v, total, n = shared.value, None, 0
            for b in batches:
                for shard, codes in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    own = Model(*(x.copy() for x in now.value.parts()))
                    tokens = codes.values.to_numpy().astype(np.int64)
                    pieces = (tokens[i : i + (1 << 17)] for i in range(0, len(tokens), 1 << 17))
                    size = own.train(pieces, v, 0.1 / (k + 1), shard * rounds + k, k + 1 == rounds)
                    each = [x.astype(np.float64) * size for x in own.parts()]
                    total = [t + x for t, x in zip(total, each, strict=True)] if total else each
                    n += size
            if n:  # a row for each vector: of classes, three kinds, then of words
                pad = [np.hstack((x, np.zeros((len(x), DIM + 1 - x.shape[1])))) for x in (total if last else total[:3])]
                rows = np.ascontiguousarray(np.vstack(pad).T)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(rows.shape[1]), pa.int32()), pa.array(np.full(rows.shape[1], float(n))), *map(pa.array, rows)], ["code", "n", *names])

        got = shards.select("shard", "codes").mapInArrow(run, "code int, n double, " + ", ".join(f"{c} double" for c in names))
        got = got.groupBy("code").agg(*((F.sum(c) / F.sum("n")).alias(c) for c in names)).toPandas().sort_values("code")
        x = got[names].to_numpy(np.float32)
        before, second, out = (np.ascontiguousarray(x[i * classes : (i + 1) * classes]) for i in range(3))
        word = np.ascontiguousarray(x[3 * classes :]) if k + 1 == rounds else model.word
        model = Model(*(np.ascontiguousarray(p[:, :DIM]) for p in (before, second)), out, word)
        del got, x
        now.destroy()
    shared.destroy()
    discard(shards)
    return model


def score(docs: DataFrame, folds: int = 7, fold: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of ``docs``.

    Tokens are the words of the text with A-Z lower-cased, and one end. Counts come from
    the documents that are not held out, all of them. ``base_score`` adds up
    log10((c + 1) / (N + V + 1)). ``score`` is log10 of the model's probability: a
    softmax over classes (frequent words, endings of the other words, the end) given the two
    classes before, times a softmax over the words of the class, which has one place for
    all words without a vector; such a word takes its smoothed share of it. So each
    context's probabilities add up to one, unseen words of a class together taking one more
    count. All words seen SEEN times have a vector, up to HEAD, so the model grows with the
    corpus to that bound. The scores of a corpus do not depend on how its rows are laid out.

    Executors hold at most HEAD counts; other words' counts are joined. Null counts as
    the empty text, which has an end only. Without training text both scores are of an
    untrained model. Other columns are ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    train = docs.where(~held_out(F.col("doc_id"), folds, fold))
    counts = materialize(word_counts(train))
    v, others = vocabulary(counts, train.count())
    model = _fit(train, v)
    shared, fitted = spark.sparkContext.broadcast(v), spark.sparkContext.broadcast((model, model.tables()[3]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, (model, norm) = shared.value, fitted.value
        by_one, by_two, bias = model.pairs()
        logs = np.concatenate((np.log10(v.counts + 1.0), [0.0]))
        den = np.log10(v.rest_count + v.rest_words + 1.0)
        end_log, all_log = np.log10(v.ends + 1.0), np.log10(v.tokens + v.distinct + 1.0)
        for b in batches:
            for lo, hi, _, _ in column_slices(b.column(1), _SCORED):
                docs_ = [_split(t) for t in b.column(1).slice(lo, hi - lo).to_pylist()]
                sizes = np.fromiter(map(len, docs_), np.int64, len(docs_))
                words = list(chain.from_iterable(docs_))
                at, codes = v.encode(words)
                tokens = v.stream(codes, sizes)
                w, c1, c2 = v.contexts(tokens)
                each = (by_one[c1, w] + by_two[c2, w] + bias[w] - norm[c1, c2]).astype(np.float64) + within(tokens, c1, c2, v, model)
                score = np.add.reduceat(each, np.cumsum(sizes + 1) - sizes - 1) / _LN10
                known = logs[at]  # the last entry, 0, stands for words outside the head
                place = np.append(0, np.cumsum(sizes))
                total = lambda x, place=place: np.diff(np.append(0.0, np.cumsum(x))[place])
                new = np.flatnonzero(at < 0)
                tails: list[Counter[bytes]] = [Counter() for _ in docs_]
                for d, i in zip((np.searchsorted(place, new, side="right") - 1).tolist(), new.tolist(), strict=True):
                    tails[d][words[i]] += 1
                tail = pa.StructArray.from_arrays([pa.array(list(chain.from_iterable(tails)), pa.binary()).cast(pa.string()), pa.array(list(chain.from_iterable(t.values() for t in tails)), pa.int32())], ["word", "tf"])
                offsets = pa.array(np.append(0, np.cumsum([len(t) for t in tails])).astype(np.int32))
                share = np.zeros(len(codes))
                rest = codes >= v.vectors
                share[rest] = known[rest] - den[codes[rest] - v.vectors]
                cols = [
                    pa.array(sizes + 1),
                    pa.array(total(at >= 0).astype(np.int64) + (v.ends > 0)),
                    pa.array(total(known) + end_log - (sizes + 1) * all_log),
                    pa.array(score + total(share)),
                    pa.ListArray.from_arrays(offsets, tail),
                ]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *cols], ["doc_id", "n_tokens", "n_known", "base", "model", "tail"])

    rows = docs.mapInArrow(run, "doc_id long, n_tokens long, n_known long, base double, model double, tail array<struct<word: string, tf: int>>")
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()))
    shared.destroy()
    fitted.destroy()
    tail = rows.where(F.size("tail") > 0).select("row", F.explode("tail").alias("t")).select("row", "t.word", "t.tf")
    more = tail.join(others, "word").groupBy("row").agg(F.sum(F.col("tf") * F.log10(F.col("c") + 1.0)).alias("logs"), F.sum("tf").alias("known"))
    none = F.lit(0)
    return rows.drop("tail").join(more, "row", "left").select(
        "doc_id",
        held_out(F.col("doc_id"), folds, fold).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", none)).alias("n_known"),
        F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("logs", none)).alias("base_score"),
        (F.col("model") + F.coalesce("logs", none)).alias("score"),
    )
