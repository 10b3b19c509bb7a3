"""Quality scores by positive-unlabelled learning with the non-negative risk (Kiryo et al. 2017)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import PLAIN, column_slices, materialize, prepare, words_of

#: Most rows of either kind that the classifier is fitted on.
SAMPLE = 20_000
_GROUPS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " ", "\n", ".,;:", "|", "!?", "#$%&*", "\"'()[]{}<>/\\=+-_@~^`")
_CLASS = np.full(256, len(_GROUPS), np.int64)
_CLASS[128:] = len(_GROUPS) + 1
for _i, _g in enumerate(_GROUPS):
    _CLASS[[ord(c) for c in _g]] = _i
_KINDS = len(_GROUPS) + 2
FEATURES = _KINDS + 9


def held_out(doc_id: Column, folds: int = 3, fold: int = 1) -> Column:
    """Whether crc32 of the id as text leaves ``fold``; a null id is for training."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def _distinct(rows: np.ndarray, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row's keys: how many differ, and how often the most frequent one occurs."""
    order = np.lexsort((keys, rows))
    r, k = rows[order], keys[order]
    head = np.concatenate(([True], (r[1:] != r[:-1]) | (k[1:] != k[:-1]))) if len(r) else np.zeros(0, bool)
    at = np.flatnonzero(head)
    runs = np.diff(np.append(at, len(r)))
    most = np.zeros(n, np.int64)
    np.maximum.at(most, r[at], runs)
    return np.bincount(r[at], minlength=n), most


def features_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Shape of each text: shares of kinds of bytes, word lengths, repetition of words, runs and lines."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    row_of = np.repeat(np.arange(n), size)
    kinds = np.bincount(row_of * _KINDS + _CLASS[data], minlength=n * _KINDS).reshape(n, _KINDS) / np.maximum(size, 1)[:, None]
    w = words_of(data, offsets, PLAIN)
    count, rows, h = w.counts(), w.rows(), w.hashes()
    some = np.maximum(count, 1)
    length = w.ends - w.starts
    mean = np.bincount(rows, length, n) / some
    spread = np.sqrt(np.maximum(np.bincount(rows, length.astype(float) ** 2, n) / some - mean**2, 0))
    differ, most = _distinct(rows, h, n)
    at, threes = w.shingles(h, 3)
    differ3, _ = _distinct(rows[at], threes, n)
    again = np.bincount(rows[1:], (h[1:] == h[:-1]) & (rows[1:] == rows[:-1]), n) if len(h) > 1 else np.zeros(n)
    lines = np.bincount(row_of, data == 10, n) if len(data) else np.zeros(n)
    more = [np.log1p(size), np.log1p(count), mean, spread, differ / some, most / some, np.where(count > 2, differ3 / np.maximum(count - 2, 1), 1), again / some, np.log1p(count / (lines + 1))]
    return np.column_stack([np.sqrt(kinds), *more]).astype(np.float32)


def feature_table(docs: DataFrame) -> DataFrame:
    """(doc_id, x) for each row of ``docs``."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offs in column_slices(b.column(1)):
                x = features_of(data, offs)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, FEATURES), pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), lists], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, x array<float>")


@dataclass
class Classifier:
    """A network with one hidden layer; its output is a log odds ratio."""

    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]

    def odds(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        return np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ a + b) @ c + d[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.odds(x.astype(np.float64)), -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 16, steps: int = 1500, batch: int = 1024, rate: float = 0.01, plain: bool = False) -> Classifier:
    """Minimise prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)]) with the logistic loss l, by Adam.

    Where the second term of a batch is negative, the step goes back up on it instead, as
    in the method's large-scale form. Without positives every score is the prior.
    ``plain`` tells positives from unlabelled rows instead, without a correction.
    """
    both = np.vstack([positive, unlabelled]) if len(unlabelled) else positive
    width = positive.shape[1]
    mean = both.mean(0) if len(both) else np.zeros(width)
    scale = both.std(0) + 1e-3 if len(both) else np.ones(width)
    rng = np.random.default_rng(11)
    ws = [rng.normal(0, width**-0.5, (width, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.array([np.log(prior / (1 - prior))])]
    model = Classifier(mean, scale, ws)
    if not len(positive) or not len(unlabelled):
        ws[2][:] = 0
        return model
    p_all, u_all = (np.clip((x - mean) / scale, -8, 8) for x in (positive, unlabelled))
    m, v = [np.zeros_like(w) for w in ws], [np.zeros_like(w) for w in ws]
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, steps + 1):
        p, u = p_all[rng.integers(len(p_all), size=batch)], u_all[rng.integers(len(u_all), size=batch)]
        x = np.vstack([p, u])
        z = np.tanh(x @ ws[0] + ws[1])
        g = z @ ws[2] + ws[3][0]
        gp, gu = g[:batch], g[batch:]
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        up, down = np.concatenate([prior * (sig(gp) - 1), np.zeros(batch)]), np.concatenate([-prior * sig(gp), sig(gu)])
        dg = (up + down if negative >= 0 else -down) / batch
        if plain:
            dg = np.concatenate([sig(gp) - 1, sig(gu)]) / batch
        dz = np.outer(dg, ws[2]) * (1 - z * z)
        grads = [x.T @ dz + 1e-4 * ws[0], dz.sum(0), z.T @ dg + 1e-4 * ws[2], np.array([dg.sum()])]
        lr = rate * min(1.0, 2 * (1 - t / (steps + 1)))
        for w, d, a, b in zip(ws, grads, m, v, strict=True):
            a *= 0.9
            a += 0.1 * d
            b *= 0.999
            b += 0.001 * d * d
            w -= lr * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
    return model


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1) -> float:
    """Share of positives among unlabelled rows, by best bin estimation (Garg et al. 2021).

    A classifier tells one half of the positives from one half of the unlabelled rows. In
    the other halves, the part of each that scores above a threshold is compared: above a
    threshold that only positives pass, unlabelled rows over positives is the share. The
    threshold is the one with the least upper confidence bound of that ratio. Kept between
    0.02 and 0.98; 0.5 where either kind has fewer than 20 rows.
    """
    if min(len(positive), len(unlabelled)) < 20:
        return 0.5
    model = fit(positive[::2], unlabelled[::2], 0.5, steps=600, plain=True)
    p, u = np.sort(model.score(positive[1::2])), np.sort(model.score(unlabelled[1::2]))
    above = lambda x: 1 - np.searchsorted(x, p) / len(x)
    share_p, share_u = above(p), above(u)
    slack = np.sqrt(np.log(4 / delta) / 2) * (len(u) ** -0.5 + len(p) ** -0.5)
    best = np.argmin((share_u + slack) / share_p)
    return float(min(0.98, max(0.02, share_u[best] / share_p[best])))


def learn(table: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1, sample: int = SAMPLE) -> Classifier:
    """Fit on a feature table: positives are labelled 1 in the training folds, unlabelled rows are any of those folds.

    The class prior is estimated from these two alone; labels 0 are not used. At most about
    ``sample`` rows of either kind, chosen by a hash of the id and the features, are used. A
    row with several labels has the least one.
    """
    mark = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~held_out(F.col("doc_id"), folds, fold)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") == 1).alias("good"))
    good = mark.where("good")
    width = FEATURES

    def some(df: DataFrame, have: int) -> np.ndarray:
        share = min(1.0, sample / max(have, 1))
        keep = F.pmod(F.xxhash64("doc_id", "x", F.lit("sample")), F.lit(1_000_000)) < int(share * 1_000_000)
        got = df.where(keep).select("doc_id", "x").toPandas()
        rows = np.array(got["x"].tolist(), np.float64).reshape(-1, width)
        return rows[np.lexsort((*rows.T, got["doc_id"].to_numpy(np.float64)))] if len(rows) else rows

    usable = table.where(~held_out(F.col("doc_id"), folds, fold))
    positive, unlabelled = some(usable.join(good, "doc_id", "left_semi"), good.count()), some(usable, usable.count())
    return fit(positive, unlabelled, estimate_prior(positive, unlabelled))


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from 0.5) for each row of ``docs``.

    Only the shape of the whole text enters a score. Null and empty texts are scored like
    any other, on features of nothing. Rows of ``docs`` keep their number whatever their
    ids. Without usable labels every score is the prior, 0.5. Other columns are ignored.
    """
    table = materialize(feature_table(docs))
    model = docs.sparkSession.sparkContext.broadcast(learn(table, labels, folds, fold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.value.score(x))], ["doc_id", "score"])

    out = table.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score at least ``threshold``."""
    prepare(docs.sparkSession)
    table = materialize(feature_table(docs))
    model = docs.sparkSession.sparkContext.broadcast(learn(table, labels, folds, fold))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [model.value.score(features_of(data, offs)) for _, _, data, offs in column_slices(b.column(place))]
            if scores:
                yield b.filter(pa.array(np.concatenate(scores) >= threshold))

    return docs.mapInArrow(run, docs.schema)
