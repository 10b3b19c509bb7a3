"""Topic corpora and models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import LDA
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import discard, materialize, ship_package


def topic_contexts(sentences: DataFrame, citations: DataFrame) -> DataFrame:
    """(citation_id, citance, extended): lemmas of the citing sentence, and of all sentences of its subsection in order, scrubbed.

    sentences: (paper_id, section, subsection, sentence, lemmas array).
    """
    sub = sentences.groupBy("paper_id", "section", "subsection").agg(F.array_sort(F.collect_list(F.struct("sentence", "lemmas"))).alias("all"))
    line = lambda c: tx.scrub(F.lower(c))
    own = citations.join(sentences, ["paper_id", "section", "subsection", "sentence"]).select("citation_id", "paper_id", "section", "subsection", line(F.array_join("lemmas", " ")).alias("citance"))
    return own.join(sub, ["paper_id", "section", "subsection"]).select("citation_id", "citance", line(F.array_join(F.flatten(F.transform("all", lambda s: s["lemmas"])), " ")).alias("extended"))


def rare_and_common(words: DataFrame, common: int = 200, least: int = 2) -> DataFrame:
    """(word) to drop: the most frequent ``common`` ones (ties by word), and those below ``least`` occurrences. ``words``: one row per token."""
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), "word").limit(common).select("word")
    return top.unionByName(counts.where(F.col("n") < least).select("word")).distinct()


def trim(docs: DataFrame, common: int = 200, least: int = 2) -> DataFrame:
    """(id, words) without rare and common words, in order; DUMMY where none is left. ``docs``: id, words; each row gives one."""
    counts = materialize(docs.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    top = [r.word for r in counts.orderBy(F.desc("n"), "word").limit(common).collect()]  # ``common`` words at most
    rest = F.filter("words", lambda w: ~w.isin(top)) if top else F.col("words")
    own = docs.select("id", rest.alias("words")).withColumn("row", F.struct("id", F.xxhash64("words").alias("h")))
    rare = counts.where(F.col("n") < least).select("word")
    # rare words are joined, and gathered by row; frequent ones have gone before any shuffle, and word lists are never taken apart
    gone = own.select("row", F.explode(F.array_distinct("words")).alias("word")).join(rare, "word").groupBy("row").agg(F.collect_list("word").alias("gone"))
    left = F.filter("words", lambda w: F.coalesce(~F.array_contains("gone", w), F.lit(True)))
    out = own.join(gone, "row", "left").select("id", left.alias("words"))
    return out.withColumn("words", F.when(F.size("words") > 0, F.col("words")).otherwise(F.array(F.lit("DUMMY"))))


def fit_topics(docs: DataFrame, topics: int = 100, rounds: int = 50, vocabulary: int | None = None, seed: int = 7) -> PipelineModel:
    """Counts and latent Dirichlet allocation (variational) over ``words``; the vocabulary has all of them, unless its size is given.

    The model is one matrix of topics times words on the driver; ``document_topics`` has none.
    """
    if vocabulary is None:
        vocabulary = max(1, docs.select(F.explode("words").alias("w")).agg(F.countDistinct("w")).first()[0])
    return Pipeline(stages=[CountVectorizer(inputCol="words", outputCol="counts", vocabSize=vocabulary), LDA(k=topics, maxIter=rounds, seed=seed, featuresCol="counts", optimizer="online")]).fit(docs)


def infer_topics(model: PipelineModel, docs: DataFrame) -> DataFrame:
    """``topics``, the distribution of each document."""
    return model.transform(docs).withColumn("topics", vector_to_array("topicDistribution")).drop("counts", "topicDistribution")


def _digamma(x: np.ndarray) -> np.ndarray:
    y = x + 6
    f = 1 / (y * y)
    return np.log(y) - 0.5 / y - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132)))) - sum(1 / (x + i) for i in range(6))


def _trigamma(x: np.ndarray) -> np.ndarray:
    y = x + 6
    f = 1 / (y * y)
    return 1 / y + f / 2 + f / y * (1 / 6 - f * (1 / 30 - f * (1 / 42 - f / 30))) + sum(1 / (x + i) ** 2 for i in range(6))


def _expected(x: np.ndarray) -> np.ndarray:
    """Mean logarithms of a Dirichlet variable."""
    out = _digamma(np.append(x, x.sum()))
    return out[:-1] - out[-1]


def _first(words: np.ndarray, topics: int, seed: int) -> np.ndarray:
    """Start of each word's row, which depends on the word alone: nearly Gamma(100, 1/100), by Wilson and Hilferty."""

    def uniform(n: int) -> np.ndarray:
        z = words.astype(np.uint64)[:, None] + np.arange(1, topics + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((2 * seed + n) * 0xD1B54A32D192ED03 % (1 << 64))
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(by)
        return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / (1 << 53)

    normal = np.sqrt(-2 * np.log(1 - uniform(0))) * np.cos(2 * np.pi * uniform(1))
    return (1 - 1 / 900 + normal / 30) ** 3


def _packed(g: pa.ChunkedArray | pa.Array, topics: int) -> np.ndarray:
    return np.frombuffer(b"".join(g.to_pylist()), np.float32).reshape(-1, topics)


def _added(batches: Iterator[pa.RecordBatch], topics: int) -> Iterator[pa.RecordBatch]:
    """One row a word, from rows in the order of words."""
    last: tuple[np.ndarray, np.ndarray] | None = None
    out = lambda w, g: pa.RecordBatch.from_arrays([pa.array(w), pa.array([x.tobytes() for x in g], pa.binary())], names=["w", "g"])
    for batch in batches:
        if not len(batch):
            continue
        w, g = batch.column("w").to_numpy(), _packed(batch.column("g"), topics)
        if last is not None:
            w, g = np.concatenate([last[0], w]), np.concatenate([last[1], g])
        at = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
        w, g = w[at], np.add.reduceat(g, at, axis=0)
        last = w[-1:], g[-1:]
        if len(w) > 1:
            yield out(w[:-1], g[:-1])
    if last is not None:
        yield out(*last)


def document_topics(docs: DataFrame, topics: int = 100, rounds: int = 50, seed: int = 7, rate: float = 0.05, words_a_part: int = 200_000) -> DataFrame:
    """(id, topics) by online variational inference (Hoffman et al. 2010) as in ``fit_topics``, over all words and with no matrix on the driver.

    A round looks at a share ``rate`` of the documents. They are dealt to parts of about
    ``words_a_part`` words; a part is sent the rows of its own words, infers its documents and gives
    back what it adds to these rows. A row is its start, which is a function of the word, plus
    what was added; all rows shrink alike, which is one number. Additions are tables in the
    shared folder, summed up every eighth round. The driver keeps sums over words, a number a topic.
    Words are 64-bit hashes.
    """
    spark = docs.sparkSession
    ship_package(spark)
    kind = dict(docs.dtypes)["id"]
    rows = materialize(docs.select("id", F.transform("words", lambda w: F.xxhash64(w)).alias("ws")).withColumn("h", F.xxhash64("id", "ws")))
    drawn = F.filter(F.sequence(F.lit(1), F.lit(rounds)), lambda r: F.pmod(F.xxhash64("h", r, F.lit(seed)), F.lit(1_000_000)) < int(rate * 1_000_000))
    batches = materialize(rows.where("size(ws) > 0").withColumn("r", F.explode(drawn)).repartition("r").sortWithinPartitions("r"))
    sizes = {x.r: (x.n, x.words) for x in batches.groupBy("r").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("ws")).alias("words")).collect()}  # a row a round
    corpus, tokens = rows.where("size(ws) > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("ws")), F.lit(0))).first()

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(topics)
        for batch in batches:
            n += len(batch)
            for low in range(0, len(batch), 4096):
                total += _first(batch.column("w").to_numpy()[low : low + 4096], topics, seed).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"i": np.arange(topics, dtype=np.int32), "v": total, "n": np.full(topics, n)})

    found = rows.select(F.explode("ws").alias("w")).distinct().mapInArrow(starts, "i int, v double, n long").groupBy("i").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).orderBy("i").collect()
    size, total = (found[0].n, np.array([x.v for x in found])) if found else (0, np.ones(topics))
    eta, alpha, left = 1.0 / topics, np.full(topics, 1.0 / topics), 1.0

    def infer(mine: DataFrame, words: int, model: DataFrame, schema: str, scale: float = 0.0) -> DataFrame:
        """``mine`` in parts with the rows of their words; additions for the model if ``scale`` is not 0, else topics."""
        parts = max(1, -(-words // words_a_part), min(spark.sparkContext.defaultParallelism, -(-words // 20_000)))
        mine = mine.select(F.pmod(F.xxhash64("h", F.lit(seed + 1)), F.lit(parts)).alias("part"), "id", "ws")
        wanted = mine.select(F.col("part").alias("to"), F.explode("ws").alias("w")).distinct()
        held = wanted.join(model.select("w", "g"), "w").select("to", "w", "g")
        shrunk, prior, base = left, alpha, _digamma(total)

        def run(texts: pa.Table, known: pa.Table) -> pa.Table:
            lists = [x.values.to_numpy(zero_copy_only=False) for x in texts.column("ws")]
            vocabulary = np.unique(np.concatenate([*lists, np.zeros(0, np.int64)]))
            beta = np.zeros((len(vocabulary), topics), np.float32)
            at = np.searchsorted(vocabulary, known.column("w").to_numpy())
            low = 0
            for chunk in known.column("g").chunks:
                np.add.at(beta, at[low : low + len(chunk)], _packed(chunk, topics))
                low += len(chunk)
            for low in range(0, len(vocabulary), 4096):
                row = shrunk * (_first(vocabulary[low : low + 4096], topics, seed) + beta[low : low + 4096]) + eta * (1 - shrunk)
                beta[low : low + 4096] = np.exp(_digamma(row) - base)
            gain, logs, out = np.zeros_like(beta) if scale else None, np.zeros(topics), []
            for ws in lists:
                if not len(ws):
                    out.append(np.zeros(topics))
                    continue
                own, n = np.unique(ws, return_counts=True)
                own = np.searchsorted(vocabulary, own)
                b, gamma = beta[own].astype(float), np.ones(topics)
                weight = np.exp(_expected(gamma))
                for _ in range(1000):
                    was = gamma
                    gamma = weight * ((n / (b @ weight + 1e-100)) @ b) + prior
                    mean = _expected(gamma)
                    weight = np.exp(mean)
                    if np.abs(gamma - was).mean() <= 1e-3:
                        break
                if scale:
                    gain[own] += np.outer(n / (b @ weight + 1e-100), weight)
                    logs += mean
                else:
                    out.append(gamma / gamma.sum())
            if not scale:
                return pa.table([texts.column("id"), pa.array([x.tolist() for x in out], pa.list_(pa.float64()))], names=["id", "topics"])
            gain *= beta
            gain *= scale
            sums = np.concatenate([gain.sum(axis=0, dtype=float), logs])
            return pa.table([pa.array([*vocabulary.tolist(), None], pa.int64()), pa.array([*(x.tobytes() for x in gain), None], pa.binary()), pa.array([None] * len(vocabulary) + [sums.tobytes()], pa.binary())], names=["w", "g", "s"])

        return mine.groupBy("part").cogroup(held.groupBy("to")).applyInArrow(run, schema)

    written: list[DataFrame] = []
    empty = spark.createDataFrame([], "w long, g binary")

    def model() -> DataFrame:
        out = empty
        for x in written:
            out = out.unionByName(x.where("w IS NOT NULL").select("w", "g"))
        return out

    for r in range(1, rounds + 1):
        n, words = sizes.get(r, (0, 0))
        if not n:
            continue
        step = (1024 + r) ** -0.51
        after = left * (1 - step)
        added = materialize(infer(batches.where(F.col("r") == r), words, model(), "w long, g binary, s binary", step / after * corpus / n))
        both = sum((np.frombuffer(x.s) for x in added.where("s IS NOT NULL").select("s").collect()), np.zeros(2 * topics))  # two numbers a topic of each part
        total = (1 - step) * total + step * eta * size + after * both[:topics]
        left = after
        grad, c, q = n * (both[topics:] / n - _expected(alpha)), n * _trigamma(np.array([alpha.sum()])), -n * _trigamma(alpha)
        moved = alpha - step * (grad - (grad / q).sum() / (1 / c + (1 / q).sum())) / q
        alpha = moved if (moved > 0).all() else alpha
        written.append(added)
        if len(written) == 8:
            one = materialize(model().repartition("w").sortWithinPartitions("w").mapInArrow(lambda b: _added(b, topics), "w long, g binary"))
            discard(*written)
            written = [one]
    discard(batches)
    return infer(rows, tokens, model(), f"id {kind}, topics array<double>")


def top_words(model: PipelineModel, n: int = 100) -> DataFrame:
    """(topic, words, termWeights): the ``n`` words of each topic with the greatest weight."""
    vocab = model.stages[0].vocabulary
    found = model.stages[1].describeTopics(n).collect()  # topics times n numbers
    rows = [(r.topic, [vocab[i] for i in r.termIndices], list(r.termWeights)) for r in found]
    return SparkSession.active().createDataFrame(rows, "topic int, words array<string>, termWeights array<double>")


def paper_topics(topics: DataFrame) -> DataFrame:
    """Mean topic vector of each paper's citations."""
    parts = topics.select("paper_id", F.posexplode("topics").alias("i", "p")).groupBy("paper_id", "i").agg(F.avg("p").alias("p"))
    return parts.groupBy("paper_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "p"))), lambda s: s["p"]).alias("topics"))


def first_per_key(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key in an explicit order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
