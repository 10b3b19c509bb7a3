"""Feature tables, rebalancing, forests, grouped cross-validation and scores."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def feature_names(df: DataFrame, features: str = "features") -> list[str]:
    """L1: sorted names of all features; the dictionary of a model, so it must fit in one row of its metadata."""
    return [r.k for r in df.select(F.explode(F.map_keys(features)).alias("k")).distinct().orderBy("k").collect()]


def vectorise(df: DataFrame, names: list[str], features: str = "features") -> DataFrame:
    """L1, L2: ``x``, the values in the order of ``names``, 0 where missing; other features are dropped."""
    return df.withColumn("x", array_to_vector(F.transform(F.array(*map(F.lit, names)), lambda n: F.coalesce(F.element_at(features, n).cast("double"), F.lit(0.0)))))


def class_weights(df: DataFrame, label: str, boost: dict[str, float] | None = None) -> DataFrame:
    """(label, weight) = rows / (classes * rows of the class), times a class's boost."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("k"))
    factor = F.lit(1.0)
    for name, by in (boost or {}).items():
        factor = F.when(F.col(label) == name, by).otherwise(factor)
    return counts.join(F.broadcast(whole)).select(label, (F.col("all") / (F.col("k") * F.col("n")) * factor).alias("weight"))  # one row


def forest(train: DataFrame, label: str, trees: int = 100, leaf: int = 6, share: str = "0.1", seed: int = 1234, weight: str | None = None) -> PipelineModel:
    """L3: a random forest over ``x``; predictions come back as labels in ``predicted``."""
    index = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc").fit(train)
    rf = RandomForestClassifier(featuresCol="x", labelCol="_y", predictionCol="_p", numTrees=trees, minInstancesPerNode=leaf, featureSubsetStrategy=share, seed=seed)
    if weight:
        rf = rf.setWeightCol(weight)
    return Pipeline(stages=[index.setHandleInvalid("keep"), rf, IndexToString(inputCol="_p", outputCol="predicted", labels=index.labels)]).fit(train)


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """L6."""
    return model.transform(df)


def save(model: PipelineModel, path: str) -> None:
    """S21."""
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def smote(df: DataFrame, label: str, vector: str, key: str, k: int = 5, seed: int = 1234) -> DataFrame:
    """L4: (label, vector) of made-up rows that bring each class up to the largest one (Chawla et al. 2002).

    A class's rows are compared with each other within buckets of a random projection, so
    the work of a large class stays near linear; each row gives its share of the missing
    ones, between itself and a neighbour that a hash picks among its k nearest.
    """
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    most = counts.agg(F.max("n").alias("most"))
    need = counts.join(F.broadcast(most)).select(label, "n", (F.col("most") - F.col("n")).alias("missing"))  # one row
    project = lambda s: F.aggregate(F.transform(vector, lambda x, i: x * (F.pmod(F.xxhash64(i, F.lit(s)), F.lit(2001)) - 1000)), F.lit(0.0), lambda a, x: a + x)
    rows = df.select(label, key, vector).join(need, label)
    order = Window.partitionBy(label).orderBy(project(seed), key)
    placed = rows.withColumn("_place", F.row_number().over(order) - 1)
    small = placed.where("missing > 0").withColumn("_give", F.floor(F.col("missing") / F.col("n")) + (F.col("_place") < F.pmod("missing", "n")).cast("long"))
    near = Window.partitionBy(label).orderBy("_place")
    around = F.filter(F.collect_list(F.struct(F.col(key).alias("k"), F.col(vector).alias("v"))).over(near.rowsBetween(-4 * k, 4 * k)), lambda s: s["k"] != F.col(key))
    gap = lambda v: F.aggregate(F.zip_with(F.col(vector), v, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    best = F.slice(F.array_sort(F.transform(around, lambda s: F.struct(gap(s["v"]).alias("d"), s["k"].alias("k"), s["v"].alias("v")))), 1, k)
    made = small.withColumn("_near", best).where("size(_near) > 0 AND _give > 0").withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), "_give")))
    pick = F.get("_near", F.pmod(F.xxhash64(key, "_i", F.lit(seed)), F.size("_near")).cast("int"))["v"]
    t = F.pmod(F.xxhash64(key, "_i", F.lit(seed + 1)), F.lit(1_000_000)) / 1e6
    return made.select(label, F.zip_with(vector, pick, lambda a, b: a + (b - a) * t).alias(vector))


def grouped_folds(df: DataFrame, group: str, folds: int) -> DataFrame:
    """``fold`` by a hash of the group, so that a paper is never on both sides."""
    return df.withColumn("fold", F.pmod(F.xxhash64(group), F.lit(folds)))


def cross_validate(df: DataFrame, label: str, group: str, folds: int = 5, trees: int = 20, **forest_args) -> DataFrame:
    """The rows with ``predicted`` from the model that did not see their group. Leave-one-out is as many folds as groups."""
    parts = grouped_folds(df, group, folds)
    out = None
    for f in range(folds):
        test = parts.where(F.col("fold") == f)
        train = parts.where(F.col("fold") != f)
        if test.isEmpty() or train.isEmpty():
            continue
        got = materialize(predict(forest(train, label, trees, **forest_args), test).select(group, label, "predicted", "fold"))
        out = got if out is None else out.unionByName(got)
    return out


def confusion(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """(label, predicted, n)."""
    return df.groupBy(label, predicted).agg(F.count(F.lit(1)).alias("n"))


def class_scores(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """(class, precision, recall, f1, support); classes that are only predicted have support 0."""
    both = df.select(F.explode(F.array(F.struct(F.col(label).alias("c"), F.lit(1).alias("truth")), F.struct(F.col(predicted).alias("c"), F.lit(0).alias("truth")))).alias("s"), (F.col(label) == F.col(predicted)).cast("int").alias("ok"))
    got = both.groupBy(F.col("s.c").alias("class")).agg(F.sum(F.col("s.truth")).alias("support"), F.sum(1 - F.col("s.truth")).alias("given"), F.sum(F.when(F.col("s.truth") == 1, F.col("ok")).otherwise(0)).alias("hit"))
    part = lambda n, d: F.when(d > 0, n / d).otherwise(0.0)
    p, r = part(F.col("hit"), F.col("given")), part(F.col("hit"), F.col("support"))
    return got.select("class", p.alias("precision"), r.alias("recall"), part(2 * p * r, p + r).alias("f1"), "support")


def summary(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """One row: macro_f1 (unweighted), micro_f1 (accuracy)."""
    macro = class_scores(df, label, predicted).agg(F.avg("f1").alias("macro_f1"))
    micro = df.agg(F.avg((F.col(label) == F.col(predicted)).cast("double")).alias("micro_f1"))
    return macro.join(F.broadcast(micro))  # one row each
