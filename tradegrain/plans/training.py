"""Fitting, evaluating, storing and loading the boosted-tree classifiers."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, partial, reduce

from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tradegrain import fixed
from tradegrain.functions.numeric import round_even
from tradegrain.operators.sampling import shuffled_positions, stratified_split
from tradegrain.plans.evaluation import ranking_metrics, threshold_metrics
from tradegrain.session import cut_lineage

SCORE = "probability_1"
_WEIGHT = "_weight"


@dataclass(frozen=True)
class Artifact:
    """A fitted pipeline with its feature list, hold-out metrics and feature importances, computed when first read."""

    model: PipelineModel
    features: list[str]
    metrics: DataFrame
    find_importances: Callable[[], DataFrame]

    @cached_property
    def importances(self) -> DataFrame:
        return self.find_importances()

    def score(self, df: DataFrame, name: str = SCORE) -> DataFrame:
        return score(self.model, df, name)

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(os.path.join(path, "model"))
        self.metrics.write.mode("overwrite").parquet(os.path.join(path, "metrics"))
        self.importances.write.mode("overwrite").parquet(os.path.join(path, "importances"))


def load_artifact(spark: SparkSession, path: str) -> Artifact:
    model = PipelineModel.load(os.path.join(path, "model"))
    importances = spark.read.parquet(os.path.join(path, "importances"))
    return Artifact(
        model,
        model.stages[0].getInputCols(),
        spark.read.parquet(os.path.join(path, "metrics")),
        lambda: importances,
    )


def load_or_train(spark: SparkSession, path: str, train: Callable[[], Artifact]) -> Artifact:
    """Read a stored artifact; train and store one when the path holds none."""
    try:
        spark.read.parquet(os.path.join(path, "importances"))
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        train().save(path)
    return load_artifact(spark, path)


def balance(df: DataFrame, label: str) -> DataFrame:
    """Weight rows so that every class counts the same: n / (classes * n_class)."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))  # two rows
    whole = W.partitionBy()
    share = F.sum("_n").over(whole) / (F.count(F.lit(1)).over(whole) * F.col("_n"))
    weights = sizes.select(label, share.cast("double").alias(_WEIGHT))
    return df.join(F.broadcast(weights), label)


def fit(
    train: DataFrame, features: list[str], label: str, rounds: int, step: float, depth: int = 5, seed: int = 42
) -> PipelineModel:
    assembler = VectorAssembler(inputCols=features, outputCol="features")
    trees = GBTClassifier(
        labelCol=label,
        featuresCol="features",
        weightCol=_WEIGHT,
        maxIter=rounds,
        stepSize=step,
        maxDepth=depth,
        seed=seed,
    )
    return Pipeline(stages=[assembler, trees]).fit(balance(train, label))


def score(model: PipelineModel, df: DataFrame, name: str = SCORE) -> DataFrame:
    """Add the probability of class 1."""
    scored = model.transform(df).withColumn(name, vector_to_array(F.col("probability"))[1])
    return scored.drop("features", "rawPrediction", "probability", "prediction")


def permutation_importance(
    model: PipelineModel,
    test: DataFrame,
    features: list[str],
    label: str,
    key: str,
    repeats: int = 5,
    floor: float = 0.0,
    seed: int = 42,
) -> DataFrame:
    """Share of the ROC-AUC lost when one feature's values are shuffled between rows.

    For each repeat, row i meets the row in position i of another hash order, which is a random
    permutation by an equi-join. Every feature is then replaced in turn by its partner's value, and
    all variants are scored and ranked together.
    """
    rows = shuffled_positions(test.select(key, label, *features), key, seed, "_row")

    def partners(repeat: int) -> DataFrame:
        taken = shuffled_positions(test.select(key, *features), key, seed + 1 + repeat, "_row")
        swapped = taken.select("_row", *[F.col(f).alias(f"_other_{f}") for f in features])
        return rows.join(swapped, "_row").withColumn("_repeat", F.lit(repeat))

    paired = reduce(DataFrame.unionByName, [partners(r) for r in range(repeats)])

    def variant(changed: str):
        values = [F.col(f"_other_{f}" if f == changed else f).alias(f) for f in features]
        return F.struct(F.lit(changed).alias("feature"), *values)

    shuffled = paired.select("_repeat", label, F.inline(F.array(*[variant(f) for f in features])))
    unchanged = rows.select(F.lit(-1).alias("_repeat"), label, F.lit("").alias("feature"), *features)
    scored = score(model, shuffled.unionByName(unchanged))
    aucs = ranking_metrics(scored, label, SCORE, by=("feature", "_repeat"))
    base = F.max(F.when(F.col("_repeat") == -1, F.col("roc_auc"))).over(W.partitionBy())
    drops = aucs.withColumn("_drop", base - F.col("roc_auc")).where(F.col("_repeat") >= 0)
    averaged = drops.groupBy("feature").agg(F.avg("_drop").alias("auc_drop"))
    kept = F.greatest(F.lit(floor), F.col("auc_drop"))
    whole = F.greatest(F.lit(1e-6), F.sum(kept).over(W.partitionBy()))  # one row per feature
    return averaged.select("feature", "auc_drop", round_even(kept / whole * 100.0, 1).alias("importance")).orderBy(
        F.desc("importance"), "feature"
    )


def rank_features(importances: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Features by importance, with readable names where given."""
    named = F.col("feature")
    if names:
        lookup = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
        named = F.coalesce(F.try_element_at(lookup, named), named)
    return importances.select(named.alias("feature"), "importance").orderBy(F.desc("importance"), "feature")


def train_classifier(
    name: str,
    table: DataFrame,
    features: list[str],
    label: str,
    key: str,
    rounds: int | None = None,
    repeats: int = 5,
    floor: float = 0.0,
) -> Artifact:
    """Split 80/20 per class, fit with balanced weights, evaluate at the model's threshold.

    The split table is stored once, because fitting and every evaluation read it again.
    """
    settings = fixed.MODEL_SETTINGS[name]
    split = cut_lineage(stratified_split(table.select(key, label, *features), key, label))
    train, test = split.where(~F.col("is_test")), split.where(F.col("is_test"))
    model = fit(train, features, label, rounds or settings["rounds"], settings["step"])
    scored = score(model, test).select(label, SCORE)
    at_threshold = threshold_metrics(scored, label, SCORE, settings["threshold"])
    ranked = ranking_metrics(scored, label, SCORE).select("roc_auc", "pr_auc")
    metrics = at_threshold.withColumn("model", F.lit(name)).join(ranked.withColumn("model", F.lit(name)), "model")
    find = partial(permutation_importance, model, test, features, label, key, repeats, floor)
    return Artifact(model, features, metrics, find)
