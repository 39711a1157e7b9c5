"""Exact classifier metrics as grouped aggregates; no score list ever leaves the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradegrain.functions.numeric import as_double, order_free_sum, percent, ratio
from tradegrain.operators.ordered import running_totals


def confusion(scored: DataFrame, label: str, score: str, threshold: float, by: tuple[str, ...] = ()) -> DataFrame:
    """True and false positives and negatives at a threshold, one pass."""
    actual, predicted = F.col(label) == 1, F.col(score) >= threshold
    return scored.groupBy(*by).agg(
        F.count_if(~actual & ~predicted).alias("tn"),
        F.count_if(~actual & predicted).alias("fp"),
        F.count_if(actual & ~predicted).alias("fn"),
        F.count_if(actual & predicted).alias("tp"),
    )


def threshold_metrics(scored: DataFrame, label: str, score: str, threshold: float) -> DataFrame:
    """Precision, recall, F1 and accuracy (0 where undefined), base rate and the confusion matrix."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    rows = tn + fp + fn + tp

    def or_zero(top, bottom):
        return F.coalesce(ratio(top, bottom), F.lit(0.0))

    return confusion(scored, label, score, threshold).select(
        or_zero(tp, tp + fp).alias("precision"),
        or_zero(tp, tp + fn).alias("recall"),
        or_zero(tp * 2, tp * 2 + fp + fn).alias("f1"),
        or_zero(tp + tn, rows).alias("accuracy"),
        percent(tp + fn, rows).alias("base_rate"),
        "tn",
        "fp",
        "fn",
        "tp",
        rows.alias("sample_size"),
    )


def confusion_shares(counts: DataFrame) -> DataFrame:
    """Confusion cells as rows with their percentage of the total."""
    cells = {"tn": (0, 0), "fp": (0, 1), "fn": (1, 0), "tp": (1, 1)}
    whole = F.greatest(F.lit(1), sum((F.col(c) for c in cells), F.lit(0)))
    rows = [
        F.struct(
            F.lit(actual).alias("actual"),
            F.lit(predicted).alias("predicted"),
            F.col(c).alias("orders"),
            percent(F.col(c), whole).alias("pct"),
        )
        for c, (actual, predicted) in cells.items()
    ]
    return counts.select(F.inline(F.array(*rows))).orderBy("actual", "predicted")


def ranking_metrics(scored: DataFrame, label: str, score: str, by: tuple[str, ...] = ()) -> DataFrame:
    """ROC-AUC (ties count half) and average precision (step sum) per group.

    Equal scores collapse to one row, then one pass of running counts from the highest score down
    gives both figures. Pair counts are exact decimals, since positives times negatives can pass 64 bits, and precisions
    are summed without regard to order, so both figures are the same over any partitions.
    """
    keys = list(by) or ["_all"]
    base = scored if by else scored.withColumn("_all", F.lit(0))
    tallied = base.groupBy(*keys, F.col(score).alias("_score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"),
        F.count_if(F.col(label) != 1).alias("neg"),
    )
    walked = running_totals(tallied, keys, [F.desc("_score")], {"hits": "pos", "misses": "neg"})
    above = F.col("hits") - F.col("pos")
    doubled_pairs = (above * 2 + F.col("pos")).cast("decimal(19,0)") * F.col("neg").cast("decimal(19,0)")
    precision = ratio(F.col("hits"), F.col("hits") + F.col("misses"))
    sums = walked.groupBy(*keys).agg(
        F.sum("pos").alias("positives"),
        F.sum("neg").alias("negatives"),
        F.sum(doubled_pairs).cast("double").alias("pairs"),
        order_free_sum(as_double("pos") * precision).alias("weighted"),
    )
    won = F.try_divide(F.col("pairs"), as_double("positives") * as_double("negatives") * 2.0)
    result = sums.select(
        *keys,
        won.alias("roc_auc"),
        ratio(F.col("weighted"), F.col("positives")).alias("pr_auc"),
        (F.col("positives") + F.col("negatives")).alias("sample_size"),
    )
    return result if by else result.drop("_all")
