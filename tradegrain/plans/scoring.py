"""Batch scoring: probabilities, tiers and advice on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradegrain import fixed
from tradegrain.functions.numeric import banded


def repeat_propensity(scored: DataFrame, probability: str) -> DataFrame:
    """Calibrated propensity (capped at 1) and its tier."""
    calibrated = F.least(F.lit(1.0), F.col(probability) * fixed.REPEAT_CALIBRATION)
    return scored.withColumn("propensity", calibrated).withColumn(
        "tier", banded(F.col("propensity"), fixed.REPEAT_TIERS)
    )


def delay_risk(scored: DataFrame, probability: str) -> DataFrame:
    return scored.withColumn("tier", banded(F.col(probability), fixed.DELAY_RISK_TIERS))


def csat_risk(scored: DataFrame, probability: str) -> DataFrame:
    return scored.withColumn("tier", banded(F.col(probability), fixed.CSAT_RISK_TIERS))


def order_advice(scored: DataFrame, probability: str) -> DataFrame:
    """Risk tier, expected satisfaction and the list of actions per order."""
    p = F.col(probability)
    rules = [
        ((F.col("is_interstate") == 1) & (p > 0.30), fixed.ADVICE_ROUTING),
        ((F.col("estimated_days") < 14) & (p > 0.35), fixed.ADVICE_SLA),
        (F.col("product_weight_g") > 6000, fixed.ADVICE_HEAVY),
    ]
    matched = F.array_compact(F.array(*[F.when(rule, text) for rule, text in rules]))
    advice = F.when(F.size(matched) > 0, matched).otherwise(F.array(F.lit(fixed.ADVICE_DEFAULT)))
    return scored.withColumns(
        {
            "tier": banded(p, fixed.ORDER_RISK_TIERS),
            "csat_note": banded(p, fixed.ORDER_RISK_NOTES),
            "recommendations": advice,
        }
    )
