"""Impact of operational levers, swept over their whole range."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradegrain.functions.numeric import as_double, percent, ratio

# Lever ranges in half steps, and the impact coefficients.
MAX_DAYS_SAVED = 6.0
MAX_RETENTION_POINTS = 8.0
LEVER_STEP = 0.5
LATE_SAVED_PER_DAY = 0.022
ONE_STAR_PER_LATE = 0.58
SCORE_PER_DAY = 0.08
SCORE_PER_POINT = 0.02
SCORE_CAP = 0.65
REPEAT_SPEND_FACTOR = 1.35


def group_figures(master: DataFrame, by: list[str]) -> DataFrame:
    """Delivered orders, revenue and order value per group (all rows where nothing is delivered).

    Each group holds its delivered and other rows as two aggregates; the delivered one wins.
    """
    delivered = F.coalesce(F.col("order_status") == "delivered", F.lit(False))
    figures = master.groupBy(*by, delivered.alias("d")).agg(
        F.count_distinct("order_id").alias("total_orders"),
        as_double(F.sum("total_order_value")).alias("total_revenue"),
    )
    best = F.max_by(F.struct("total_orders", "total_revenue"), F.col("d")).alias("best")
    return figures.groupBy(*by).agg(best).select(
        *by, "best.*", F.coalesce(ratio(F.col("best.total_revenue"), F.col("best.total_orders")), F.lit(0.0)).alias("aov")
    )


def _range(top: float):
    return F.transform(F.sequence(F.lit(0), F.lit(round(top / LEVER_STEP))), lambda i: i.cast("double") * LEVER_STEP)


def sweep(figures: DataFrame) -> DataFrame:
    """Every group under every pair of lever settings."""
    levers = figures.withColumn("days_saved", F.explode(_range(MAX_DAYS_SAVED))).withColumn(
        "retention_points", F.explode(_range(MAX_RETENTION_POINTS))
    )
    return impact(levers)


def impact(levers: DataFrame) -> DataFrame:
    """Projected effect per row of ``total_orders, total_revenue, aov, days_saved, retention_points``."""
    orders = as_double("total_orders")
    days, points = F.col("days_saved"), F.col("retention_points")
    return (
        levers.withColumns(
            {
                "prevented_late_orders": F.floor(orders * (days * LATE_SAVED_PER_DAY)),
                "csat_lift": F.least(F.lit(SCORE_CAP), days * SCORE_PER_DAY + points * SCORE_PER_POINT),
                "additional_repeat_orders": F.floor(orders * (points / 100.0)),
            }
        )
        .withColumn("prevented_1_stars", F.floor(as_double("prevented_late_orders") * ONE_STAR_PER_LATE))
        .withColumn(
            "projected_revenue_gain", as_double("additional_repeat_orders") * F.col("aov") * REPEAT_SPEND_FACTOR
        )
        .withColumn("gain_pct", percent(F.col("projected_revenue_gain"), F.col("total_revenue")))
    )
