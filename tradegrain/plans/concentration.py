"""Revenue concentration over product categories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tradegrain.functions.numeric import as_double, percent, round_even


def pareto(master: DataFrame) -> DataFrame:
    """Categories by revenue with running share; ``Is_Top_80`` tests the rounded running share."""
    revenue = (
        master.where(F.col("category_english").isNotNull())
        .groupBy(F.col("category_english").alias("Category"))
        .agg(F.coalesce(F.sum("total_order_value"), F.lit(0)).alias("amount"))
    )
    # Windows over aggregated rows only: one row per category.
    ranked = W.orderBy(F.desc("amount"), "Category").rowsBetween(W.unboundedPreceding, W.currentRow)
    running, whole = F.sum("amount").over(ranked), F.sum("amount").over(W.partitionBy())
    shares = revenue.select(
        "Category",
        as_double("amount").alias("Revenue"),
        running.cast("double").alias("Cumulative_Revenue"),
        round_even(percent(running, whole), 2).alias("Cumulative_Pct"),
        round_even(percent(F.col("amount"), whole), 2).alias("Revenue_Share_Pct"),
    )
    return shares.withColumn("Is_Top_80", F.col("Cumulative_Pct") <= 80.0).orderBy(F.desc("Revenue"), "Category")


def summary(shares: DataFrame) -> DataFrame:
    """How many categories carry 80% of revenue, their share of the catalog, and the leader."""
    top, everything = F.count_if("Is_Top_80"), F.count(F.lit(1))
    lead = F.min_by(F.struct("Category", "Revenue"), F.struct(-F.col("Revenue"), "Category"))
    return shares.agg(
        top.alias("top_80_categories"),
        everything.alias("total_categories"),
        F.coalesce(percent(top, everything), F.lit(0.0)).alias("top_80_pct"),
        (everything - top).alias("tail_categories"),
        lead.alias("lead"),
    ).select(
        "top_80_categories",
        "total_categories",
        "top_80_pct",
        "tail_categories",
        F.col("lead.Category").alias("top_category"),
        F.col("lead.Revenue").alias("top_category_revenue"),
    )


def head(shares: DataFrame, rows: int = 20) -> DataFrame:
    """The leading categories as the concentration curve shows them."""
    return shares.orderBy(F.desc("Revenue"), "Category").limit(rows)
