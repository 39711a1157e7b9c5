"""Data behind the dashboard charts that no other plan covers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradegrain.functions.numeric import as_double, mean
from tradegrain.operators.sampling import sample_exactly


def monthly(master: DataFrame) -> DataFrame:
    return (
        master.where(F.col("order_year_month").isNotNull())
        .groupBy("order_year_month")
        .agg(
            as_double(F.sum("total_order_value")).alias("Revenue"),
            F.count_distinct("order_id").alias("Orders"),
        )
        .orderBy("order_year_month")
    )


def top_states(master: DataFrame, rows: int = 10) -> DataFrame:
    """The states with most revenue, smallest of them first."""
    grouped = (
        master.where(F.col("customer_state").isNotNull())
        .groupBy("customer_state")
        .agg(
            as_double(F.sum("total_order_value")).alias("Revenue"),
            F.count_distinct("order_id").alias("Orders"),
            mean("freight_value").alias("Avg_Freight"),
        )
    )
    best = grouped.orderBy(F.desc("Revenue"), "customer_state").limit(rows)
    return best.orderBy("Revenue", F.desc("customer_state"))


def rfm_scatter(customers: DataFrame, points: int = 2000, seed: int = 42) -> DataFrame:
    """A fixed-size sample of scored customers for the scatter plot."""
    return sample_exactly(customers, "customer_unique_id", points, seed).select(
        "customer_unique_id", "recency", "frequency", "monetary", "Segment"
    )
