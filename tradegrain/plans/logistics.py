"""Delivery performance against satisfaction and region."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradegrain import fixed
from tradegrain.functions.numeric import as_double, mean, percent, round_even, tiered
from tradegrain.functions.temporal import mean_elapsed
from tradegrain.operators.grouping import complete, labelled


def _rated_deliveries(master: DataFrame) -> DataFrame:
    return master.na.drop(subset=["delivery_delay_days", "review_score"])


def star_percent(stars: int):
    """Share of rows with exactly this mean score; a mixed order (say 1.5) does not count."""
    return percent(F.count_if(F.col("review_score") == stars), F.count(F.lit(1)))


def delay_buckets(master: DataFrame) -> DataFrame:
    """Scores per delay bucket; all five buckets appear, in order, measured or not."""
    bucket = tiered(F.col("delivery_delay_days"), fixed.DELAY_BOUNDS, fixed.DELAY_BUCKETS)
    measured = (
        _rated_deliveries(master)
        .groupBy(bucket.alias("Delay_Bucket"))
        .agg(
            F.count_distinct("order_id").alias("Order_Count"),
            round_even(mean("review_score"), 2).alias("Avg_Review_Score"),
            round_even(star_percent(1), 1).alias("Pct_1_Star"),
            round_even(star_percent(5), 1).alias("Pct_5_Star"),
        )
    )
    buckets = labelled(master.sparkSession, "Delay_Bucket", fixed.DELAY_BUCKETS)
    return complete(buckets, measured, "Delay_Bucket").orderBy("position").drop("position")


def by_state(master: DataFrame) -> DataFrame:
    transit = mean_elapsed(F.col("order_delivered_customer_date"), F.col("order_purchase_timestamp"))
    return (
        _rated_deliveries(master)
        .where(F.col("customer_state").isNotNull())
        .groupBy("customer_state")
        .agg(
            F.count_distinct("order_id").alias("Total_Orders"),
            round_even(as_double(F.sum("total_order_value")), 2).alias("Total_Revenue"),
            round_even(transit, 1).alias("Avg_Delivery_Days"),
            round_even(percent(F.count_if("is_late"), F.count("is_late")), 1).alias("Late_Delivery_Pct"),
            round_even(mean("freight_value"), 2).alias("Avg_Freight_Cost"),
            round_even(mean("review_score"), 2).alias("Avg_Review_Score"),
        )
        .orderBy(F.desc("Total_Revenue"), "customer_state")
    )
