"""Recency, frequency and monetary scores per real customer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tradegrain import fixed
from tradegrain.functions.numeric import as_double, mean, percent, round_even
from tradegrain.functions.temporal import days_floored
from tradegrain.operators.selection import quartiles
from tradegrain.session import cut_lineage


def customer_base(master: DataFrame) -> DataFrame:
    """Days since the last order (counted from the day after the newest one), orders, spend.

    The per-customer table is stored once, as both the newest order and every row are read from it.
    """
    valid = master.where(
        F.col("order_purchase_timestamp").isNotNull() & F.col("customer_unique_id").isNotNull()
    )
    per_customer = cut_lineage(
        valid.groupBy("customer_unique_id").agg(
            F.max("order_purchase_timestamp").alias("last_order"),
            F.count_distinct("order_id").alias("frequency"),
            F.sum("total_order_value").alias("monetary"),
        )
    )
    newest = per_customer.agg(F.max("last_order") + F.expr("INTERVAL '1' DAY")).scalar()
    return per_customer.select(
        "customer_unique_id",
        days_floored(newest, F.col("last_order")).alias("recency"),
        "frequency",
        "monetary",
    )


def score(base: DataFrame) -> DataFrame:
    """R, F and M scores. Rank ties break by customer id, as a stable rank of sorted groups does.

    The quartile edges are found by selection, so no customer is sorted and the base stays where it is stored.
    """
    n = base.count()
    orders = F.col("frequency")
    scored = base.select(
        "customer_unique_id",
        "recency",
        "frequency",
        "monetary",
        (5 - quartiles(base, "recency", "customer_unique_id", n)).cast("int").alias("R_score"),
        quartiles(base, "monetary", "customer_unique_id", n).alias("M_score"),
        F.when(orders >= 3, 4).when(orders == 2, 3).otherwise(2).alias("F_score"),
    )
    return scored.withColumn("RFM_Score", F.concat("R_score", "F_score", "M_score"))


def label(scored: DataFrame) -> DataFrame:
    """Segment per customer; the first matching rule wins."""
    r, f, m = F.col("R_score"), F.col("F_score"), F.col("M_score")
    rules = [
        ("Champions", (r >= 3) & (f >= 3) & (m >= 3)),
        ("Loyal Customers", (r >= 2) & (f >= 3)),
        ("Potential Loyalists", (r >= 3) & (f == 2) & (m >= 3)),
        ("Recent Buyers", (r >= 3) & (f == 2)),
        ("At Risk", f >= 3),
        ("Cant Lose Them", (f == 2) & (m >= 3)),
        ("Hibernating", f == 2),
    ]
    chosen = F.coalesce(*[F.when(rule, name) for name, rule in rules], F.lit("Lost / Inactive"))
    return scored.withColumn("Segment", chosen)


def customers(master: DataFrame) -> DataFrame:
    return label(score(customer_base(master)))


def segments(labelled: DataFrame) -> DataFrame:
    """One row per segment with its share of customers and revenue and its playbook."""
    grouped = labelled.groupBy("Segment").agg(
        F.count("customer_unique_id").alias("Customer_Count"),
        round_even(mean("recency"), 0).alias("Avg_Recency"),
        mean("frequency").alias("Avg_Frequency"),
        round_even(mean("monetary"), 2).alias("Avg_Spend"),
        F.sum("monetary").alias("revenue"),
    )
    everyone = W.partitionBy()  # at most eight segments
    playbook = F.create_map(*[F.lit(x) for pair in fixed.PLAYBOOK.items() for x in pair])
    return grouped.select(
        "Segment",
        "Customer_Count",
        "Avg_Recency",
        "Avg_Frequency",
        "Avg_Spend",
        round_even(as_double("revenue"), 2).alias("Total_Revenue"),
        round_even(percent(F.col("Customer_Count"), F.sum("Customer_Count").over(everyone)), 1).alias("Customer_Pct"),
        round_even(percent(F.col("revenue"), F.sum("revenue").over(everyone)), 1).alias("Revenue_Pct"),
        F.coalesce(F.try_element_at(playbook, F.col("Segment")), F.lit(fixed.PLAYBOOK_DEFAULT)).alias(
            "Strategic_Action"
        ),
    ).orderBy(F.desc("Total_Revenue"), "Segment")
