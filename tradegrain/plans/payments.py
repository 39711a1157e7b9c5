"""Payment channels and installment plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tradegrain.functions.numeric import as_double, mean, percent, round_even
from tradegrain.operators.grouping import complete

LONGEST_PLAN = 10


def _paid(master: DataFrame) -> DataFrame:
    return master.where(F.col("payment_type").isNotNull())


def channels(master: DataFrame) -> DataFrame:
    return (
        _paid(master)
        .groupBy("payment_type")
        .agg(
            F.count_distinct("order_id").alias("Orders"),
            as_double(F.sum("total_order_value")).alias("Total_Spend"),
            mean("total_order_value").alias("Avg_Ticket"),
            mean("payment_installments").alias("Avg_Installments"),
        )
        .orderBy(F.desc("Total_Spend"), "payment_type")
    )


def revenue_share(master: DataFrame) -> DataFrame:
    """Order value per payment type."""
    return _paid(master).groupBy("payment_type").agg(
        as_double(F.sum("total_order_value")).alias("total_order_value")
    )


def installment_plans(master: DataFrame) -> DataFrame:
    """Credit card orders per plan length 1..10, zero-filled, with the share of what is shown."""
    cards = master.where(F.col("payment_type") == "credit_card")
    as_number = F.col("payment_installments").try_cast("double")
    length = F.coalesce(as_number, F.lit(1.0)).cast("int")
    counted = cards.groupBy(length.alias("Installments")).agg(F.count(F.lit(1)).alias("orders"))
    spark = master.sparkSession
    lengths = spark.range(1, LONGEST_PLAN + 1).select(F.col("id").cast("int").alias("Installments"))
    shown = complete(lengths, counted, "Installments").select(
        "Installments",
        F.coalesce("orders", F.lit(0)).alias("Count"),
    )
    everything = F.greatest(F.lit(1), F.sum("Count").over(W.partitionBy()))  # ten rows
    return shown.select(
        "Installments",
        "Count",
        F.concat("Installments", F.lit("x")).alias("Label"),
        round_even(percent(F.col("Count"), everything), 1).alias("Pct"),
    ).orderBy("Installments")
