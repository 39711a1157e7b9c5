"""Headline figures of the executive summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tradegrain.functions.numeric import percent, ratio
from tradegrain.functions.temporal import elapsed_seconds

# Everything is grouped by "is delivered" first. If any order is delivered that group is the answer;
# if none is, the other group holds all rows. Picking the top group covers both without a second scan.
_SCOPE = "_delivered"

# The master columns these figures read.
COLUMNS = [
    "order_id",
    "customer_unique_id",
    "order_status",
    "order_purchase_timestamp",
    "order_delivered_customer_date",
    "order_year_month",
    "is_late",
    "review_score",
    "price",
    "freight_value",
    "total_order_value",
]


def _scoped(master: DataFrame) -> DataFrame:
    delivered = F.coalesce(F.col("order_status") == "delivered", F.lit(False))
    return master.withColumn(_SCOPE, delivered)


def _top_scope(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc(_SCOPE)).limit(1).drop(_SCOPE)


def _money_and_orders(scoped: DataFrame) -> DataFrame:
    """Sums and means through one order-grain pre-aggregate, so no distinct count expands rows."""
    days = elapsed_seconds(F.col("order_delivered_customer_date"), F.col("order_purchase_timestamp"))
    per_order = scoped.groupBy(_SCOPE, "order_id").agg(
        F.max("is_late").alias("late"),
        F.sum("total_order_value").alias("value"),
        F.sum("price").alias("product"),
        F.sum("freight_value").alias("freight"),
        F.sum("review_score").alias("score_sum"),
        F.count("review_score").alias("score_rows"),
        F.sum(days).alias("transit_sum"),
        F.count(days).alias("transit_rows"),
    )
    return per_order.groupBy(_SCOPE).agg(
        F.count("order_id").alias("orders"),
        F.count_if(F.col("late") & F.col("order_id").isNotNull()).alias("late_orders"),
        *[F.sum(c).alias(c) for c in ("value", "product", "freight")],
        *[F.sum(c).alias(c) for c in ("score_sum", "score_rows", "transit_sum", "transit_rows")],
    )


def _buyers(scoped: DataFrame) -> DataFrame:
    per_customer = (
        scoped.where(F.col("customer_unique_id").isNotNull())
        .groupBy(_SCOPE, "customer_unique_id")
        .agg(F.count_distinct("order_id").alias("n"))
    )
    return per_customer.groupBy(_SCOPE).agg(
        F.count(F.lit(1)).alias("unique_customers"),
        F.count_if(F.col("n") > 1).alias("repeat_customers"),
        F.count_if(F.col("n") == 1).alias("one_time_customers"),
    )


def _month_change(scoped: DataFrame) -> DataFrame:
    """Revenue growth of the last month over the one before; 0 without a positive base."""
    monthly = (
        scoped.where(F.col("order_year_month").isNotNull())
        .groupBy(_SCOPE, "order_year_month")
        .agg(F.sum("total_order_value").cast("double").alias("now"))
    )
    in_order = W.partitionBy(_SCOPE).orderBy("order_year_month")
    stepped = monthly.withColumn("before", F.lag("now").over(in_order))
    growth = F.when(F.col("before") > 0, percent(F.col("now") - F.col("before"), F.col("before")))
    last = F.max_by(F.coalesce(growth, F.lit(0.0)), F.col("order_year_month"))
    return stepped.groupBy(_SCOPE).agg(last.alias("mom_growth"))


def overview(master: DataFrame) -> DataFrame:
    """One row with the fourteen headline figures."""
    scoped = _scoped(master)
    joined = (
        _money_and_orders(scoped)
        .join(_buyers(scoped), _SCOPE, "left")
        .join(_month_change(scoped), _SCOPE, "left")
    )
    top = _top_scope(joined)
    zero = F.lit(0.0)
    late = F.coalesce(percent(F.col("late_orders"), F.col("orders")), zero)
    customers = F.coalesce("unique_customers", F.lit(0))
    return top.select(
        F.col("value").cast("double").alias("total_revenue"),
        F.col("product").cast("double").alias("product_revenue"),
        F.col("freight").cast("double").alias("freight_revenue"),
        F.col("orders").alias("total_orders"),
        customers.alias("unique_customers"),
        F.coalesce("repeat_customers", F.lit(0)).alias("repeat_customers"),
        F.coalesce("one_time_customers", F.lit(0)).alias("one_time_customers"),
        F.coalesce(ratio(F.col("value"), F.col("orders")), zero).alias("aov"),
        ratio(F.col("score_sum"), F.col("score_rows")).alias("avg_review"),
        (ratio(F.col("transit_sum"), F.col("transit_rows")) / 86400.0).alias("avg_delivery_days"),
        (100.0 - late).alias("ontime_rate"),
        late.alias("late_rate"),
        F.coalesce(percent(F.col("repeat_customers"), F.col("unique_customers")), zero).alias("repeat_rate"),
        F.coalesce("mom_growth", zero).alias("mom_growth"),
    )


def repeat_counts(master: DataFrame) -> DataFrame:
    return _top_scope(_buyers(_scoped(master)))


def latest_month_change(master: DataFrame) -> DataFrame:
    return _top_scope(_month_change(_scoped(master)))
