"""Exploratory sales, category and customer analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradegrain.functions.numeric import as_double, mean, percent, ratio, total
from tradegrain.functions.temporal import elapsed_seconds, month_start
from tradegrain.operators.quantiles import summarize, tall
from tradegrain.sources.market import MarketTables


def monthly_sales(market: MarketTables) -> DataFrame:
    """Merchandise value, distinct orders and their ratio per purchase month.

    Prices are summed per order before the join with orders.
    """
    sold = market.order_items.groupBy("order_id").agg(total("price").alias("price"))
    dated = market.orders.select("order_id", month_start(F.col("order_purchase_timestamp")).alias("month"))
    monthly = (
        dated.where(F.col("month").isNotNull())
        .join(sold, "order_id")
        .groupBy("month")
        .agg(as_double(F.sum("price")).alias("GMV"), F.count_distinct("order_id").alias("Orders"))
    )
    return monthly.withColumn("Average_Order_Value", ratio(F.col("GMV"), F.col("Orders"))).orderBy("month")


def _extremes(monthly: DataFrame, column: str, best: str, worst: str) -> DataFrame:
    """The first month with the highest and with the lowest value."""
    row = F.struct(*monthly.columns)
    month = F.datediff(F.col("month").cast("date"), F.lit("1970-01-01").cast("date"))
    found = monthly.agg(
        F.max_by(row, F.struct(column, -month)).alias("high"),
        F.min_by(row, F.struct(F.col(column), month)).alias("low"),
    )
    pair = F.array(
        F.struct(F.lit(best).alias("kind"), F.col("high").alias("row")),
        F.struct(F.lit(worst).alias("kind"), F.col("low").alias("row")),
    )
    return found.select(F.inline(pair)).select("kind", "row.*")


def best_worst_month(monthly: DataFrame) -> DataFrame:
    return _extremes(monthly, "GMV", "best", "worst")


def order_value_extremes(monthly: DataFrame) -> DataFrame:
    return _extremes(monthly, "Average_Order_Value", "highest", "lowest")


def average_order_value(monthly: DataFrame, order_items: DataFrame) -> DataFrame:
    """Ratio of totals over the months, and the item-level variant."""
    over_months = monthly.agg(ratio(F.sum(F.col("GMV").cast("decimal(28,2)")), F.sum("Orders")).alias("monthly_aov"))
    over_items = order_items.agg(
        as_double(total("price")).alias("total_revenue"),
        F.count_distinct("order_id").alias("total_orders"),
    )
    return over_items.select(
        over_months.scalar().alias("monthly_aov"),
        "total_revenue",
        "total_orders",
        ratio(F.col("total_revenue"), F.col("total_orders")).alias("item_aov"),
    )


def _categorized(sold: DataFrame, products: DataFrame) -> DataFrame:
    named = products.select("product_id", "product_category_name")
    return sold.join(named, "product_id").where(F.col("product_category_name").isNotNull())


def category_sales(market: MarketTables, rows: int | None = 10) -> DataFrame:
    """Merchandise value per native category; items are summed per product before the join."""
    per_product = market.order_items.groupBy("product_id").agg(total("price").alias("price"))
    ranked = (
        _categorized(per_product, market.products)
        .groupBy("product_category_name")
        .agg(as_double(F.sum("price")).alias("gmv"))
        .orderBy(F.desc("gmv"), "product_category_name")
    )
    return ranked if rows is None else ranked.limit(rows)


def category_orders(market: MarketTables, rows: int | None = 10) -> DataFrame:
    """Distinct orders per native category; repeated lines of a product collapse before the join."""
    pairs = market.order_items.select("order_id", "product_id").distinct()
    ranked = (
        _categorized(pairs, market.products)
        .groupBy("product_category_name")
        .agg(F.count_distinct("order_id").alias("orders"))
        .orderBy(F.desc("orders"), "product_category_name")
    )
    return ranked if rows is None else ranked.limit(rows)


def orders_per_customer(market: MarketTables) -> DataFrame:
    people = market.customers.select("customer_id", "customer_unique_id")
    return (
        market.orders.select("order_id", "customer_id")
        .join(people, "customer_id", "left")
        .where(F.col("customer_unique_id").isNotNull())
        .groupBy("customer_unique_id")
        .agg(F.count_distinct("order_id").alias("orders"))
    )


def orders_per_customer_summary(market: MarketTables) -> DataFrame:
    return summarize(tall(orders_per_customer(market), ["orders"]), ["metric"]).drop("metric")


def repeat_rate(market: MarketTables) -> DataFrame:
    repeats = F.count_if(F.col("orders") > 1)
    return orders_per_customer(market).agg(
        repeats.alias("repeat_customers"),
        F.count_if(F.col("orders") <= 1).alias("one_time_customers"),
        percent(repeats, F.count(F.lit(1))).alias("repeat_rate"),
    )


def delivery_summary(orders: DataFrame) -> DataFrame:
    """Summary of transit days and delay days over all orders with a delivery date.

    Statistics run on exact seconds and are scaled to days at the end.
    """
    arrived = F.col("order_delivered_customer_date")
    timed = orders.where(arrived.isNotNull()).select(
        elapsed_seconds(arrived, F.col("order_purchase_timestamp")).alias("delivery_days"),
        elapsed_seconds(arrived, F.col("order_estimated_delivery_date")).alias("delivery_delay_days"),
    )
    stats = summarize(tall(timed, timed.columns), ["metric"])
    in_days = [(F.col(c) / 86400.0).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")]
    return stats.select("metric", "count", *in_days)


def time_span(orders: DataFrame) -> DataFrame:
    bought = F.col("order_purchase_timestamp")
    return orders.agg(F.min(bought).alias("first_order"), F.max(bought).alias("last_order"))


def money_totals(order_items: DataFrame) -> DataFrame:
    return order_items.agg(
        as_double(total("price")).alias("total_product_value"),
        as_double(total("freight_value")).alias("total_freight"),
        mean("price").alias("average_product_price"),
    )
