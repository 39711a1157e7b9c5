"""The order-grain master table: one row per order, details pre-aggregated before every join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradegrain import fixed
from tradegrain.functions import temporal
from tradegrain.functions.numeric import total
from tradegrain.functions.text import title_words
from tradegrain.operators.skew import lookup_join
from tradegrain.sources.delimited import coerce_order_dates
from tradegrain.sources.market import MarketTables


def named_categories(market: MarketTables) -> DataFrame:
    """Products with ``category_english``: the translation, or the native name without one."""
    native = F.col("product_category_name")
    if market.category_translation is None:
        return market.products.withColumn("category_english", native)
    return market.products.join(market.category_translation, "product_category_name", "left").withColumn(
        "category_english", F.coalesce("product_category_name_english", native)
    )


def items_with_category(market: MarketTables) -> DataFrame:
    """Item lines with their category.

    The catalog is folded to one row per product id. That states the key's uniqueness to Catalyst,
    which drops the whole join from plans that do not read the category.
    """
    catalog = named_categories(market).groupBy("product_id").agg(F.min("category_english").alias("category_english"))
    return lookup_join(market.order_items, catalog, "product_id")


def items_per_order(market: MarketTables) -> DataFrame:
    """First product, most frequent category, money sums and line count per order."""
    modal = F.mode("category_english", deterministic=True)
    return items_with_category(market).groupBy("order_id").agg(
        F.min_by("product_id", F.struct("order_item_id", "product_id")).alias("product_id"),
        F.coalesce(modal, F.lit(fixed.DEFAULT_CATEGORY)).alias("category_english"),
        total("price").alias("price"),
        total("freight_value").alias("freight_value"),
        F.count("order_item_id").alias("item_count"),
    )


def payments_per_order(payments: DataFrame) -> DataFrame:
    return payments.groupBy("order_id").agg(
        F.mode("payment_type", deterministic=True).alias("payment_type"),
        F.max("payment_installments").alias("payment_installments"),
        total("payment_value").alias("payment_value"),
    )


def reviews_per_order(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("order_id").agg(F.avg("review_score").alias("review_score"))


def orders_with_customers(market: MarketTables) -> DataFrame:
    return coerce_order_dates(market.orders).join(market.customers, "customer_id")


def join_orders(market: MarketTables) -> DataFrame:
    """Orders with customer, item, payment and review figures; orders without items drop out."""
    joined = orders_with_customers(market).join(items_per_order(market), "order_id")
    if market.payments is not None:
        joined = joined.join(payments_per_order(market.payments), "order_id", "left")
    else:
        joined = joined.withColumns(
            {
                "payment_type": F.lit(fixed.DEFAULT_PAYMENT_TYPE),
                "payment_installments": F.lit(fixed.DEFAULT_INSTALLMENTS),
                "payment_value": F.col("price") + F.col("freight_value"),
            }
        )
    if market.reviews is not None:
        return joined.join(reviews_per_order(market.reviews), "order_id", "left")
    return joined.withColumn("review_score", F.lit(fixed.DEFAULT_REVIEW_SCORE))


def add_calendar(df: DataFrame) -> DataFrame:
    bought = F.col("order_purchase_timestamp")
    return df.withColumns(
        {
            "order_year": F.year(bought),
            "order_month": F.month(bought),
            "order_year_month": temporal.year_month(bought),
            "order_date": F.to_date(bought),
            "day_of_week": temporal.weekday_name(bought),
        }
    )


def add_delivery(df: DataFrame) -> DataFrame:
    bought, delivered, promised = (
        F.col("order_purchase_timestamp"),
        F.col("order_delivered_customer_date"),
        F.col("order_estimated_delivery_date"),
    )
    timed = df.withColumns(
        {
            "delivery_days": temporal.elapsed_days(delivered, bought),
            "estimated_delivery_days": temporal.elapsed_days(promised, bought),
            "delivery_delay_days": temporal.elapsed_days(delivered, promised),
        }
    )
    late = timed.withColumn("is_late", temporal.late_or_not(F.col("delivery_delay_days")))
    return late.withColumn("delivery_status", temporal.late_label(F.col("is_late")))


def add_total_value(df: DataFrame) -> DataFrame:
    if "total_order_value" in df.columns:
        return df
    return df.withColumn("total_order_value", F.col("price") + F.col("freight_value"))


def add_category(df: DataFrame) -> DataFrame:
    """Fill ``category_english`` when the frame has none, from whichever name column it carries."""
    if "category_english" in df.columns:
        return df
    for source in ("product_category_name_english", "product_category_name"):
        if source in df.columns:
            filled = F.coalesce(F.col(source), F.lit(fixed.DEFAULT_CATEGORY))
            return df.withColumn("category_english", title_words(filled))
    return df.withColumn("category_english", F.lit(fixed.DEFAULT_CATALOG))


def add_lifetime_orders(df: DataFrame) -> DataFrame:
    """Distinct orders per real customer on every row.

    A left join on a unique key: plans that read neither column lose the join altogether.
    """
    lifetime = (
        df.where(F.col("customer_unique_id").isNotNull())
        .groupBy("customer_unique_id")
        .agg(F.count_distinct("order_id").alias("customer_lifetime_orders"))
    )
    counted = lookup_join(df, lifetime, "customer_unique_id")
    repeats = F.coalesce(F.col("customer_lifetime_orders") > 1, F.lit(False))
    return counted.withColumn("is_repeat_customer", repeats)


def enrich(df: DataFrame, lifetime: bool = True) -> DataFrame:
    """All derived analytic columns on an order-grain frame, optionally without lifetime orders."""
    dated = coerce_order_dates(df)
    derived = add_category(add_total_value(add_delivery(add_calendar(dated))))
    return add_lifetime_orders(derived) if lifetime else derived


def build_master(market: MarketTables, lifetime: bool = True) -> DataFrame:
    return enrich(join_orders(market), lifetime)


def write_master(master: DataFrame, path: str) -> None:
    """Store the master table once for many readers, one folder per purchase month.

    Rows are clustered by month first (the rebalance splits a large month over several tasks), so
    each month is a few whole files and date filters skip folders.
    """
    clustered = master.hint("rebalance", "order_year_month")
    clustered.write.partitionBy("order_year_month").mode("overwrite").parquet(path)


def read_master(spark: SparkSession, path: str) -> DataFrame:
    stored = spark.read.parquet(path)
    return stored.withColumn("order_year_month", F.col("order_year_month").cast("string"))
