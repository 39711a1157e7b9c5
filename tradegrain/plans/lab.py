"""The catalog of named business queries; each runs on any master frame, filtered or not."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tradegrain import fixed
from tradegrain.functions.numeric import as_double, mean, money, percent, ratio, round_up, share_of, tiered
from tradegrain.functions.temporal import mean_elapsed

_ORDERS = F.count_distinct
WHOLE = W.partitionBy  # windows below run over aggregated rows: categories, months, payment types


def _delivered(frame: DataFrame) -> DataFrame:
    return frame.where(F.col("order_status") == "delivered")


def _amount(column: str) -> Column:
    return round_up(F.sum(column), 2)


def _average(column: str, digits: int = 2) -> Column:
    return round_up(mean(column), digits)


def _average_transit() -> Column:
    spent = mean_elapsed(F.col("order_delivered_customer_date"), F.col("order_purchase_timestamp"))
    return round_up(spent, 1)


def _percent_of_rows(flag: Column) -> Column:
    """A null flag stays in the denominator."""
    return round_up(share_of(flag) * 100.0, 2)


def top_categories(frame: DataFrame, rows: int = 10) -> DataFrame:
    """Revenue leaders with their market share; ``items_sold`` counts order rows, as the grain is orders."""
    per_category = _delivered(frame).groupBy(F.col("category_english").alias("category")).agg(
        _ORDERS("order_id").alias("total_orders"),
        F.count("product_id").alias("items_sold"),
        _amount("total_order_value").alias("gross_revenue"),
        F.sum("total_order_value").alias("exact"),
        _average("price").alias("avg_item_price"),
        _average("review_score").alias("avg_review_score"),
    )
    share = round_up(ratio(F.col("gross_revenue"), F.sum("exact").over(WHOLE())) * 100.0, 2)
    return (
        per_category.withColumn("revenue_share_pct", share)
        .drop("exact")
        .orderBy(F.desc("gross_revenue"), "category")
        .limit(rows)
    )


def state_sales_freight(frame: DataFrame, rows: int = 10) -> DataFrame:
    value, freight = mean("total_order_value"), mean("freight_value")
    return (
        _delivered(frame)
        .groupBy(F.col("customer_state").alias("state"))
        .agg(
            _ORDERS("order_id").alias("order_volume"),
            _amount("total_order_value").alias("total_revenue"),
            round_up(value, 2).alias("avg_order_value"),
            round_up(freight, 2).alias("avg_freight_cost"),
            round_up(ratio(freight, value) * 100.0, 2).alias("freight_to_revenue_ratio_pct"),
            _average_transit().alias("avg_delivery_days"),
            _percent_of_rows(F.col("is_late")).alias("late_delivery_rate_pct"),
        )
        .orderBy(F.desc("total_revenue"), "state")
        .limit(rows)
    )


def month_growth(frame: DataFrame) -> DataFrame:
    monthly = _delivered(frame).groupBy(F.col("order_year_month").alias("period")).agg(
        _ORDERS("order_id").alias("monthly_orders"),
        _amount("total_order_value").alias("monthly_revenue"),
        _average("total_order_value").alias("monthly_aov"),
    )

    def growth(column: str) -> Column:
        previous = F.lag(column).over(W.orderBy("period"))
        return round_up(ratio(F.col(column) - previous, previous) * 100.0, 2)

    return monthly.withColumns(
        {
            "revenue_growth_pct": growth("monthly_revenue"),
            "order_growth_pct": growth("monthly_orders"),
        }
    ).orderBy("period")


def repeat_vs_onetime(frame: DataFrame) -> DataFrame:
    """Customer base, revenue and lifetime value of repeat and one-time buyers."""
    per_customer = _delivered(frame).groupBy("customer_unique_id").agg(
        _ORDERS("order_id").alias("orders"),
        money(F.sum("total_order_value")).alias("spend"),
        money(mean("total_order_value")).alias("aov"),
    )
    kind = F.when(F.col("orders") > 1, "Repeat Customer").otherwise("One-Time Customer")
    grouped = per_customer.groupBy(kind.alias("customer_type")).agg(
        F.count("customer_unique_id").alias("total_customers"),
        F.sum("spend").alias("spend"),
        _average("spend").alias("avg_clv"),
        _average("aov").alias("avg_order_value"),
    )

    def share(column: str) -> Column:
        return round_up(percent(F.col(column), F.sum(column).over(WHOLE())), 2)

    return grouped.select(
        "customer_type",
        "total_customers",
        share("total_customers").alias("customer_base_pct"),
        round_up("spend", 2).alias("aggregate_revenue"),
        share("spend").alias("revenue_contribution_pct"),
        "avg_clv",
        "avg_order_value",
    )


def payment_installments(frame: DataFrame) -> DataFrame:
    """Payment mix over all order states; orders without a payment form their own group."""
    grouped = frame.groupBy("payment_type").agg(
        _ORDERS("order_id").alias("transaction_count"),
        F.sum("total_order_value").alias("volume"),
        _average("total_order_value").alias("avg_ticket_size"),
        _average("payment_installments", 1).alias("avg_installments"),
        F.max("payment_installments").alias("max_installments"),
    )
    share = round_up(percent(F.col("volume"), F.sum("volume").over(WHOLE())), 2)
    return grouped.select(
        "payment_type",
        "transaction_count",
        round_up("volume", 2).alias("total_volume_brl"),
        share.alias("volume_share_pct"),
        "avg_ticket_size",
        "avg_installments",
        "max_installments",
    ).orderBy(F.desc("total_volume_brl"), "payment_type")


def delay_vs_reviews(frame: DataFrame) -> DataFrame:
    tier = tiered(F.col("delivery_delay_days"), fixed.DELAY_BOUNDS, fixed.DELAY_TIERS)
    return (
        _delivered(frame)
        .na.drop(subset=["review_score", "delivery_delay_days"])
        .groupBy(tier.alias("delay_tier"))
        .agg(
            F.count("order_id").alias("total_orders"),
            _average("review_score").alias("avg_review_score"),
            _percent_of_rows(F.col("review_score") == 1).alias("pct_1_star_reviews"),
            _percent_of_rows(F.col("review_score") == 5).alias("pct_5_star_reviews"),
        )
        .orderBy("delay_tier")
    )


def underperforming_categories(frame: DataFrame, min_orders: int = 100, rows: int = 10) -> DataFrame:
    """Categories with most complaints; small categories are left out as noise."""
    return (
        _delivered(frame)
        .groupBy(F.col("category_english").alias("category"))
        .agg(
            _ORDERS("order_id").alias("total_orders"),
            _amount("total_order_value").alias("category_revenue"),
            _average("review_score").alias("avg_review_score"),
            _percent_of_rows(F.col("review_score") <= 2).alias("negative_review_pct"),
            _average_transit().alias("avg_delivery_days"),
            _average("freight_value").alias("avg_freight"),
        )
        .where(F.col("total_orders") >= min_orders)
        .orderBy(F.desc("negative_review_pct"), "category")
        .limit(rows)
    )


@dataclass(frozen=True)
class NamedQuery:
    title: str
    build: Callable[[DataFrame], DataFrame]


CATALOG: dict[str, NamedQuery] = {
    "q1_top_categories": NamedQuery("Revenue leaders among categories", top_categories),
    "q2_state_sales_freight": NamedQuery("Sales and freight friction by state", state_sales_freight),
    "q3_mom_growth": NamedQuery("Monthly revenue and order growth", month_growth),
    "q4_repeat_vs_onetime": NamedQuery("Repeat against one-time buyers", repeat_vs_onetime),
    "q5_payment_installments": NamedQuery("Payment mix and installments", payment_installments),
    "q6_delivery_delay_reviews": NamedQuery("Delay tiers against review scores", delay_vs_reviews),
    "q7_underperforming_categories": NamedQuery("Categories with most complaints", underperforming_categories),
}


def run(key: str, frame: DataFrame) -> DataFrame:
    """Run a named query on a master frame."""
    return CATALOG[key].build(frame)


def run_sql(statement: str, frame: DataFrame) -> DataFrame:
    """Run free SQL text in which ``df`` is the table of the frame's rows.

    The name is bound to this call only, no view of the session is made or hidden for others. The text may have CTEs of
    its own, an order, comments, a closing semicolon and braces. ``{df}`` in place of ``df`` works too.
    """
    text = statement.strip().rstrip(";")
    if "{df}" in text:
        return frame.sparkSession.sql(text, df=frame)
    plain = text.replace("{", "{{").replace("}", "}}")
    return frame.sparkSession.sql(f"WITH df AS (SELECT * FROM {{frame}}) SELECT * FROM (\n{plain}\n)", frame=frame)
