"""Order volume, status mix and delivery timing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tradegrain.functions import temporal
from tradegrain.functions.names import approved, arrived, bought, is_delivered, is_late, promised, row_count, shipped
from tradegrain.functions.numeric import mean, percent, ratio, round_up, share_of
from tradegrain.sources.market import MarketTables


def order_count(orders: DataFrame) -> DataFrame:
    return orders.agg(row_count().alias("total_orders"))


def _per_status(orders: DataFrame) -> DataFrame:
    return orders.groupBy("order_status").agg(row_count().alias("total_orders"))


def by_status(orders: DataFrame) -> DataFrame:
    return _per_status(orders).orderBy(F.desc("total_orders"), "order_status")


def status_share(orders: DataFrame) -> DataFrame:
    whole = F.sum("total_orders").over(W.partitionBy())  # one row per status
    share = round_up(percent(F.col("total_orders"), whole), 2)
    return _per_status(orders).withColumn("percentage_of_orders", share).orderBy(
        F.desc("total_orders"), "order_status"
    )


def status_percentage(orders: DataFrame, status: str, name: str) -> DataFrame:
    """Share of orders in one status, in percent."""
    return orders.agg(round_up(share_of(F.col("order_status") == status) * 100.0, 2).alias(name))


def delivered_count(orders: DataFrame) -> DataFrame:
    return orders.agg(F.count_if(is_delivered()).alias("delivered_orders"))


def _counted_by(orders: DataFrame, name: str, part: Column) -> DataFrame:
    return orders.groupBy(part.alias(name)).agg(row_count().alias("total_orders"))


def by_year(orders: DataFrame) -> DataFrame:
    return _counted_by(orders, "year", F.year(bought()).cast("bigint")).orderBy("year")


def by_month(orders: DataFrame) -> DataFrame:
    return _counted_by(orders, "month", temporal.month_start(bought())).orderBy("month")


def by_weekday(orders: DataFrame) -> DataFrame:
    counted = _counted_by(orders, "day_of_week", temporal.weekday_name(bought()))
    return counted.orderBy(F.desc("total_orders"), "day_of_week")


def by_hour(orders: DataFrame) -> DataFrame:
    counted = _counted_by(orders, "order_hour", F.hour(bought()).cast("bigint"))
    return counted.orderBy(F.desc("total_orders"), "order_hour")


def late_summary(orders: DataFrame) -> DataFrame:
    """Delivered orders at least one whole day late, and their mean whole days."""
    late = orders.where(is_delivered() & temporal.late_by_truncated_days(arrived(), promised()))
    days = temporal.days_truncated(arrived(), promised())
    return late.agg(
        F.count("order_id").alias("total_late_orders"),
        round_up(mean(days), 2).alias("avg_days_late"),
    )


def average_delay(orders: DataFrame) -> DataFrame:
    days = temporal.days_truncated(arrived(), promised())
    return orders.where(is_late()).agg(round_up(mean(days), 2).alias("avg_delay"))


def bottleneck_states(market: MarketTables, rows: int = 10) -> DataFrame:
    """States with the longest mean delay.

    Late orders are summed per customer first: that shuffle serves the join, and a customer id with
    very many orders reaches it as one row.
    """
    per_customer = market.orders.where(is_late()).groupBy("customer_id").agg(
        F.count("order_id").alias("late"),
        F.sum(temporal.days_truncated(arrived(), promised())).alias("days"),
        row_count().alias("rows"),
    )
    located = per_customer.join(market.customers.select("customer_id", "customer_state"), "customer_id")
    return (
        located.groupBy("customer_state")
        .agg(
            F.sum("late").alias("late_order_count"),
            round_up(ratio(F.sum("days"), F.sum("rows")), 2).alias("avg_delay"),
        )
        .orderBy(F.desc("avg_delay"), "customer_state")
        .limit(rows)
    )


def delivery_time(orders: DataFrame) -> DataFrame:
    """Purchase-to-arrival interval of every delivered order."""
    return orders.where(is_delivered() & arrived().isNotNull()).select(
        "order_id", bought(), arrived(), (arrived() - bought()).alias("delivery_time")
    )


def average_delivery_days(orders: DataFrame) -> DataFrame:
    done = orders.where(is_delivered() & arrived().isNotNull())
    return done.agg(round_up(temporal.mean_elapsed(arrived(), bought()), 2).alias("average_delivery_days"))


def late_count(orders: DataFrame) -> DataFrame:
    return orders.where(is_delivered() & is_late()).agg(row_count().alias("late_orders"))


def late_percentage(orders: DataFrame) -> DataFrame:
    dated = orders.where(is_delivered() & arrived().isNotNull() & promised().isNotNull())
    return dated.agg(round_up(share_of(is_late()) * 100.0, 2).alias("late_delivery_percentage"))


def late_percentage_all(orders: DataFrame) -> DataFrame:
    """Late orders and their unrounded share among all orders with a delivery date."""
    dated = orders.where(arrived().isNotNull())
    return dated.agg(
        F.count_if(is_late()).alias("late_orders"),
        (share_of(is_late()) * 100.0).alias("late_percentage"),
    )


def days_late(orders: DataFrame) -> DataFrame:
    late = orders.where(is_delivered() & is_late())
    days = round_up(temporal.elapsed_days(arrived(), promised()), 2)
    return late.select("order_id", days.alias("days_late")).orderBy(F.desc("days_late"), "order_id")


def most_delayed(orders: DataFrame, rows: int = 10) -> DataFrame:
    return days_late(orders).limit(rows)


def missing_dates(orders: DataFrame) -> DataFrame:
    counters = {
        "missing_purchase_date": bought(),
        "missing_approval_date": approved(),
        "missing_carrier_date": shipped(),
        "missing_customer_delivery_date": arrived(),
        "missing_estimated_date": promised(),
    }
    return orders.agg(*[F.count_if(col.isNull()).alias(name) for name, col in counters.items()])


def approval_hours(orders: DataFrame) -> DataFrame:
    hours = temporal.mean_elapsed(approved(), bought(), unit_seconds=3600.0)
    return orders.agg(round_up(hours, 2).alias("avg_approval_hours"))


def days_to_carrier(orders: DataFrame) -> DataFrame:
    return orders.agg(round_up(temporal.mean_elapsed(shipped(), approved()), 2).alias("avg_days_to_carrier"))


def longer_than(orders: DataFrame, days: int = 30) -> DataFrame:
    """Delivered orders that took more than the given number of days."""
    limit = F.make_dt_interval(days=F.lit(days))
    slow = orders.where(is_delivered() & (arrived() - bought() > limit))
    spent = round_up(temporal.elapsed_days(arrived(), bought()), 2)
    return slow.select("order_id", spent.alias("delivery_days")).orderBy(F.desc("delivery_days"), "order_id")


def outcome_counts(orders: DataFrame) -> DataFrame:
    outcome = temporal.delivery_outcome(arrived(), promised()).alias("delivery_performance")
    return orders.where(is_delivered()).groupBy(outcome).agg(row_count().alias("total_orders")).orderBy(
        F.desc("total_orders"), "delivery_performance"
    )


def floored_outcome_counts(orders: DataFrame) -> DataFrame:
    """Delivered orders by the floored-day rule; a missing date counts as on time."""
    late = temporal.late_by_floored_days(arrived(), promised())
    outcome = F.when(late, "Late").otherwise("On Time").alias("delivery_performance")
    return orders.where(is_delivered()).groupBy(outcome).agg(row_count().alias("total_orders")).orderBy(
        F.desc("total_orders"), "delivery_performance"
    )
