"""Columns and counters that many plans share, built on use (a column needs a running session)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def row_count() -> Column:
    """Row count."""
    return F.count(F.lit(1))


def bought() -> Column:
    return F.col("order_purchase_timestamp")


def approved() -> Column:
    return F.col("order_approved_at")


def shipped() -> Column:
    return F.col("order_delivered_carrier_date")


def arrived() -> Column:
    return F.col("order_delivered_customer_date")


def promised() -> Column:
    return F.col("order_estimated_delivery_date")


def is_delivered() -> Column:
    return F.col("order_status") == "delivered"


def is_late() -> Column:
    """Delivered after the promised instant; null when either date is missing."""
    return arrived() > promised()
