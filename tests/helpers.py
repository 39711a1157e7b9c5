"""Small hand-made markets for edge cases."""

from __future__ import annotations

from datetime import datetime

from tradegrain.sources.market import Market
from tradegrain.sources.schemas import SCHEMAS


def ts(text: str | None) -> datetime | None:
    return datetime.fromisoformat(text) if text else None


def table(spark, name: str, rows: list[dict]):
    """A source table from partial rows; columns left out are null."""
    schema = SCHEMAS[name]
    return spark.createDataFrame([tuple(r.get(c) for c in schema.names) for r in rows], schema)


def order(key: str, customer: str, bought: str, arrived: str | None = None, promised: str = "2018-02-01", **more):
    return {
        "order_id": key,
        "customer_id": customer,
        "order_status": "delivered",
        "order_purchase_timestamp": ts(bought),
        "order_delivered_customer_date": ts(arrived),
        "order_estimated_delivery_date": ts(promised),
        **more,
    }


def market(spark, **tables: list[dict]) -> Market:
    return Market(**{name: table(spark, name, rows) for name, rows in tables.items()})
