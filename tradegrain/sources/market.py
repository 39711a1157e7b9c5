"""The table set every plan starts from."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

TABLES = (
    "orders",
    "order_items",
    "customers",
    "products",
    "payments",
    "reviews",
    "sellers",
    "category_translation",
    "geolocation",
)


class MarketTables:
    """What every table set offers: one attribute per table, ``None`` where a table is absent."""

    def tables(self) -> dict[str, DataFrame]:
        """The tables that are present, by name."""
        present = {name: getattr(self, name) for name in TABLES}
        return {name: df for name, df in present.items() if df is not None}

    def register(self) -> None:
        """Expose every present table to ``spark.sql`` under its name."""
        for name, df in self.tables().items():
            df.createOrReplaceTempView(name)


@dataclass(frozen=True)
class Market(MarketTables):
    """Marketplace tables. The first four are required, the others may be absent."""

    orders: DataFrame
    order_items: DataFrame
    customers: DataFrame
    products: DataFrame
    payments: DataFrame | None = None
    reviews: DataFrame | None = None
    sellers: DataFrame | None = None
    category_translation: DataFrame | None = None
    geolocation: DataFrame | None = None
