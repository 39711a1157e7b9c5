"""Profiling and data-quality checks over any set of tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradegrain.functions.names import row_count
from tradegrain.functions.numeric import as_double, percent, total
from tradegrain.operators.quantiles import summarize, tall
from tradegrain.sources.market import MarketTables

def _stack(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _kind(data_type: T.DataType) -> str:
    """Type family of a column, the same for every width."""
    if isinstance(data_type, T.IntegralType):
        return "integer"
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return "timestamp"
    return {"string": "text"}.get(data_type.typeName(), data_type.typeName())


def schema_report(tables: dict[str, DataFrame]) -> DataFrame:
    """Every column of every table with its position, type family and the table's row count."""

    def describe(name: str, df: DataFrame) -> DataFrame:
        columns = [
            F.struct(
                F.lit(name).alias("table_name"),
                F.lit(i).alias("position"),
                F.lit(field.name).alias("column_name"),
                F.lit(_kind(field.dataType)).alias("kind"),
                F.col("n").alias("row_count"),
            )
            for i, field in enumerate(df.schema, start=1)
        ]
        return df.agg(row_count().alias("n")).select(F.inline(F.array(*columns)))

    return _stack([describe(name, df) for name, df in tables.items()]).orderBy("table_name", "position")


def null_report(tables: dict[str, DataFrame]) -> DataFrame:
    """Null count and share per table and column, one pass over each table."""

    def count(name: str, df: DataFrame) -> DataFrame:
        counted = df.agg(row_count().alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"c{i}") for i, c in enumerate(df.columns)])
        columns = [
            F.struct(
                F.lit(name).alias("table_name"),
                F.lit(c).alias("column_name"),
                F.col(f"c{i}").alias("missing_count"),
                percent(F.col(f"c{i}"), F.col("n")).alias("missing_percentage"),
            )
            for i, c in enumerate(df.columns)
        ]
        return counted.select(F.inline(F.array(*columns)))

    return _stack([count(name, df) for name, df in tables.items()]).orderBy(
        "table_name", F.desc("missing_count"), "column_name"
    )


def row_hashes(df: DataFrame) -> Column:
    """Two independent 64-bit hashes of a row as one value; null columns leave no trace in them."""
    columns = [F.col(c) for c in df.columns]
    return F.struct(F.xxhash64(F.lit(1), *columns).alias("a"), F.xxhash64(F.lit(2), *reversed(columns)).alias("b"))


def repeated_rows(df: DataFrame, hashes: Callable[[DataFrame], Column] = row_hashes) -> DataFrame:
    """One row with ``duplicate_rows``: how many rows repeat an earlier row in all columns.

    Hashes are grouped first, so the rows themselves stay where they are. Only rows whose hashes repeat are compared
    as rows, so equal hashes of different rows do no harm.
    """
    keyed = df.select(hashes(df).alias("_hashes"), F.struct(*df.columns).alias("_all"))
    often = keyed.groupBy("_hashes").agg(row_count().alias("_copies")).where("_copies > 1").select("_hashes")
    grouped = keyed.join(often, "_hashes", "left_semi").groupBy("_all").agg(row_count().alias("_copies"))
    return grouped.agg(F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicate_rows"))


def duplicate_report(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows that repeat an earlier row in all columns, per table."""
    counts = [repeated_rows(df).select(F.lit(name).alias("table_name"), "duplicate_rows") for name, df in tables.items()]
    return _stack(counts).orderBy("table_name")


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-null values of a column."""
    return df.agg(F.count_distinct(column).alias("distinct_values"))


def nulls_by_group(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    counters = [F.count_if(F.col(c).isNull()).alias(c) for c in columns]
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(*counters).orderBy(group)


def comment_split(reviews: DataFrame) -> DataFrame:
    """Reviews with and without comment text (null or not), with shares."""
    missing = F.col("review_comment_message").isNull()
    counted = reviews.agg(row_count().alias("n"), F.count_if(missing).alias("missing"))
    written = F.col("n") - F.col("missing")
    return counted.select(
        written.alias("with_comment"),
        F.col("missing").alias("without_comment"),
        percent(written, F.col("n")).alias("with_comment_pct"),
        (100.0 - percent(written, F.col("n"))).alias("without_comment_pct"),
    )


def _uncategorized(products: DataFrame) -> DataFrame:
    return products.where(F.col("product_category_name").isNull())


def missing_category(products: DataFrame) -> DataFrame:
    """Nulls per column among products that have no category."""
    return null_report({"products": _uncategorized(products)}).select("column_name", "missing_count")


def missing_category_sales(market: MarketTables) -> DataFrame:
    """What products without a category sold; lines are summed per product before the semi join."""
    per_product = market.order_items.groupBy("product_id").agg(
        row_count().alias("lines"), total("price").alias("price"), total("freight_value").alias("freight")
    )
    sold = per_product.join(_uncategorized(market.products), "product_id", "left_semi")
    return sold.agg(
        total("lines").alias("sold_lines"),
        as_double(total("price") + total("freight")).alias("revenue_with_freight"),
        as_double(total("price")).alias("revenue"),
        F.count("product_id").alias("products"),
    )


# References between tables as (table, column, referenced table, referenced column).
REFERENCES = [
    ("orders", "customer_id", "customers", "customer_id"),
    ("order_items", "order_id", "orders", "order_id"),
    ("order_items", "product_id", "products", "product_id"),
    ("order_items", "seller_id", "sellers", "seller_id"),
    ("payments", "order_id", "orders", "order_id"),
    ("reviews", "order_id", "orders", "order_id"),
    ("products", "product_category_name", "category_translation", "product_category_name"),
    ("customers", "customer_zip_code_prefix", "geolocation", "geolocation_zip_code_prefix"),
]


def orphan_report(market: MarketTables) -> DataFrame:
    """Rows whose reference has no target, per reference; null references are not counted.

    Keys are counted before the anti join, so a key on a third of the rows joins as one row.
    """
    tables = market.tables()

    def count(child: str, key: str, parent: str, target: str) -> DataFrame:
        used = tables[child].where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(row_count().alias("rows"))
        lost = used.join(tables[parent].select(F.col(target).alias("k")), "k", "left_anti")
        return lost.agg(
            total("rows").alias("orphan_rows"), F.count("k").alias("orphan_keys")
        ).select(F.lit(f"{child}.{key} -> {parent}").alias("reference"), "orphan_rows", "orphan_keys")

    present = [r for r in REFERENCES if r[0] in tables and r[2] in tables]
    return _stack([count(*r) for r in present]).orderBy("reference")


def numeric_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """Count, mean, deviation and quartiles of every numeric column of every table, in one pass."""

    def values(name: str, df: DataFrame) -> DataFrame | None:
        numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
        return tall(df, numeric).withColumn("table_name", F.lit(name)) if numeric else None

    stacked = [v for v in (values(name, df) for name, df in tables.items()) if v is not None]
    return summarize(_stack(stacked), ["table_name", "metric"])
