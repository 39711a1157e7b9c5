"""CSV scans and sinks for the source tables."""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradegrain.functions.temporal import lenient_timestamp
from tradegrain.sources.market import Market
from tradegrain.sources.quoted_csv import read_quoted
from tradegrain.sources.schemas import ORDER_DATES, REQUIRED, SCHEMAS

# File patterns; any path Spark can glob works, so a table may be one file or thousands.
FILE_PATTERNS = {
    "orders": "*orders_dataset.csv",
    "order_items": "*order_items_dataset.csv",
    "customers": "*customers_dataset.csv",
    "products": "*products_dataset.csv",
    "payments": "*order_payments_dataset.csv",
    "reviews": "*order_reviews_dataset.csv",
    "sellers": "*sellers_dataset.csv",
    "category_translation": "*category_name_translation.csv",
    "geolocation": "*geolocation_dataset.csv",
}

# Only free text may hold line breaks inside quotes; such a table is split by the parity of its quotes.
MULTILINE_TABLES = {"reviews"}
TIME_PATTERN = "yyyy-MM-dd HH:mm:ss"


def read_csv(spark: SparkSession, path: str, table: str, schema: T.StructType | None = None) -> DataFrame:
    """Scan one table with a header line; columns are found by name and have their declared types.

    Columns that are not declared are left out. A missing column is an error, as is a file whose header differs
    from the first one's.
    """
    declared = schema or SCHEMAS[table]
    options = {"header": True, "quote": '"', "escape": '"', "multiLine": table in MULTILINE_TABLES}
    names = spark.read.options(**options).csv(path).columns  # reads the header line only
    missing = [name for name in declared.names if name not in names]
    if missing and names:
        raise ValueError(f"{table}: no column {', '.join(missing)} in {path}")
    present = [declared[n] if n in declared.names else T.StructField(n, T.StringType()) for n in names]
    if table in MULTILINE_TABLES and names:
        settings = {**options, "timestampNTZFormat": TIME_PATTERN}
        return read_quoted(spark, path, names, T.StructType(present), settings).select(*declared.names)
    read = spark.read.schema(T.StructType(present) if names else declared).options(**options)
    return read.option("enforceSchema", False).option("timestampNTZFormat", TIME_PATTERN).csv(path).select(*declared.names)


def write_csv(df: DataFrame, path: str) -> None:
    """Write a table so that :func:`read_csv` gives it back."""
    (
        df.write.option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("timestampNTZFormat", TIME_PATTERN)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .mode("errorifexists")
        .csv(path)
    )


def read_csv_market(spark: SparkSession, folder: str, patterns: dict[str, str] | None = None) -> Market:
    """Read all tables found in ``folder``.

    A missing required table is an error. A missing optional table is left out, and so are empty
    payments or reviews, which makes the master table fall back to its default columns.
    """
    found: dict[str, DataFrame] = {}
    for table, pattern in {**FILE_PATTERNS, **(patterns or {})}.items():
        try:
            found[table] = read_csv(spark, os.path.join(folder, pattern), table)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND" or table in REQUIRED:
                raise
    for table in ("payments", "reviews"):
        if table in found and found[table].isEmpty():
            del found[table]
    return Market(**found)


def coerce_order_dates(orders: DataFrame) -> DataFrame:
    """Turn order dates that arrived as text into timestamps, bad values into null."""
    textual = {f.name for f in orders.schema if isinstance(f.dataType, T.StringType)}
    return orders.withColumns({c: lenient_timestamp(F.col(c)) for c in ORDER_DATES if c in textual})
