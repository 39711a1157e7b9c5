"""Marketplace tables derived from a star schema in parquet (orders, lineitem, part, ...).

The star schema has no reviews, payments or delivery dates; they are derived from its keys with
plain expressions, so every row of every table takes part.
"""

from __future__ import annotations

import os
from functools import cache, cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradegrain.sources.market import MarketTables

STATUS = """
    CASE o_orderstatus
        WHEN 'F' THEN 'delivered'
        WHEN 'O' THEN IF(o_orderkey % 10 < 8, 'delivered', 'shipped')
        ELSE IF(o_orderkey % 3 = 0, 'canceled', 'delivered')
    END
"""
REVIEW_SCORE = """
    CASE
        WHEN o_orderkey % 50 = 0 THEN NULL
        WHEN transit_days <= promised_days - 3
            THEN CASE WHEN o_orderkey % 17 = 0 THEN 1 WHEN o_orderkey % 3 = 0 THEN 4 ELSE 5 END
        WHEN transit_days <= promised_days THEN 3 + o_orderkey % 3
        WHEN transit_days <= promised_days + 3 THEN 1 + o_orderkey % 5
        WHEN transit_days <= promised_days + 7 THEN 1 + o_orderkey % 3
        WHEN o_orderkey % 3 = 0 THEN 2
        ELSE 1
    END
"""
PAYMENT_TYPE = """
    CASE
        WHEN l_returnflag = 'R' THEN 'credit_card'
        WHEN l_returnflag = 'A' THEN 'boleto'
        WHEN l_linestatus = 'F' THEN 'voucher'
        ELSE 'debit_card'
    END
"""


def _cents(amount: str) -> str:
    """A whole number of cents as DECIMAL(18,2); from an integer, since text conversion of doubles is slow."""
    return f"CAST(CAST(CAST(round({amount}) AS BIGINT) AS DECIMAL(15,0)) * 0.01BD AS DECIMAL(18,2))"


LINE_PRICE = _cents("l_extendedprice")


def _minutes(count: str) -> str:
    return f"({count}) * INTERVAL '1' MINUTE"


@cache
def _schema(spark: SparkSession, path: str) -> T.StructType:
    """Column types of a file set, read from its footers once per session."""
    return spark.read.parquet(path).schema


class StarMarket(MarketTables):
    """Marketplace tables over a folder of star-schema parquet files; each is planned on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder

    def _read(self, name: str) -> DataFrame:
        path = os.path.join(self._folder, f"{name}.parquet")
        return self._spark.read.schema(_schema(self._spark, path)).parquet(path)

    @cached_property
    def _base(self) -> DataFrame:
        """Orders with their customer and nation, plus the derived purchase and transit figures."""
        return (
            self._read("orders")
            .join(self._read("customer"), F.expr("o_custkey = c_custkey"))
            .join(self._read("nation"), F.expr("c_nationkey = n_nationkey"))
            .selectExpr(
                "o_orderkey",
                "o_custkey",
                "o_orderdate",
                "c_mktsegment",
                "n_name",
                f"{STATUS} AS status",
                f"o_orderdate + {_minutes('o_orderkey * 37 % 1440')} AS purchased",
                "2 + (o_orderkey * 7919 + o_custkey * 31) % 36 AS transit_days",
                "12 + c_nationkey % 12 AS promised_days",
            )
        )

    @cached_property
    def orders(self) -> DataFrame:
        approval = "o_orderkey * 13 % 2880"
        handover = _minutes(approval + " + o_orderkey * 29 % 4320")
        arrival = _minutes("transit_days * 1440 + o_orderkey * 53 % 1440")
        return self._base.selectExpr(
            "o_orderkey AS order_id",
            "o_orderkey AS customer_id",
            "status AS order_status",
            "purchased AS order_purchase_timestamp",
            f"IF(o_orderkey % 97 <> 0, purchased + {_minutes(approval)}, NULL) AS order_approved_at",
            f"IF(status <> 'canceled', purchased + {handover}, NULL) AS order_delivered_carrier_date",
            f"IF(status = 'delivered' AND o_orderkey % 211 <> 0, purchased + {arrival}, NULL)"
            " AS order_delivered_customer_date",
            f"o_orderdate + {_minutes('promised_days * 1440')} AS order_estimated_delivery_date",
        )

    @cached_property
    def customers(self) -> DataFrame:
        return self._base.selectExpr(
            "o_orderkey AS customer_id",
            "o_custkey * 16 + o_orderkey % 16 AS customer_unique_id",
            "CAST(o_custkey % 1000 AS INT) AS customer_zip_code_prefix",
            "concat(lower(c_mktsegment), ' ', o_custkey % 40) AS customer_city",
            "n_name AS customer_state",
        )

    @cached_property
    def order_items(self) -> DataFrame:
        return self._read("lineitem").selectExpr(
            "l_orderkey AS order_id",
            "l_linenumber AS order_item_id",
            "l_partkey AS product_id",
            "l_suppkey AS seller_id",
            f"{LINE_PRICE} AS price",
            f"{_cents('l_extendedprice * (l_tax + 0.05D)')} AS freight_value",
        )

    @cached_property
    def products(self) -> DataFrame:
        return self._read("part").selectExpr(
            "p_partkey AS product_id",
            "IF(p_partkey % 40 <> 0, concat(lower(p_type), '_', replace(lower(p_brand), '#', '_')), NULL)"
            " AS product_category_name",
            "IF(p_partkey % 53 <> 0, CAST(p_size * 250 AS DOUBLE), NULL) AS product_weight_g",
            "CAST(10 + p_size AS DOUBLE) AS product_length_cm",
            "CAST(5 + p_size % 20 AS DOUBLE) AS product_height_cm",
            "CAST(8 + p_size % 30 AS DOUBLE) AS product_width_cm",
        )

    @cached_property
    def category_translation(self) -> DataFrame:
        named = self.products.where("product_category_name NOT LIKE 'small%'")
        return named.select("product_category_name").distinct().selectExpr(
            "product_category_name",
            "replace(product_category_name, 'brand', 'line') AS product_category_name_english",
        )

    @cached_property
    def payments(self) -> DataFrame:
        return self._read("lineitem").where("l_orderkey % 113 <> 0").selectExpr(
            "l_orderkey AS order_id",
            "l_linenumber AS payment_sequential",
            f"{PAYMENT_TYPE} AS payment_type",
            "IF(l_returnflag = 'R', 1 + CAST(l_quantity AS INT) % 10, 1) AS payment_installments",
            f"{LINE_PRICE} AS payment_value",
        )

    @cached_property
    def reviews(self) -> DataFrame:
        comments = self._read("documents").select("doc_id", "text")
        return (
            self._base.where("o_orderkey % 23 <> 0")
            .join(comments, F.expr("doc_id = o_orderkey"), "left")
            .selectExpr(
                "IF(o_orderkey % 499 = 0, o_orderkey + 1, o_orderkey) AS review_id",
                "IF(o_orderkey % 31 = 0, o_orderkey + 1, o_orderkey) AS order_id",
                f"CAST({REVIEW_SCORE} AS INT) AS review_score",
                "coalesce(text, IF(o_orderkey % 20 = 7, '  ', NULL)) AS review_comment_message",
                f"purchased + {_minutes('(transit_days + 1) * 1440')} AS review_creation_date",
            )
        )

    @cached_property
    def sellers(self) -> DataFrame:
        located = self._read("supplier").join(self._read("nation"), F.expr("s_nationkey = n_nationkey"))
        return located.selectExpr(
            "s_suppkey AS seller_id",
            "CAST(s_suppkey % 1000 AS INT) AS seller_zip_code_prefix",
            "n_name AS seller_state",
        )

    @cached_property
    def geolocation(self) -> DataFrame:
        placed = self._read("nation").join(self._read("region"), F.expr("n_regionkey = r_regionkey"))
        return placed.selectExpr(
            "CAST(n_nationkey * 40 AS INT) AS geolocation_zip_code_prefix",
            "lower(r_name) AS geolocation_city",
            "n_name AS geolocation_state",
        )


def read_star_market(spark: SparkSession, folder: str) -> StarMarket:
    return StarMarket(spark, folder)
