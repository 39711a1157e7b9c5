"""Declared schemas of the nine source tables; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

TEXT, INT, NUMBER, MONEY, TIME = (
    T.StringType(),
    T.IntegerType(),
    T.DoubleType(),
    T.DecimalType(18, 2),
    T.TimestampNTZType(),
)


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


# Column names and types of the source tables, in file order.
SCHEMAS: dict[str, T.StructType] = {
    "customers": _table(
        customer_id=TEXT,
        customer_unique_id=TEXT,
        customer_zip_code_prefix=INT,
        customer_city=TEXT,
        customer_state=TEXT,
    ),
    "orders": _table(
        order_id=TEXT,
        customer_id=TEXT,
        order_status=TEXT,
        order_purchase_timestamp=TIME,
        order_approved_at=TIME,
        order_delivered_carrier_date=TIME,
        order_delivered_customer_date=TIME,
        order_estimated_delivery_date=TIME,
    ),
    "order_items": _table(
        order_id=TEXT,
        order_item_id=INT,
        product_id=TEXT,
        seller_id=TEXT,
        shipping_limit_date=TIME,
        price=MONEY,
        freight_value=MONEY,
    ),
    "products": _table(
        product_id=TEXT,
        product_category_name=TEXT,
        product_name_lenght=INT,
        product_description_lenght=INT,
        product_photos_qty=INT,
        product_weight_g=NUMBER,
        product_length_cm=NUMBER,
        product_height_cm=NUMBER,
        product_width_cm=NUMBER,
    ),
    "payments": _table(
        order_id=TEXT,
        payment_sequential=INT,
        payment_type=TEXT,
        payment_installments=INT,
        payment_value=MONEY,
    ),
    "reviews": _table(
        review_id=TEXT,
        order_id=TEXT,
        review_score=INT,
        review_comment_title=TEXT,
        review_comment_message=TEXT,
        review_creation_date=TIME,
        review_answer_timestamp=TIME,
    ),
    "sellers": _table(
        seller_id=TEXT,
        seller_zip_code_prefix=INT,
        seller_city=TEXT,
        seller_state=TEXT,
    ),
    "category_translation": _table(
        product_category_name=TEXT,
        product_category_name_english=TEXT,
    ),
    "geolocation": _table(
        geolocation_zip_code_prefix=INT,
        geolocation_lat=NUMBER,
        geolocation_lng=NUMBER,
        geolocation_city=TEXT,
        geolocation_state=TEXT,
    ),
}

REQUIRED = ("orders", "order_items", "customers", "products")
ORDER_DATES = tuple(f.name for f in SCHEMAS["orders"] if isinstance(f.dataType, T.TimestampNTZType))
