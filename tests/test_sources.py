"""CSV scans: quoting, line breaks, missing and empty tables."""

from __future__ import annotations

import pytest
from pyspark.errors import AnalysisException

from tradegrain.plans.master import build_master
from tradegrain.sources.delimited import read_csv_market, write_csv


@pytest.fixture
def folder(tmp_path):
    files = {
        "x_orders_dataset.csv": (
            "order_id,customer_id,order_status,order_purchase_timestamp,order_approved_at,"
            "order_delivered_carrier_date,order_delivered_customer_date,order_estimated_delivery_date\n"
            "o1,c1,delivered,2018-01-02 10:00:00,2018-01-02 11:00:00,,2018-01-09 10:00:00,2018-01-12 00:00:00\n"
            "o2,c2,canceled,2018-03-02 10:00:00,,,,2018-03-12 00:00:00\n"
        ),
        "x_order_items_dataset.csv": (
            "order_id,order_item_id,product_id,seller_id,shipping_limit_date,price,freight_value\n"
            "o1,1,p1,s1,2018-01-05 00:00:00,10.10,2.20\no2,1,p1,s1,2018-03-05 00:00:00,10.10,2.20\n"
        ),
        "x_customers_dataset.csv": (
            "customer_id,customer_unique_id,customer_zip_code_prefix,customer_city,customer_state\n"
            "c1,u1,01310,sao paulo,SP\nc2,u1,20010,\"rio, centro\",RJ\n"
        ),
        "x_products_dataset.csv": (
            "product_id,product_category_name,product_name_lenght,product_description_lenght,"
            "product_photos_qty,product_weight_g,product_length_cm,product_height_cm,product_width_cm\n"
            "p1,moveis,10,20,1,500,10,10,10\n"
        ),
        "product_category_name_translation.csv": (
            "product_category_name,product_category_name_english\nmoveis,furniture\n"
        ),
        "x_order_reviews_dataset.csv": (
            "review_id,order_id,review_score,review_comment_title,review_comment_message,"
            "review_creation_date,review_answer_timestamp\n"
            'r1,o1,4,"a ""fine"" one","two\nlines, quoted",2018-01-10 00:00:00,2018-01-11 00:00:00\n'
        ),
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    return tmp_path


def test_tables_come_with_declared_types(spark, folder):
    market = read_csv_market(spark, str(folder))
    assert market.payments is None and market.sellers is None
    assert dict(market.orders.dtypes)["order_purchase_timestamp"] == "timestamp_ntz"
    assert dict(market.order_items.dtypes)["price"] == "decimal(18,2)"
    review = market.reviews.first()
    assert review.review_comment_message == "two\nlines, quoted" and review.review_comment_title == 'a "fine" one'
    assert market.customers.where("customer_state = 'RJ'").first().customer_city == "rio, centro"
    rows = {r.order_id: r for r in build_master(market).collect()}
    assert rows["o1"].category_english == "furniture" and rows["o1"].payment_type == "credit_card"
    assert rows["o2"].review_score is None and rows["o1"].delivery_days == 7.0


def test_missing_required_table_fails(spark, folder):
    (folder / "x_products_dataset.csv").unlink()
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        read_csv_market(spark, str(folder))


def test_empty_payments_count_as_missing(spark, folder):
    (folder / "x_order_payments_dataset.csv").write_text(
        "order_id,payment_sequential,payment_type,payment_installments,payment_value\n"
    )
    assert read_csv_market(spark, str(folder)).payments is None


def test_written_tables_read_back(spark, folder, tmp_path):
    market = read_csv_market(spark, str(folder))
    target = tmp_path / "copy"
    for name, df in market.tables().items():
        write_csv(df, str(target / f"{name}.csv"))
    again = read_csv_market(spark, str(target), {name: f"{name}.csv" for name in market.tables()})
    for name, df in market.tables().items():
        assert getattr(again, name).collect() == df.collect(), name


def test_tables_register_for_sql(spark, folder):
    read_csv_market(spark, str(folder)).register()
    assert spark.sql("SELECT count(*) FROM orders JOIN order_items USING (order_id)").first()[0] == 2


def test_csv_columns_are_found_by_name(spark, tmp_path):
    """Shuffled and extra columns are read by header; a missing one is an error."""
    path = tmp_path / "shuffled"
    path.mkdir()
    (path / "a.csv").write_text(
        "customer_state,customer_unique_id,extra,customer_id,customer_city,customer_zip_code_prefix\nSP,u1,x,c1,santos,1310\n"
    )
    from tradegrain.sources.delimited import read_csv

    row = read_csv(spark, str(path), "customers").collect()[0]
    assert (row["customer_id"], row["customer_unique_id"], row["customer_state"]) == ("c1", "u1", "SP")
    assert "extra" not in row.asDict()
    short = tmp_path / "short"
    short.mkdir()
    (short / "a.csv").write_text("customer_id\nc1\n")
    with pytest.raises(ValueError):
        read_csv(spark, str(short), "customers")


def test_lenient_timestamps_ignore_the_session_zone(spark):
    """00:30 does not exist on this day in the zone, and is read as it stands."""
    from tradegrain.functions.temporal import lenient_timestamp

    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
    try:
        frame = spark.createDataFrame([("2018-11-04 00:30:00",), ("no date",)], "t string")
        found = [r[0] for r in frame.select(lenient_timestamp(frame["t"]).cast("string")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert found == ["2018-11-04 00:30:00", None]
