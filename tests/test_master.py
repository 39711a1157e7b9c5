"""Order-grain joins, defaults, ties and the derived columns."""

from __future__ import annotations

from decimal import Decimal

import pytest

from tests.conftest import plan_of
from tests.helpers import market, order, table
from tradegrain.plans import filters, kpi, master, payments
from tradegrain.sources.market import Market


def items(*rows):
    return [
        {
            "order_id": o,
            "order_item_id": i,
            "product_id": p,
            "seller_id": "s",
            "price": Decimal(price) if price else None,
            "freight_value": Decimal("1.00"),
        }
        for o, i, p, price in rows
    ]


@pytest.fixture(scope="module")
def tiny(spark):
    return market(
        spark,
        orders=[
            order("o1", "c1", "2018-01-01", "2018-02-02"),
            order("o2", "c2", "2018-01-03"),
            order("o3", "c3", "2018-02-05", "2018-01-30", order_status="shipped"),
            order("o4", "c4", "2018-02-06"),
        ],
        customers=[
            {"customer_id": "c1", "customer_unique_id": "u1", "customer_state": "SP"},
            {"customer_id": "c2", "customer_unique_id": "u1", "customer_state": "RJ"},
            {"customer_id": "c3", "customer_unique_id": None, "customer_state": None},
            {"customer_id": "c4", "customer_unique_id": "u4", "customer_state": "SP"},
        ],
        order_items=items(
            ("o1", 2, "p1", "5.00"), ("o1", 1, "p2", "7.00"), ("o2", 1, "p3", None), ("o3", 1, "p4", "2.50")
        ),
        products=[
            {"product_id": "p1", "product_category_name": "beta"},
            {"product_id": "p2", "product_category_name": "alpha"},
            {"product_id": "p3", "product_category_name": None},
            {"product_id": "p4", "product_category_name": "gamma"},
        ],
        category_translation=[{"product_category_name": "gamma", "product_category_name_english": "g_english"}],
        payments=[
            {"order_id": "o1", "payment_type": "voucher", "payment_installments": 1, "payment_value": Decimal(4)},
            {"order_id": "o1", "payment_type": "boleto", "payment_installments": 3, "payment_value": Decimal(8)},
        ],
        reviews=[
            {"review_id": "r1", "order_id": "o1", "review_score": 1},
            {"review_id": "r2", "order_id": "o1", "review_score": 2},
        ],
    )


def by_order(df):
    return {r.order_id: r for r in df.collect()}


def test_ties_nulls_and_missing_details(tiny):
    rows = by_order(master.build_master(tiny))
    assert set(rows) == {"o1", "o2", "o3"}  # an order without items drops out
    o1, o2, o3 = rows["o1"], rows["o2"], rows["o3"]
    assert o1.category_english == "alpha" and o1.product_id == "p2"  # smaller of tied modes; first line
    assert (o1.price, o1.freight_value, o1.item_count) == (Decimal("12.00"), Decimal("2.00"), 2)
    assert (o1.payment_type, o1.payment_installments, o1.payment_value) == ("boleto", 3, Decimal(12))
    assert o1.review_score == 1.5
    assert o2.category_english == "Other" and o2.price == 0 and o2.payment_type is None
    assert o3.category_english == "g_english"
    assert (o1.is_late, o1.delivery_status) == (True, "Late")
    assert (o2.is_late, o2.delivery_status, o2.delivery_days) == (False, "On-Time", None)
    assert (o1.customer_lifetime_orders, o1.is_repeat_customer) == (2, True)
    assert (o3.customer_lifetime_orders, o3.is_repeat_customer) == (None, False)
    assert o1.order_year_month == "2018-01" and o1.day_of_week == "Monday"


def test_missing_optional_tables_give_defaults(tiny):
    rows = by_order(master.build_master(Market(tiny.orders, tiny.order_items, tiny.customers, tiny.products)))
    assert rows["o3"].category_english == "gamma"
    assert (rows["o1"].payment_type, rows["o1"].payment_installments) == ("credit_card", 1)
    assert rows["o1"].payment_value == Decimal("14.00") and rows["o1"].review_score == 4.0


def test_unread_details_leave_the_plan(tiny):
    whole = master.build_master(tiny)
    assert plan_of(whole).count("Join") >= 5
    assert plan_of(whole.select("order_id", "price", "customer_state")).count("Join") == 2


def test_category_fallbacks(spark):
    native = spark.createDataFrame([("bed_bath",), (None,)], "product_category_name string")
    assert [r.category_english for r in master.add_category(native).collect()] == ["Bed Bath", "Other"]
    nothing = spark.createDataFrame([(1,)], "x int")
    assert master.add_category(nothing).first().category_english == "General Merchandise"
    given = spark.createDataFrame([("keep_me",)], "category_english string")
    assert master.add_category(given).first().category_english == "keep_me"


def test_dashboard_filter_is_inclusive_and_optional(tiny):
    whole = master.build_master(tiny)
    assert filters.narrow(whole).count() == 3
    assert filters.narrow(whole, start="2018-01-01", end="2018-01-03").count() == 2
    assert filters.narrow(whole, states=["SP"], categories=["alpha", "x"]).count() == 1
    choices = {(r.kind, r.choice) for r in filters.filter_choices(whole).collect()}
    assert ("first_date", "2018-01-01") in choices and ("state", "RJ") in choices
    assert all(choice is not None for _, choice in choices)


def test_stored_master_reads_back(tiny, spark, tmp_path):
    whole = master.build_master(tiny)
    master.write_master(whole, str(tmp_path / "master"))
    stored = master.read_master(spark, str(tmp_path / "master"))
    assert sorted(stored.columns) == sorted(whole.columns)
    assert kpi.overview(stored).collect() == kpi.overview(whole).collect()


def test_kpi_single_month_and_no_delivered_orders(tiny, spark):
    whole = master.build_master(tiny)
    row = kpi.overview(whole).first()
    assert (row.total_orders, row.unique_customers, row.repeat_customers, row.mom_growth) == (2, 1, 1, 0.0)
    assert row.late_rate == 50.0 and row.total_revenue == 15.0
    shipped = whole.where("order_status = 'shipped'")
    row = kpi.overview(shipped).first()
    assert (row.total_orders, row.total_revenue, row.unique_customers) == (1, 3.5, 0)


def test_kpi_growth_without_positive_base(spark):
    rows = [("delivered", "a", "2018-01", 0), ("delivered", "b", "2018-02", 5)]
    df = spark.createDataFrame(rows, "order_status string, order_id string, order_year_month string, total_order_value int")
    assert kpi.latest_month_change(df).first().mom_growth == 0.0


def test_installments_fill_empty_lengths_and_bad_values(spark):
    rows = [("credit_card", "2"), ("credit_card", "2"), ("credit_card", None), ("credit_card", "x"), ("boleto", "5"), ("credit_card", "12")]
    df = spark.createDataFrame(rows, "payment_type string, payment_installments string")
    got = [(r.Label, r.Count, r.Pct) for r in payments.installment_plans(df).collect()]
    assert got[:3] == [("1x", 2, 50.0), ("2x", 2, 50.0), ("3x", 0, 0.0)] and len(got) == 10


def test_duplicate_products_do_not_inflate_item_sums(tiny, spark):
    doubled = tiny.products.union(tiny.products)
    market_ = Market(tiny.orders, tiny.order_items, tiny.customers, doubled)
    assert by_order(master.build_master(market_))["o1"].price == Decimal("12.00")
