"""One order, product, customer and state on a third of the rows or more: whole results, split work."""

from __future__ import annotations

from decimal import Decimal

import pandas as pd
import pytest

from tests.helpers import order, table
from tradegrain.plans import concentration, eda, kpi, master, quality, reviews, rfm
from tradegrain.sources.market import Market

ORDERS, ITEMS = 600, 3000


@pytest.fixture(scope="module")
def frames():
    orders = [
        order(f"o{i}", f"c{i}", f"2018-0{1 + i % 6}-{1 + i % 28:02d}", f"2018-07-{1 + i % 28:02d}", "2018-07-15")
        for i in range(ORDERS)
    ]
    customers = [
        {"customer_id": f"c{i}", "customer_unique_id": "hot" if i % 3 == 0 else f"u{i % 150}", "customer_state": "SP"}
        for i in range(ORDERS)
    ]
    items = [
        {
            "order_id": "o0" if i % 3 == 0 else f"o{i % ORDERS}",
            "order_item_id": i,
            "product_id": "p0" if i % 5 < 2 else f"p{i % 40}",
            "price": Decimal(i % 90) + Decimal("0.25"),
            "freight_value": Decimal("1.10"),
        }
        for i in range(ITEMS)
    ]
    products = [{"product_id": f"p{i}", "product_category_name": f"cat{i % 4}"} for i in range(40)]
    reviews_ = [
        {"review_id": f"r{i}", "order_id": "o1" if i % 3 == 0 else f"o{i % ORDERS}", "review_score": 1 + i % 5}
        for i in range(900)
    ]
    return {"orders": orders, "customers": customers, "order_items": items, "products": products, "reviews": reviews_}


@pytest.fixture(scope="module")
def market(spark, frames):
    return Market(**{name: table(spark, name, rows).repartition(6) for name, rows in frames.items()})


@pytest.fixture(scope="module")
def expected(frames):
    """The same figures in pandas."""
    items = pd.DataFrame(frames["order_items"]).merge(pd.DataFrame(frames["products"]), on="product_id")
    per_order = items.groupby("order_id").agg(
        category=("product_category_name", lambda x: x.mode()[0]),
        price=("price", "sum"),
        lines=("order_item_id", "count"),
    )
    orders = pd.DataFrame(frames["orders"]).merge(pd.DataFrame(frames["customers"]), on="customer_id")
    return items, orders.merge(per_order, on="order_id")


def test_master_figures(market, expected):
    _, whole = expected
    got = {r.order_id: r for r in master.build_master(market).collect()}
    assert len(got) == len(whole)
    lifetime = whole.groupby("customer_unique_id")["order_id"].nunique()
    for row in whole.itertuples():
        r = got[row.order_id]
        assert (r.category_english, r.price, r.item_count) == (row.category, row.price, row.lines)
        assert r.customer_lifetime_orders == lifetime[row.customer_unique_id]


def test_reports(market, expected):
    items, whole = expected
    built = master.build_master(market)
    figures = kpi.overview(built).first()
    assert figures.total_orders == len(whole)
    assert figures.product_revenue == float(whole["price"].sum())
    assert rfm.customers(built).count() == whole["customer_unique_id"].nunique()
    sales = {r.product_category_name: r.gmv for r in eda.category_sales(market).collect()}
    assert sales == items.groupby("product_category_name")["price"].sum().astype(float).to_dict()
    orders = {r.product_category_name: r.orders for r in eda.category_orders(market).collect()}
    assert orders == items.groupby("product_category_name")["order_id"].nunique().to_dict()
    assert concentration.pareto(built).collect()[-1].Cumulative_Pct == 100.0


def test_reviews_and_references(market, frames):
    merged = pd.DataFrame(frames["reviews"]).merge(pd.DataFrame(frames["orders"]), on="order_id")
    late = merged["order_delivered_customer_date"] > merged["order_estimated_delivery_date"]
    got = {r.delivery_status: r.total_reviews for r in reviews.by_delivery(market).collect()}
    assert got == {"Late": int(late.sum()), "On Time": int((~late).sum())}
    orphans = {r.reference: (r.orphan_rows, r.orphan_keys) for r in quality.orphan_report(market).collect()}
    assert orphans["order_items.order_id -> orders"] == (0, 0)
    short = Market(market.orders.where("order_id <> 'o0'"), market.order_items, market.customers, market.products)
    orphans = {r.reference: (r.orphan_rows, r.orphan_keys) for r in quality.orphan_report(short).collect()}
    in_o0 = sum(1 for i in frames["order_items"] if i["order_id"] == "o0")
    assert orphans["order_items.order_id -> orders"] == (in_o0, 1)
