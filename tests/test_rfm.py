"""Segmentation against a pandas restatement on the small data set."""

from __future__ import annotations

import pandas as pd
import pytest

from tradegrain import fixed
from tradegrain.plans import concentration, logistics, rfm


@pytest.fixture(scope="module")
def scored(small_master):
    return rfm.customers(small_master)


def test_scores_equal_a_pandas_restatement(small_master, scored):
    frame = small_master.select(
        "customer_unique_id", "order_id", "order_purchase_timestamp", "total_order_value"
    ).toPandas()
    newest = frame["order_purchase_timestamp"].max() + pd.Timedelta(days=1)
    groups = frame.groupby("customer_unique_id")
    expected = pd.DataFrame(
        {
            "recency": (newest - groups["order_purchase_timestamp"].max()).dt.days,
            "frequency": groups["order_id"].nunique(),
            "monetary": groups["total_order_value"].sum().astype(float),
        }
    )
    expected["R_score"] = 5 - pd.qcut(expected["recency"].rank(method="first"), 4, labels=[1, 2, 3, 4]).astype(int)
    expected["M_score"] = pd.qcut(expected["monetary"].rank(method="first"), 4, labels=[1, 2, 3, 4]).astype(int)
    got = scored.toPandas().set_index("customer_unique_id").sort_index()
    got["monetary"] = got["monetary"].astype(float)
    for column in expected:
        assert (got[column] == expected[column]).all(), column


def test_segments_add_up(scored):
    table = rfm.segments(scored).toPandas()
    assert table["Customer_Count"].sum() == scored.count()
    assert abs(table["Customer_Pct"].sum() - 100) < 0.5 and abs(table["Revenue_Pct"].sum() - 100) < 0.5
    assert list(table["Total_Revenue"]) == sorted(table["Total_Revenue"], reverse=True)
    assert all(table["Strategic_Action"] == table["Segment"].map(fixed.PLAYBOOK))


def test_segment_rules_in_order(spark):
    rows = [(r, f, m) for r in (1, 2, 3, 4) for f in (2, 3, 4) for m in (1, 2, 3, 4)]
    df = rfm.label(spark.createDataFrame(rows, "R_score int, F_score int, M_score int"))
    got = {(x.R_score, x.F_score, x.M_score): x.Segment for x in df.collect()}
    assert got[4, 3, 3] == "Champions" and got[4, 3, 2] == "Loyal Customers"
    assert got[2, 4, 4] == "Loyal Customers" and got[1, 3, 4] == "At Risk"
    assert got[3, 2, 3] == "Potential Loyalists" and got[3, 2, 2] == "Recent Buyers"
    assert got[2, 2, 3] == "Cant Lose Them" and got[1, 2, 1] == "Hibernating"
    assert "Lost / Inactive" not in got.values()


def test_pareto_ends_at_all_revenue_and_drops_null_categories(spark, small_master):
    rows = concentration.pareto(small_master).collect()
    assert rows[-1].Cumulative_Pct == 100.0
    assert [r.Is_Top_80 for r in rows] == [r.Cumulative_Pct <= 80 for r in rows]
    toy = spark.createDataFrame([("a", 8), (None, 5), ("b", 2)], "category_english string, total_order_value int")
    assert [(r.Category, r.Cumulative_Pct) for r in concentration.pareto(toy).collect()] == [("a", 80.0), ("b", 100.0)]
    summary = concentration.summary(concentration.pareto(toy)).first()
    assert (summary.top_80_categories, summary.tail_categories, summary.top_category) == (1, 1, "a")


def test_empty_delay_buckets_stay(spark):
    rows = [("o1", -5.0, 5.0), ("o2", 9.0, 1.5), ("o3", None, 3.0), ("o4", 8.0, 1.0)]
    df = spark.createDataFrame(rows, "order_id string, delivery_delay_days double, review_score double")
    got = logistics.delay_buckets(df).collect()
    assert [r.Delay_Bucket for r in got] == fixed.DELAY_BUCKETS
    assert [r.Order_Count for r in got] == [1, None, None, None, 2]
    assert got[4].Pct_1_Star == 50.0  # a mean of 1.5 is not a one-star order
