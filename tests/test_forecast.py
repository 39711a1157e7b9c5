"""Smoothing folds against a plain Python restatement, and the what-if sweep."""

from __future__ import annotations

from datetime import datetime
from math import isclose, sqrt

import pytest
from pyspark.sql import functions as F

from tradegrain.plans import forecast, whatif

BY = ["k"]


def months(n):
    return [datetime(2017 + i // 12, i % 12 + 1, 1) for i in range(n)]


@pytest.fixture(scope="module")
def lines(spark):
    values = {
        "long": [100.0 + 7 * i + (13 * i % 11) for i in range(20)],
        "edge": [50.0 - i for i in range(12)],
        "short": [10.0 * (i + 1) for i in range(11)],
        "single": [5.0],
        "broken": [float("nan")] * 12,
    }
    rows = [(k, m, v) for k, series in values.items() for m, v in zip(months(len(series)), series, strict=True)]
    df = spark.createDataFrame(rows, "k string, month timestamp_ntz, revenue double").repartition(4)
    return values, forecast.series(df, BY)


def smooth(y, alpha, beta, phi):
    level, trend, errors = y[0], y[1] - y[0], []
    for value in y[1:]:
        expected = level + phi * trend
        new = alpha * value + (1.0 - alpha) * expected
        trend = beta * (new - level) + (1.0 - beta) * phi * trend
        level = new
        errors.append(value - expected)
    return sum(e * e for e in errors), level, trend, errors


def best(y):
    return min((smooth(y, *g)[0], *g) for g in forecast.GRID)


def test_fit_equals_a_plain_restatement(lines):
    values, df = lines
    rows = {r.k: r for r in forecast.fit_report(forecast.fit(df), BY).collect()}
    assert set(rows) == {"long", "edge", "broken"}
    for k in ("long", "edge"):
        sse, alpha, beta, phi = best(values[k])
        _, level, trend, errors = smooth(values[k], alpha, beta, phi)
        centre = sum(errors) / len(errors)
        spread = sqrt(sum((e - centre) ** 2 for e in errors) / len(errors))
        got = rows[k]
        assert (got.alpha, got.beta, got.phi) == (alpha, beta, phi)
        for a, b in ((got.sse, sse), (got.level, level), (got.trend, trend), (got.residual_std, spread)):
            assert isclose(a, b, rel_tol=1e-9, abs_tol=1e-6)


def test_every_series_gets_six_months(lines):
    values, df = lines
    rows = forecast.forecast_all(df, BY).collect()
    assert len(rows) == 6 * len(values)
    first = {r.k: r for r in rows if r.step == 1}
    assert first["long"].ds == "2018-09" and first["short"].ds == "2017-12" and first["single"].ds == "2017-02"
    assert isclose(first["short"].forecast, 110.0 * 1.02) and isclose(first["single"].ci_95_upper, 5 * 1.02 * 1.15)
    last = {r.k: r for r in rows if r.step == 6}
    assert last["long"].ci_95_upper - last["long"].forecast > first["long"].ci_95_upper - first["long"].forecast
    assert all(r.ci_95_lower <= r.ci_80_lower <= r.forecast for r in rows if r.k in ("long", "edge"))
    fitted = {r.k: r for r in forecast.forecast(forecast.fit(df), BY).where("step = 1").collect()}
    assert isclose(first["long"].forecast, fitted["long"].forecast)


def test_backtest_uses_the_held_out_months(lines):
    values, df = lines
    row = {r.k: r for r in forecast.backtest(df, BY).collect()}["long"]
    y = values["long"]
    _, alpha, beta, phi = best(y[:-4])
    _, level, trend, _ = smooth(y[:-4], alpha, beta, phi)
    guesses = [level + trend * sum(phi**i for i in range(1, h + 1)) for h in range(1, 5)]
    mape = sum(abs((a - g) / a) for a, g in zip(y[-4:], guesses, strict=True)) / 4 * 100
    assert isclose(row.mape, mape, abs_tol=0.0051)


def test_quarter_growth_without_a_base(spark):
    df = spark.createDataFrame([("z", [0.0, 0.0, 0.0], 3, datetime(2018, 8, 1))], "k string, y array<double>, months int, last_month timestamp_ntz")
    row = forecast.quarter_growth(df, forecast.fallback(df, BY), BY).first()
    assert row.projected_growth_rate == 12.5


def test_month_window_and_scenarios(spark, lines):
    _, df = lines
    ahead = forecast.fallback(df, BY)
    assert forecast.scenarios(ahead).count() == 3 * ahead.count()
    rows = [(f"o{i}", m, 1) for i, m in enumerate(months(24))]
    frame = spark.createDataFrame(rows, "order_id string, order_purchase_timestamp timestamp_ntz, total_order_value int")
    assert forecast.monthly(frame, []).count() == 20


def test_what_if_sweep(spark):
    figures = spark.createDataFrame([(1000, 5000.0, 5.0)], "total_orders bigint, total_revenue double, aov double")
    rows = {(r.days_saved, r.retention_points): r for r in whatif.sweep(figures).collect()}
    assert len(rows) == 13 * 17
    r = rows[2.5, 3.0]
    assert (r.prevented_late_orders, r.prevented_1_stars, r.additional_repeat_orders) == (int(1000 * (2.5 * 0.022)), 31, 30)
    assert isclose(r.csat_lift, 0.26) and isclose(r.projected_revenue_gain, 30 * 5 * 1.35)
    assert rows[6.0, 8.0].csat_lift == pytest.approx(0.64)


def test_quarter_growth_of_one_series_without_a_key(spark):
    months = [(float(100 + i), f"2017-{i:02d}-01") for i in range(1, 13)]
    frame = spark.createDataFrame(months, "revenue double, d string").selectExpr("revenue", "CAST(d AS TIMESTAMP_NTZ) AS month")
    lines = forecast.series(frame, [])
    row = forecast.quarter_growth(lines, forecast.forecast_all(lines, []), []).collect()
    assert len(row) == 1 and row[0].recent_revenue == 333.0


def test_levels_add_up_and_null_keys_are_a_series(spark, small_master):
    keyed = small_master.withColumn("category_english", F.when(F.col("order_id") % 7 != 0, F.col("category_english")))
    levels = {"nation": None, "state": "customer_state", "category": "category_english"}
    rows = forecast.monthly_levels(keyed, levels, "2000-01", "2001-07").collect()
    sums = {level: sum(r.order_count for r in rows if r.series.split(":")[0] == level) for level in levels}
    assert sums["nation"] == sums["state"] == sums["category"] > 0
    assert any(r.series == "category:" for r in rows)
    for level, column in levels.items():
        if column:
            alone = forecast.monthly(keyed, [column], "2000-01", "2001-07").collect()
            expected = {(f"{level}:{r[column] or ''}", r.month): (r.revenue, r.order_count) for r in alone}
            assert {(r.series, r.month): (r.revenue, r.order_count) for r in rows if r.series.startswith(f"{level}:")} == expected
