"""Every registered query as ``(spark, folder) -> DataFrame`` over the star-schema parquet tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradegrain import fixed
from tradegrain.operators.sampling import sample_exactly, stratified_split
from tradegrain.plans import (
    charts,
    concentration,
    customers,
    eda,
    evaluation,
    features,
    filters,
    forecast,
    kpi,
    lab,
    logistics,
    master,
    orders,
    payments,
    presentation,
    quality,
    reviews,
    rfm,
    scoring,
    training,
    whatif,
)
from tradegrain.session import cut_lineage, scratch_path
from tradegrain.sources.delimited import coerce_order_dates, read_csv, write_csv
from tradegrain.sources.market import Market, MarketTables
from tradegrain.sources.schemas import ORDER_DATES
from tradegrain.sources.star_parquet import read_star_market

# Parameters that fit the star-schema data: its home state, its last full months.
HOME_STATE = "NATION_0"
FIRST_MONTH, LAST_MONTH = "2000-01", "2001-07"
STATE = ["customer_state"]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


# Plans (not data) of the tables and the master, shared by the queries of a session.
_market = cache(read_star_market)


@cache
def _master(spark: SparkSession, folder: str, lifetime: bool = True) -> DataFrame:
    return master.build_master(_market(spark, folder), lifetime)


def _on_market(name: str, plan: Callable[[MarketTables], DataFrame]) -> None:
    QUERIES[name] = lambda spark, folder: plan(_market(spark, folder))


def _on_table(table: str, plans: dict[str, Callable[[DataFrame], DataFrame]]) -> None:
    for name, plan in plans.items():
        _on_market(name, lambda market, plan=plan: plan(getattr(market, table)))


def _on_master(plans: dict[str, Callable[[DataFrame], DataFrame]], lifetime: bool = True) -> None:
    for name, plan in plans.items():
        QUERIES[name] = lambda spark, folder, plan=plan: plan(_master(spark, folder, lifetime))


# --- sources -----------------------------------------------------------------------------------


def _csv_round_trip(market: MarketTables) -> DataFrame:
    """Write orders as CSV to the shared folder and scan them back with the declared types."""
    path = scratch_path(market.orders.sparkSession, "orders-csv")
    write_csv(market.orders, path)
    return read_csv(market.orders.sparkSession, path, "orders", schema=market.orders.schema)


def _reviews_round_trip(market: MarketTables) -> DataFrame:
    """Reviews, whose comments hold line breaks and quotes, through CSV files that tasks read in splits."""
    path = scratch_path(market.reviews.sparkSession, "reviews-csv")
    write_csv(market.reviews, path)
    return read_csv(market.reviews.sparkSession, path, "reviews", schema=market.reviews.schema)


def _textual_dates(orders_: DataFrame) -> DataFrame:
    """Order dates as text, every tenth unusable, parsed leniently."""
    broken = F.col("order_id") % 10 == 0
    textual = {
        c: F.when(broken, F.lit("not a date")).otherwise(F.date_format(c, "yyyy-MM-dd HH:mm:ss"))
        for c in ORDER_DATES
    }
    return coerce_order_dates(orders_.withColumns(textual)).select("order_id", *ORDER_DATES)


def _without_optional(market: MarketTables) -> DataFrame:
    needed = Market(market.orders, market.order_items, market.customers, market.products)
    columns = ["order_id", "category_english", "payment_type", "payment_installments", "payment_value"]
    return _readable(master.build_master(needed).select(*columns, "review_score"))


_on_market("src_csv_orders", _csv_round_trip)
_on_market("src_csv_reviews", _reviews_round_trip)
_on_table("orders", {"src_coerce_ts": _textual_dates})
_on_market("src_optional_defaults", _without_optional)

# --- master table, derived columns, joins, filters ---------------------------------------------

MASTER_COLUMNS = [
    "order_id",
    "customer_id",
    "customer_unique_id",
    "customer_city",
    "customer_state",
    "order_status",
    "order_purchase_timestamp",
    "order_approved_at",
    "order_delivered_carrier_date",
    "order_delivered_customer_date",
    "order_estimated_delivery_date",
    "customer_zip_code_prefix",
    "product_id",
    "category_english",
    "price",
    "freight_value",
    "item_count",
    "payment_type",
    "payment_installments",
    "payment_value",
    "review_score",
    "order_year",
    "order_month",
    "order_year_month",
    "order_date",
    "day_of_week",
    "delivery_days",
    "estimated_delivery_days",
    "delivery_delay_days",
    "is_late",
    "delivery_status",
    "total_order_value",
    "is_repeat_customer",
    "customer_lifetime_orders",
]
_MONEY = ["price", "freight_value", "payment_value", "total_order_value"]


def _readable(df: DataFrame) -> DataFrame:
    """Money as double at the edge of the engine."""
    return df.withColumns({c: F.col(c).cast("double") for c in _MONEY if c in df.columns})


def _native_titles(products: DataFrame) -> DataFrame:
    named = products.select("product_id", "product_category_name")
    return master.add_category(named)


_on_master(
    {
        "master_orders": lambda m: _readable(m.select(*MASTER_COLUMNS)),
        "prj_time_parts": lambda m: m.select(
            "order_id", "order_year", "order_month", "order_year_month", "order_date", "day_of_week"
        ),
        "prj_delivery_days": lambda m: m.select(
            "order_id", "delivery_days", "estimated_delivery_days", "delivery_delay_days"
        ),
        "prj_delivery_status": lambda m: m.select("order_id", "is_late", "delivery_status"),
        "prj_total_value": lambda m: _readable(m.select("order_id", "total_order_value")),
        "prj_lifetime_orders": lambda m: m.select(
            "order_id", "customer_unique_id", "customer_lifetime_orders", "is_repeat_customer"
        ),
    }
)
_on_table("products", {"prj_category_title": _native_titles})
_on_table("customers", {"prj_head5": lambda t: customers.preview(t, "customer_id")})
_on_market(
    "jn_orders_customers",
    lambda k: master.orders_with_customers(k).select(
        "order_id", "customer_id", "customer_unique_id", "customer_state", "order_status"
    ),
)
_on_market(
    "jn_category_translation",
    lambda k: master.named_categories(k).select("product_id", "product_category_name", "category_english"),
)
_on_market(
    "jn_items_products",
    lambda k: _readable(
        master.items_with_category(k).select(
            "order_id", "order_item_id", "product_id", "category_english", "price", "freight_value"
        )
    ),
)
_on_market("ag_items_per_order", lambda k: _readable(master.items_per_order(k)))
_on_table("payments", {"ag_payments_per_order": lambda t: _readable(master.payments_per_order(t))})
_on_table("reviews", {"ag_reviews_per_order": master.reviews_per_order})

DASHBOARD = {
    "start": "1997-01-01",
    "end": "2000-06-30",
    "states": ["NATION_0", "NATION_3", "NATION_7", "NATION_11", "NATION_18"],
}
_on_master(
    {
        "fil_dashboard": lambda m: _readable(
            filters.narrow(m, **DASHBOARD).select(
                "order_id", "order_date", "customer_state", "category_english", "total_order_value"
            )
        ),
        "fil_domain": filters.filter_choices,
    }
)

# --- headline figures, segments, concentration, logistics, payments, charts --------------------


def _segments(m: DataFrame) -> DataFrame:
    return rfm.segments(rfm.customers(m))


_on_master(
    {
        # Three aggregates read the master here, so its columns are stored once.
        "kpi_overview": lambda m: kpi.overview(cut_lineage(m.select(*kpi.COLUMNS))),
        "kpi_repeat": kpi.repeat_counts,
        "kpi_mom_latest": kpi.latest_month_change,
        "rfm_base": lambda m: rfm.customer_base(m).withColumn("monetary", F.col("monetary").cast("double")),
        "rfm_scores": lambda m: rfm.score(rfm.customer_base(m)).select(
            "customer_unique_id", "R_score", "F_score", "M_score", "RFM_Score"
        ),
        "rfm_customers": lambda m: rfm.customers(m).select("customer_unique_id", "RFM_Score", "Segment"),
        "rfm_segments": _segments,
        "pareto_categories": concentration.pareto,
        "pareto_summary": lambda m: concentration.summary(concentration.pareto(m)),
        "viz_pareto20": lambda m: concentration.head(concentration.pareto(m)),
        "csat_delay_buckets": logistics.delay_buckets,
        "logistics_by_state": logistics.by_state,
        "payment_channels": payments.channels,
        "viz_payment_share": payments.revenue_share,
        "viz_installments": payments.installment_plans,
        "viz_monthly": charts.monthly,
        "viz_top_states": charts.top_states,
        "viz_rfm_scatter": lambda m: charts.rfm_scatter(rfm.customers(m)).withColumn(
            "monetary", F.col("monetary").cast("double")
        ),
        "fmt_segments": lambda m: presentation.segments(_segments(m)),
        "fmt_pareto": lambda m: presentation.pareto(concentration.pareto(m)),
        "fmt_state": lambda m: presentation.state_logistics(logistics.by_state(m)),
        "fmt_payment": lambda m: presentation.payment_channels(payments.channels(m)),
    }
)

# --- named queries, on the whole master and behind the dashboard filter ------------------------

for _key, _query in lab.CATALOG.items():
    _on_master(
        {
            _key: _query.build,
            f"lab_filtered_{_key[:2]}": lambda m, q=_query: q.build(filters.narrow(m, **DASHBOARD)),
        }
    )

# Free SQL text on the frame as table df.
STATE_TEXT = """
    WITH monthly AS (
        SELECT customer_state, order_year_month, count(DISTINCT order_id) AS orders, sum(total_order_value) AS revenue
        FROM df WHERE order_status = 'delivered' GROUP BY customer_state, order_year_month)
    SELECT customer_state, count(*) AS active_months, sum(orders) AS total_orders, max(orders) AS best_month_orders,
           CAST(sum(revenue) AS DOUBLE) AS total_revenue
    FROM monthly GROUP BY customer_state ORDER BY total_revenue DESC, customer_state;
"""
_on_master({"lab_sql_text": lambda m: lab.run_sql(STATE_TEXT, m)})

# --- customers, orders, reviews ----------------------------------------------------------------

_on_table(
    "customers",
    {
        "cust_count": customers.record_count,
        "cust_by_state": customers.by_state,
        "cust_by_state_asc": customers.by_state_fewest,
        "cust_top_states": customers.top_states,
        "cust_unique": customers.unique_customers,
        "cust_top_cities": customers.top_cities,
        "cust_multi_record": customers.multiple_records,
        "cust_multi_record_count": customers.multiple_record_count,
        "cust_cities": customers.city_count,
        "cust_cities_by_state": customers.cities_by_state,
        "cust_top_city_states": customers.top_city_states,
        "cust_in_state": lambda t: customers.in_state(t, HOME_STATE),
        "cust_frequency_dist": customers.record_frequency,
    },
)


def _delivery_seconds(table: DataFrame) -> DataFrame:
    """The interval column as seconds, which every client can read."""
    seconds = F.col("delivery_time").cast("interval second").cast("decimal(18,6)").cast("double")
    return orders.delivery_time(table).withColumn("delivery_time", seconds)


_on_table(
    "orders",
    {
        "ord_count": orders.order_count,
        "ord_by_status": orders.by_status,
        "ord_status_share": orders.status_share,
        "ord_delivered_pct": lambda t: orders.status_percentage(t, "delivered", "delivered_percentage"),
        "ord_success_rate": lambda t: orders.status_percentage(t, "delivered", "success_rate"),
        "ord_canceled_pct": lambda t: orders.status_percentage(t, "canceled", "canceled_percentage"),
        "ord_delivered_count": orders.delivered_count,
        "ord_by_year": orders.by_year,
        "ord_by_month": orders.by_month,
        "ord_by_weekday": orders.by_weekday,
        "ord_by_hour": orders.by_hour,
        "ord_late_summary": orders.late_summary,
        "ord_avg_delay": orders.average_delay,
        "ord_delivery_time": _delivery_seconds,
        "ord_avg_delivery_days": orders.average_delivery_days,
        "ord_late_count": orders.late_count,
        "ord_late_pct": orders.late_percentage,
        "ord_late_pct_all": orders.late_percentage_all,
        "ord_days_late": orders.days_late,
        "ord_top10_delayed": orders.most_delayed,
        "ord_missing_dates": orders.missing_dates,
        "ord_approval_hours": orders.approval_hours,
        "ord_days_to_carrier": orders.days_to_carrier,
        "ord_over_30_days": orders.longer_than,
        "ord_performance": orders.outcome_counts,
        "eda_delivery_counts": orders.floored_outcome_counts,
        "prf_delivery_describe": eda.delivery_summary,
        "prf_time_span": eda.time_span,
    },
)
_on_market("ord_bottleneck_states", orders.bottleneck_states)

_on_table(
    "reviews",
    {
        "rev_count": reviews.review_count,
        "rev_by_score": reviews.by_score,
        "rev_five_star_pct": reviews.five_star,
        "rev_one_star_pct": reviews.one_star,
        "rev_avg": reviews.average,
        "rev_sentiment": reviews.sentiment,
        "rev_unhappy_pct": reviews.unhappy,
        "rev_monthly_avg": reviews.monthly_average,
        "rev_monthly_count": reviews.monthly_count,
        "rev_comment_count": reviews.comment_count,
        "rev_comment_pct": reviews.comment_percentage,
        "rev_missing_score": reviews.missing_scores,
        "rev_duplicate_ids": reviews.duplicate_ids,
        "rev_comments_by_score": reviews.comments_by_score,
        "rev_comment_totals": reviews.comment_totals,
        "rev_latest": reviews.latest,
        "rev_latest_unhappy": reviews.latest_unhappy,
        "rev_longest": reviews.longest_comments,
        "rev_category_share": reviews.category_share,
        "dq_comments": quality.comment_split,
    },
)
_on_market("rev_by_delivery", reviews.by_delivery)

# --- exploration and data quality --------------------------------------------------------------

def _measures(market: MarketTables) -> dict[str, DataFrame]:
    """All tables without their keys, which are numbers in this data; the item's running number is no key."""

    def kept(name: str) -> bool:
        return not name.endswith("_id") or name == "order_item_id"

    return {name: t.select(*[c for c in t.columns if kept(c)]) for name, t in market.tables().items()}


_on_market("eda_monthly_sales", eda.monthly_sales)
_on_market("eda_best_worst_month", lambda k: eda.best_worst_month(eda.monthly_sales(k)))
_on_market("eda_aov_extremes", lambda k: eda.order_value_extremes(eda.monthly_sales(k)))
_on_market("eda_aov", lambda k: eda.average_order_value(eda.monthly_sales(k), k.order_items))
_on_market("eda_category_gmv", eda.category_sales)
_on_market("eda_category_orders", eda.category_orders)
_on_market("eda_customer_orders", eda.orders_per_customer_summary)
_on_market("eda_repeat_rate", eda.repeat_rate)
_on_table("order_items", {"prf_money": eda.money_totals})
_on_market("prf_schema", lambda k: quality.schema_report(k.tables()))
_on_market("prf_numeric", lambda k: quality.numeric_summary(_measures(k)))
_on_market("dq_nulls", lambda k: quality.null_report(k.tables()))
_on_market("dq_duplicates", lambda k: quality.duplicate_report(k.tables()))
_on_table("customers", {"dq_distinct": lambda t: quality.distinct_values(t, "customer_state")})
_on_table(
    "orders",
    {
        "dq_nulls_by_status": lambda t: quality.nulls_by_group(
            t,
            "order_status",
            ["order_approved_at", "order_delivered_carrier_date", "order_delivered_customer_date"],
        )
    },
)
_on_table("products", {"dq_missing_category": quality.missing_category})
_on_market("dq_missing_category_sales", quality.missing_category_sales)
_on_market("dq_orphans", quality.orphan_report)

# --- sampling, features, models ----------------------------------------------------------------

SAMPLE_ROWS = 1000


def _repeat(m: DataFrame) -> DataFrame:
    return features.repeat_features(m, HOME_STATE)


def _csat(m: DataFrame) -> DataFrame:
    return features.csat_features(m, HOME_STATE)


def _master_delay(m: DataFrame) -> DataFrame:
    return features.delay_features_on_master(m, HOME_STATE)


def _rule_scored(m: DataFrame) -> DataFrame:
    """A deterministic score (scaled delivery delay), so metrics can be checked exactly."""
    scaled = (F.col("delivery_delta_days") + 20.0) / 45.0
    return _csat(m).select(
        "order_id",
        F.col("is_low_csat").alias("label"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), scaled)).alias("score"),
    )


def _first_orders(m: DataFrame) -> DataFrame:
    return _readable(features.first_orders(m))


def _train(name: str, table: DataFrame, columns: list[str], label: str, key: str) -> training.Artifact:
    return training.train_classifier(name, table, columns, label, key)


def _train_repeat(m: DataFrame) -> training.Artifact:
    return _train("repeat", _repeat(m), features.REPEAT_FEATURES, "is_repeat_customer", "customer_unique_id")


def _train_csat(m: DataFrame) -> training.Artifact:
    return _train("csat", _csat(m), features.CSAT_FEATURES, "is_low_csat", "order_id")


def _fitted(name: str, table: DataFrame, columns: list[str], label: str):
    """The model of a stored feature table, with all boosting rounds of its settings."""
    settings = fixed.MODEL_SETTINGS[name]
    return training.fit(table, columns, label, settings["rounds"], settings["step"])


def _score_repeat(m: DataFrame) -> DataFrame:
    table = cut_lineage(_repeat(m))
    model = _fitted("repeat", table, features.REPEAT_FEATURES, "is_repeat_customer")
    scored = scoring.repeat_propensity(training.score(model, table), training.SCORE)
    return scored.select("customer_unique_id", training.SCORE, "propensity", "tier")


def _score_delay(m: DataFrame) -> DataFrame:
    table = cut_lineage(_master_delay(m))
    model = _fitted("delay", table, features.DELAY_FEATURES, "is_delayed")
    return scoring.delay_risk(training.score(model, table), training.SCORE).select("order_id", training.SCORE, "tier")


def _score_csat(m: DataFrame) -> DataFrame:
    table = cut_lineage(_csat(m))
    model = _fitted("csat", table, features.CSAT_FEATURES, "is_low_csat")
    return scoring.csat_risk(training.score(model, table), training.SCORE).select("order_id", training.SCORE, "tier")


def _delay_model(market: MarketTables) -> DataFrame:
    table = features.delay_features(market)
    settings = ("delay_normalized", table, features.DELAY_FEATURES, "is_delayed", "order_id")
    return training.train_classifier(*settings, repeats=3, floor=0.001).metrics


def _advice(market: MarketTables) -> DataFrame:
    table = cut_lineage(features.delay_features(market))
    model = _fitted("delay_normalized", table, features.DELAY_FEATURES, "is_delayed")
    advised = scoring.order_advice(training.score(model, table), training.SCORE)
    return advised.select("order_id", training.SCORE, "tier", "csat_note", "recommendations")


def _rule_advice(market: MarketTables) -> DataFrame:
    """The advice rules on a deterministic probability, so every rule can be checked exactly."""
    table = features.delay_features(market).withColumn(
        "p", F.least(F.lit(1.0), F.greatest(F.lit(0.0), (24.0 - F.col("estimated_days")) / 14.0))
    )
    advised = scoring.order_advice(table, "p")
    return advised.select("order_id", "tier", F.array_join("recommendations", "\n").alias("recommendations"))


_on_master(
    {
        "smp_fixed_n": lambda m: sample_exactly(m.select("order_id", "customer_state"), "order_id", SAMPLE_ROWS),
        "smp_stratified_split": lambda m: stratified_split(m.select("order_id", "is_late"), "order_id", "is_late"),
        "ml_delay_features_master": _master_delay,
        "ml_csat_features": _csat,
        "csat_expectation_gap": lambda m: features.expectation_gap(_csat(m)),
        "ml_threshold_metrics": lambda m: evaluation.threshold_metrics(_rule_scored(m), "label", "score", 0.45),
        "ml_confusion_pct": lambda m: evaluation.confusion_shares(
            evaluation.confusion(_rule_scored(m), "label", "score", 0.45)
        ),
        "ml_roc_auc": lambda m: evaluation.ranking_metrics(_rule_scored(m), "label", "score").select(
            "roc_auc", "sample_size"
        ),
        "ml_avg_precision": lambda m: evaluation.ranking_metrics(_rule_scored(m), "label", "score").select(
            F.round("pr_auc", 9).alias("pr_auc")  # the SQL sums doubles in any order
        ),
        "ml_csat_model": lambda m: _train_csat(m).metrics,
        "ml_permutation_importance": lambda m: _train_csat(m).importances,
        "ml_score_delay": _score_delay,
        "ml_score_csat": _score_csat,
    }
)
_on_master(
    {
        "ml_first_orders": _first_orders,
        "ml_repeat_features": _repeat,
        "ml_repeat_model": lambda m: _train_repeat(m).metrics,
        "ml_score_repeat": _score_repeat,
    },
    lifetime=False,
)
_on_market("ml_delay_features", features.delay_features)
_on_market("ml_delay_model", _delay_model)
_on_market("ml_recommendations", _advice)
_on_market("ml_recommendation_rules", _rule_advice)

# --- time series and what-if -------------------------------------------------------------------


def _months(m: DataFrame) -> DataFrame:
    return forecast.monthly(m, STATE, FIRST_MONTH, LAST_MONTH)


def _lines(m: DataFrame) -> DataFrame:
    return forecast.series(_months(m), STATE)


def _ahead(m: DataFrame) -> DataFrame:
    return forecast.forecast_all(_lines(m), STATE)


LEVELS = {"nation": None, "state": "customer_state", "category": "category_english"}
SERIES = ["series"]


def _level_months(m: DataFrame) -> DataFrame:
    return forecast.monthly_levels(m, LEVELS, FIRST_MONTH, LAST_MONTH)


def _level_lines(m: DataFrame) -> DataFrame:
    return forecast.series(_level_months(m), SERIES)


def _level_ahead(m: DataFrame) -> DataFrame:
    return forecast.forecast_all(_level_lines(m), SERIES)


_on_master(
    {
        "ts_levels_monthly": _level_months,
        "ts_levels_fit": lambda m: forecast.fit_report(forecast.fit(_level_lines(m)), SERIES),
        "ts_levels_backtest": lambda m: forecast.backtest(_level_lines(m), SERIES),
        "ts_levels_forecast": _level_ahead,
        "ts_levels_quarter_growth": lambda m: forecast.quarter_growth(_level_lines(m), _level_ahead(m), SERIES),
        "ts_levels_scenarios": lambda m: forecast.scenarios(_level_ahead(m)),
        "fmt_scenarios": lambda m: presentation.forecast(forecast.scenarios(_level_ahead(m)), [*SERIES, "scenario"]),
        "ts_monthly": _months,
        "ts_damped_fit": lambda m: forecast.fit_report(forecast.fit(_lines(m)), STATE),
        "ts_backtest": lambda m: forecast.backtest(_lines(m), STATE),
        "ts_forecast": lambda m: forecast.forecast(forecast.fit(_lines(m)), STATE),
        "ts_forecast_all": _ahead,
        "ts_fallback": lambda m: forecast.fallback(_lines(m), STATE),
        "ts_quarter_growth": lambda m: forecast.quarter_growth(_lines(m), _ahead(m), STATE),
        "ts_scenarios": lambda m: forecast.scenarios(_ahead(m)),
        "fmt_forecast": lambda m: presentation.forecast(_ahead(m), STATE),
        "whatif_sweep": lambda m: whatif.sweep(whatif.group_figures(m, STATE)),
    }
)
