"""Model features as column expressions: fill first where a default exists, then clip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradegrain import fixed
from tradegrain.functions.names import arrived, bought, is_delivered, promised
from tradegrain.functions.numeric import as_double, clip, clip_or, mean, percent, ratio, round_even, tiered
from tradegrain.functions.temporal import elapsed_days, late_by_clock
from tradegrain.operators.grouping import complete, first_per_key, labelled
from tradegrain.operators.sampling import sample_exactly
from tradegrain.operators.skew import lookup_join
from tradegrain.plans.logistics import star_percent
from tradegrain.sources.market import MarketTables

# Feature lists in model order.
REPEAT_FEATURES = [
    "first_order_value",
    "first_order_freight",
    "freight_ratio",
    "payment_installments",
    "first_review_score",
    "delivery_duration_days",
    "delivery_delta_days",
    "is_interstate",
]
DELAY_FEATURES = [
    "price",
    "freight_value",
    "freight_ratio",
    "product_weight_g",
    "product_volume_cm3",
    "is_interstate",
    "estimated_days",
    "purchase_dayofweek",
    "purchase_month",
]
CSAT_FEATURES = [
    "delivery_delta_days",
    "delivery_duration_days",
    "price",
    "freight_ratio",
    "payment_installments",
    "is_late",
    "is_interstate",
]


def freight_ratio(price: Column, freight: Column) -> Column:
    return clip(freight / (price + freight + 1e-5), 0, 1)


def flag(condition: Column) -> Column:
    return condition.cast("int")


def away_from_home(home_state: str) -> Column:
    """1 unless the customer lives in the home state; a missing state counts as away."""
    return flag(~F.col("customer_state").eqNullSafe(F.lit(home_state)))


def _finish(df: DataFrame, key: str, columns: list[str], max_rows: int | None) -> DataFrame:
    """Drop incomplete rows; cap the table at an exact sample only when asked to."""
    ready = df.select(key, *columns).na.drop(subset=columns)
    return ready if max_rows is None else sample_exactly(ready, key, max_rows)


def first_orders(master: DataFrame) -> DataFrame:
    """The earliest order of each customer, with the number of their orders; ties go to the smaller id.

    Without a ``customer_lifetime_orders`` column the count comes from the same aggregate, which spares
    joining it to every order first.
    """
    counted = "customer_lifetime_orders" in master.columns
    wanted = [
        "customer_unique_id",
        "order_id",
        "order_purchase_timestamp",
        "order_delivered_customer_date",
        "delivery_delay_days",
        "customer_state",
        "price",
        "freight_value",
        "payment_installments",
        "review_score",
    ]
    wanted += [c for c in ("customer_lifetime_orders", "avg_delivery_days") if c in master.columns]
    dated = master.select(*wanted).withColumn("undated", bought().isNull())
    order = ["undated", "order_purchase_timestamp", "order_id"]
    orders_made = {} if counted else {"customer_lifetime_orders": F.count_distinct("order_id")}
    return first_per_key(dated, ["customer_unique_id"], order, orders_made).drop("undated")


def repeat_features(
    master: DataFrame, home_state: str = fixed.HOME_STATE, max_rows: int | None = None
) -> DataFrame:
    """First-order experience per customer with the label "ordered again"."""
    first = first_orders(master)
    spent = F.col("avg_delivery_days") if "avg_delivery_days" in first.columns else elapsed_days(arrived(), bought())
    value, freight = F.col("first_order_value"), F.col("first_order_freight")
    shaped = (
        first.withColumns(
            {
                "first_order_value": clip(as_double("price"), 10, 5000),
                "first_order_freight": clip(as_double("freight_value"), 1, 500),
            }
        )
        .withColumns(
            {
                "freight_ratio": freight_ratio(value, freight),
                "payment_installments": clip_or(F.col("payment_installments"), 1, 1, 24),
                "first_review_score": clip_or(F.col("review_score"), 4, 1, 5),
                "delivery_duration_days": clip_or(spent, 12, 1, 60),
                "delivery_delta_days": clip_or(F.col("delivery_delay_days"), 0, -20, 30),
                "is_interstate": away_from_home(home_state),
                "is_repeat_customer": flag(F.coalesce(F.col("customer_lifetime_orders") > 1, F.lit(False))),
            }
        )
    )
    return _finish(shaped, "customer_unique_id", [*REPEAT_FEATURES, "is_repeat_customer"], max_rows)


def delay_features_on_master(
    master: DataFrame, home_state: str = fixed.HOME_STATE, max_rows: int | None = None
) -> DataFrame:
    """Delay features of delivered orders; weight and volume default when the frame has none."""
    orders = master.where(F.col("order_status") == "delivered") if "order_status" in master.columns else master

    def column_or(name: str, default: float) -> Column:
        return F.col(name) if name in master.columns else F.lit(default)

    if "is_late" in master.columns:
        late = F.col("is_late")
    else:
        late = F.coalesce(late_by_clock(arrived(), promised()), F.lit(False))
    weight = column_or("product_weight_g", fixed.DEFAULT_WEIGHT_G)
    volume = column_or("product_volume_cm3", fixed.DEFAULT_VOLUME_CM3)
    shaped = orders.withColumns(
        {
            "is_delayed": flag(late),
            "price": clip(as_double("price"), 10, 3000),
            "freight_value": clip(as_double("freight_value"), 5, 300),
            "product_weight_g": clip_or(weight, fixed.DEFAULT_WEIGHT_G, 50, 30000),
            "product_volume_cm3": clip_or(volume, fixed.DEFAULT_VOLUME_CM3, 100, 100000),
            "is_interstate": away_from_home(home_state),
            "estimated_days": clip_or(elapsed_days(promised(), bought()), 22, 1, 90),
            "purchase_dayofweek": F.coalesce(F.weekday(bought()), F.lit(2)),
            "purchase_month": F.coalesce(F.month(bought()), F.lit(6)),
        }
    ).withColumn("freight_ratio", freight_ratio(F.col("price"), F.col("freight_value")))
    return _finish(shaped, "order_id", [*DELAY_FEATURES, "is_delayed"], max_rows)


def _item_figures(market: MarketTables) -> DataFrame:
    """Item sums, first seller and mean product dimensions per order.

    Products are folded to one row per id first, so a repeated product id cannot inflate item sums.
    """
    sizes = ["product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm"]
    folded = market.products.groupBy("product_id").agg(
        *[F.sum(c).alias(f"{c}_sum") for c in sizes], *[F.count(c).alias(f"{c}_n") for c in sizes]
    )
    first_seller = F.min_by(
        "seller_id",
        F.when(F.col("seller_id").isNotNull(), F.struct("order_item_id", "product_id", "seller_id")),
    )
    return (
        lookup_join(market.order_items, folded, "product_id")
        .groupBy("order_id")
        .agg(
            as_double(F.sum("price")).alias("price"),
            as_double(F.sum("freight_value")).alias("freight_value"),
            first_seller.alias("seller_id"),
            *[ratio(F.sum(f"{c}_sum"), F.sum(f"{c}_n")).alias(c) for c in sizes],
        )
    )


def delay_features(market: MarketTables, max_rows: int | None = None) -> DataFrame:
    """Delay features from the normalized tables; the route compares customer and seller state."""
    orders = market.orders.where(
        (F.col("order_status") == "delivered") & arrived().isNotNull() & promised().isNotNull()
    )
    buyer = market.customers.select("customer_id", "customer_state").distinct()
    joined = orders.join(_item_figures(market), "order_id").join(buyer, "customer_id", "left")
    if market.sellers is not None:
        joined = joined.join(market.sellers.select("seller_id", "seller_state").distinct(), "seller_id", "left")
    else:  # without sellers every route counts as interstate
        joined = joined.withColumn("seller_state", F.lit(None).cast("string"))
    side = {k: F.coalesce(f"product_{k}_cm", F.lit(v)) for k, v in fixed.DEFAULT_DIMENSIONS_CM.items()}
    shaped = joined.select(
        "order_id",
        "price",
        "freight_value",
        freight_ratio(F.col("price"), F.col("freight_value")).alias("freight_ratio"),
        clip_or(F.col("product_weight_g"), fixed.DEFAULT_WEIGHT_G, 50, 30000).alias("product_weight_g"),
        clip(side["length"] * side["height"] * side["width"], 100, 150000).alias("product_volume_cm3"),
        flag(F.coalesce(F.col("customer_state") != F.col("seller_state"), F.lit(True))).alias("is_interstate"),
        clip(elapsed_days(promised(), bought()), 1, 90).alias("estimated_days"),
        F.weekday(bought()).alias("purchase_dayofweek"),
        F.month(bought()).alias("purchase_month"),
        flag(late_by_clock(arrived(), promised())).alias("is_delayed"),
    )
    return _finish(shaped, "order_id", [*DELAY_FEATURES, "is_delayed"], max_rows)


def csat_features(
    master: DataFrame, home_state: str = fixed.HOME_STATE, max_rows: int | None = None
) -> DataFrame:
    """Order experience with the label "scored three stars or fewer"."""
    delay = F.col("delivery_delay_days") if "delivery_delay_days" in master.columns else elapsed_days(arrived(), promised())
    price, freight = clip(as_double("price"), 10, 3000), clip(as_double("freight_value"), 5, 300)
    shaped = master.where(F.col("review_score").isNotNull()).select(
        "order_id",
        "review_score",
        clip_or(delay, 0, -20, 25).alias("delivery_delta_days"),
        clip_or(elapsed_days(arrived(), bought()), 12, 1, 60).alias("delivery_duration_days"),
        price.alias("price"),
        freight_ratio(price, freight).alias("freight_ratio"),
        clip_or(F.col("payment_installments"), 1, 1, 24).alias("payment_installments"),
        away_from_home(home_state).alias("is_interstate"),
        flag(F.col("review_score") <= 3).alias("is_low_csat"),
    ).withColumn("is_late", flag(F.col("delivery_delta_days") > 0))
    return _finish(shaped, "order_id", [*CSAT_FEATURES, "is_low_csat", "review_score"], max_rows)


def expectation_gap(features: DataFrame) -> DataFrame:
    """Mean score, one-star share and orders per delivery bin; empty bins stay with count 0."""
    bin_ = tiered(F.col("delivery_delta_days"), fixed.GAP_BOUNDS, fixed.GAP_BINS)
    measured = features.groupBy(bin_.alias("delta_bucket")).agg(
        mean("review_score").alias("avg_review"),
        star_percent(1).alias("pct_1_star"),
        F.count("review_score").alias("order_count"),
    )
    bins = labelled(features.sparkSession, "delta_bucket", fixed.GAP_BINS)
    return (
        complete(bins, measured, "delta_bucket")
        .withColumn("order_count", F.coalesce("order_count", F.lit(0)))
        .orderBy("position")
        .drop("position")
    )
