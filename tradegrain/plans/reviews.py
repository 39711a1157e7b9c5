"""Review scores, comments and satisfaction over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tradegrain.functions.names import row_count
from tradegrain.functions.numeric import mean, percent, ratio, round_up, share_of
from tradegrain.functions.temporal import delivered_label, month_start
from tradegrain.functions.text import is_filled
from tradegrain.sources.market import MarketTables


def score() -> Column:
    return F.col("review_score")


def written() -> Column:
    return F.col("review_creation_date")


def has_comment() -> Column:
    return is_filled(F.col("review_comment_message"))


def review_count(reviews: DataFrame) -> DataFrame:
    return reviews.agg(row_count().alias("total_reviews"))


def by_score(reviews: DataFrame) -> DataFrame:
    """Reviews per score, missing scores first."""
    return reviews.groupBy("review_score").agg(row_count().alias("total_reviews")).orderBy(
        score().desc_nulls_first()
    )


def percentage(reviews: DataFrame, flag: Column, name: str) -> DataFrame:
    return reviews.agg(round_up(share_of(flag) * 100.0, 2).alias(name))


def five_star(reviews: DataFrame) -> DataFrame:
    return percentage(reviews, score() == 5, "five_star_percentage")


def one_star(reviews: DataFrame) -> DataFrame:
    return percentage(reviews, score() == 1, "one_star_percentage")


def unhappy(reviews: DataFrame) -> DataFrame:
    return percentage(reviews, score().isin(1, 2), "unhappy_percentage")


def average(reviews: DataFrame) -> DataFrame:
    return reviews.agg(round_up(mean("review_score"), 2).alias("average_review_score"))


def sentiment(reviews: DataFrame) -> DataFrame:
    """Three moods; a missing score has no mood and keeps its own group."""
    mood = F.when(score().isin(1, 2), "Unhappy").when(score() == 3, "Neutral").when(score().isin(4, 5), "Happy")
    return reviews.groupBy(mood.alias("customer_sentiment")).agg(row_count().alias("total_reviews")).orderBy(
        F.desc("total_reviews"), "customer_sentiment"
    )


def category_share(reviews: DataFrame) -> DataFrame:
    """Positive, neutral, negative with their share; a missing score is negative."""
    mood = F.when(score() >= 4, "Positive").when(score() == 3, "Neutral").otherwise("Negative")
    counted = reviews.groupBy(mood.alias("review_category")).agg(row_count().alias("total_reviews"))
    whole = F.sum("total_reviews").over(W.partitionBy())  # three rows
    share = round_up(percent(F.col("total_reviews"), whole), 2)
    return counted.withColumn("percentage", share).orderBy(F.desc("total_reviews"), "review_category")


def _monthly(reviews: DataFrame, measure: Column) -> DataFrame:
    return reviews.groupBy(month_start(written()).alias("review_month")).agg(measure).orderBy("review_month")


def monthly_average(reviews: DataFrame) -> DataFrame:
    return _monthly(reviews, round_up(mean("review_score"), 2).alias("average_rating"))


def monthly_count(reviews: DataFrame) -> DataFrame:
    return _monthly(reviews, row_count().alias("total_reviews"))


def comment_count(reviews: DataFrame) -> DataFrame:
    return reviews.agg(F.count_if(has_comment()).alias("reviews_with_comments"))


def comment_percentage(reviews: DataFrame) -> DataFrame:
    return percentage(reviews, has_comment(), "comment_percentage")


def missing_scores(reviews: DataFrame) -> DataFrame:
    return reviews.agg(F.count_if(score().isNull()).alias("missing_review_scores"))


def duplicate_ids(reviews: DataFrame) -> DataFrame:
    counted = reviews.groupBy("review_id").agg(row_count().alias("occurrences"))
    return counted.where(F.col("occurrences") > 1).orderBy(F.desc("occurrences"), "review_id")


def comments_by_score(reviews: DataFrame) -> DataFrame:
    counted = reviews.groupBy("review_score").agg(F.count_if(has_comment()).alias("reviews_with_comments"))
    return counted.orderBy(score().desc_nulls_first())


def comment_totals(reviews: DataFrame) -> DataFrame:
    return (
        reviews.groupBy("review_score")
        .agg(row_count().alias("total_reviews"), F.count_if(has_comment()).alias("reviews_with_comments"))
        .orderBy(score().asc_nulls_last())
    )


_LISTED = ["review_id", "order_id", "review_score", "review_comment_message", "review_creation_date"]


def latest(reviews: DataFrame, rows: int = 10) -> DataFrame:
    return reviews.select(*_LISTED).orderBy(written().desc_nulls_first(), "review_id", "order_id").limit(rows)


def latest_unhappy(reviews: DataFrame, rows: int = 20) -> DataFrame:
    return latest(reviews.where(score().isin(1, 2)), rows)


def longest_comments(reviews: DataFrame, rows: int = 10) -> DataFrame:
    message = F.col("review_comment_message")
    return (
        reviews.where(message.isNotNull())
        .select("review_id", "review_score", F.length(message).cast("bigint").alias("comment_length"), message)
        .orderBy(F.desc("comment_length"), "review_id", "review_score")
        .limit(rows)
    )


def by_delivery(market: MarketTables) -> DataFrame:
    """Mean score of late and on-time deliveries.

    Reviews are summed per order before the join, so an order with very many reviews joins as one row.
    """
    arrived, promised = F.col("order_delivered_customer_date"), F.col("order_estimated_delivery_date")
    per_order = market.reviews.groupBy("order_id").agg(
        F.count("review_id").alias("reviews"),
        F.sum("review_score").alias("points"),
        F.count("review_score").alias("scored"),
    )
    dated = market.orders.where(
        (F.col("order_status") == "delivered") & arrived.isNotNull() & promised.isNotNull()
    ).select("order_id", delivered_label(arrived, promised).alias("delivery_status"))
    return (
        dated.join(per_order, "order_id")
        .groupBy("delivery_status")
        .agg(
            F.sum("reviews").alias("total_reviews"),
            round_up(ratio(F.sum("points"), F.sum("scored")), 2).alias("average_review_score"),
        )
    )
