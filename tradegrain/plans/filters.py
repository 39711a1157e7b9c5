"""Dashboard filters over the master table."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def narrow(
    master: DataFrame,
    start: date | str | None = None,
    end: date | str | None = None,
    states: Sequence[str] = (),
    categories: Sequence[str] = (),
) -> DataFrame:
    """Keep an inclusive date range and the listed states and categories; an empty list keeps all.

    With both dates given, rows without a purchase date drop out.
    """
    kept = master
    if start is not None and end is not None:
        kept = kept.where(F.col("order_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    if states:
        kept = kept.where(F.col("customer_state").isin(*states))
    if categories:
        kept = kept.where(F.col("category_english").isin(*categories))
    return kept


def filter_choices(master: DataFrame) -> DataFrame:
    """What the filters can offer: date bounds, states and categories as (kind, choice) rows.

    One pass: (state, category) groups carry their date bounds, then every group lists its four values
    and equal values fold together. ISO dates order as text.
    """
    bought = F.col("order_purchase_timestamp")
    groups = master.groupBy("customer_state", "category_english").agg(
        F.min(bought).alias("first"), F.max(bought).alias("last")
    )
    offers = {
        "first_date": F.to_date("first").cast("string"),
        "last_date": F.to_date("last").cast("string"),
        "state": F.col("customer_state"),
        "category": F.col("category_english"),
    }
    listed = groups.select(
        F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("choice")) for k, v in offers.items()]))
    ).where(F.col("choice").isNotNull())
    own_group = F.when(F.col("kind").isin("state", "category"), F.col("choice"))
    bounds = listed.groupBy("kind", own_group.alias("_own")).agg(
        F.min("choice").alias("low"), F.max("choice").alias("high")
    )
    choice = F.when(F.col("kind") == "last_date", F.col("high")).otherwise(F.col("low"))
    return bounds.select("kind", choice.alias("choice")).orderBy("kind", "choice")
