"""Exact summary statistics of many columns from one value histogram."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradegrain.functions.numeric import ratio
from tradegrain.operators.ordered import running_totals

_EXACT = "decimal(18,6)"


def tall(df: DataFrame, columns: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per (column, value), nulls left out."""
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast(_EXACT).alias("value")) for c in columns])
    return df.select(*keep, F.inline(pairs)).where(F.col("value").isNotNull())


def summarize(values: DataFrame, by: list[str]) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum of ``value`` per group.

    Groups are described columns, so there are few of them. Values are counted first, so equal values cost one row each; quartiles interpolate linearly
    between the two neighbouring ranks, found by running counts in value order.
    """
    counted = values.groupBy(*by, "value").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("value").alias("s"),
        F.sum(F.col("value") * F.col("value")).alias("ss"),
    )
    ranked = running_totals(counted, by, [F.col("value")], {"upto": "n"})
    sizes = ranked.groupBy(*by).agg(F.sum("n").alias("size"))
    probabilities = {"p25": 0.25, "p50": 0.50, "p75": 0.75}

    def at(position: Column) -> Column:
        return F.min(F.when(F.col("upto") > position, F.col("value"))).cast("double")

    picks = []
    for name, p in probabilities.items():
        spot = (F.col("size") - 1) * p
        picks += [at(F.floor(spot)).alias(f"{name}_low"), at(F.ceil(spot)).alias(f"{name}_high")]
    stats = (
        ranked.join(F.broadcast(sizes), by)  # one row per described column
        .groupBy(*by, "size")
        .agg(
            F.sum("s").cast("double").alias("sum"),
            F.sum("ss").cast("double").alias("squares"),
            F.min("value").cast("double").alias("min"),
            F.max("value").cast("double").alias("max"),
            *picks,
        )
    )
    size = F.col("size").cast("double")
    spread = F.try_divide(F.col("squares") - F.col("sum") * F.col("sum") / size, size - 1.0)

    def between(name: str, p: float) -> Column:
        spot = (F.col("size") - 1) * p
        low, high = F.col(f"{name}_low"), F.col(f"{name}_high")
        return (low + (high - low) * (spot - F.floor(spot))).alias(name)

    return stats.select(
        *by,
        F.col("size").alias("count"),
        ratio(F.col("sum"), size).alias("mean"),
        F.when(spread.isNotNull(), F.sqrt(F.greatest(spread, F.lit(0.0)))).alias("std"),
        "min",
        *[between(name, p) for name, p in probabilities.items()],
        "max",
    )
