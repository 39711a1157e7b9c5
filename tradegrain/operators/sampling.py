"""Exact-size samples and splits in a reproducible pseudo-random order.

Order is the MD5 of key and seed. A histogram over the first hash digits (at most 65,536 rows per
label) tells how many rows lie below each digit group, so ranking needs no global sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tradegrain.operators.grouping import join_groups

_DIGITS = 4


def shuffle_key(key: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))))


def shuffled_positions(
    df: DataFrame, key: str, seed: int, name: str, within: str | None = None, size: str | None = None
) -> DataFrame:
    """Add the 1-based position of each row in hash order, per value of ``within`` if given.

    ``key`` must be unique. ``size`` optionally names a column for the row count of the group.
    """
    groups = [within] if within else []
    hashed = df.withColumn("_hash", shuffle_key(F.col(key), seed)).withColumn(
        "_cell", F.substring("_hash", 1, _DIGITS)
    )
    frame = W.partitionBy(*groups)
    cells = (
        hashed.groupBy(*groups, "_cell")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            *groups,
            "_cell",
            (F.sum("_n").over(frame.orderBy("_cell")) - F.col("_n")).alias("_below"),
            F.sum("_n").over(frame).alias("_group"),
        )
    )
    # Evenly filled cells; the shuffle on them serves both this join and the ranking inside a cell.
    placed = join_groups(hashed, cells, groups, plain=("_cell",))
    inside = W.partitionBy(*groups, "_cell").orderBy("_hash", key)
    placed = placed.withColumn(name, F.col("_below") + F.row_number().over(inside))
    if size:
        placed = placed.withColumn(size, F.col("_group"))
    return placed.drop("_hash", "_cell", "_below", "_group")


def sample_exactly(df: DataFrame, key: str, rows: int, seed: int = 42) -> DataFrame:
    """Exactly ``rows`` rows drawn uniformly, or all of them when there are fewer.

    ``df`` is read twice and never shuffled: counts per cell say which cells the sample fills, and only rows of these
    cells, one cell's worth more than the sample, are ranked.
    """
    hashed = df.withColumn("_hash", shuffle_key(F.col(key), seed)).withColumn("_cell", F.substring("_hash", 1, _DIGITS))
    counts = hashed.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n"))
    below = F.sum("_n").over(W.orderBy("_cell")) - F.col("_n")
    cells = counts.select("_cell", below.alias("_below")).where(F.col("_below") < rows)
    # At most 16 ** _DIGITS short rows.
    near = hashed.join(F.broadcast(cells), "_cell")
    place = F.row_number().over(W.partitionBy("_cell").orderBy("_hash", key))
    placed = near.withColumn("_position", F.col("_below") + place)
    return placed.where(F.col("_position") <= rows).select(*df.columns)


def stratified_split(
    df: DataFrame, key: str, label: str, test_fraction: float = 0.2, seed: int = 42
) -> DataFrame:
    """Add ``is_test``: the first ``ceil(fraction * n)`` rows of each label in hash order."""
    placed = shuffled_positions(df, key, seed, "_position", within=label, size="_size")
    is_test = F.col("_position") <= F.ceil(F.col("_size") * test_fraction)
    return placed.withColumn("is_test", is_test).drop("_position", "_size")
