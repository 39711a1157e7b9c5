"""Global order without a single-partition window.

Rows are range-partitioned and sorted once, the result is checkpointed (range bounds are sampled, so
a second evaluation could cut elsewhere), and per-partition totals give every partition its offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tradegrain.operators.grouping import join_groups
from tradegrain.session import cut_lineage

_MARK, _SLOT = "_mark", "_slot"
_SEQUENCE_BITS = 33  # monotonically_increasing_id keeps the partition number above these bits


def _sorted_once(df: DataFrame, order: list[Column]) -> DataFrame:
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    stored = cut_lineage(placed.withColumn(_MARK, F.monotonically_increasing_id()))
    return stored.withColumn(_SLOT, F.shiftright(F.col(_MARK), _SEQUENCE_BITS))


def number_rows(df: DataFrame, order: list[Column], name: str, total: str | None = None) -> DataFrame:
    """Add the 1-based position of each row in the global order (and the row count as ``total``).

    ``order`` must break all ties for the result to be unique.
    """
    stored = _sorted_once(df, order)
    everything = W.orderBy(_SLOT)
    offsets = (
        stored.groupBy(_SLOT)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(
            _SLOT,
            (F.sum("_rows").over(everything) - F.col("_rows")).alias("_before"),
            F.sum("_rows").over(everything.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("_all"),
        )
    )
    # One row per partition of the sort, so the broadcast is bounded by the partition count.
    placed = stored.join(F.broadcast(offsets), _SLOT)
    in_slot = F.col(_MARK).bitwiseAND(F.lit((1 << _SEQUENCE_BITS) - 1))
    placed = placed.withColumn(name, F.col("_before") + in_slot + 1)
    if total:
        placed = placed.withColumn(total, F.col("_all"))
    return placed.drop(_MARK, _SLOT, "_before", "_all")


def running_totals(df: DataFrame, by: list[str], order: list[Column], totals: dict[str, str]) -> DataFrame:
    """Add inclusive running sums per ``by`` group in ``order``.

    ``totals`` maps a new column to the column it sums. A group may span many partitions: each
    partition sums its own stretch and adds what earlier partitions hold of the same group.
    """
    stored = _sorted_once(df, [F.col(c) for c in by] + order)
    stretch = W.partitionBy(_SLOT, *by)
    earlier = W.partitionBy(*by).orderBy(_SLOT)
    pieces = stored.groupBy(_SLOT, *by).agg(*[F.sum(src).alias(src) for src in totals.values()])
    offsets = pieces.select(
        _SLOT,
        *by,
        *[(F.sum(src).over(earlier) - F.col(src)).alias(f"_{new}_before") for new, src in totals.items()],
    )
    upto = stretch.orderBy(_MARK).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = stored.withColumns({new: F.sum(src).over(upto) for new, src in totals.items()})
    joined = join_groups(local, offsets, by, plain=(_SLOT,))
    added = joined.withColumns({new: F.col(new) + F.col(f"_{new}_before") for new in totals})
    return added.drop(_MARK, _SLOT, *[f"_{new}_before" for new in totals])


def quartile(position: Column, rows: Column) -> Column:
    """Quartile 1..4 of a 1-based rank with edges interpolated over ``rows`` ranks.

    Edges lie at 1 + q*(rows-1)/4, which differs from ``ntile(4)``. A single row is quartile 1.
    """
    steps = F.ceil(F.try_divide((position - 1) * 4, rows - 1))
    return F.greatest(F.lit(1), F.coalesce(steps, F.lit(1))).cast("int")
