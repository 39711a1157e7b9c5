"""Exact order statistics without sorting the rows.

A histogram over an order-preserving whole-number key is refined until each wanted rank lies in a single value. Only rows
with that value are ranked, by the tie-breaking column. A pass over the rows sends counts only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradegrain.operators.ordered import number_rows

_CELLS = 16_384


def whole_number(df: DataFrame, value: str) -> Column:
    """An exact whole-number column in the order of a whole or decimal column; null stays null."""
    kind = df.schema[value].dataType
    if isinstance(kind, T.DecimalType):
        # More than 18 digits do not fit and are an error, not a wrong rank.
        return (F.col(value) * F.lit(10**kind.scale)).cast("decimal(38,0)").cast("long")
    if not isinstance(kind, T.IntegralType):
        raise TypeError(f"{value} is neither whole nor decimal")
    return F.col(value).cast("long")


@dataclass
class _Search:
    """Keys from low to high hold the wanted row; ``rank`` is its place among them, ``n`` their number."""

    low: int
    high: int
    rank: int
    n: int


def _narrowed(keyed: DataFrame, open_: list[_Search]) -> None:
    """One pass over the rows: each search goes on in the cell that holds its rank."""
    ranges = sorted({(s.low, s.high) for s in open_})
    cells = []
    for i, (low, high) in enumerate(ranges):
        width = -(-(high - low + 1) // _CELLS)
        here = F.struct(F.lit(i).alias("range"), F.expr(f"(key - {low}L) DIV {width}L").alias("cell"))
        cells.append(F.when(F.col("key").between(low, high), here))
    counts = keyed.select(F.coalesce(*cells).alias("at")).where("at IS NOT NULL").groupBy("at.range", "at.cell").agg(F.count(F.lit(1)).alias("n"))
    found = sorted((r["range"], r["cell"], r["n"]) for r in counts.collect())  # at most _CELLS rows per search
    for search in open_:
        place = ranges.index((search.low, search.high))
        low, high = search.low, search.high
        width = -(-(high - low + 1) // _CELLS)
        for _, cell, n in (f for f in found if f[0] == place):
            if search.rank <= n:
                search.low, search.n = low + cell * width, n
                search.high = min(high, search.low + width - 1)
                break
            search.rank -= n


def rows_at(df: DataFrame, value: str, tie: str, ranks: list[int]) -> list[tuple[int | None, object]]:
    """(key, tie), in order, of the rows of the given 1-based ranks in order of ``value`` (null first), then ``tie``.

    ``tie`` must be unique, and the ranks between 1 and the number of rows. ``df`` is read a few times, so store it if it
    is costly.
    """
    keyed = df.select(whole_number(df, value).alias("key"), F.col(tie).alias("tie"))
    nulls, low, high, n = keyed.agg(F.count_if(F.col("key").isNull()), F.min("key"), F.max("key"), F.count("key")).first()
    searches = [_Search(low, high, rank - nulls, n) for rank in ranks if rank > nulls]
    while open_ := [s for s in searches if s.low < s.high]:
        _narrowed(keyed, open_)
    # Only rows of a wanted key are put in order; how many lie before them is known.
    sizes = {None: nulls} | {s.low: s.n for s in searches}
    wanted = {rank for rank in ranks if rank <= nulls}
    needed = [None] * bool(wanted) + sorted(k for k in sizes if k is not None)
    before = {key: sum(sizes[k] for k in needed[:i]) for i, key in enumerate(needed)}
    places = [(None, rank) for rank in ranks if rank <= nulls] + [(s.low, before[s.low] + s.rank) for s in searches]
    same = keyed.where(F.col("key").isin(*[k for k in needed if k is not None]) | F.col("key").isNull() & F.lit(bool(wanted)))
    ranked = number_rows(same, [F.col("key").asc_nulls_first(), F.col("tie")], "place")
    ties = {r["place"]: r["tie"] for r in ranked.where(F.col("place").isin(*{place for _, place in places})).collect()}
    return sorted(((key, ties[place]) for key, place in places), key=lambda cut: (cut[0] is not None, cut[0] or 0, cut[1]))


def quartiles(df: DataFrame, value: str, tie: str, rows: int) -> Column:
    """Quartile 1..4 of every row by its rank in order of ``value`` (null first), then ``tie``.

    Quartile q ends at rank 1 + q * (rows - 1) / 4, as ``ordered.quartile`` has it; a single row is quartile 1. The column
    compares with three rows, so it may be used on any rows of ``df``.
    """
    if rows < 2:
        return F.lit(1)
    kind = df.schema[tie].dataType
    mine = F.struct(F.col(value).isNotNull(), F.coalesce(whole_number(df, value), F.lit(0)), F.col(tie))
    above = F.lit(1)
    for key, last in rows_at(df, value, tie, [1 + q * (rows - 1) // 4 for q in (1, 2, 3)]):
        edge = F.struct(F.lit(key is not None), F.lit(key or 0).cast("long"), F.lit(last).cast(kind))
        above = above + F.when(mine > edge, 1).otherwise(0)
    return above.cast("int")
