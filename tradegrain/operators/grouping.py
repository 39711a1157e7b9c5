"""Grouping helpers: complete group lists and most frequent values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def labelled(spark: SparkSession, column: str, labels: list, position: str = "position") -> DataFrame:
    """A small ordered list of group labels as rows."""
    return spark.range(1).select(F.posexplode(F.array(*map(F.lit, labels))).alias(position, column))


def complete(groups: DataFrame, measured: DataFrame, column: str) -> DataFrame:
    """Every listed group once, with nulls where nothing was measured."""
    return groups.join(measured, column, "left")


def join_groups(rows: DataFrame, figures: DataFrame, keys: list[str], plain: tuple[str, ...] = ()) -> DataFrame:
    """Give every row the figures of its group; a null key is a group like any other.

    ``plain`` keys are never null and join by ordinary equality.
    """
    renamed = figures.withColumnsRenamed({k: f"_group_{k}" for k in (*keys, *plain)})
    matches = [F.col(k) == F.col(f"_group_{k}") for k in plain]
    matches += [F.col(k).eqNullSafe(F.col(f"_group_{k}")) for k in keys]
    return rows.join(renamed, matches).drop(*[f"_group_{k}" for k in (*keys, *plain)])


def first_per_key(
    df: DataFrame, keys: list[str], order: list[str], also: dict[str, Column] | None = None
) -> DataFrame:
    """The whole row that comes first in ``order`` for each key, and further aggregates of the key.

    An aggregate rather than a window: each map task keeps one row per key, so a key holding a third
    of the table never meets in one task.
    """
    rest = [c for c in df.columns if c not in {*keys, *order}]
    packed = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest])
    more = {name: col.alias(name) for name, col in (also or {}).items()}
    best = df.groupBy(*keys).agg(F.min_by(packed, F.struct(*order)).alias("_row"), *more.values())
    return best.select(*keys, "_row.*", *more).select(*df.columns, *more)
