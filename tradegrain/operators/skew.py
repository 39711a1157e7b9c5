"""Lookup joins that survive a key holding a large part of the fact table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CHECK = "_key_hash"


def lookup_join(fact: DataFrame, lookup: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join a lookup table that was aggregated to one row per key.

    Adaptive execution splits an oversized partition of the fact side, but only where both join inputs
    are fresh shuffles. An aggregate on the key alone would hand its own partitioning to the join and
    so switch that off. Joining on the key and its hash asks for a new, narrow shuffle of the lookup
    side instead, and keeps the uniqueness of the key visible to the optimizer. A lookup side below
    the session's broadcast limit is still broadcast, with no shuffle at all.
    """
    left = fact.withColumn(_CHECK, F.xxhash64(key))
    right = lookup.withColumn(_CHECK, F.xxhash64(key))
    return left.join(right, [key, _CHECK], how).drop(_CHECK)
