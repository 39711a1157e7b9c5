"""Balanced shards for groups that must stay together, by Karmarkar-Karp differencing.

Every copy of a text belongs to one indivisible group. A group that weighs more than one grain (the total over
``GRAINS``) is an item of its own; all others are dealt by hash into ``GRAINS`` light grains. There are thus at
most twice ``GRAINS`` items however large the corpus is, and differencing them is one small task. Numbering
inside a shard is spread over stretches, so no shard passes through one task.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tradegrain.llm.common import store

GRAINS = 4096
OVERHEAD = 8  # bytes a document costs beside its text
STRETCH = 20_000  # rows numbered by one task


def difference(sizes: list[int], parts: int) -> list[int]:
    """The part (0 to ``parts`` - 1) of each item.

    Each item starts as a partial partition with one filled part. The two partial partitions of the largest
    spread are combined, the fullest part of one with the emptiest of the other, until one is left.
    """
    if not sizes:
        return []
    heap = []
    for i, size in enumerate(sizes):
        heap.append((-size, i, (0,) * (parts - 1) + (size,), [[]] * (parts - 1) + [[i]]))
    heapq.heapify(heap)
    made = len(sizes)
    while len(heap) > 1:
        _, _, sums_a, items_a = heapq.heappop(heap)
        _, _, sums_b, items_b = heapq.heappop(heap)
        sums = np.array(sums_a) + np.array(sums_b[::-1])
        items = [a + b if a and b else a or b for a, b in zip(items_a, items_b[::-1], strict=True)]
        order = np.argsort(sums, kind="stable")
        sums = sums[order]
        low = int(sums[0])  # only differences matter from here on
        made += 1
        merged = tuple((sums - low).tolist())
        heapq.heappush(heap, (-merged[-1], made, merged, [items[i] for i in order]))
    shard = [0] * len(sizes)
    for part, members in enumerate(heap[0][3]):
        for i in members:
            shard[i] = part
    return shard


def _deal(shards: int):
    def deal(items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["size", "item", "heavy"], ascending=[False, True, True], kind="stable")
        found = difference([int(s) for s in items["size"]], shards)
        return pd.DataFrame({"item": items["item"].to_numpy(), "heavy": items["heavy"].to_numpy(), "shard": found})

    return deal


def shard_by_bytes(
    docs: DataFrame, *, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", grains: int = GRAINS
) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Sizes are UTF-8 bytes plus ``OVERHEAD``. Equal texts share a shard; null and empty texts are equal. Slots
    number a shard from 0 without gaps; rows equal in id and text take theirs in any order. A group heavier
    than a shard's fair share fills its shard above the others, which no placement can avoid. An empty table
    gives an empty result. Columns beside id and text are not carried.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text).alias("text_key"),
    )
    sized = store(sized, "shard-sizes")  # the text is read once; every later pass reads these few bytes a row
    totals = sized.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    all_bytes, all_rows = totals["bytes"] or 0, totals["rows"]
    heavy = F.col("size") * grains > F.lit(all_bytes)
    grain = F.pmod(F.xxhash64("text_key", F.lit("grain")), F.lit(grains)).cast("long")
    groups = sized.groupBy("text_key").agg(F.sum("size").alias("size"))
    dealt = groups.select(F.when(heavy, F.col("text_key")).otherwise(grain).alias("item"), heavy.alias("heavy"), "size")
    items = dealt.groupBy("item", "heavy").agg(F.sum("size").alias("size"))
    placed = store(items.groupBy().applyInPandas(_deal(shards), "item long, heavy boolean, shard int"), "shard-items")
    # At most ``grains`` rows in each: the bound of these broadcasts.
    own = placed.filter("heavy").select(F.col("item").alias("text_key"), F.col("shard").alias("own_shard"))
    light = placed.filter("NOT heavy").select(F.col("item").alias("grain"), F.col("shard").alias("grain_shard"))
    stretches = max(1, math.ceil(all_rows / (STRETCH * shards)))
    stretch = F.pmod(F.xxhash64("doc_id", "text_crc32", F.lit("slot")), F.lit(stretches))
    located = (
        sized.withColumns({"grain": grain, "stretch": stretch})
        .join(F.broadcast(own), "text_key", "left")
        .join(F.broadcast(light), "grain", "left")
        .withColumn("shard", F.coalesce("own_shard", "grain_shard"))
    )
    return _numbered(located).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _numbered(located: DataFrame) -> DataFrame:
    """Add ``slot``, the gapless position inside the shard, by stretch, doc_id and checksum."""
    counts = located.groupBy("shard", "stretch").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("shard").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("shard", "stretch", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = W.partitionBy("shard", "stretch").orderBy("doc_id", "text_crc32")
    numbered = located.withColumn("place", F.row_number().over(inside) - 1)
    return numbered.join(offsets, ["shard", "stretch"]).withColumn("slot", (F.col("first") + F.col("place")).cast("long"))
