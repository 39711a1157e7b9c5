"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint is embedded as the bit counts of its segments. The Manhattan distance of two embeddings is a lower
bound of the number of differing bits, so a grid range-join on the embedding misses no link. The segments are
split into ``PARTS`` parts; with at most ``max_bits`` differing bits, at least ``PARTS - max_bits`` parts have
Manhattan distance zero, so two fingerprints that link share the grid cell of some ``AGREE`` parts. Inside a
cell the whole embedding's distance is tested first and the bits then exactly. A cell gives back a spanning
forest of its links, never all its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradegrain.llm.common import columns_of, slices, split_count, store
from tradegrain.llm.components import connected_components

SEED = 42
PARTS, AGREE = 6, 2
SEGMENT_BITS = 2
BLOCK = 8192  # fingerprints of one cell compared in one task
GROUP = 50_000  # rows of small cells compared by one call

_FINGERPRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def fingerprint(words: list[bytes], shingle: int) -> int:
    """Bits set in over half the shingle hashes; no words give zero."""
    import xxhash

    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    size = min(shingle, len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - size + 1].tolist()
    stops = ends[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], dtype=">u8")
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):
        block = hashes[at : at + 65_536]
        total += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every row, fp as a signed 64-bit number."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(parts):
            keys, texts = columns_of(part, "doc_id", "text")
            found = [fingerprint((t or "").encode().lower().split(), shingle) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(found, pa.int64())], schema=_FINGERPRINTS)

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(run, "doc_id long, fp long")


def _segments() -> list[list[tuple[int, int]]]:
    """(first bit, width) of the segments of each part."""
    widths = [64 // PARTS + (p < 64 % PARTS) for p in range(PARTS)]
    parts, at = [], 0
    for width in widths:
        cut = [(at + i, min(SEGMENT_BITS, width - i)) for i in range(0, width, SEGMENT_BITS)]
        parts.append(cut)
        at += width
    return parts


def embed(values: np.ndarray) -> np.ndarray:
    """Bit counts per segment, one row a fingerprint."""
    columns = [
        np.bitwise_count((values >> np.uint64(first)) & np.uint64((1 << width) - 1))
        for part in _segments()
        for first, width in part
    ]
    return np.stack(columns, axis=1)


def _cells(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shape = [len(p) for p in _segments()]
    first = np.concatenate([[0], np.cumsum(shape)])
    for part in parts:
        values = part.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        counts = embed(values).astype(np.int64)
        keys = [
            (counts[:, first[p] : first[p + 1]] * (SEGMENT_BITS + 1) ** np.arange(shape[p])).sum(axis=1)
            for p in range(PARTS)
        ]
        for number, chosen in enumerate(combinations(range(PARTS), AGREE)):
            cell = np.full(len(values), number, dtype=np.int64)
            for p in chosen:
                cell = cell * (SEGMENT_BITS + 1) ** max(shape) + keys[p]
            yield pa.RecordBatch.from_arrays([pa.array(cell), part.column(0)], names=["cell", "fp"])


def _forest(cell: np.ndarray, block: np.ndarray, whole: np.ndarray, values: np.ndarray, max_bits: int) -> np.ndarray:
    """Links that span what is linked inside each run of equal ``cell``, as pairs of positions.

    Row i meets row i + 1, i + 2, ... of its run, all rows at once. Pairs that are already connected are
    skipped, so a dense run costs few comparisons. Where ``whole`` is false only different blocks meet.
    """
    parts = np.cumsum([0] + [len(p) for p in _segments()[:-1]])
    counts = np.add.reduceat(embed(values).astype(np.int8), parts, axis=1)
    top = np.arange(len(values))
    found = []
    at, step = np.arange(len(values)), 0
    while True:
        step += 1
        at = at[at + step < len(values)]
        at = at[cell[at] == cell[at + step]]
        if not len(at):
            return np.array(found, dtype=np.int64).reshape(-1, 2)
        other = at + step
        open_ = (top[at] != top[other]) & (whole[at] | (block[at] != block[other]))
        left, right = at[open_], other[open_]
        near = np.abs(counts[left] - counts[right]).sum(axis=1) <= max_bits  # the lower bound
        left, right = left[near], right[near]
        near = np.bitwise_count(values[left] ^ values[right]) <= max_bits
        for i, j in zip(left[near].tolist(), right[near].tolist(), strict=True):
            a, b = _top(top, i), _top(top, j)
            if a != b:
                top[max(a, b)] = min(a, b)
                found.append((i, j))
        if near.any():
            while not np.array_equal(top, top[top]):
                top = top[top]


def _top(top: np.ndarray, i: int) -> int:
    while top[i] != i:
        i = int(top[i])
    return i


def _compare(max_bits: int):
    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["cell", "low", "high", "fp"])
        same = (rows[["cell", "low", "high"]].diff().fillna(1) != 0).any(axis=1).cumsum().to_numpy()
        values = rows["fp"].to_numpy().view(np.uint64)
        whole = (rows["low"] == rows["high"]).to_numpy()
        found = _forest(same, rows["block"].to_numpy(), whole, values, max_bits)
        signed = rows["fp"].to_numpy()
        return pd.DataFrame({"a": signed[found[:, 0]], "b": signed[found[:, 1]]})

    return compare


def links(distinct: DataFrame, max_bits: int) -> DataFrame:
    """Links (a, b) between different fingerprints that connect all that differ in at most ``max_bits`` bits.

    Cells above ``BLOCK`` fingerprints are cut into blocks by hash and every pair of blocks is compared on its
    own, so the largest cell bounds no task. Cells are dealt to groups of about ``GROUP`` rows.
    """
    if PARTS - max_bits < AGREE:
        raise ValueError(f"at most {PARTS - AGREE} differing bits with {PARTS} parts")
    cells = distinct.select("fp").mapInArrow(_cells, "cell long, fp long")
    crowded = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK)
    split = cells.join(crowded, "cell", "left").select(
        "cell", "fp", split_count(F.coalesce("n", F.lit(1)), BLOCK).alias("blocks")
    )
    split = split.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")))
    pairs = split.select("cell", "fp", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    pairs = pairs.select(
        "cell", "fp", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")
    )
    groups = max(1, math.ceil(distinct.count() * math.comb(PARTS, AGREE) / GROUP))
    dealt = pairs.withColumn("deal", F.pmod(F.xxhash64("cell", "low", "high"), F.lit(groups)))
    return dealt.groupBy("deal").applyInPandas(_compare(max_bits), "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame, *, shingle: int = 4, max_bits: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    ``component_id`` is the least doc_id reachable over links of at most ``max_bits`` differing bits. Null and
    empty texts, and texts without a word, have fingerprint zero, which links like any other. Repeated rows each
    keep their row; a null id belongs to its component but never names it unless all its ids are null. Equal
    fingerprints are one node, so copies in any number cost one row. Other columns are not carried.
    """
    prints = store(fingerprints(docs, shingle, id_col=id_col, text_col=text_col), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(links(nodes, max_bits), "a", "b")
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = placed.join(named, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(
    docs: DataFrame, *, shingle: int = 4, max_bits: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row of every near-duplicate group, all columns: of least id (null last), then of least text hash.

    A document is an id and a text; rows that repeat both are one document, with the least of their other columns,
    which must have an order. Null and empty texts are one group with all others of fingerprint zero.
    """
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    whole = docs.select(F.struct(*others, id_col, text_col).alias("whole"))
    own, text = F.col("whole")[id_col], F.col("whole")[text_col]
    # Rows go by a key of their own, so groups that share an id, or have none, stay apart.
    keyed = whole.select(F.xxhash64(own.isNull(), own, text).alias("row"), own.alias("own"), text.alias("text"), "whole")
    found = near_duplicates(keyed, shingle=shingle, max_bits=max_bits, id_col="row")
    groups = found.select(F.col("doc_id").alias("row"), F.col("component_id").alias("group")).distinct()
    order = F.struct(F.col("own").isNull().alias("lone"), "own", F.xxhash64("text").alias("text_key"), "row")
    places = keyed.select("row", order.alias("place")).distinct().join(groups, "row")
    stay = places.groupBy("group").agg(F.min("place").alias("first")).select(F.col("first.row").alias("row"))
    kept = keyed.join(stay, "row", "left_semi").groupBy("row").agg(F.min("whole").alias("whole"))
    return kept.select("whole.*").select(*docs.columns)
