"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item is in a document if at least ``CONTAINMENT`` of the item's distinct five-word shingles are. Items are
partitioned by size, in powers of two. Every item of a partition has the same number k of MinHash values, the k
least hashes of its shingles, with k set by the partition's largest size: an item with so many shingles can miss
fewer than k of them, so one of the k least is in any document that contains it. The search therefore finds
every contained item however long the document is, and an exact count of shingles decides.

Documents send only the shingle hashes that pass a bitmap of the signatures, whose size is fixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradegrain.llm.common import WordIds, as_long, columns_of, free_name, shingle_hashes, slices, store

SHINGLE = 5
CONTAINMENT = 0.8
BITMAP_BITS = 24


def _words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().split()


def _shingles(table: DataFrame) -> DataFrame:
    """(key, hashes) with the distinct shingle hashes of each row of (key, text), sorted."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds()
        for part in slices(parts):
            keys, texts = columns_of(part, "key", "text")
            found = [np.unique(shingle_hashes(one, SHINGLE)) for one in ids([_words(t) for t in texts])]
            arrays = [pa.array(keys, pa.int64()), pa.array([as_long(f) for f in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "hashes"])

    return table.select("key", "text").mapInArrow(run, "key long, hashes array<long>")


def signatures(items: DataFrame, containment: float) -> DataFrame:
    """(item_id, n, class, hash): the MinHash values of every item with a shingle, as many as its size class needs."""
    sized = _shingles(items).filter("size(hashes) > 0").withColumn("n", F.size("hashes"))
    # The class is the least power of two that holds the item; of its largest, at most (1 - containment) may be missing.
    sized = sized.withColumn("class", F.pow(F.lit(2), F.ceil(F.log2("n"))).cast("int"))
    most_missing = F.floor(F.col("class") * F.lit(round(1 - containment, 9)) + F.lit(1e-9))
    # Hashes are uniform, so their order as numbers is the random order MinHash needs.
    least = F.slice(F.sort_array("hashes"), 1, (most_missing + 1).cast("int"))
    return sized.select(F.col("key").alias("item_id"), "n", "class", F.explode(least).alias("hash"))


def _bitmap(marks: DataFrame) -> np.ndarray:
    """One bit for the low bits of every hash; the same size whatever there is to mark."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << BITMAP_BITS, dtype=bool)
        for part in parts:
            bits[part.column(0).to_numpy(zero_copy_only=False) & ((1 << BITMAP_BITS) - 1)] = True
        words = np.packbits(bits).view(np.int64)
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at])], names=["at", "bits"])

    filled = marks.select("hash").mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits"))
    words = np.zeros((1 << BITMAP_BITS) // 64, dtype=np.int64)
    for row in filled.collect():  # at most 2 ** BITMAP_BITS / 64 rows
        words[row["at"]] = row["bits"]
    return np.unpackbits(words.view(np.uint8)).astype(bool)


def _hits(docs: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """(key, hash) for the distinct shingle hashes of each row that the bitmap lets pass."""
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(bitmap))  # 2 MB

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, marked = WordIds(), np.unpackbits(sent.value).astype(bool)
        low = np.uint64((1 << BITMAP_BITS) - 1)
        for part in slices(parts):
            keys, texts = columns_of(part, "key", "text")
            found = []
            for one in ids([_words(t) for t in texts]):
                hashes = shingle_hashes(one, SHINGLE)
                found.append(np.unique(hashes[marked[(hashes & low).astype(np.int64)]]))
            repeats = np.repeat(np.arange(len(keys)), [len(f) for f in found])
            names = pa.array(keys, pa.int64()).take(pa.array(repeats))
            values = as_long(np.concatenate(found)) if found else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([names, pa.array(values)], names=["key", "hash"])

    return docs.select("key", "text").mapInArrow(run, "key long, hash long")


def _verify(pairs: DataFrame, containment: float) -> DataFrame:
    """Exact containment of (item_text) in (doc_text), shingle by shingle as words."""

    def distinct(text: str | None) -> set[tuple[bytes, ...]]:
        words = _words(text)
        size = min(SHINGLE, len(words))
        return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, set] = {}
        for part in slices(parts, 64):
            docs, texts, items, wanted = columns_of(part, "doc_key", "doc_text", "item_ids", "item_texts")
            rows = []
            for doc, text, ids, asked in zip(docs, texts, items, wanted, strict=True):
                there = distinct(text)
                for item, other in zip(ids, asked, strict=True):
                    if item not in known:
                        if len(known) > 10_000:
                            known.clear()
                        known[item] = distinct(other)
                    shared = len(there & known[item])
                    if shared >= containment * len(known[item]) - 1e-9:
                        rows.append((doc, item, shared, len(known[item])))
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns], names=["key", "item_id", "shared", "total"]
            )

    return pairs.mapInArrow(run, "key long, item_id long, shared long, total long")


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    containment: float = CONTAINMENT,
) -> DataFrame:
    """(doc_id, item_id, shared, total) for every document and item it contains, and nothing else.

    Words are split at ASCII white space and lower-cased; an item of fewer than five words is one shingle and is
    only found in texts that are that run of words, one without words is found nowhere. Null texts have no words.
    Rows with a null id are not searched under a name and are left out; items with equal ids are told apart by
    their texts and reported once for each id. Repeated documents give their pairs once. Extra columns are not read.
    """
    chosen = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text")).filter("key IS NOT NULL")
    wanted = items.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("item_text"))
    wanted = wanted.filter("item IS NOT NULL").distinct()
    # Each different item text is searched once, under its own 64-bit hash.
    named = wanted.withColumn("key", F.xxhash64("item_text"))
    marks = store(signatures(named.select("key", F.col("item_text").alias("text")).distinct(), containment), "signatures")
    hits = _hits(chosen, _bitmap(marks))
    candidates = hits.join(marks.select("hash", F.col("item_id").alias("item_key")), "hash")
    candidates = store(candidates.select("key", "item_key").distinct(), "candidates")
    texts = named.select(F.col("key").alias("item_key"), "item_text").distinct()
    per_doc = (
        candidates.join(texts, "item_key")
        .groupBy("key")
        .agg(F.collect_list("item_key").alias("item_ids"), F.collect_list("item_text").alias("item_texts"))
    )
    pairs = chosen.join(per_doc, "key").select(
        F.col("key").alias("doc_key"), F.col("text").alias("doc_text"), "item_ids", "item_texts"
    )
    found = _verify(pairs, containment).groupBy("key", "item_id").agg(F.max("shared").alias("shared"), F.max("total").alias("total"))
    ids = named.select(F.col("key").alias("item_key"), "item").distinct()
    return (
        found.withColumnRenamed("item_id", "item_key")
        .join(ids, "item_key")
        .groupBy(F.col("key").alias("doc_id"), F.col("item").alias("item_id"))
        .agg(F.max("shared").alias("shared"), F.max("total").alias("total"))
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` whose id contains no item; rows with a null id stay."""
    bad = contaminated(docs, items, **settings).select(F.col("doc_id").alias(free_name(docs, "_bad"))).distinct()
    return docs.join(bad, F.col(settings.get("id_col", "doc_id")) == F.col(bad.columns[0]), "left_anti")


def drop_contaminated_texts(
    docs: DataFrame,
    items: DataFrame,
    *,
    text_col: str = "text",
    item_text_col: str = "text",
    containment: float = CONTAINMENT,
) -> DataFrame:
    """The rows of ``docs`` whose own text contains no item. Ids, null or repeated, of rows and items play no part."""
    key = free_name(docs, "_key")
    keyed = docs.withColumn(key, F.xxhash64(F.col(text_col)))
    asked = items.select(F.xxhash64(F.col(item_text_col)).alias("item_id"), F.col(item_text_col).alias("text"))
    bad = contaminated(keyed, asked, id_col=key, text_col=text_col, containment=containment)
    return keyed.join(bad.select(F.col("doc_id").alias(key)).distinct(), key, "left_anti").select(*docs.columns)
