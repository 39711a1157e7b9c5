"""Alignment of the tokens of two vocabularies over the same texts.

Each whole text is tokenized twice. Where the tokens of both sides spell the text's own bytes, the byte offsets at
which both have a token end cut it into groups, and every token of one side is linked with those of the other in
its group. The shared ends before a token marked with a space on both sides are anchors: they split the text into
windows of a word or so, whose alignment depends on their ids alone and is remembered by their two id tuples.

How many documents hold a pair linked is counted by Spark. The pairs that most documents hold are sent to every
task, at most ``HEAD_PAIRS`` of them; the others are joined by a shuffle, so no table that grows is broadcast.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradegrain.llm.common import Column64, columns_of, slices, store

HEAD_PAIRS = 1_000_000
MEMO_WINDOWS = 200_000
WIDE_GROUP = 4096
MEMO_TOKENS = 256  # a longer window is aligned anew each time, so that the memo stays small
PAIR_BITS = 32  # a pair's key is the first id above these bits and the second id below
SECOND = 1 << 30  # added to ids of the second side where both stand in one row of numbers
SPELLED = 1 << 16  # tokens whose bytes are laid out at once
_LINK = pa.struct([("key", pa.int64()), ("times", pa.int64())])
_COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
_SCHEMA = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, " + (
    "links array<struct<key: long, times: long>>"
)


@dataclass(frozen=True)
class Side:
    """One tokenizer: ids of texts, and the bytes that each id stands for."""

    encode: Callable[[list[str]], list[list[int]]]
    entries: list[bytes]


def byte_level_side(path: str, pattern: str) -> Side:
    """A byte-level BPE vocabulary (JSON); a space is put before each text, special tokens count as plain text.

    Entries must be numbered in the order of their merges, as public vocabularies of this kind are; then an entry's
    number is its rank and a rank encoder gives the same ids. ``pattern`` splits texts before the merges.
    """
    import tiktoken

    # Byte-level entries show printable bytes as themselves and the others, in order, as characters from 256 on.
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    value = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    with open(path, encoding="utf-8") as file:
        stored = json.load(file)
    special = {token["content"] for token in stored["added_tokens"]}
    ranks = {bytes(value[c] for c in e): at for e, at in stored["model"]["vocab"].items() if e not in special}
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in stored["model"]["merges"]]
    if [stored["model"]["vocab"][e] for e in merged] != list(range(256, 256 + len(merged))):
        raise ValueError("entries are not numbered in the order of their merges")
    entries = [b""] * (max(stored["model"]["vocab"].values()) + 1)
    for entry, at in ranks.items():
        entries[at] = entry
    encoding = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return Side(lambda texts: [encoding.encode_ordinary(" " + t) for t in texts], entries)


def piece_side(path: str) -> Side:
    """A sentence-piece model with byte pieces, which puts the space before a text itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    entries = []
    for at in range(model.get_piece_size()):
        piece = model.id_to_piece(at)
        plain = not model.is_byte(at)
        entries.append(piece.replace("▁", " ").encode() if plain else bytes([int(piece[3:5], 16)]))
    return Side(lambda texts: model.encode(texts, num_threads=1), entries)


class _Known(dict):
    """Places of windows by their ids, those of the first side before those of the second.

    A new window gets the next place; it is remembered unless it is long.
    """

    fresh: list[bytes]
    base: int

    def __missing__(self, ids: bytes) -> int:
        place = self.base + len(self.fresh)
        self.fresh.append(ids)
        if len(ids) <= 4 * MEMO_TOKENS:
            self[ids] = place
        return place


class _Memo:
    """Alignments of windows by their id tuples, kept flat; emptied between batches of texts once it is full.

    The texts of a batch are cut together, and its new windows are aligned together.
    """

    def __init__(self, a: Side, b: Side):
        self.bytes = [np.frombuffer(b"".join(side.entries), dtype=np.uint8) for side in (a, b)]
        self.sizes = [np.array([len(e) for e in side.entries], dtype=np.int64) for side in (a, b)]
        self.begins = [np.cumsum(size) - size for size in self.sizes]
        self.spaced = [np.array([e[:1] == b" " for e in side.entries]) for side in (a, b)]
        # Each id as text with what follows it inside and at the end of its side of a group.
        self.inner, self.last = (
            [np.array([f"{i}{mark}" for i in range(len(side.entries))], dtype=object) for side, mark in zip((a, b), marks, strict=True)]
            for marks in (",,", "|;")
        )
        # The lengths of those texts: the digits of the id and the mark.
        self.shown = [np.array([len(str(i)) + 1 for i in range(len(side.entries))], dtype=np.int64) for side in (a, b)]
        self.clear()

    def clear(self) -> None:
        self.known = _Known()
        self.texts: list[str] = []
        self.columns = {name: Column64(np.int64) for name in ("groups", "totals", "ends", "keys", "times")}
        self.columns["ends"].extend([0])
        self.known.base, self.known.fresh = 0, []

    def settle(self) -> None:
        """Align the windows that were new since the last call; all of them one after the other spell the same bytes."""
        fresh = self.known.fresh
        if not fresh:
            return
        mixed = np.frombuffer(b"".join(fresh), dtype=np.int32)
        theirs = mixed >= SECOND
        sides = a, b = mixed[~theirs], mixed[theirs] - SECOND
        whole = np.cumsum(np.fromiter(map(len, fresh), dtype=np.int64, count=len(fresh)) // 4)
        stop = np.cumsum(theirs)[whole - 1]
        stops = [whole - stop, stop]
        ends_a, ends_b = (np.cumsum(size[ids]) for size, ids in zip(self.sizes, sides, strict=True))
        near = np.searchsorted(ends_b, ends_a)
        shared = ends_b[near] == ends_a
        stop_a, stop_b = np.flatnonzero(shared) + 1, near[shared] + 1  # of every group
        n_a, n_b = np.diff(stop_a, prepend=0), np.diff(stop_b, prepend=0)
        self._spell(a, b, stop_a, stop_b, n_a, n_b, stops)
        pairs = n_a * n_b
        last = np.searchsorted(stop_a, stops[0])  # the last group of every window
        held = np.append(0, np.cumsum(pairs))[np.append(0, last + 1)]
        self.columns["groups"].extend(np.diff(last + 1, prepend=0))
        self.columns["totals"].extend(np.diff(held))
        # Groups of very many tokens are counted by distinct ids instead of laid out pair by pair.
        wide = pairs > WIDE_GROUP
        many = {int(g): _counted(a[stop_a[g] - n_a[g] : stop_a[g]], b[stop_b[g] - n_b[g] : stop_b[g]]) for g in np.flatnonzero(wide)}
        kept = pairs.copy()
        for g, (keys, _) in many.items():
            kept[g] = len(keys)
        first = np.cumsum(kept) - kept
        group = np.repeat(np.arange(len(kept)), np.where(wide, 0, kept))
        at = np.repeat(first, np.where(wide, 0, kept))
        place = np.arange(len(group)) + np.repeat(np.cumsum(np.where(wide, kept, 0)), np.where(wide, 0, kept))
        step = place - at
        keys, times = np.zeros(kept.sum(), dtype=np.int64), np.ones(kept.sum(), dtype=np.int64)
        x = a[stop_a[group] - n_a[group] + step // n_b[group]].astype(np.int64)
        keys[place] = x << PAIR_BITS | b[stop_b[group] - n_b[group] + step % n_b[group]]
        for g, (pair, n) in many.items():
            keys[first[g] : first[g] + len(pair)], times[first[g] : first[g] + len(pair)] = pair, n
        self.columns["ends"].extend(self.columns["keys"].size + np.cumsum(kept)[last])
        self.columns["keys"].extend(keys)
        self.columns["times"].extend(times)
        self.known.base, self.known.fresh = len(self.texts), []

    def _spell(self, a, b, stop_a, stop_b, n_a, n_b, stops) -> None:
        """Add the text of every new window: the ids of each group, its first side before its second."""
        said = np.empty(len(a) + len(b), dtype=object)
        group_a, group_b = np.repeat(np.arange(len(n_a)), n_a), np.repeat(np.arange(len(n_b)), n_b)
        said[np.arange(len(a)) + (stop_b - n_b)[group_a]] = self.inner[0][a]
        said[np.arange(len(b)) + stop_a[group_b]] = self.inner[1][b]
        said[stop_a - 1 + stop_b - n_b] = self.last[0][a[stop_a - 1]]
        said[stop_b - 1 + stop_a] = self.last[1][b[stop_b - 1]]
        length = np.empty(len(said), dtype=np.int64)
        length[np.arange(len(a)) + (stop_b - n_b)[group_a]] = self.shown[0][a]
        length[np.arange(len(b)) + stop_a[group_b]] = self.shown[1][b]
        text, ends = "".join(said.tolist()), np.cumsum(length)[stops[0] + stops[1] - 1].tolist()
        self.texts += [text[p : q - 1] for p, q in zip([0, *ends], ends)]

    def spelled(self, side: int, ids: np.ndarray) -> bytes:
        """The bytes that ids of one side stand for."""
        found = []
        for at in range(0, len(ids), SPELLED):
            part = ids[at : at + SPELLED]
            size = self.sizes[side][part]
            ends = np.cumsum(size)
            found.append(self.bytes[side][np.repeat(self.begins[side][part] - ends + size, size) + np.arange(ends[-1])].tobytes())
        return b"".join(found)

    def windows(self, a_ids: list[np.ndarray], b_ids: list[np.ndarray]) -> list[np.ndarray]:
        """Places of the windows of each text, in order; both sides of a text spell the same bytes."""
        if not a_ids:
            return []
        a, b = np.concatenate(a_ids), np.concatenate(b_ids)
        last = np.cumsum([len(ids) for ids in a_ids])
        ends_a, ends_b = np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b])
        near = np.searchsorted(ends_b, ends_a)
        shared = ends_b[near] == ends_a
        after_a, after_b = np.flatnonzero(shared) + 1, near[shared] + 1
        anchors = np.append(self.spaced[0][a[after_a[:-1]]] & self.spaced[1][b[after_b[:-1]]], True)
        anchors[np.searchsorted(after_a, last)] = True  # texts end where both sides end
        stop_a, stop_b = after_a[anchors], after_b[anchors]
        n_a, n_b = np.diff(stop_a, prepend=0), np.diff(stop_b, prepend=0)
        mixed = np.empty(len(a) + len(b), dtype=np.int32)
        mixed[np.arange(len(a)) + np.repeat(stop_b - n_b, n_a)] = a
        mixed[np.arange(len(b)) + np.repeat(stop_a, n_b)] = b + SECOND
        raw, ends = mixed.tobytes(), (4 * (stop_a + stop_b)).tolist()
        ids = [raw[p:q] for p, q in zip([0, *ends], ends)]
        found = np.fromiter(map(self.known.__getitem__, ids), dtype=np.int64, count=len(ids))
        return np.split(found, np.searchsorted(stop_a, last[:-1]) + 1)

    def links(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs linked in these windows, in order of their keys, and how often."""
        ends = self.columns["ends"].values
        different, often = np.unique(places, return_counts=True)
        first = ends[different]
        size = ends[different + 1] - first
        at = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
        keys, times = self.columns["keys"].values[at], self.columns["times"].values[at] * np.repeat(often, size)
        order = np.argsort(keys, kind="stable")
        keys, times = keys[order], times[order]
        heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        return keys[heads], np.add.reduceat(times, heads)


def _counted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different pairs of two groups of ids, and how often each stands."""
    (ours, n), (theirs, m) = (np.unique(ids.astype(np.int64), return_counts=True) for ids in (a, b))
    return (ours[:, None] << PAIR_BITS | theirs).ravel(), (n[:, None] * m).ravel()


def _aligned(docs: DataFrame, first: Callable[[], Side], second: Callable[[], Side]) -> DataFrame:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_side, b_side = first(), second()
        memo = _Memo(a_side, b_side)
        for part in slices(parts, 64):
            rows, doc_ids, texts = columns_of(part, "row", "doc_id", "text")
            wanted = [t or "" for t in texts]
            a_ids, b_ids = (
                [np.fromiter(ids, dtype=np.int32, count=len(ids)) for ids in side.encode(wanted)] for side in (a_side, b_side)
            )
            same = []
            for text, *sides in zip(wanted, a_ids, b_ids, strict=True):
                spelled = (" " + text).encode()
                same.append(bool(text) and all(memo.spelled(i, ids) == spelled for i, ids in enumerate(sides)))
            found = iter(memo.windows(list(compress(a_ids, same)), list(compress(b_ids, same))))
            places = [next(found) if s else None for s in same]
            memo.settle()
            counts, marks, keys, times, ends = [], [], [], [], [0]
            for at, a, b in zip(places, a_ids, b_ids, strict=True):
                if at is None:
                    marks.append("")
                    counts.append((0, 0, 0, 0))
                    ends.append(ends[-1])
                    continue
                pair, often = memo.links(at)
                shown = ";".join(map(memo.texts.__getitem__, at.tolist()))
                marks.append(hashlib.sha256(shown.encode()).hexdigest())
                sums = (int(memo.columns[c].values[at].sum()) for c in ("groups", "totals"))
                counts.append((len(a), len(b), *sums))
                keys.append(pair)
                times.append(often)
                ends.append(ends[-1] + len(pair))
            if len(memo.texts) > MEMO_WINDOWS:
                memo.clear()
            flat = [np.concatenate(c) if c else np.empty(0, np.int64) for c in (keys, times)]
            links = pa.StructArray.from_arrays([pa.array(f, pa.int64()) for f in flat], fields=list(_LINK))
            arrays = [pa.array(rows, pa.int64()), pa.array(doc_ids, pa.int64())]
            arrays += [pa.array(c, pa.int64()) for c in zip(*counts, strict=True)] if counts else [pa.array([], pa.int64())] * 4
            arrays += [pa.array(marks, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), links)]
            names = ["row", "doc_id", *_COUNTS, "groups_sha256", "links"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.mapInArrow(run, _SCHEMA)


def pair_counts(links: DataFrame) -> DataFrame:
    """(key, n, best): in how many documents each pair is linked, and whether no pair of its first id is in more."""
    counts = store(links.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "pair-counts")
    first = F.shiftright("key", PAIR_BITS).alias("first")
    most = counts.groupBy(first).agg(F.max("n").alias("most"))
    # One row per entry of the first vocabulary at most, so the broadcast has a bound.
    marked = counts.withColumn("first", first).join(F.broadcast(most), "first")
    return marked.select("key", "n", (F.col("n") == F.col("most")).alias("best"))


def _cut(counts: DataFrame, head_pairs: int) -> tuple[int, bool]:
    """The least count of pairs to send to every task, and whether any are left over."""
    # Eight classes for each power of two: a few hundred rows at most.
    sized = counts.groupBy(F.floor(F.log2("n") * 8).alias("class")).agg(F.min("n").alias("n"), F.count(F.lit(1)).alias("pairs"))
    least, room = 1 << 62, head_pairs
    for row in sized.orderBy(F.desc("class")).collect():
        room -= row["pairs"]
        if room < 0:
            return least, True
        least = row["n"]
    return least, False


def align(
    docs: DataFrame,
    first: Callable[[], Side],
    second: Callable[[], Side],
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    head_pairs: int = HEAD_PAIRS,
) -> tuple[DataFrame, DataFrame]:
    """A report per document, and the corpus table of linked pairs.

    The report has doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is in as many documents as any pair of
    the same first id, ties included), count_sum (documents of the pair, summed over links) and groups_sha256. The
    table has first_id, second_id, n_docs, best.

    ``first`` and ``second`` load a tokenizer inside a task. Null and empty texts, and texts that the tokens of one
    side do not spell byte for byte, have no tokens: zeros and an empty digest. Each row is a document of its own,
    rows that repeat and rows without id included; a null id stays null. A text of any length is taken whole, and
    one without anchors is a single window. Other columns are not read. An empty table gives an empty report.
    """
    # Ids are stored with the rows that carry them, so later reads see the same ones.
    named = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")
    )
    rows = store(_aligned(named, first, second), "aligned")
    spread = rows.select("row", F.explode("links").alias("link")).select("row", "link.key", "link.times")
    counts = store(pair_counts(spread), "pairs")
    least, more = _cut(counts, head_pairs)
    head = F.broadcast(counts.filter(F.col("n") >= least))  # at most head_pairs rows
    sums = [F.sum(F.when(F.col("best"), F.col("times"))).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum")]
    # The pairs of a document lie in one task, so each task sends one row per document.
    found = spread.join(head, "key").groupBy("row").agg(*sums)
    if more:
        rest = spread.join(F.broadcast(head.select("key")), "key", "left_anti").join(counts.filter(F.col("n") < least), "key")
        found = found.union(rest.groupBy("row").agg(*sums))
    found = found.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    report = rows.select("row", "doc_id", *_COUNTS, "groups_sha256").join(found, "row", "left")
    filled = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    pairs = counts.select(
        F.shiftright("key", PAIR_BITS).alias("first_id"),
        F.col("key").bitwiseAND(F.lit((1 << PAIR_BITS) - 1)).alias("second_id"),
        F.col("n").alias("n_docs"),
        "best",
    )
    return report.select("doc_id", *_COUNTS, *filled, "groups_sha256"), pairs
