"""Line dedup by an exact set-similarity join.

A line is the set of its words. Lines of equal sets are one set, known by its first place (document, line). Sets
are joined by prefix filtering: with words ordered from rare to frequent, two sets of Jaccard similarity t or more
share a word among their first n - ceil(t * n) + 1. Pairs that meet there pass a length filter, a positional
filter and a bound from 128-bit word signatures, none of which can lose a match; then the words themselves decide.
Every line with an earlier match goes.

Rarity is read from counts in a fixed number of slots, so its table is bounded; any order of words gives the same
matches. A place is one number, made of the place of its document and the line's number there, so that order and
identity cost one column, and the number leads back to the line. A set is first compared with its nearest earlier
candidates. Only sets that find no match there and have more candidates are compared with all of them, so a large
group of near copies is not expanded into its pairs. Sets and words are known by 64-bit hashes; equal hashes count
as equal.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradegrain.llm.common import as_long, columns_of, free_name, hashed_words, mix, slices, split_count, store
from tradegrain.operators.ordered import number_rows

SIMILARITY = 0.8
MIN_WORDS = 1  # different words a line needs to take part, unless the caller says otherwise
SLOT_BITS, CHUNK_BITS = 24, 16
NEAREST = 2  # candidates per word compared at first
BLOCK, GROUP, RUN = 8192, 60_000, 1 << 20
PAIRS_HELD = 1 << 18  # candidate pairs a task holds before it passes them on
SLOTS_HELD = 1 << 19  # counted slots a task holds before it adds them up
SPAN_BITS = 20
LINE_BITS = 31  # a text has fewer lines than that counts to
PLACES = 1 << 63 - LINE_BITS  # documents that can be numbered
HOT_SCALE = int(16 * math.log2(BLOCK)) - 1
_LOW = np.uint64((1 << SLOT_BITS) - 1)


def _joined(texts: list[str | None]) -> Iterator[tuple[slice, bytes, np.ndarray]]:
    """Runs of texts as lower-cased bytes, a line end after each, with the place of each text; about ``RUN`` bytes."""
    data, begin, held = [], 0, 0
    for i, text in enumerate(texts):
        data.append((text or "").lower().encode())
        held += len(data[-1])
        if i + 1 == len(texts) or held >= RUN:
            sizes = np.array([len(one) + 1 for one in data])
            yield slice(begin, i + 1), b"\n".join([*data, b""]), np.cumsum(sizes) - sizes
            data, begin, held = [], i + 1, 0


def _line_words(data: bytes, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of the lines that have ``least`` or more: (which of them each word is in, words, their numbers)."""
    words, places = hashed_words(data)
    breaks = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 10)
    count = np.diff(np.searchsorted(places, breaks), prepend=0, append=len(places))
    long = count >= least
    if not long[count > 0].all():
        words = words[np.repeat(long, count)]
    return np.repeat(np.cumsum(long) - 1, np.where(long, count, 0)), words, np.flatnonzero(long)


def _lines(texts: list[str | None], least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Lines of the texts, some at a time: (line of each word, words, text of each line, its number there)."""
    for part, data, starts in _joined(texts):
        line, words, number = _line_words(data, least)
        breaks = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 10)
        first = np.searchsorted(breaks, starts)
        owner = np.searchsorted(first, number, side="right") - 1
        if len(number):
            yield line, words, owner + part.start, number - first[owner]


def _sets(
    line: np.ndarray, words: np.ndarray, count: int, rarity: np.ndarray | None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of each line, from rare to frequent if rarity is given: (line of each word, words, first word, size).

    One sort by line, rarity and leading bits of the hash. Words of a line that agree in all three stand together.
    """
    key = (line.astype(np.uint64) << np.uint64(40)) | (words >> np.uint64(32))
    if rarity is not None:
        key |= rarity[(words & _LOW).astype(np.int64)].astype(np.uint64) << np.uint64(32)
    order = np.argsort(key)
    key, words, line = key[order], words[order], line[order]
    tied = np.flatnonzero((key[1:] == key[:-1]) & (words[1:] != words[:-1]))
    if len(tied):  # different words of equal key: settle their order by the whole hash
        order = np.lexsort((words, key))
        words, line = words[order], line[order]
    new = np.ones(len(words), dtype=bool)
    new[1:] = (words[1:] != words[:-1]) | (line[1:] != line[:-1])
    line, words = line[new], words[new]
    size = np.bincount(line, minlength=count)
    return line, words, np.cumsum(size) - size, size


def _keys(words: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set, whatever the order of its words."""
    return mix(np.add.reduceat(mix(words + np.uint64(7)), first) + size.astype(np.uint64))


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct slots in order and the sums of their counts."""
    slots, counts = (np.concatenate(column) for column in zip(*parts, strict=True))
    order = np.argsort(slots)
    slots, counts = slots[order], counts[order].astype(np.int32)
    first = np.flatnonzero(np.diff(slots, prepend=-1))
    return slots[first], np.add.reduceat(counts, first) if len(first) else counts


def _signatures(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit halves for each set: parities, so that long lines do not fill them; sets differ by a word per differing bit."""
    bit = mix(words) >> np.uint64(57)
    mask, left = np.uint64(1) << (bit & np.uint64(63)), bit < np.uint64(64)
    low, high = (np.bitwise_xor.reduceat(np.where(half, mask, np.uint64(0)), first) for half in (left, ~left))
    return as_long(low), as_long(high)


def rarity_table(docs: DataFrame) -> np.ndarray:
    """How frequent each slot of words is, as 16 * log2 of its count: zero if a single word fell there."""
    width = 1 << CHUNK_BITS

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [(np.empty(0, np.int32), np.empty(0, np.int32))], 0  # a split holds fewer words than that counts to
        for part in slices(parts):
            for _, data, _ in _joined(columns_of(part, "text")[0]):
                held.append(np.unique((hashed_words(data)[0] & _LOW).astype(np.int32), return_counts=True))
                count += len(held[-1][0])
                if count > SLOTS_HELD + len(held[0][0]):
                    held, count = [_added(held)], 0
        slots, counts = _added(held)
        edges = np.searchsorted(slots, np.arange(0, (1 << SLOT_BITS) + 1, width))
        for chunk in np.flatnonzero(np.diff(edges)).tolist():
            own = slice(edges[chunk], edges[chunk + 1])
            low = (slots[own] & (width - 1)).astype("<u2")
            row = {"chunk": [chunk], "slots": [low.tobytes()], "counts": [counts[own].astype("<i4").tobytes()]}
            yield pa.RecordBatch.from_pydict(row)

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(width, dtype=np.int64)
        for slots, counts in zip(rows["slots"], rows["counts"], strict=True):
            total[np.frombuffer(slots, "<u2")] += np.frombuffer(counts, "<i4")
        scale = np.minimum(255, np.round(16 * np.log2(np.maximum(total, 1)))).astype(np.uint8)
        return pd.DataFrame({"chunk": [rows["chunk"].iloc[0]], "scale": [scale.tobytes()]})

    pieces = docs.select("text").mapInArrow(run, "chunk long, slots binary, counts binary")
    merged = pieces.groupBy("chunk").applyInPandas(merge, "chunk long, scale binary")
    table = np.zeros(1 << SLOT_BITS, dtype=np.uint8)
    for row in merged.toArrow().to_pylist():  # 2 ** SLOT_BITS bytes in all
        table[row["chunk"] * width : (row["chunk"] + 1) * width] = np.frombuffer(row["scale"], dtype=np.uint8)
    return table


def _place_by_id(docs: DataFrame, id_col: str) -> Column | None:
    """The place of a document by its id alone, if no two rows share an id and the ids lie close enough; else nothing."""
    doc = F.col(id_col).cast("long")
    counts = [F.count(F.lit(1)), F.count(doc), F.countDistinct(doc), F.min(doc), F.max(doc)]
    rows, ids, distinct, least, most = docs.agg(*[c.alias(f"c{i}") for i, c in enumerate(counts)]).first()
    if rows - ids > 1 or distinct < ids or ids and most - least >= PLACES - 1:
        return None
    return F.coalesce(F.shiftleft(doc - F.lit(least or 0).cast("long") + 1, LINE_BITS), F.lit(0).cast("long"))


def _with_place(docs: DataFrame, id_col: str, text_col: str, name: str) -> tuple[DataFrame, DataFrame]:
    """``docs`` with the place of each row's document as ``name``, and (place, text) of each document.

    Ids shared by rows, or too far apart, are put in order by sorting, which takes the texts through a shuffle.
    """
    doc, text = F.col(id_col).cast("long"), F.col(text_col)
    pair = [F.col(name).alias("place"), text.alias("text")]
    place = _place_by_id(docs, id_col)
    if place is not None:
        full = docs.withColumn(name, place)
        return full, full.select(*pair)
    own, key = free_name(docs, "_doc"), free_name(docs, "_text_key")
    documents = docs.select(doc.alias(own), F.xxhash64(text).alias(key)).distinct()
    ranks = number_rows(documents, [F.col(own), F.col(key)], name)
    ranks = store(ranks.withColumn(name, F.shiftleft(F.col(name).cast("long"), LINE_BITS)), "places")
    same = doc.eqNullSafe(ranks[own]) & F.xxhash64(text).eqNullSafe(ranks[key])
    full = docs.join(ranks, same, "left").drop(own, key)
    return full, store(full.select(*pair).dropDuplicates(["place"]), "placed")


_LINES = "number long, key long, n long, low long, high long, skipped int, cold int, prefix array<long>"


def line_sets(docs: DataFrame, rarity: np.ndarray, similarity: float, least: int = MIN_WORDS) -> DataFrame:
    """One row a line of ``least`` different words or more, with the prefix words that other lines may have.

    A set of n words has at most n of n + 1 in common with another set. If that is too little, it has no prefix and
    only matches lines of its own key. The words that no other line has come first and are ``skipped``; after the
    ``cold`` first words of the prefix come those that may stand in more than BLOCK lines.
    """
    sent = docs.sparkSession.sparkContext.broadcast(rarity)  # 2 ** SLOT_BITS bytes

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale = sent.value
        for part in slices(parts):
            places, texts = part.column(0).to_numpy(), part.column(1).to_pylist()
            for line, words, owner, number in _lines(texts, least):
                line, words, first, size = _sets(line, words, len(number), scale)
                low, high = _signatures(words, first)
                length = size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1
                length[size < similarity * (size + 1) - 1e-9] = 0
                rare = scale[(words & _LOW).astype(np.int64)]
                inside = np.arange(len(words)) - first[line] < length[line]
                used = inside & (rare > 0)
                skipped, cold, kept = (
                    np.bincount(line[which], minlength=len(size))
                    for which in (inside & ~used, used & (rare < HOT_SCALE), used)
                )
                offsets = np.concatenate([[0], np.cumsum(kept)]).astype(np.int32)
                batch = pa.RecordBatch.from_arrays(
                    [
                        pa.array(places[owner] + number),
                        pa.array(as_long(_keys(words, first, size))),
                        pa.array(size),
                        pa.array(low),
                        pa.array(high),
                        pa.array(skipped.astype(np.int32)),
                        pa.array(cold.astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(as_long(words[used]))),
                    ],
                    names=[f.split()[0] for f in _LINES.split(", ")],
                )
                yield batch.filter(pa.array(size >= least))

    return docs.select("place", "text").mapInArrow(run, _LINES)


_MEETINGS = ["spot", "number", "shape", "low", "high"]  # shape: n, at and three marks: right block, whole, wanted


def _pairs(similarity: float, nearest: int | None):
    """Candidate pairs (a, b) of the sets that meet in a spot, a before b; ``a = b`` marks sets with candidates left out.

    Rows come in order of spot, and within a spot are put in order of number, the order in which lines go: a set looks
    at all its earlier candidates from its own side. Only the rows of an unfinished spot are held back.
    """

    def batch(firsts: list[np.ndarray], seconds: list[np.ndarray]) -> pa.RecordBatch:
        pairs = np.stack([np.concatenate(firsts), np.concatenate(seconds)], axis=1)
        pairs = np.unique(pairs, axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def compare(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        spot, number, *rest = (c.to_numpy() for c in rows.columns)
        rank = np.empty(len(spot), dtype=np.int64)
        rank[np.argsort(number)] = np.arange(len(spot))
        order = np.argsort(np.cumsum(np.diff(spot, prepend=spot[0]) != 0) * len(spot) + rank)
        spot, number, shape, low, high = (c[order] for c in (spot, number, *rest))
        n, at = shape >> 33, (shape >> 3) & ((1 << 30) - 1)
        right, whole, wanted = (shape & 4) > 0, (shape & 2) > 0, (shape & 1) > 0
        signature = np.stack([low, high], axis=1).view(np.uint64)
        held, more = np.zeros(len(spot), dtype=np.int64), np.zeros(len(spot), dtype=bool)
        firsts, seconds, count = [], [], 0
        later, step = np.flatnonzero(wanted), 0
        while True:
            step += 1
            later = later[later >= step]
            later = later[(spot[later] == spot[later - step]) & ~more[later]]
            if not len(later):
                break
            a, b = later - step, later
            fits = (whole[b] | (right[a] != right[b])) & (number[a] != number[b])
            fits &= np.minimum(n[a], n[b]) >= similarity * np.maximum(n[a], n[b]) - 1e-9
            a, b = a[fits], b[fits]
            needed = np.ceil(similarity / (1 + similarity) * (n[a] + n[b]) - 1e-9)
            fits = np.minimum(n[a] - at[a], n[b] - at[b]) >= needed
            a, b, needed = a[fits], b[fits], needed[fits]
            apart = np.bitwise_count(signature[a] ^ signature[b]).sum(axis=1)
            fits = (n[a] + n[b] - apart) // 2 >= needed
            a, b = a[fits], b[fits]
            if nearest is not None:
                full = held[b] >= nearest
                more[b[full]] = True
                a, b = a[~full], b[~full]
                held[b] += 1
            firsts.append(number[a])
            seconds.append(number[b])
            count += len(a)
            if count >= PAIRS_HELD:
                yield batch(firsts, seconds)
                firsts, seconds, count = [], [], 0
        left_out = number[more]
        yield batch([*firsts, left_out], [*seconds, left_out])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for part in parts:
            held.append(part)
            count += part.num_rows
            if count < GROUP:
                continue
            rows = pa.Table.from_batches(held)
            spot = rows.column(0).to_numpy()
            whole = int(np.searchsorted(spot, spot[-1]))
            if whole:
                yield from compare(rows.slice(0, whole))
                held, count = rows.slice(whole).to_batches(), len(spot) - whole
        if count:
            yield from compare(pa.Table.from_batches(held))

    return run


def _bitmap(table: DataFrame, values: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """One bit for the low bits of each of ``values`` of the table's batches, packed; its size is fixed."""

    def mark(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << SLOT_BITS, dtype=bool)
        for part in parts:
            seen[(values(part) & _LOW).astype(np.int64)] = True
        packed = np.packbits(seen).view(np.int64)
        at = np.flatnonzero(packed)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(packed[at])], names=["at", "bits"])

    filled = table.mapInArrow(mark, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits"))
    packed = np.zeros((1 << SLOT_BITS) // 64, dtype=np.int64)
    for row in filled.toArrow().to_pylist():  # at most 2 ** SLOT_BITS / 64 rows
        packed[row["at"]] = row["bits"]
    return packed


def _marked(packed: np.ndarray) -> np.ndarray:
    return np.unpackbits(packed.view(np.uint8)).view(bool)


_SET = ["number", "n", "low", "high"]


def _prefix_rows(sets: DataFrame) -> DataFrame:
    """One row per set and prefix word: where the word stands in the set, and whether it may be hot."""
    rows = sets.select(*_SET, "skipped", "cold", F.posexplode("prefix").alias("pos", "word"))
    return rows.select(*_SET, "word", (F.col("skipped") + F.col("pos")).alias("at"), (F.col("pos") >= F.col("cold")).alias("hot"))


def _spans(opened: DataFrame, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per slot of prefix words of open sets: the last number, and the least and greatest size that may match one."""
    slot = F.col("word").bitwiseAND(F.lit((1 << SPAN_BITS) - 1)).alias("slot")
    words = opened.select("number", "n", F.explode("prefix").alias("word")).groupBy(slot)
    found = words.agg(F.max("number").alias("last"), F.min("n").alias("least"), F.max("n").alias("most")).toArrow()
    slots, last, least, most = (c.to_numpy() for c in found.columns)  # at most 2 ** SPAN_BITS rows
    spans = np.full(1 << SPAN_BITS, -1), np.zeros(1 << SPAN_BITS, np.int32), np.zeros(1 << SPAN_BITS, np.int32)
    spans[0][slots] = last
    spans[1][slots] = np.ceil(similarity * least - 1e-9)
    spans[2][slots] = np.minimum(np.floor(most / similarity + 1e-9), (1 << 31) - 1)
    return spans


def _prefix_rows_of(sets: DataFrame, opened: DataFrame, similarity: float) -> DataFrame:
    """The rows of ``_prefix_rows`` that an open set or an earlier set of fitting size has with a word of an open
    set, and few others; the rest is never spread out."""
    sent = sets.sparkSession.sparkContext.broadcast(_spans(opened, similarity))  # 16 * 2 ** SPAN_BITS bytes

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, least, most = sent.value
        for part in parts:
            lists = part.column(len(_SET) + 2)
            length = lists.value_lengths().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(part.num_rows), length)
            words = lists.flatten().to_numpy(zero_copy_only=False)
            pos = np.arange(len(words)) - np.repeat(np.cumsum(length) - length, length)
            slot = words & ((1 << SPAN_BITS) - 1)
            number, n = (part.column(i).to_numpy()[owner] for i in range(2))
            hit = (number <= last[slot]) & (n >= least[slot]) & (n <= most[slot])
            owner, pos = owner[hit], pos[hit]
            skipped, cold = (part.column(len(_SET) + i).to_numpy()[owner] for i in range(2))
            kept = part.select(_SET).take(pa.array(owner))
            columns = [*kept.columns, pa.array(words[hit]), pa.array(skipped + pos), pa.array(pos >= cold)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept.schema.names, "word", "at", "hot"])

    schema = ", ".join(f"{c} long" for c in [*_SET, "word", "at"]) + ", hot boolean"
    return sets.select(*_SET, "skipped", "cold", "prefix").mapInArrow(run, schema)


def _candidates(few: DataFrame, many: DataFrame, similarity: float, nearest: int | None) -> DataFrame:
    """(a, b) of sets that may match, of the rows of ``_prefix_rows`` (``many``: those that may be hot) and ``wanted``,
    which says whose earlier candidates are looked for; a = b marks a set with candidates left out.

    Sets meet in spots: a word, or two blocks of a word that stands in many sets.
    """
    few = few.withColumns({"spot": F.col("word"), "right": F.lit(False), "whole": F.lit(True)})
    # Only words the counts allow to be hot are counted exactly and cut into blocks, every two of which meet.
    crowded = many.groupBy("word").agg(F.count(F.lit(1)).alias("rows"))
    many = many.join(crowded, "word").withColumn("blocks", split_count(F.col("rows"), BLOCK)).drop("rows")
    many = many.withColumn("block", F.pmod(F.xxhash64("number"), F.col("blocks"))).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    )
    left, right = F.least("block", "other"), F.greatest("block", "other")
    many = many.withColumns(
        {"spot": F.xxhash64("word", left, right), "right": F.col("block") == right, "whole": left == right}
    )
    flags = F.when(F.col("right"), 4).otherwise(0) + F.when(F.col("whole"), 2).otherwise(0)
    flags = flags + F.when(F.col("wanted"), 1).otherwise(0)
    # A text has less than 2 ** 30 words.
    shape = F.shiftleft("n", 33).bitwiseOR(F.shiftleft(F.col("at").cast("long"), 3)).bitwiseOR(flags.cast("long")).alias("shape")
    few, many = (part.select("spot", "number", shape, "low", "high") for part in (few, many))
    dealt = few.unionByName(many).repartition("spot")
    ordered = dealt.sortWithinPartitions("spot").select(*_MEETINGS)  # one long column, which Spark sorts by radix
    return ordered.mapInArrow(_pairs(similarity, nearest), "a long, b long").distinct()


def _cut_lines(texts: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts as bytes, and of each of their lines: its text, its number there, where it begins and ends."""
    held = texts.fill_null("").cast(pa.large_binary())
    _, offsets, data = held.buffers()
    edges = np.frombuffer(offsets, dtype=np.int64)[held.offset : held.offset + len(held) + 1]
    data = memoryview(data or b"")[: edges[-1]]
    breaks = np.flatnonzero(np.frombuffer(data, dtype=np.uint8)[edges[0] :] == 10) + edges[0]
    count = np.diff(np.searchsorted(breaks, edges)) + 1
    owner = np.repeat(np.arange(len(held)), count)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    last = np.append(number[1:], 0) == 0
    begin, end = edges[owner], edges[owner + 1]
    begin[number > 0], end[~last] = breaks + 1, breaks
    return data, owner, number, begin, end


def _words_of(docs: DataFrame, numbers: DataFrame, least: int) -> DataFrame:
    """(number, words) of the sets with these first places, and of some others, read again from the texts.

    A bitmap of fixed size over places tells each scan task which lines to send, so no text is shuffled.
    """

    def locate(part: pa.RecordBatch) -> np.ndarray:
        return mix(part.column(0).to_numpy())

    sent = docs.sparkSession.sparkContext.broadcast(_bitmap(numbers, locate))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = _marked(sent.value)
        for part in slices(parts):
            data, owner, number, begin, end = _cut_lines(part.column(1))
            place = part.column(0).to_numpy()[owner] + number
            chosen = np.flatnonzero(marked[(mix(place) & _LOW).astype(np.int64)])
            spans = zip(begin[chosen].tolist(), end[chosen].tolist(), strict=True)
            found = b"\n".join([str(data[a:b], "utf-8").lower().encode() for a, b in spans])
            line, words, number = _line_words(found, least)
            if not len(number):
                continue
            _, words, first, size = _sets(line, words, len(number), None)
            sets = [words[a : a + n].tobytes() for a, n in zip(first.tolist(), size.tolist(), strict=True)]
            columns = [pa.array(place[chosen][number]), pa.array(sets, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["number", "words"])

    return docs.select("place", "text").mapInArrow(run, "number long, words binary")


def _matches(pairs: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose sets are similar enough, by the words themselves."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(parts, 2048):
            left, right = columns_of(part, "left_words", "right_words")
            good = []
            for x, y in zip(left, right, strict=True):
                a, b = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                shared = len(np.intersect1d(a, b, assume_unique=True))
                good.append(shared >= similarity * (len(a) + len(b) - shared) - 1e-9)
            yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    words = words.repartition("number")  # read once for both sides
    both = pairs.join(words.select(F.col("number").alias("a"), F.col("words").alias("left_words")), "a").join(
        words.select(F.col("number").alias("b"), F.col("words").alias("right_words")), "b"
    )
    return both.select("a", "b", "left_words", "right_words").mapInArrow(run, "a long, b long")


def removed_lines(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    similarity: float = SIMILARITY,
    min_words: int = MIN_WORDS,
) -> DataFrame:
    """(doc, text_key, line) of every line that has an earlier match: a similarity of ``similarity`` or more with
    a line of an earlier document, or earlier in its own.

    Documents are in order of id (null first), then of the 64-bit hash of their text (``text_key``). Repeated rows
    of a document are one document. Words are lower-cased; lines of fewer than ``min_words`` different words never
    match, with 1 every line that has a word takes part. Null and empty texts have no such lines.
    """
    name = free_name(docs, "_place")
    full, placed = _with_place(docs, id_col, text_col, name)
    key = F.xxhash64(F.col(text_col)).alias("text_key")
    names = full.select(F.col(name).alias("place"), F.col(id_col).cast("long").alias("doc"), key).dropDuplicates(["place"])
    return _removed(placed, similarity, min_words).join(names, "place").select("doc", "text_key", "line")


def _removed(docs: DataFrame, similarity: float = SIMILARITY, min_words: int = MIN_WORDS) -> DataFrame:
    """(place, line) of every line that goes, of documents (place, text) with places of their own."""
    rows = store(line_sets(docs, rarity_table(docs), similarity, min_words), "line-sets")
    firsts = rows.groupBy("key").agg(F.min("number").alias("number")).select("number", F.lit(True).alias("first"))
    # By the number of a row, not the key, so that a line with many copies is dealt out.
    told = rows.drop("key").join(firsts.hint("shuffle_hash"), "number", "left")
    told = told.select("number", "first", *[F.when(F.col("first"), F.col(c)).alias(c) for c in told.columns[1:-1]])
    told = store(told, "sets")
    sets, copies = told.filter("first").drop("first"), told.filter("first IS NULL").select("number")
    wanted = F.lit(True).alias("wanted")
    few = _prefix_rows(sets).filter("NOT hot").select("*", wanted)
    many = _prefix_rows(sets.filter(F.col("cold") < F.size("prefix"))).filter("hot").select("*", wanted)
    near = store(_candidates(few, many, similarity, NEAREST), "candidates")
    gone = _confirmed(docs, near.filter("a <> b"), similarity, min_words)
    open_ = near.filter("a = b").select(F.col("a").alias("number")).join(gone, "number", "left_anti")
    open_ = store(open_.distinct(), "open-sets")
    if open_.limit(1).count():
        rows_of = _prefix_rows_of(sets, sets.join(open_, "number", "left_semi"), similarity)
        rows_of = rows_of.join(open_.withColumn("wanted", F.lit(True)), "number", "left")
        rows_of = store(rows_of.withColumn("wanted", F.coalesce("wanted", F.lit(False))), "open-rows")
        rest = _candidates(rows_of.filter("NOT hot"), rows_of.filter("hot"), similarity, None)
        rest = store(rest.join(near, ["a", "b"], "left_anti"), "candidates")
        gone = gone.union(_confirmed(docs, rest, similarity, min_words)).distinct()
    line = (1 << LINE_BITS) - 1
    number = F.col("number")
    return gone.union(copies).select(number.bitwiseAND(F.lit(~line)).alias("place"), number.bitwiseAND(F.lit(line)).alias("line"))


def _confirmed(docs: DataFrame, pairs: DataFrame, similarity: float, least: int) -> DataFrame:
    """(number) of the later set of each pair that matches by its words."""
    numbers = pairs.select(F.explode(F.array("a", "b")).alias("number"))
    matches = _matches(pairs, _words_of(docs, numbers, least), similarity)
    return store(matches.select(F.col("b").alias("number")).distinct(), "later-sets")


def _with_removed(docs: DataFrame, id_col: str, text_col: str, gone_col: str, **settings) -> DataFrame:
    """``docs`` and ``gone_col``, the numbers of the lines to remove from each, null if none."""
    name = free_name(docs, "_place")
    full, placed = _with_place(docs, id_col, text_col, name)
    # As many numbers as a text has lines.
    per_doc = _removed(placed, **settings).groupBy("place").agg(F.array_sort(F.collect_list("line")))
    return full.join(per_doc.toDF(name, gone_col).hint("shuffle_hash"), name, "left").drop(name)


def _without(lines: Column, gone: Column) -> Column:
    def join(held: Column) -> Column:
        numbers = F.array_except(F.sequence(F.lit(0), F.size(held) - 1), gone.cast("array<int>"))
        return F.array_join(F.transform(numbers, lambda i: F.get(held, i)), "\n")

    # The lines are bound to a variable, or they would be split again for each line.
    return F.get(F.transform(F.array(lines), join), F.lit(0))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """All rows and columns of ``docs`` with the lines of ``removed_lines`` taken out of the text, the rest in order;
    settings as there.

    A document that loses every line keeps an empty text; a null text stays null.
    """
    lines = F.split(F.col(text_col), "\n", -1)
    gone = free_name(docs, "_gone")
    text = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(_without(lines, F.col(gone)))
    return _with_removed(docs, id_col, text_col, gone, **settings).withColumn(text_col, text).drop(gone)


def line_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """One row per row of ``docs``: doc_id, text without its removed lines, n_lines, n_removed, removed_lines
    (their numbers from 0); settings as for ``removed_lines``. A null text stays null and has no lines."""
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = _with_removed(chosen, "doc_id", "text", "_gone", **settings)
    lines = F.split("text", "\n", -1)
    gone = F.coalesce("_gone", F.array().cast("array<long>"))
    return found.select(
        "doc_id",
        F.when(F.col("_gone").isNull(), F.col("text")).otherwise(_without(lines, gone)).alias("text"),
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
        F.size(gone).cast("long").alias("n_removed"),
        gone.alias("removed_lines"),
    )
