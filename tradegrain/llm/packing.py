"""Vector bin packing of token sequences.

An item is a piece of a document with three sizes: tokens, segments (one) and loss-bearing tokens. A bin is one
training sequence with a limit on each. The dot-product heuristic fills one bin at a time with the waiting item
whose sizes point most nearly along what is left of the limits. When nothing fits whole, the gap is closed by
cutting a piece off the longest waiting item, so only the last bin of a pool can need padding.

Each task packs the rows of its own input split, in pools of bounded size. No token crosses a shuffle, there is
no group whose size the data decide, and a task that runs again on the same split packs the same way.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradegrain.llm.common import Column64, Words, batches, kept_by_worker, slices

LONG_WORD = 1000  # bytes; a longer word goes to the whole tokenizer
WORDS_HELD = 600_000  # distinct words a worker remembers, some 200 bytes each
STOPS = (b".", b",")
WORD_END = "</w>"  # what ends the last token of a word in the vocabulary
SEQUENCE_BITS = 32  # a sequence id is the task number above these bits and a running number below
PIECES = (
    "doc_id long, start long, length long, ids binary, loss_tokens long, doc_tokens long, "
    "sequence_id long, offset long"
)
_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids", pa.binary()),
        ("loss_tokens", pa.int64()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
    ]
)


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold; a sequence of ``tokens`` length, or of a power of two, is not padded."""

    tokens: int = 4096
    segments: int = 1024
    loss_tokens: int = 4096


@dataclass
class Item:
    doc_id: int | None
    start: int
    ids: np.ndarray
    loss: np.ndarray
    doc_tokens: int

    def __post_init__(self):
        self.shape = len(self.ids), int(np.count_nonzero(self.loss))

    def cut(self, length: int) -> tuple[Item, Item]:
        head = Item(self.doc_id, self.start, self.ids[:length], self.loss[:length], self.doc_tokens)
        tail = Item(self.doc_id, self.start + length, self.ids[length:], self.loss[length:], self.doc_tokens)
        return head, tail


def _longest_prefix(loss: np.ndarray, tokens: int, loss_tokens: int) -> int:
    """The most leading tokens that keep within both limits."""
    over = np.flatnonzero(np.cumsum(loss[:tokens]) > loss_tokens)
    return int(over[0]) if len(over) else min(tokens, len(loss))


def fill(items: list[Item], limits: Limits) -> Iterator[list[Item]]:
    """Bins of items that use up ``items``; items of equal sizes are interchangeable and counted, not compared."""
    waiting: dict[tuple[int, int], list[Item]] = {}
    for item in items:
        waiting.setdefault(item.shape, []).append(item)
    full = np.array([limits.tokens, limits.segments, limits.loss_tokens], dtype=float)
    shapes = np.array(sorted(waiting), dtype=np.int64).reshape(-1, 2)
    counts = np.array([len(waiting[tuple(s)]) for s in shapes.tolist()], dtype=np.int64)

    def take(at: int) -> Item:
        counts[at] -= 1
        return waiting[tuple(shapes[at].tolist())].pop()

    def put(item: Item) -> None:
        nonlocal shapes, counts
        found = np.flatnonzero((shapes[:, 0] == item.shape[0]) & (shapes[:, 1] == item.shape[1]))
        waiting.setdefault(item.shape, []).append(item)
        if len(found):
            counts[found[0]] += 1
        else:
            shapes, counts = np.vstack([shapes, item.shape]), np.append(counts, 1)

    while counts.sum():
        left = full.copy()
        held: list[Item] = []
        while left[0] > 0 and left[1] > 0:
            fits = (counts > 0) & (shapes[:, 0] <= left[0]) & (shapes[:, 1] <= left[2])
            if fits.any():
                toward = shapes[:, 0] * left[0] / full[0] ** 2 + left[1] / full[1] ** 2
                toward = toward + shapes[:, 1] * left[2] / full[2] ** 2
                item = take(int(np.argmax(np.where(fits, toward, -1.0))))
            else:
                at = np.flatnonzero(counts > 0)
                if not len(at):
                    break
                whole = take(int(at[np.argmax(shapes[at, 0])]))
                length = _longest_prefix(whole.loss, int(left[0]), int(left[2]))
                if not length:
                    put(whole)
                    break
                item, rest = whole.cut(length)
                put(rest)
            held.append(item)
            left -= (item.shape[0], 1, item.shape[1])
        if not held:
            raise ValueError("a single token exceeds the limits")
        yield held


def pack(
    examples: DataFrame,
    encode: Callable[[], Callable[[list], list[tuple[np.ndarray, np.ndarray]]]],
    columns: list[str],
    limits: Limits = Limits(),
    *,
    id_col: str = "doc_id",
    pool_tokens: int = 1 << 20,
    pool_items: int = 20_000,
) -> DataFrame:
    """Pieces of all rows of ``examples`` as ``PIECES``, each with its token ids (unsigned 32-bit little-endian).

    ``encode`` is called once in a task and returns a function from a list of rows of ``columns`` to, for each,
    its token ids and a boolean per token that bears loss. Rows without tokens give no piece. Repeated rows are
    packed one by one; a null id stays null. Other columns are not carried. A pool holds up to ``pool_tokens``
    tokens in up to ``pool_items`` items, which bounds a task's memory.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encode()
        first = TaskContext.get().partitionId() << SEQUENCE_BITS
        made = 0

        def pieces(pool: list[Item]) -> Iterator[tuple]:
            nonlocal made
            for held in fill(pool, limits):
                offset = 0
                for item in held:
                    size, loss = item.shape
                    ids = np.asarray(item.ids, dtype="<u4").tobytes()
                    yield item.doc_id, item.start, size, ids, loss, item.doc_tokens, first + made, offset
                    offset += size
                made += 1

        def packed() -> Iterator[tuple]:
            pool: list[Item] = []
            tokens = 0
            for part in slices(parts, keeps=True):
                keys = part.column(0).to_pylist()
                rows = list(zip(*(part.column(i + 1).to_pylist() for i in range(len(columns))), strict=True))
                for key, (ids, loss) in zip(keys, encoder(rows), strict=True):
                    item = Item(key, 0, ids, loss, len(ids))
                    while len(item.ids) > limits.tokens:  # whole sequences of one long document
                        length = _longest_prefix(item.loss, limits.tokens, limits.loss_tokens)
                        if not length:
                            break
                        head, item = item.cut(length)
                        if length == limits.tokens:
                            yield from pieces([head])
                        else:
                            pool.append(head)
                            tokens += length
                    if len(item.ids):
                        pool.append(item)
                        tokens += len(item.ids)
                    if tokens >= pool_tokens or len(pool) >= pool_items:
                        yield from pieces(pool)
                        pool, tokens = [], 0
            yield from pieces(pool)

        yield from batches(packed(), _ARROW, 500)

    chosen = examples.select(F.col(id_col).cast("long"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(columns)])
    return chosen.mapInArrow(run, PIECES)


def document_encoder(vocabulary: str, end_id: int = 2):
    """An ``encode`` for plain texts: ids of ``vocabulary`` (a tokenizers file that never joins words over white
    space) and then ``end_id``, every token bearing loss. A null text is empty.

    Texts are cut at ASCII white space and each distinct word is tokenized once per worker, as long as it is held.
    The vocabulary's normalizer lower-cases, so letter case is settled before words are compared, and one full
    stop or comma after a letter of ASCII or Latin-1 is a token of its own, so it is split off. Words that could hold a special
    token's name are left as they are. Words of lower-case letters only would pass the normalizer unchanged and the
    word splitter as one piece, so they go straight to the vocabulary's merges, many at a time.
    """

    key = ("words", vocabulary, end_id)
    return partial(kept_by_worker, key, partial(_word_encoder, vocabulary, end_id))


def _word_encoder(vocabulary: str, end_id: int):
    """The encoder of ``document_encoder``; a Python worker keeps it, and the words it knows, for its next task of the kind."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary)
    words = Words(WORDS_HELD)
    ids, begins, sizes = Column64(np.uint32), Column64(np.int64), Column64(np.int64)
    stop_ids = {stop: tokenizer.encode(stop.decode(), add_special_tokens=False).ids for stop in STOPS}
    stops_cut = STOPS if all(len(one) == 1 for one in stop_ids.values()) else ()

    merges = _merge_encoder(vocabulary)
    is_end = np.array([(tokenizer.id_to_token(i) or "").endswith(WORD_END) for i in range(tokenizer.get_vocab_size())])

    def split_ids(chosen: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after another, and how many each has, by the whole tokenizer."""
        encoded = tokenizer.encode_batch_fast([p.decode() for p in chosen], add_special_tokens=False)
        single = [one.ids for one in encoded]
        lengths = np.fromiter(map(len, single), dtype=np.int64, count=len(single))
        return np.fromiter(chain.from_iterable(single), dtype=np.uint32, count=int(lengths.sum())), lengths

    def merged_ids(letters: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The same of plain words, each followed by a space, by the merges alone."""
        if merges is None:
            return split_ids(letters.split())
        found = merges.encode_ordinary(letters.decode())
        found = np.fromiter(found, dtype=np.uint32, count=len(found))
        return found, np.diff(np.flatnonzero(is_end[found]) + 1, prepend=0)

    def tokenize(fresh: list[bytes]) -> None:
        """Learn the ids of new words: plain ones go to the merges in one string, the rest one by one."""
        if not fresh:
            return
        letters, plain, stop = _plain_words(fresh, stops_cut)
        rest = [_parted(word, stops_cut) for word in compress(fresh, ~plain)]
        simple = np.array([kind and len(core) <= LONG_WORD for _, core, kind in rest], dtype=bool)
        at = np.flatnonzero(~plain)
        stop[at] = [end[0] if end else 0 for end, _, _ in rest]
        cores = [core for _, core, _ in rest]
        begin, size = np.zeros(len(fresh), dtype=np.int64), np.zeros(len(fresh), dtype=np.int64)
        for chosen, ids_of, parts in (
            (np.flatnonzero(plain), merged_ids, letters),
            (at[simple], merged_ids, b"".join(core + b" " for core in compress(cores, simple))),
            (at[~simple], split_ids, list(compress(cores, ~simple))),
        ):
            if not len(chosen):
                continue
            found, lengths = ids_of(parts)
            # Room for the id of a stop that was cut off.
            ends = stop[chosen]
            tail = (ends > 0).astype(np.int64)
            width = lengths + tail
            after = np.cumsum(width)
            moved = np.empty(int(width.sum()), dtype=np.uint32)
            moved[np.arange(len(found)) + np.repeat(np.cumsum(tail) - tail, lengths)] = found
            moved[after[tail > 0] - 1] = [stop_ids[bytes([end])][0] for end in ends[tail > 0].tolist()]
            begin[chosen] = ids.size + after - width
            size[chosen] = width
            ids.extend(moved)
        begins.extend(begin)
        sizes.extend(size)

    def encode(rows: list[tuple]) -> list[tuple[np.ndarray, np.ndarray]]:
        nonlocal ids, begins, sizes
        out = []
        for at in range(0, len(rows), 256):
            raw = [(row[0] or "").encode() for row in rows[at : at + 256]]
            texts = [(t if b"<|" in t else t.lower()).split() for t in raw]
            places, fresh, afresh = words.index(texts)
            if afresh:
                ids, begins, sizes = Column64(np.uint32), Column64(np.int64), Column64(np.int64)
            tokenize(fresh)
            out += [joined(p) for p in places]
        return out

    def joined(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = sizes.values[places]
        ends = np.cumsum(size)
        total = int(size.sum())
        found = np.empty(total + 1, dtype=np.uint32)
        found[:-1] = ids.values[np.repeat(begins.values[places] - (ends - size), size) + np.arange(total)]
        found[-1] = end_id
        return found, np.ones(total + 1, dtype=bool)

    return encode


_LETTERS = frozenset(b"abcdefghijklmnopqrstuvwxyz")


def _stop(word: bytes) -> bytes:
    """The full stop or comma that ends a word after a letter of ASCII or Latin-1, else nothing."""
    if len(word) < 2 or b"<|" in word:
        return b""
    accented = word[-3:-2] == b"\xc3" and word[-2] not in (0x97, 0xB7)  # but for the signs of times and division
    return word[-1:] if word[-2] in _LETTERS or accented else b""


def _parted(word: bytes, stops: tuple[bytes, ...]) -> tuple[bytes, bytes, bool]:
    """The stop that ends a word, the rest, and whether that is simple.

    A rest of Latin-1 letters only is put in lower case, each letter by itself as the normalizer has it; composed
    letters of lower case are simple.
    """
    end = _stop(word) if word.endswith(stops) else b""
    core = word[:-1] if end else word
    if not core.isascii():
        text = core.decode()
        if text.isalpha() and max(text) < "\u0100":
            return end, text.lower().encode(), True
    return end, core, _is_simple(core)


def _plain_words(words: list[bytes], stops: tuple[bytes, ...]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Which words are plain: lower-case letters of ASCII and letters of Latin-1 above U+00BF, perhaps with a stop at the end.

    Gives the plain words in lower case without their stops, each followed by a space; a mark per word; and the stop
    of each plain word, else 0. They are settled as ``_parted`` does it, all together.
    """
    raw = np.frombuffer(b" ".join(words) + b" ", dtype=np.uint8)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    after = np.cumsum(size)
    lead = raw == 0xC3
    accented = np.append(False, lead[:-1]) & (raw != 0x97) & (raw != 0xB7)  # but for the signs of times and division
    letter = (raw - np.uint8(97) < 26) | accented
    odd = np.add.reduceat(~(letter | lead), after - size, dtype=np.int64) - 1
    last = raw[after - 2]
    stopped = np.isin(last, [stop[0] for stop in stops]) & letter[after - 3] & (size > 2)
    plain = (odd == stopped) & (size <= LONG_WORD)
    stopped &= plain
    kept = np.repeat(plain, size)
    kept[after[stopped] - 2] = False
    lowered = raw + np.where(accented & (raw < 0x9F), np.uint8(32), np.uint8(0))
    return lowered[kept].tobytes(), plain, np.where(stopped, last, 0)


# The visible stand-ins of byte-level vocabularies: printable bytes stand for themselves, others for 256 and up.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_OTHERS = [b for b in range(256) if b not in set(_PRINTABLE)]
_LETTER_BYTES = {chr(b): b for b in _PRINTABLE} | {chr(256 + i): b for i, b in enumerate(_OTHERS)}


def _merge_encoder(vocabulary: str):
    """The merges of a byte-level vocabulary as an encoder of words that each end with a space; none if it is of another kind.

    Entries must be numbered in the order of their merges, after single bytes and single bytes that end a word; then an
    entry's number is its rank. The space stands for the end of a word, so no longer entry may hold one itself.
    """
    import tiktoken

    with open(vocabulary, encoding="utf-8") as file:
        model = json.load(file)["model"]
    if model["type"] != "BPE" or model.get("end_of_word_suffix") != WORD_END:
        return None
    entries = {e: (e.removesuffix(WORD_END), at) for e, at in model["vocab"].items()}
    longer = [e for e, (core, _) in sorted(entries.items(), key=lambda one: one[1][1]) if len(core) > 1]
    joined = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    if joined != longer or [entries[e][1] for e in longer] != list(range(512, len(entries))):
        return None
    if any("\u0120" in entries[e][0] for e in longer) or not set("".join(core for core, _ in entries.values())) <= _LETTER_BYTES.keys():
        return None
    ranks = {bytes(map(_LETTER_BYTES.__getitem__, core)) + b" " * (core != e): at for e, (core, at) in entries.items()}
    if len(ranks) != len(entries):
        return None
    return tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})


def _is_simple(part: bytes) -> bool:
    """Whether a part is lower-case letters in composed form, nothing else."""
    if part.isascii():
        return part.isalpha() and part.islower()
    text = part.decode()
    return text.isalpha() and unicodedata.is_normalized("NFC", text) and text == text.lower()
