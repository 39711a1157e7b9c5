"""Small helpers shared by the text operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradegrain.session import scratch_path

# A word is a run of anything but the six ASCII white-space characters. ``bytes.split()`` cuts exactly there.
WORD = r"[^\x20\x09-\x0D]+"


def store(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` below the shared folder and return the stored rows.

    Later steps read files instead of repeating the work, and a lost executor costs only its running tasks.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, lengthened until no column of ``df`` has the name in any case."""
    taken = {name.lower() for name in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def all_equal(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    """Null-safe equality on ``names``, still an equi-join for Spark."""
    found = F.lit(True)
    for name in names:
        found = found & left[name].eqNullSafe(right[name])
    return found


def split_count(amount: Column, per_part: int) -> Column:
    """How many parts of about ``per_part`` an amount needs, at least one."""
    return F.greatest(F.lit(1), F.ceil(amount / F.lit(per_part))).cast("long")


def columns_of(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(name)).to_pylist() for name in names]


def mix(values: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (public splitmix constants), so sums of hashes spread well."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_KEPT: dict = {}


def kept_by_worker(key: tuple, make: Callable):
    """What ``make`` makes, kept by a Python worker under ``key`` for its next task; it keeps one thing at a time."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def _give_back() -> None:
    """Free memory that this process still holds goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library of most Linux systems has it
    if trim:
        trim(0)


def slices(parts: Iterator[pa.RecordBatch], rows: int = 256, keeps: bool = False) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so few texts are held as Python objects at a time.

    What the worker keeps for tasks of another kind goes first, unless the caller is of that kind (``keeps``).
    """
    if _KEPT and not keeps:
        _KEPT.clear()
        _give_back()
    for part in parts:
        for at in range(0, part.num_rows, rows):
            yield part.slice(at, rows)


class Column64:
    """A numpy column that grows at its end."""

    def __init__(self, dtype):
        self._all, self.size = np.empty(1024, dtype=dtype), 0

    def extend(self, values) -> None:
        need = self.size + len(values)
        if need > len(self._all):
            self._all = np.concatenate([self._all, np.empty(max(need, len(self._all)), dtype=self._all.dtype)])
        self._all[self.size : need] = values
        self.size = need

    @property
    def values(self) -> np.ndarray:
        return self._all[: self.size]


class _Known(dict):
    """Words and their positions; a word that is looked up for the first time gets the next one."""

    fresh: list[bytes]

    def __missing__(self, word: bytes) -> int:
        self[word] = place = len(self)
        self.fresh.append(word)
        return place


class Words:
    """Positions of distinct words, so that per-word work is done once.

    Memory is bounded by ``limit`` words and those of one call: beyond the limit the next call starts afresh.
    """

    def __init__(self, limit: int = 300_000):
        self.limit, self.known = limit, _Known()

    def index(self, texts: list[list[bytes]]) -> tuple[list[np.ndarray], list[bytes], bool]:
        """Positions of each text's words, the words new in this call, and whether earlier positions are void."""
        afresh = len(self.known) > self.limit
        if afresh:
            self.known = _Known()
        self.known.fresh = fresh = []
        look = self.known.__getitem__
        found = [np.fromiter(map(look, words), dtype=np.int64, count=len(words)) for words in texts]
        return found, fresh, afresh


class WordIds:
    """64-bit hashes of words, each hashed once."""

    def __init__(self):
        self.words, self.hashes = Words(), Column64(np.uint64)

    def __call__(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        import xxhash

        places, fresh, afresh = self.words.index(texts)
        if afresh:
            self.hashes = Column64(np.uint64)
        self.hashes.extend([xxhash.xxh64_intdigest(w) for w in fresh])
        return [self.hashes.values[at] for at in places]


_WINDOW = 1 << 16
_STEP = 0x9E3779B97F4A7C15  # odd, so that its powers can be divided out


def _powers(step: int, count: int) -> np.ndarray:
    steps = np.full(count, step, dtype=np.uint64)
    steps[:1] = 1
    return np.cumprod(steps)


_BYTES = mix(np.arange(1, 257))
_SEARCHED = 256  # bytes before the end of a window where the last gap is sought at first
_UP, _DOWN = _powers(_STEP, _WINDOW), _powers(pow(_STEP, -1, 1 << 64), _WINDOW)


def hashed_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, and where it starts.

    Rolling hashes by running sums over windows of ``_WINDOW`` bytes that end between words; only a longer word
    needs more memory.
    """
    raw = np.frombuffer(data, dtype=np.uint8)
    space = (raw == 32) | (raw - np.uint8(9) < 5)
    hashes, places, at = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
    terms, totals = np.empty(_WINDOW, dtype=np.uint64), np.zeros(_WINDOW + 1, dtype=np.uint64)
    while at < len(raw):
        end = min(at + _WINDOW, len(raw))
        if end < len(raw):
            begin = max(at, end - _SEARCHED)
            gaps = np.flatnonzero(space[begin:end])
            if not len(gaps):
                begin, gaps = at, np.flatnonzero(space[at:end])
            if len(gaps):
                end = begin + int(gaps[-1]) + 1
            else:
                more = int(np.argmax(space[end:]))
                end = end + more + 1 if space[end + more] else len(raw)
        size = end - at
        up, down = _UP, _DOWN
        if size > _WINDOW:
            up, down = _powers(_STEP, size), _powers(pow(_STEP, -1, 1 << 64), size)
            terms, totals = np.empty(size, dtype=np.uint64), np.zeros(size + 1, dtype=np.uint64)
        outside = np.ones(size + 2, dtype=bool)
        outside[1:-1] = space[at:end]
        edges = np.flatnonzero(outside[1:] != outside[:-1])
        first, last = edges[::2], edges[1::2]
        own, sums = terms[:size], totals[: size + 1]
        np.take(_BYTES, raw[at:end], out=own, mode="clip")
        own *= up[:size]
        np.cumsum(own, out=sums[1:])
        hashes.append((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64))
        places.append(first + at)
        at = end
    return mix(np.concatenate(hashes)), np.concatenate(places)


def shingle_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """One 64-bit hash per run of ``size`` words, in order; a shorter text is one run, an empty text none."""
    if not len(ids):
        return ids
    size = min(size, len(ids))
    rows = len(ids) - size + 1
    total = np.zeros(rows, dtype=np.uint64)
    for step in range(size):
        total = mix(total + ids[step : step + rows] + np.uint64(step + 1))
    return total


def hash_bitmap(marks: DataFrame, bits: int = 24) -> np.ndarray:
    """One mark for the low bits of every number in ``hash``; the same size whatever there is to mark."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << bits, dtype=bool)
        for part in parts:
            seen[part.column(0).to_numpy(zero_copy_only=False) & ((1 << bits) - 1)] = True
        words = np.packbits(seen).view(np.int64)
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at])], names=["at", "bits"])

    filled = marks.select("hash").mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits"))
    words = np.zeros((1 << bits) // 64, dtype=np.int64)
    for row in filled.collect():  # at most 2 ** bits / 64 rows
        words[row["at"]] = row["bits"]
    return np.unpackbits(words.view(np.uint8)).astype(bool)


def as_long(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 5000) -> Iterator[pa.RecordBatch]:
    """Row tuples as record batches of at most ``size`` rows."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    arrays = [pa.array(values, type=field.type) for values, field in zip(zip(*rows, strict=True), schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)
