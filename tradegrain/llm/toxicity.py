"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are hashed into ``2 ** BITS`` coordinates, each present or absent in a text: words, the first letters of
longer words, pairs of neighbours and pairs with one or two words between. Every coordinate has its own learning
rate, and the L1 term leaves few weights other than zero, so what goes to the tasks is small and never more than
``2 ** BITS`` weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradegrain.llm.common import Column64, Words, columns_of, mix

BITS = 20
STEM = 5  # letters of the word beginnings that are features of their own
SKIPS = (1, 2, 3)
MAX_TRAINING_ROWS = 12_000  # the labelled rows a model is fitted on, chosen by hash


@dataclass(frozen=True)
class Settings:
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 3.0
    l2: float = 1.0
    rounds: int = 3


_EDGES = ".,;:!?\"'()[]{}*#$%&|<>-_/\\"


class Features:
    """Coordinates of texts, with repeats."""

    def __init__(self):
        self.known, self.words, self.stems = Words(), Column64(np.uint64), Column64(np.uint64)

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        import xxhash

        split = [(t or "").encode().split() for t in texts]
        places, fresh, afresh = self.known.index(split)
        if afresh:
            self.words, self.stems = Column64(np.uint64), Column64(np.uint64)
        forms = [w.decode().lower() for w in fresh]
        forms = [f.strip(_EDGES) or f for f in forms]
        self.words.extend([xxhash.xxh64_intdigest(f) for f in forms])
        # Zero stands for no beginning of its own.
        self.stems.extend([xxhash.xxh64_intdigest(f[:STEM], 1) | 1 if len(f) > STEM else 0 for f in forms])
        out = []
        for at in places:
            ids, begun = self.words.values[at], self.stems.values[at]
            kinds = [ids, begun[begun > 0]]
            for skip in SKIPS:
                kinds.append(ids[:-skip] * np.uint64(2 * skip + 1) + ids[skip:])
            out.append((mix(np.concatenate(kinds)) >> np.uint64(64 - BITS)).astype(np.int64))
        return out


def fit(examples: list[tuple[np.ndarray, int]], settings: Settings = Settings()) -> tuple[np.ndarray, np.ndarray, float]:
    """(coordinates, weights, bias) after ``rounds`` passes over the examples in their order."""
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)  # the last coordinate is the bias, without L1

    def weights(at: np.ndarray, l1: float) -> np.ndarray:
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - l1, 0.0)
        return -shrunk / ((settings.beta + np.sqrt(n[at])) / settings.alpha + settings.l2)

    bias = np.array([size])
    for _ in range(settings.rounds):
        for at, label in examples:
            w = weights(at, settings.l1)
            w0 = weights(bias, 0.0)
            gradient = float(logistic(w.sum() + w0[0])) - label
            for where, value in ((at, w), (bias, w0)):
                rate = (np.sqrt(n[where] + gradient**2) - np.sqrt(n[where])) / settings.alpha
                z[where] += gradient - rate * value
                n[where] += gradient**2
    every = weights(np.arange(size), settings.l1)
    at = np.flatnonzero(every)
    return at, every[at], float(weights(bias, 0.0)[0])


def logistic(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30.0, 30.0)))


def _split(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str, most: int) -> DataFrame:
    """(doc_id, label, coordinates as 32-bit numbers) of at most ``most`` labelled documents that are not held out.

    The rows with the least hashes of their id are chosen. A document with several labels has the highest, one
    that occurs several times counts once.
    """
    marks = labels.select("doc_id", F.col(label_col).cast("int").alias("label")).dropna()
    marks = marks.filter(~_split(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = marks.orderBy(F.xxhash64("doc_id", F.lit("train")), "doc_id").limit(most)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for part in parts:
            ids, found, texts = columns_of(part, "doc_id", "label", "text")
            coordinates = []
            for at in range(0, len(texts), 64):
                coordinates += [np.unique(f).astype("<i4").tobytes() for f in features(texts[at : at + 64])]
            arrays = [pa.array(ids, pa.int64()), pa.array(found, pa.int32()), pa.array(coordinates, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "label", "at"])

    # The bound of this broadcast is ``most`` rows of two numbers.
    texts = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
    found = texts.mapInArrow(run, "doc_id long, label int, at binary")
    return found.groupBy("doc_id").agg(F.min("label").alias("label"), F.min("at").alias("at"))


def _learn(settings: Settings):
    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({"at": [], "weight": [], "bias": []})
        order = rows["doc_id"].map(lambda i: int(mix(np.array([i], dtype=np.int64).view(np.uint64))[0]))
        rows = rows.assign(order=order).sort_values(["order", "doc_id"])
        examples = [
            (np.frombuffer(at, dtype="<i4").astype(np.int64), int(label > 0))
            for at, label in zip(rows["at"], rows["label"], strict=True)
        ]
        at, weights, bias = fit(examples, settings)
        packed = {"at": [at.astype("<i4").tobytes()], "weight": [weights.astype("<f8").tobytes()], "bias": [bias]}
        return pd.DataFrame(packed)

    return learn


def score(
    docs: DataFrame,
    labels: DataFrame,
    *,
    label_col: str = "toxic",
    id_col: str = "doc_id",
    text_col: str = "text",
    settings: Settings = Settings(),
    max_training_rows: int = MAX_TRAINING_ROWS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    The model is fitted on at most ``max_training_rows`` labelled rows whose id's checksum is not divisible by
    five; every document is scored on its whole text and nothing else. Null and empty texts get the score of no
    features, a null id is not held out, and repeated rows each keep their row. Null labels are void. Without a
    labelled row nothing is known and every score is close to 0. Other columns are not carried.
    """
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = training_rows(chosen, labels, label_col, max_training_rows)
    fitted = rows.groupBy().applyInPandas(_learn(settings), "at binary, weight binary, bias double").collect()
    weights = np.zeros(1 << BITS)
    bias = -30.0
    for row in fitted:  # one row at most
        weights[np.frombuffer(row["at"], dtype="<i4")] = np.frombuffer(row["weight"], dtype="<f8")
        bias = row["bias"]
    kept = np.flatnonzero(weights)
    # At most 2 ** BITS weights, in practice the few thousand that L1 leaves.
    model = docs.sparkSession.sparkContext.broadcast((kept, weights[kept], bias))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, values, base = model.value
        dense = np.zeros(1 << BITS)
        dense[places] = values
        features = Features()
        for part in parts:
            ids, texts = columns_of(part, "doc_id", "text")
            scores = []
            for at in range(0, len(texts), 64):
                for found in features(texts[at : at + 64]):
                    found = np.unique(found[dense[found] != 0])
                    scores.append(float(logistic(dense[found].sum() + base)))
            arrays = [pa.array(ids, pa.int64()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "score"])

    scored = chosen.mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id", _split(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
