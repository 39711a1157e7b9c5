"""What a task of line dedup holds at a time."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.test_text_operators import brute_places
from tradegrain.llm import lines


def test_signatures_are_parities_and_short_lines_need_little():
    """A signature took a kilobyte for each line while it was made, so a run of short lines took hundreds of megabytes."""
    rng = np.random.default_rng(5)
    size = rng.integers(1, 4, 100_000)
    words, first = rng.integers(0, 1 << 63, int(size.sum())).astype(np.uint64), np.cumsum(size) - size
    tracemalloc.start()
    low, high = lines._signatures(words, first)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 * len(words)
    for i in range(50):
        marks = 0
        for word in words[first[i] : first[i] + size[i]]:
            marks ^= 1 << int(lines.mix(np.array([word]))[0] >> np.uint64(57))
        assert (int(low[i]) & (1 << 64) - 1) | (int(high[i]) & (1 << 64) - 1) << 64 == marks


def test_slots_are_counted_alike_however_often_they_are_added_up(spark, monkeypatch):
    rows = [(i, " ".join(f"w{i * j % 97}" for j in range(200))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = lines.rarity_table(docs)
    words = np.concatenate([lines.hashed_words(t.encode())[0] for _, t in rows])
    slots, times = np.unique((words & lines._LOW).astype(np.int64), return_counts=True)
    assert (table[slots] == np.minimum(255, np.round(16 * np.log2(times)))).all() and np.count_nonzero(table) <= len(slots)


def test_one_python_worker_a_task(spark, monkeypatch):
    """Places were marked by two Python steps in one task, each in a worker of its own."""
    plans, packed = [], lines._bitmap

    def watched(table, *rest):
        plans.append(table._jdf.queryExecution().executedPlan().toString())
        return packed(table, *rest)

    monkeypatch.setattr(lines, "_bitmap", watched)
    rows = [(i, f"one two three four five six seven eight nine w{i}") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert lines.removed_lines(docs).count() == 19
    assert plans and not any("MapInArrow" in plan for plan in plans)


def test_repeated_rows_make_one_set(spark, monkeypatch):
    """A set comes from one row, however many rows of one document or lines of other documents have its words."""
    seen, prefixes = [], lines._prefix_rows

    def watched(sets):
        seen.append(sets.agg(F.count("number"), F.countDistinct("number")).first())
        return prefixes(sets)

    monkeypatch.setattr(lines, "_prefix_rows", watched)
    text = "a b c d e f\nf e d c b a\nq r s t u v w x y z"
    docs = spark.createDataFrame([(1, text)] * 30 + [(2, text), (None, text)], "doc_id long, text string").repartition(7)
    found = {(r["doc"], r["line"]) for r in lines.removed_lines(docs).collect()}
    assert found == {(None, 1), *((d, n) for d in (1, 2) for n in range(3))}
    assert tuple(seen[0]) == (2, 2)


def test_rows_of_lines_are_stored_twice(spark, monkeypatch):
    """Two more tables of all sets were written to number them in order, which took disk and a sort."""
    stored, store = [], lines.store

    def watched(table, label):
        stored.append(store(table, label))
        return stored[-1]

    monkeypatch.setattr(lines, "store", watched)
    rows = [(i, f"one two three four five six seven eight nine w{i}\nother v{i} and u{i} and t{i}") for i in range(20)]
    assert lines.removed_lines(spark.createDataFrame(rows, "doc_id long, text string")).count() == 19
    assert [table.count() for table in stored].count(40) == 2


@pytest.mark.parametrize("ids", [[3, None, 1, 2], [-(1 << 62), None, 5, 1 << 62], [4, 4, None, None], [0, (1 << 32) - 2, 1, 2]])
def test_places_by_id_and_by_sorting_give_the_same_lines(spark, ids):
    texts = [f"a b c d e\nf g h\n\na b c d e {i}\nown{i} line{i}\nh g f" for i in range(4)]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)) * 2, "doc_id long, text string")
    for frame in (docs, docs.dropDuplicates(["doc_id", "text"])):
        found = frame.transform(lines.removed_lines).collect()
        assert len(found) == len(set(found))
        assert {(r["doc"], r["text_key"], r["line"]) for r in found} == brute_places(frame, 1)


def test_lines_are_cut_in_place():
    texts = pa.array(["skip", "a\n\nb", None, "", "\n", "é\nz\n", "last"])
    for part in (texts, texts[1:], texts[2:5]):
        data, owner, number, begin, end = lines._cut_lines(part)
        found = [(o, n, str(data[a:b], "utf-8")) for o, n, a, b in zip(*(c.tolist() for c in (owner, number, begin, end)), strict=True)]
        assert found == [(i, n, line) for i, t in enumerate(part.to_pylist()) for n, line in enumerate((t or "").split("\n"))]
