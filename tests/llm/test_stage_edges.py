"""Clashing column names, empty tables and odd rows, for what returns whole documents and for each pipeline stage."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import SMALL
from tests.llm.test_text_operators import LONG, PROSE
from tradegrain.llm import decontaminate, lines, quality, simhash

CLASHING = ["_doc", "_key", "_text_key", "_gone", "_id", "_lang", "_row", "_bad", "row", "whole", "key", "gone", "first", "group"]
ROWS = [
    (1, PROSE + "\nshort", "en", "a", 1),
    (2, PROSE, None, None, None),
    (3, None, None, None, None),
    (4, "", "en", "a", 0),
    (5, LONG, "de", "b", 1),
    (None, PROSE, "en", "a", 1),
    (7, PROSE, "en", "a", 1),
    (7, PROSE, "en", "a", 1),
]
KEEPERS = {
    "lines": lambda docs, items: lines.dedup_lines(docs),
    "quality": lambda docs, items: quality.keep_good(docs),
    "near": lambda docs, items: simhash.keep_one(docs),
    "ids": lambda docs, items: decontaminate.drop_contaminated(docs, items),
    "texts": lambda docs, items: decontaminate.drop_contaminated_texts(docs, items),
}


@pytest.fixture(scope="module")
def plain(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "six seven eight nine ten"), (None, "elsewhere only in this one item"), (2, None)], "item_id long, text string")


@pytest.mark.parametrize("name", sorted(KEEPERS))
def test_clashing_names_change_nothing(plain, items, name):
    crowded = plain.select("*", *(F.lit(f"value of {c}").alias(c) for c in CLASHING))
    found = KEEPERS[name](crowded, items)
    assert found.columns == crowded.columns
    rows = found.collect()
    assert all(r[c] == f"value of {c}" for r in rows for c in CLASHING)
    expected = KEEPERS[name](plain, items).collect()
    assert Counter(tuple(r)[:5] for r in rows) == Counter(map(tuple, expected))


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_empty_and_odd_tables(spark, plain, stage):
    function = dict(corpus_pipeline.STAGES)[stage]
    assert function(spark, plain.limit(0), SMALL).count() == 0
    crowded = plain.select("*", *(F.lit(1).alias(c) for c in CLASHING))
    found = function(spark, crowded, SMALL)
    rows = found.collect()
    if stage == "packing":
        # The words of every row are in some piece, null texts as empty ones.
        assert Counter(r["doc_id"] for r in rows if r["start"] == 0) == Counter(r[0] for r in ROWS)
    else:
        assert found.columns == corpus_pipeline.COLUMNS
        held = Counter(r[0] for r in ROWS)
        assert all(n <= held[i] for i, n in Counter(r["doc_id"] for r in rows).items())


def test_quality_stage_keeps_what_the_operator_keeps(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = {r["doc_id"] for r in quality.judge(docs).filter("kept").collect()}
    found = corpus_pipeline.quality_rules(spark, docs, SMALL)
    assert Counter(map(tuple, found.collect())) == Counter(
        tuple(r) for r in docs.select(*corpus_pipeline.COLUMNS).collect() if r["doc_id"] in kept
    )


def test_near_stage_keeps_the_least_of_each_group(plain):
    found = {(r["doc_id"], r["text"]) for r in simhash.keep_one(plain).collect()}
    # Null and empty texts are one group, equal texts another.
    assert (3, None) in found and (4, "") not in found and (2, PROSE) in found and (5, LONG) in found
    assert not any(i in (7, None) for i, _ in found)
