"""Token alignment against a plain version that knows no windows, and on edge cases."""

from __future__ import annotations

import hashlib
import json
from collections import Counter, defaultdict
from functools import partial

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.conftest import SMALL
from tradegrain.llm import align
from tradegrain.llm.queries import QUERIES

BYTES, PIECES = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
SIDES = (partial(align.byte_level_side, BYTES, public_tokenizers.PATTERN), partial(align.piece_side, PIECES))
ODD = [
    "plain words stand here, and <s> or <|endoftext|> or <0x41> too",
    "  two  spaces \t tab\r\n\n\nlines  ",
    "日本語の文は空白を持たない。" * 20,
    "=" * 500 + " - " * 40,
    "é é Å ﬁ 　 wide   nbsp ﻿ mark",
    "\U0001f600\U0001f468‍\U0001f469‍\U0001f467 smile",
    "under▁score ▁▁ here",
    " ".join(f"w{i % 977}" for i in range(20_000)),
    "x" * 70_000,
    " ",
    "\x00nul",
]


def plain(texts: list[str | None]) -> list[tuple]:
    import sentencepiece

    first = Tokenizer.from_file(BYTES)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    with open(BYTES, encoding="utf-8") as file:
        shown = {i: t for t, i in json.load(file)["model"]["vocab"].items()}
    value, spare = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            value[chr(b)] = b
        else:
            value[chr(spare)] = b
            spare += 1
    results, per_doc = [], []
    for text in texts:
        groups: list[tuple[list[int], list[int]]] = []
        if text:
            a = first.encode(" " + text, add_special_tokens=False).ids
            b = second.encode(text)
            a_bytes = [bytes(value[c] for c in shown[i]) for i in a]
            b_bytes = [
                bytes([int(second.id_to_piece(i)[3:5], 16)])
                if second.is_byte(i)
                else second.id_to_piece(i).replace("▁", " ").encode()
                for i in b
            ]
            if b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
                ends: list[dict[int, int]] = []
                for parts in (a_bytes, b_bytes):
                    at, seen = 0, {}
                    for n, part in enumerate(parts, 1):
                        at += len(part)
                        seen[at] = n
                    ends.append(seen)
                i = j = 0
                for end in sorted(ends[0].keys() & ends[1].keys()):
                    groups.append((a[i : ends[0][end]], b[j : ends[1][end]]))
                    i, j = ends[0][end], ends[1][end]
        links = Counter((x, y) for ours, theirs in groups for x in ours for y in theirs)
        said = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        per_doc.append(links)
        sizes = (sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), links.total())
        results.append((sizes, hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    held = Counter(pair for links in per_doc for pair in links)
    most: dict[int, int] = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    return [
        (
            *sizes,
            sum(n for p, n in links.items() if held[p] == most[p[0]]),
            sum(n * held[p] for p, n in links.items()),
            mark,
        )
        for (sizes, mark), links in zip(results, per_doc, strict=True)
    ]


@pytest.mark.parametrize("head", [align.HEAD_PAIRS, 40, 0])
def test_odd_texts_equal_the_plain_version(spark, head):
    texts = [None, "", *ODD, ODD[0], ODD[0]]
    docs = spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(texts)], "doc_id long, text string, row string, key long")
    found = align.align(docs, *SIDES, head_pairs=head)[0].collect()
    assert [tuple(r)[1:] for r in sorted(found, key=lambda r: r["doc_id"])] == plain(texts)


def test_query_equals_the_plain_version(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    wanted = plain([d["text"] for d in docs])
    assert sorted(map(tuple, QUERIES["op12_token_alignment"](spark, SMALL).collect())) == sorted(
        (d["doc_id"], *w) for d, w in zip(docs, wanted, strict=True)
    )


def test_empty_memo_changes_nothing(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(40)
    whole = sorted(map(tuple, align.align(docs, *SIDES)[0].collect()))
    monkeypatch.setattr(align, "MEMO_WINDOWS", 5)
    monkeypatch.setattr(align, "WIDE_GROUP", 2)
    assert sorted(map(tuple, align.align(docs, *SIDES)[0].collect())) == whole


def test_texts_of_a_batch_are_cut_together_and_end_as_they_would_alone():
    import numpy as np

    sides = [side() for side in SIDES]
    texts = [*filter(None, ODD), "red", "\nred", "日本", "red"]
    memo = align._Memo(*sides)
    a_ids, b_ids = ([np.array(one, dtype=np.int32) for one in side.encode(texts)] for side in sides)
    assert [memo.spelled(0, one) for one in a_ids] == [(" " + t).encode() for t in texts]
    pairs = [(a, b) for a, b in zip(a_ids, b_ids, strict=True) if memo.spelled(0, a) == memo.spelled(1, b)]
    assert len(pairs) > 10 and memo.windows([], []) == []
    together = memo.windows(*map(list, zip(*pairs, strict=True)))
    memo.settle()
    for (a, b), at in zip(pairs, together, strict=True):
        alone = align._Memo(*sides)
        (places,) = alone.windows([a], [b])
        alone.settle()
        assert [alone.texts[i] for i in places] == [memo.texts[i] for i in at]
        assert all(np.array_equal(x, y) for x, y in zip(alone.links(places), memo.links(at), strict=True))


def test_pairs_count_documents(spark):
    docs = spark.createDataFrame([(1, "red red red"), (2, "red"), (None, "red"), (None, "red")], "doc_id long, text string")
    report, pairs = align.align(docs, *SIDES)
    assert {r["n_docs"] for r in pairs.collect()} == {4}
    assert sorted((r["doc_id"] or 0, r["n_links"]) for r in report.collect()) == [(0, 1), (0, 1), (1, 3), (2, 1)]


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    report, pairs = align.align(none, *SIDES)
    assert report.collect() == [] and pairs.collect() == []
