"""The prefix trie against a plain recursive version, and on edge cases."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tradegrain.llm import prefix_trie
from tradegrain.llm.queries import QUERIES

TURNS = "conv_id long, turn long, role string, text string, key string, depth int, place int, at int"


def plain(rows: list[tuple]) -> list[tuple]:
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    original = {c: [t[2:] for t in sorted(turns)] for c, turns in convs.items()}
    rebuilt = {}
    for c, own in original.items():
        if c is None:
            rebuilt[c] = own
            continue
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        rebuilt[c] = original.get(base, [])[:h] + own[h:]
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    least = {node: min((c for c in held if c is not None), default=None) for node, held in members.items()}
    found, sums = [], {}
    for node in sorted(members, key=len, reverse=True):
        below = [sums[child] for child in children[node]]
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        sums[node] = (sum(b[0] for b in below) or 1, sum(b[1] for b in below) + own)
        ends = sorted(c for c in members[node] if c is not None and len(rebuilt[c]) == len(node))
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        parent = least[node[:-1]] if node else None
        found.append((least[node], len(node), parent, len(members[node]), len(children[node]), *sums[node], digest))
    return sorted(found, key=str)


def got(spark, rows: list[tuple], width: int = prefix_trie.WIDTH) -> list[tuple]:
    turns = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], TURNS)
    return sorted(map(tuple, prefix_trie.prefix_trie(*prefix_trie.rebuilt_turns(turns), width=width).collect()), key=str)


def made(n: int, longest: int) -> list[tuple]:
    rows = []
    for c in range(n):
        for t in range((c * 7) % longest):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"turn {t} of {'é' * (c % 3)} kind {(c // 4) % 3 if t < 20 else c}"))
    return rows


@pytest.mark.parametrize("width", [1, 3, 8])
def test_made_conversations_equal_the_plain_version(spark, width):
    rows = made(60, 30)
    assert got(spark, rows, width) == plain(rows)


def test_long_copies_nulls_ties_and_turnless(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "STRETCH", 2)
    monkeypatch.setattr(prefix_trie, "ID_BITS", 1)
    rows = [(c, t, "user", f"long {t}") for c in (100, 101, 105, -7, -5, None) for t in range(75)]
    rows += [(c, None, None, None) for c in (3, 3, 10, 11, None)]
    rows += [(c, 0, "user", "same") for c in (20, 20, 21, 22, 25, 30, 31)] + [(22, 1, None, "same"), (22, 1, "user", None)]
    rows += [(c, 0, "user", "copy") for c in range(200, 260)]
    # Ids whose first turns come from an absent or shorter conversation have none left.
    turnless = [c for c in range(1000, 1100) if zlib.crc32(str(c).encode()) % 9 > 0 and c % 5][:4]
    rows += [(c, 0, "user", "gone") for c in turnless]
    assert got(spark, rows) == plain(rows)


def test_query_equals_the_plain_version(spark):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op13_prefix_trie"](spark, SMALL).collect()), key=str) == plain(rows)


def test_one_conversation_with_most_rows(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") < 2000, 7).otherwise(F.col("id")).alias("conv_id"),
        F.col("id").alias("turn"),
        F.lit("user").alias("role"),
        F.concat(F.lit("t"), F.col("id")).alias("text"),
    )
    found = prefix_trie.prefix_trie(*prefix_trie.rebuilt_turns(rows))
    assert sorted(map(tuple, found.collect()), key=str) == plain([tuple(r) for r in rows.collect()])


def test_empty_table(spark):
    assert got(spark, []) == []
