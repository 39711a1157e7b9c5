"""Order statistics, samples and duplicate rows without sorting or shuffling the input, beside plain versions."""

from __future__ import annotations

import random
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.conftest import plan_of
from tradegrain.operators.ordered import number_rows, quartile
from tradegrain.operators.sampling import sample_exactly
from tradegrain.operators.selection import quartiles, rows_at
from tradegrain.plans.quality import repeated_rows


def made(kind: str, n: int) -> list[tuple]:
    rng = random.Random(n)
    pick = {
        "ties": lambda: rng.choice([3, 3, 3, 4, None]),
        "wide": lambda: rng.randrange(-(10**17), 10**17),
        "money": lambda: rng.choice([None, Decimal(rng.randrange(-500, 10**9)) / 100]),
        "one": lambda: 7,
        "null": lambda: None,
    }[kind]
    return [(f"c{i:05d}", pick()) for i in rng.sample(range(n), n)]


@pytest.mark.parametrize("kind", ["ties", "wide", "money", "one", "null"])
def test_selected_rows_and_quartiles_equal_the_sorted_order(spark, kind):
    rows = made(kind, 997)
    df = spark.createDataFrame(rows, f"who string, v {'decimal(28,2)' if kind == 'money' else 'long'}").repartition(7)
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    ranks = [1, 250, 499, 748, 997]
    scale = 100 if kind == "money" else 1
    assert rows_at(df, "v", "who", ranks) == [(None if order[k - 1][1] is None else int(order[k - 1][1] * scale), order[k - 1][0]) for k in ranks]
    sorted_way = number_rows(df, [F.col("v").asc_nulls_first(), F.col("who")], "rank", total="n")
    expected = {r.who: r.q for r in sorted_way.select("who", quartile(F.col("rank"), F.col("n")).alias("q")).collect()}
    assert {r.who: r.q for r in df.select("who", quartiles(df, "v", "who", 997).alias("q")).collect()} == expected


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5])
def test_few_rows(spark, n):
    df = spark.range(n).selectExpr("cast(id AS string) AS who", "id AS v")
    expected = {0: [], 1: [1], 2: [1, 4], 3: [1, 2, 4], 5: [1, 1, 2, 3, 4]}[n]
    assert [r.q for r in df.select("who", quartiles(df, "v", "who", n).alias("q")).orderBy("who").collect()] == expected


def test_quartiles_need_no_exchange(spark):
    df = spark.range(100).selectExpr("cast(id AS string) AS who", "id AS v")
    assert "Exchange" not in plan_of(df.select(quartiles(df, "v", "who", 100)))


def test_sample_ranks_only_the_cells_it_fills(spark):
    df = spark.range(0, 200_000, 1, 8)
    plan = sample_exactly(df, "id", 50)
    # Of 65,536 cells with three rows each a few are filled; only their rows cross the second shuffle.
    assert plan.count() == 50
    shown = plan_of(plan)
    assert shown.index("BroadcastHashJoin") > shown.index("Window")  # the filter stands below the ranking
    assert "SortMergeJoin" not in shown


def test_duplicates_with_equal_hashes_are_compared_as_rows(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, 1, 2]), rng.choice([None, "a", "b", ""]), rng.choice([None, 0.5])) for _ in range(300)]
    df = spark.createDataFrame(rows, "a int, b string, c double")
    expected = sum(n - 1 for n in Counter(rows).values())
    assert repeated_rows(df).first()[0] == expected
    for forced in (lambda _: F.lit(1), lambda d: F.struct(d["a"])):
        assert repeated_rows(df, forced).first()[0] == expected
    assert repeated_rows(df.limit(0)).first()[0] == 0


def test_duplicates_shuffle_hashes_first(spark):
    df = spark.range(10).selectExpr("id", "repeat('x', 100) AS text")
    shown = plan_of(repeated_rows(df))
    assert "Exchange hashpartitioning(_hashes" in shown
