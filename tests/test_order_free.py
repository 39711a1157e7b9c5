"""Figures that must be the same bits over any partitions and any order of rows."""

from __future__ import annotations

import random
from fractions import Fraction

import pytest
from pyspark.errors import ArithmeticException
from pyspark.sql import functions as F

from tradegrain.functions.numeric import order_free_sum
from tradegrain.plans.evaluation import ranking_metrics


def test_average_precision_is_the_same_over_any_partitions(spark):
    rng = random.Random(9)
    rows = [(rng.randrange(2), round(rng.random(), 3), g) for g in range(3) for _ in range(2000)]
    found = set()
    for parts in (1, 7, 64):
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "label int, score double, g int").repartition(parts)
        found.add(tuple(map(tuple, ranking_metrics(df, "label", "score", by=("g",)).orderBy("g").collect())))
    assert len(found) == 1


def test_average_precision_equals_exact_fractions(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(2), rng.randrange(60) / 64) for _ in range(500)]
    got = ranking_metrics(spark.createDataFrame(rows, "label int, score double"), "label", "score").first().pr_auc
    hits = seen = 0
    total = Fraction(0)
    for score in sorted({s for _, s in rows}, reverse=True):
        here = [y for y, s in rows if s == score]
        hits, seen = hits + sum(here), seen + len(here)
        total += Fraction(sum(here) * hits, seen)
    assert got == pytest.approx(float(total / sum(y for y, _ in rows)), rel=1e-15)


def test_sums_cancel_exactly_and_null_counts_nothing(spark):
    values = [1e12, 0.1, None, -1e12, 0.2, 1e-20]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
    assert df.agg(order_free_sum(F.col("v"))).first()[0] == 0.30000000000000000001
    assert df.limit(0).agg(order_free_sum(F.col("v"))).first()[0] is None
    with pytest.raises(ArithmeticException):
        spark.createDataFrame([(1e15,)], "v double").agg(order_free_sum(F.col("v"))).first()
