"""Global order, exact samples, quantiles and skewed lookups against brute force."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import plan_of
from tradegrain.operators.grouping import complete, first_per_key, labelled
from tradegrain.operators.ordered import number_rows, quartile, running_totals
from tradegrain.operators.quantiles import summarize, tall
from tradegrain.operators.sampling import sample_exactly, stratified_split
from tradegrain.operators.skew import lookup_join


def test_row_numbers_with_one_value_on_a_third_of_the_rows(spark):
    rng = random.Random(3)
    rows = [(i, 7 if i % 3 == 0 else rng.randrange(1000)) for i in range(5000)]
    df = spark.createDataFrame(rows, "id int, v int").repartition(8)
    got = number_rows(df, [F.col("v"), F.col("id")], "rn", total="n").collect()
    expected = {i: k for k, (i, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])), start=1)}
    assert {r.id: r.rn for r in got} == expected
    assert {r.n for r in got} == {5000}


def test_row_numbers_never_use_one_partition(spark):
    df = spark.range(1000).withColumn("v", F.col("id") % 10)
    numbered = number_rows(df, [F.col("v"), F.col("id")], "rn")
    # The only single-partition step is the window over one row per sort partition.
    assert plan_of(numbered).count("SinglePartition") <= 1


@pytest.mark.parametrize("n", [2, 3, 4, 5, 6, 7, 8, 11, 18, 25, 101])
def test_quartiles_equal_interpolated_quantile_cuts(spark, n):
    ranks = pd.Series(range(1, n + 1), dtype=float)
    expected = pd.qcut(ranks, 4, labels=[1, 2, 3, 4]).astype(int).tolist()
    df = spark.range(1, n + 1).select(quartile(F.col("id"), F.lit(n)).alias("q"), "id").orderBy("id")
    assert [r.q for r in df.collect()] == expected


def test_quartile_of_a_single_row(spark):
    assert spark.range(1, 2).select(quartile(F.col("id"), F.lit(1))).first()[0] == 1


def test_running_totals_span_partitions(spark):
    rng = random.Random(5)
    rows = [("hot" if i % 3 else None, rng.random(), rng.randrange(5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v double, n int").repartition(8)
    got = running_totals(df, ["g"], [F.desc("v")], {"upto": "n"}).collect()
    sums: dict = defaultdict(int)
    expected = {}
    for g, v, n in sorted(rows, key=lambda r: -r[1]):
        sums[g] += n
        expected[g, v] = sums[g]
    assert {(r.g, r.v): r.upto for r in got} == expected


def test_samples_have_the_exact_size_and_order(spark):
    df = spark.range(3000)
    for n in (0, 1, 500, 3000, 9000):
        assert sample_exactly(df, "id", n).count() == min(n, 3000)

    def rank(i):
        return hashlib.md5(f"{i}:42".encode()).hexdigest()

    expected = set(sorted(range(3000), key=rank)[:500])
    assert {r.id for r in sample_exactly(df, "id", 500).collect()} == expected


def test_stratified_split_is_exact_per_label(spark):
    labels = F.when(F.col("id") % 10 != 9, (F.col("id") % 97 == 0).cast("int"))
    df = spark.range(1003).withColumn("label", labels)
    counts = Counter((r.label, r.is_test) for r in stratified_split(df, "id", "label").collect())
    unlabelled = sum(1 for i in range(1003) if i % 10 == 9)
    assert counts[None, True] == math.ceil(0.2 * unlabelled)
    rare = sum(1 for i in range(1003) if i % 97 == 0 and i % 10 != 9)
    assert counts[1, True] == math.ceil(0.2 * rare)
    assert counts[0, True] == math.ceil(0.2 * (1003 - rare - unlabelled))
    assert sum(counts.values()) == 1003


def test_summary_equals_describe(spark):
    rng = np.random.default_rng(11)
    frame = pd.DataFrame({"a": rng.integers(0, 50, 999), "b": np.round(rng.normal(0, 3, 999), 3)})
    frame.loc[:332, "a"] = 7
    df = spark.createDataFrame(frame).repartition(6)
    got = summarize(tall(df, ["a", "b"]), ["metric"]).toPandas().set_index("metric")
    for name in ("a", "b"):
        expected = frame[name].describe()
        expected.index = ["count", "mean", "std", "min", "p25", "p50", "p75", "max"]
        assert np.allclose(got.loc[name, expected.index].astype(float), expected, rtol=1e-12)


def test_summary_of_one_value(spark):
    df = spark.createDataFrame([(4,)], "a int")
    row = summarize(tall(df, ["a"]), ["metric"]).first()
    assert (row["count"], row.mean, row.std, row.min, row.p50, row.max) == (1, 4.0, None, 4.0, 4.0, 4.0)


def test_complete_groups_keep_empty_ones(spark):
    groups = labelled(spark, "g", ["x", "y", "z"])
    measured = spark.createDataFrame([("y", 3)], "g string, n int")
    rows = complete(groups, measured, "g").orderBy("position").collect()
    assert [(r.g, r.n) for r in rows] == [("x", None), ("y", 3), ("z", None)]


def test_first_row_per_key(spark):
    rows = [("a", 2, 9, "p"), ("a", 1, 8, "q"), ("a", 1, 7, "r"), ("b", 5, 1, None), (None, 1, 1, "n")]
    df = spark.createDataFrame(rows, "k string, t int, id int, v string")
    got = {tuple(r) for r in first_per_key(df, ["k"], ["t", "id"]).collect()}
    assert got == {("a", 1, 7, "r"), ("b", 5, 1, None), (None, 1, 1, "n")}


def test_lookup_join_splits_a_hot_key(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        fact = spark.range(0, 60000, 1, 8).select(
            F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id") % 500).alias("k"), F.col("id").alias("x")
        )
        names = spark.range(500).select(F.col("id").alias("k"), F.concat(F.lit("n"), "id").alias("name"))
        lookup = names.union(names).groupBy("k").agg(F.min("name").alias("name"))
        joined = lookup_join(fact, lookup, "k")
        result = joined.agg(F.count("*").alias("n"), F.count("name").alias("named"), F.sum("x").alias("s"))
        assert tuple(result.first()) == (60000, 60000, sum(range(60000)))
        result.collect()
        assert "skew=true" in result._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_lookup_join_disappears_when_unread(spark):
    fact = spark.range(10).select(F.col("id").alias("k"))
    lookup = spark.range(10).groupBy(F.col("id").alias("k")).agg(F.count("*").alias("n"))
    assert "Join" not in plan_of(lookup_join(fact, lookup, "k").select("k"))
