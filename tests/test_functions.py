"""Rounding, lateness, clipping and text rules on edge values."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tradegrain import fixed
from tradegrain.functions import numeric, temporal, text


def one(spark, schema, rows, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


@pytest.fixture(scope="module")
def deliveries(spark):
    """Delays of -1.5, -0.5, 0, 0.5 and 1.5 days, and one undelivered order."""
    hours = [-36, -12, 0, 12, 36]
    promised = pd.Timestamp("2020-05-10")
    rows = [(h / 24, promised.to_pydatetime(), (promised + pd.Timedelta(hours=h)).to_pydatetime()) for h in hours]
    rows.append((None, promised.to_pydatetime(), None))
    schema = "delay double, promised timestamp_ntz, arrived timestamp_ntz"
    return spark.createDataFrame(rows, schema)


def test_lateness_rules_differ_on_part_days_and_missing_dates(deliveries):
    arrived, promised = F.col("arrived"), F.col("promised")
    delay = temporal.elapsed_days(arrived, promised)
    rows = deliveries.select(
        delay,
        temporal.days_truncated(arrived, promised),
        temporal.days_floored(arrived, promised),
        temporal.late_by_clock(arrived, promised),
        temporal.late_or_not(delay),
        temporal.late_by_truncated_days(arrived, promised),
        temporal.late_by_floored_days(arrived, promised),
        temporal.delivery_outcome(arrived, promised),
        temporal.late_label(temporal.late_or_not(delay)),
    ).collect()
    assert [tuple(r) for r in rows] == [
        (-1.5, -1, -2, False, False, False, False, "On Time", "On-Time"),
        (-0.5, 0, -1, False, False, False, False, "On Time", "On-Time"),
        (0.0, 0, 0, False, False, False, False, "On Time", "On-Time"),
        (0.5, 0, 0, True, True, False, False, "Late", "Late"),
        (1.5, 1, 1, True, True, True, True, "Late", "Late"),
        (None, None, None, None, False, None, False, "Unknown", "On-Time"),
    ]


def test_rounding_rules(spark):
    values = [1.005, 2.675, 0.125, -0.125, 0.375, None]
    rows = [(v,) for v in values]
    even = one(spark, "x double", rows, numeric.round_even(F.col("x")))
    assert even[:-1] == list(pd.Series(values[:-1]).round(2)) and even[-1] is None
    assert one(spark, "x double", rows, numeric.round_up(F.col("x")))[2:4] == [0.13, -0.13]


def test_printed_numbers_equal_c_formatting(spark):
    rng = np.random.default_rng(7)
    values = [0.25, 0.35, 1.15, 1.25, 2.5, 3.5, 1.005, 2.675, 1234567.125, *(rng.integers(0, 100000, 400) / 100).tolist()]
    for digits in (0, 1, 2):
        got = one(spark, "x double", [(v,) for v in values], text.fixed_point(F.col("x"), digits, "%"))
        assert got == [f"{v:.{digits}f}%" for v in values]
    money = one(spark, "x double", [(v,) for v in values], text.reais(F.col("x")))
    assert money == [f"R$ {v:,.2f}" for v in values]


def test_tiers_are_closed_above(spark):
    rows = [(v,) for v in (-3.0, -2.9, 0.0, 0.1, 3.0, 7.0, 7.1)]
    tier = numeric.tiered(F.col("x"), fixed.DELAY_BOUNDS, fixed.DELAY_BUCKETS)
    got = one(spark, "x double", rows, tier)
    assert [fixed.DELAY_BUCKETS.index(g) for g in got] == [0, 1, 1, 2, 2, 3, 4]


def test_bands_are_closed_below(spark):
    rows = [(0.6,), (0.59,), (0.3,), (0.29,)]
    got = one(spark, "x double", rows, numeric.banded(F.col("x"), fixed.CSAT_RISK_TIERS))
    labels = [label for _, label in fixed.CSAT_RISK_TIERS]
    assert [labels.index(g) for g in got] == [0, 1, 1, 2]


def test_clip_keeps_null_unless_filled(spark):
    rows = [(None,), (-5.0,), (50.0,), (99.0,)]
    assert one(spark, "x double", rows, numeric.clip(F.col("x"), 0, 60)) == [None, 0.0, 50.0, 60.0]
    assert one(spark, "x double", rows, numeric.clip_or(F.col("x"), 12, 0, 60)) == [12.0, 0.0, 50.0, 60.0]


def test_means_and_shares_guard_empty_groups(spark):
    empty = spark.createDataFrame([], "x double, f boolean")
    row = empty.agg(numeric.mean("x"), numeric.share_of(F.col("f")), numeric.total("x")).first()
    assert tuple(row) == (None, None, 0.0)
    some = spark.createDataFrame([(True,), (None,), (False,), (None,)], "f boolean")
    assert some.agg(numeric.share_of(F.col("f"))).first()[0] == 0.25


def test_filled_text_and_titles(spark):
    rows = [(None,), ("",), ("  ",), (" a ",)]
    assert one(spark, "x string", rows, text.is_filled(F.col("x"))) == [False, False, False, True]
    assert one(spark, "x string", [("bed_bath_table",)], text.title_words(F.col("x"))) == ["Bed Bath Table"]


def test_lenient_timestamps(spark):
    rows = [("2018-01-02 03:04:05",), ("nonsense",), (None,), ("2018-13-40",)]
    got = one(spark, "x string", rows, temporal.lenient_timestamp(F.col("x")))
    assert [g is None for g in got] == [False, True, True, True]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        one(spark, "x string", rows, temporal.strict_timestamp(F.col("x")))


def test_elapsed_time_ignores_the_session_time_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
    try:
        df = spark.sql("SELECT TIMESTAMP_NTZ'2018-11-03 12:00:00' AS a, TIMESTAMP_NTZ'2018-11-05 12:00:00' AS b")
        row = df.select(temporal.elapsed_days(F.col("b"), F.col("a")), temporal.month_start(F.col("b"))).first()
        assert row[0] == 2.0 and str(row[1]) == "2018-11-01 00:00:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
