"""Exact metrics, model training, storage and scoring."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tradegrain import fixed, registry
from tradegrain.plans import evaluation, features, scoring, training


def brute_auc(pairs):
    pos = [s for y, s in pairs if y == 1]
    neg = [s for y, s in pairs if y == 0]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return wins / (len(pos) * len(neg))


def brute_ap(pairs):
    total = sum(y for y, _ in pairs)
    area = 0.0
    for cut in sorted({s for _, s in pairs}, reverse=True):
        chosen = [y for y, s in pairs if s >= cut]
        area += sum(y for y, s in pairs if s == cut) / total * sum(chosen) / len(chosen)
    return area


def test_ranking_metrics_per_group_with_ties(spark):
    rng = random.Random(1)
    pairs = {g: [(rng.randrange(2), rng.randrange(8) / 8) for _ in range(200)] for g in "ab"}
    pairs["b"] += [(0, 0.5)] * 200  # one score on half of the rows
    rows = [(g, y, s) for g, ps in pairs.items() for y, s in ps]
    df = spark.createDataFrame(rows, "g string, y int, s double").repartition(6)
    for r in evaluation.ranking_metrics(df, "y", "s", by=("g",)).collect():
        assert r.roc_auc == pytest.approx(brute_auc(pairs[r.g]), rel=1e-12)
        assert r.pr_auc == pytest.approx(brute_ap(pairs[r.g]), rel=1e-12)


def test_threshold_metrics_guard_zero_division(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.2)], "y int, s double")
    row = evaluation.threshold_metrics(df, "y", "s", 0.5).first()
    assert (row.precision, row.recall, row.f1, row.accuracy, row.tn) == (0.0, 0.0, 0.0, 1.0, 2)


def test_class_weights_balance(spark):
    df = spark.createDataFrame([(0,)] * 9 + [(1,)], "y int")
    sums = {r.y: r.w for r in training.balance(df, "y").groupBy("y").agg(F.sum("_weight").alias("w")).collect()}
    assert sums == {0: pytest.approx(5.0), 1: pytest.approx(5.0)}


@pytest.fixture(scope="module")
def artifact(small_master):
    table = features.csat_features(small_master, "NATION_0")
    return table, training.train_classifier("csat", table, features.CSAT_FEATURES, "is_low_csat", "order_id", rounds=3, repeats=2)


def test_training_beats_chance_and_names_the_driver(artifact):
    _, model = artifact
    row = model.metrics.first()
    assert row.roc_auc > 0.8 and row.tn + row.fp + row.fn + row.tp == row.sample_size
    importances = training.rank_features(model.importances).collect()
    assert len(importances) == len(features.CSAT_FEATURES)
    assert importances[0].feature == "delivery_delta_days"
    assert sum(r.importance for r in importances) == pytest.approx(100, abs=1)


def test_artifact_survives_storage(spark, artifact, tmp_path):
    table, model = artifact
    path = str(tmp_path / "csat")
    calls = []

    def train():
        calls.append(1)
        return model

    first = training.load_or_train(spark, path, train)
    again = training.load_or_train(spark, path, train)
    assert len(calls) == 1 and again.features == features.CSAT_FEATURES
    assert again.metrics.collect() == model.metrics.collect() == first.metrics.collect()
    scored = scoring.csat_risk(again.score(table), training.SCORE)
    labels = {label for _, label in fixed.CSAT_RISK_TIERS}
    assert {r.tier for r in scored.select("tier").distinct().collect()} <= labels
    assert scored.count() == table.count()


FITS = {
    "ml_repeat_model": "repeat",
    "ml_csat_model": "csat",
    "ml_delay_model": "delay_normalized",
    "ml_permutation_importance": "csat",
    "ml_score_repeat": "repeat",
    "ml_score_delay": "delay",
    "ml_score_csat": "csat",
    "ml_recommendations": "delay_normalized",
}


@pytest.mark.parametrize("name", sorted(FITS))
def test_queries_fit_with_all_rounds(spark, monkeypatch, name):
    class Asked(Exception):
        pass

    def fit(train, columns, label, rounds, step, *rest):
        raise Asked(rounds, step)

    monkeypatch.setattr(training, "fit", fit)
    with pytest.raises(Asked) as asked:
        registry.QUERIES[name](spark, SMALL)
    settings = fixed.MODEL_SETTINGS[FITS[name]]
    assert asked.value.args == (settings["rounds"], settings["step"])


def test_importances_wait_until_read(small_master, monkeypatch):
    asked = []
    monkeypatch.setattr(training, "permutation_importance", lambda *settings: asked.append(settings[5]))
    table = features.csat_features(small_master, "NATION_0")
    model = training.train_classifier("csat", table, features.CSAT_FEATURES, "is_low_csat", "order_id", rounds=1, repeats=3)
    assert model.metrics.count() == 1 and not asked
    assert (model.importances, model.importances, asked) == (None, None, [3])


def test_advice_rules(spark):
    rows = [(1, 10.0, 9000.0, 0.6), (1, 10.0, 100.0, 0.32), (0, 20.0, 100.0, 0.9), (0, 10.0, 100.0, 0.2)]
    df = spark.createDataFrame(rows, "is_interstate int, estimated_days double, product_weight_g double, p double")
    got = scoring.order_advice(df, "p").collect()
    assert [len(r.recommendations) for r in got] == [3, 1, 1, 1]
    assert got[1].recommendations == [fixed.ADVICE_ROUTING] and got[2].recommendations == [fixed.ADVICE_DEFAULT]
    assert [r.tier for r in got] == ["Critical Risk", "Moderate Risk", "Critical Risk", "Low Risk"]


def test_propensity_is_capped(spark):
    df = spark.createDataFrame([(0.9,), (0.2,), (0.1,)], "p double")
    got = scoring.repeat_propensity(df, "p").collect()
    assert [r.propensity for r in got] == [1.0, pytest.approx(0.32), pytest.approx(0.16)]
    assert [r.tier.split()[0] for r in got] == ["HIGH", "MODERATE", "HIGH"]


def test_gap_bins_are_closed_above_and_kept_when_empty(spark):
    df = spark.createDataFrame([(-5.0, 5.0), (0.0, 4.0), (7.0, 1.0), (7.5, 1.0)], "delivery_delta_days double, review_score double")
    rows = features.expectation_gap(df).collect()
    assert [(r.delta_bucket, r.order_count) for r in rows] == list(zip(fixed.GAP_BINS, [1, 1, 0, 1, 1], strict=True))
    assert rows[2].avg_review is None
