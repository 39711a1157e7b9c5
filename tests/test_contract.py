"""The driver contract: every registered query equals its SQL statement on the small data set."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as contract
from checks.compare import connect, differences
from tests.conftest import SMALL, plan_of
from tradegrain.registry import QUERIES as REGISTERED

# The commerce queries; the text operators have tests of their own.
QUERIES = REGISTERED
STATEMENTS = {name: sql for name, sql in contract.oracle_sql().items() if name in REGISTERED}

# Fitted models have no SQL counterpart; tests/test_models.py covers them.
FITTED = {
    "ml_repeat_model",
    "ml_csat_model",
    "ml_delay_model",
    "ml_permutation_importance",
    "ml_score_repeat",
    "ml_score_delay",
    "ml_score_csat",
    "ml_recommendations",
}


# Each query costs seconds of planning, so a plain test run takes every fourth one plus those whose plans
# are easiest to get wrong; CONTRACT=all runs the whole list, as ``python -m checks.compare`` does.
TRICKY = {"master_orders", "kpi_overview", "rfm_segments", "eda_aov", "ts_forecast_all", "q4_repeat_vs_onetime"}
CHOSEN = sorted(STATEMENTS) if os.environ.get("CONTRACT") == "all" else sorted({*sorted(STATEMENTS)[::4], *TRICKY})


@pytest.fixture(scope="module")
def database():
    return connect(SMALL)


def test_only_fitted_models_lack_a_statement():
    assert set(QUERIES) - set(STATEMENTS) == FITTED and set(STATEMENTS) <= set(QUERIES)


def test_contract_offers_every_query():
    assert set(QUERIES) <= set(contract.queries()) and set(contract.oracle_sql()) <= set(contract.queries())


def test_entry_returns_rows(spark):
    assert contract.entry(spark).count() == 10


def single_partition_inputs(plan: str) -> set[str]:
    """What feeds each step that runs in one task: it must be an aggregate's few rows."""
    lines = plan.split("\n")
    found = set()
    for i, line in enumerate(lines):
        if "SinglePartition" in line:
            below = " ".join(lines[i + 1 : i + 3])
            known = "aggregate" if "Aggregate" in below else "ten plan lengths" if "Installments" in below else below
            found.add(known)
    return found


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_its_statement(spark, database, name):
    df = QUERIES[name](spark, SMALL)
    plan = plan_of(df)
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert single_partition_inputs(plan) <= {"aggregate", "ten plan lengths"}
    assert differences(df, database, STATEMENTS[name]) == []
