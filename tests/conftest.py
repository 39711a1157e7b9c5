from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tradegrain.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "4g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small_market(spark):
    from tradegrain.sources.star_parquet import read_star_market

    return read_star_market(spark, SMALL)


@pytest.fixture(scope="session")
def small_master(small_market):
    from tradegrain.plans.master import build_master

    return build_master(small_market).cache()


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
