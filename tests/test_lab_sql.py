"""Free SQL text on a frame called df."""

from __future__ import annotations

import pytest
from pyspark.errors import AnalysisException

from tradegrain.plans import lab


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(i, f"s{i % 3}") for i in range(9)], "n long, df string")


@pytest.mark.parametrize(
    "text",
    [
        "SELECT df, sum(n) AS total FROM df GROUP BY df ORDER BY df DESC",
        "SELECT df, sum(n) AS total FROM {df} GROUP BY df ORDER BY df DESC;",
        "WITH x AS (SELECT * FROM df) SELECT x.df, sum(x.n) AS total FROM x GROUP BY x.df ORDER BY x.df DESC -- latest",
        "SELECT a.df, sum(a.n) AS total FROM df a JOIN df b ON a.n = b.n GROUP BY a.df ORDER BY 1 DESC",
    ],
)
def test_the_frame_is_a_table(frame, text):
    assert [tuple(r) for r in lab.run_sql(text, frame).collect()] == [("s2", 15), ("s1", 12), ("s0", 9)]


def test_braces_are_plain_text_and_no_view_stays(spark, frame):
    assert lab.run_sql("SELECT '{x}' AS a, count(*) AS n FROM df", frame).first() == ("{x}", 9)
    with pytest.raises(AnalysisException):
        spark.sql("SELECT * FROM df").collect()


def test_two_frames_at_once(spark, frame):
    other = lab.run_sql("SELECT count(*) AS n FROM df", frame.limit(2))
    assert lab.run_sql("SELECT count(*) AS n FROM df", frame).first().n == 9 and other.first().n == 2
