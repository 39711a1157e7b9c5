"""Splittable CSV with line breaks in fields, beside Spark's own whole-file reader."""

from __future__ import annotations

import random

import pytest

from tradegrain.sources.delimited import read_csv
from tradegrain.sources.schemas import SCHEMAS

NAMES = SCHEMAS["reviews"].names
OPTIONS = {"header": True, "quote": '"', "escape": '"', "multiLine": True, "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss"}


def made(rows: int, seed: int, end: str = "\n", longest: int = 12) -> str:
    rng = random.Random(seed)
    words = ["fine", 'a ""quoted"" word', "two\nlines", "\n\n", "comma, here", '""', "é 日本", "tab\t"]
    lines = [",".join(NAMES)]
    for i in range(rows):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(longest)))
        title = rng.choice(["", "plain", '"x, y"', '""'])
        lines.append(f'r{i},o{i % 50},{i % 5 + 1},{title},"{text}",2018-01-10 00:00:00,{rng.choice(["", "2018-01-11 10:20:30"])}')
    return end.join(lines) + rng.choice(["", end])


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {name: spark.conf.get(name, None) for name in names}
    for name, value in zip(names, ("2000", "0", "200"), strict=True):
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def rows_of(df) -> list[tuple]:
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_one_file_is_read_by_many_tasks_like_the_whole_file_reader(spark, tmp_path, small_splits, end):
    (tmp_path / "reviews.csv").write_bytes(made(3000, 1, end).encode())
    found = read_csv(spark, str(tmp_path), "reviews")
    plain = spark.read.schema(SCHEMAS["reviews"]).options(**OPTIONS).csv(str(tmp_path))
    assert plain.rdd.getNumPartitions() == 1 and found.rdd.getNumPartitions() > 20
    assert rows_of(found) == rows_of(plain) and found.count() == 3000


def test_a_record_longer_than_several_splits(spark, tmp_path, small_splits):
    text = made(40, 2, longest=3) + ("" if made(40, 2, longest=3).endswith("\n") else "\n")
    text += 'long,o,5,t,"' + "line\n" * 5000 + '",2018-01-10 00:00:00,\nlast,o,1,,,,\n'
    (tmp_path / "reviews.csv").write_text(text)
    found = {r["review_id"]: r for r in read_csv(spark, str(tmp_path), "reviews").collect()}
    assert len(found) == 42 and found["long"]["review_comment_message"] == "line\n" * 5000
    assert found["last"]["review_score"] == 1 and found["last"]["review_comment_message"] is None


def test_many_files_blank_lines_and_no_rows(spark, tmp_path, small_splits):
    for i in range(5):
        (tmp_path / f"part-{i}.csv").write_text(made(200 * i, i) + "\n\n")
    plain = spark.read.schema(SCHEMAS["reviews"]).options(**OPTIONS).csv(str(tmp_path))
    found = read_csv(spark, str(tmp_path), "reviews")
    assert rows_of(found) == rows_of(plain) and found.count() == 2000


def test_a_file_with_another_header_is_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text(made(3, 1))
    (tmp_path / "b.csv").write_text(made(3, 2).replace("review_id,order_id", "order_id,review_id"))
    with pytest.raises(Exception, match="header"):
        read_csv(spark, str(tmp_path), "reviews").collect()


def test_no_text_is_shuffled_but_fragments(spark, tmp_path):
    (tmp_path / "a.csv").write_text(made(30, 1))
    plan = read_csv(spark, str(tmp_path), "reviews")._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and all("value" not in line for line in exchanges)
