"""The newest n rows, also where very many have one time."""

import random
from datetime import datetime, timedelta

import pytest

from mailmill.operators import ordering

START = datetime(2026, 3, 19, 10, 0, 0)
SCHEMA = "id string, internal_ts timestamp"


def plain(rows, n):
    dated = sorted((r for r in rows if r[1] is not None), key=lambda r: (-(r[1] - START).total_seconds(), r[0]))
    return (dated + sorted(r for r in rows if r[1] is None))[:n]


def check(spark, rows, n):
    df = spark.createDataFrame(rows, SCHEMA)
    assert [tuple(r) for r in ordering.most_recent(df, n).collect()] == plain(rows, n)


@pytest.mark.parametrize("few", [3, 10_000])
@pytest.mark.parametrize("n", [0, 1, 7, 40, 99, 100, 101, 200])
def test_mixed_times(spark, monkeypatch, few, n):
    monkeypatch.setattr(ordering, "FEW", few)
    rng = random.Random(2)
    spread = [86400 * 3, 3600, 60, 1, 0.001, 0.00001, 0]
    rows = [(f"{rng.randrange(10**6):06}{k}", None if k % 10 == 0 else START + timedelta(seconds=rng.choice(spread) * rng.random())) for k in range(100)]
    check(spark, rows, n)


@pytest.mark.parametrize("n", [1, 50, 299, 300])
def test_all_rows_at_one_moment(spark, monkeypatch, n):
    monkeypatch.setattr(ordering, "FEW", 5)
    rng = random.Random(n)
    keys = ["", "a", "aa", "ab", "é", "日本", "\U0001f389"] + [f"{rng.randrange(9**9):x}" * rng.randint(1, 3) for _ in range(293)]
    check(spark, [(k, START) for k in keys], n)
    check(spark, [(k, None) for k in keys], n)


def test_copies_of_one_id(spark, monkeypatch):
    monkeypatch.setattr(ordering, "FEW", 5)
    rows = [("same", START)] * 60 + [("later", START + timedelta(days=2))]
    for n in (1, 2, 30, 61, 80):
        check(spark, rows, n)


def test_no_task_takes_n_rows_and_the_time_reaches_the_scan(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ordering, "FEW", 50)
    path = f"{tmp_path}/rows"
    spark.createDataFrame([(str(k), START + timedelta(microseconds=k % 3)) for k in range(4000)], SCHEMA).write.parquet(path)
    found = ordering.most_recent(spark.read.parquet(path), 3000)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "Limit" not in plan and "Window" not in plan
    assert "GreaterThanOrEqual(internal_ts" in plan.split("PushedFilters")[1]
    assert found.count() == 3000


def test_empty_table(spark):
    check(spark, [], 5)
