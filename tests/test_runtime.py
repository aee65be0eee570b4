import random

import pytest
from pyspark.sql import functions as F

from quizloom import runtime


@pytest.fixture(params=[(1 << 12, 10_000), (4, 3)])
def bounds(request, monkeypatch):
    monkeypatch.setattr(runtime, "SELECT_BINS", request.param[0])
    monkeypatch.setattr(runtime, "SELECT_ROWS", request.param[1])


def rows():
    rng = random.Random(5)
    texts = ["", "a", "ab", "abcdef", "abcdefg", "abcdef\x00", "é", "漢字", "same text", "same text", None]
    return [(rng.choice(texts), rng.choice([None, -1.5, 0.0, 1e-9, 3.0, 1e300]), rng.choice([True, False, None]), i)
            for i in range(60)]


def test_nth_key_is_that_of_a_sort(spark, bounds):
    df = spark.createDataFrame(rows(), "t string, x double, b boolean, i long").repartition(3)
    for columns in (["i"], ["t", "i"], ["x", "t", "i"], ["b", "x", "i"]):
        keys = df.select(*columns)
        ordered = [tuple(r) for r in keys.orderBy(*columns).collect()]
        for n in (1, 2, 17, 40, 60):
            assert tuple(runtime.nth_key(keys, n)) == ordered[n - 1], (columns, n)
    assert runtime.nth_key(df.select("i"), 61) is None and runtime.nth_key(df.select("i"), 0) is None


def test_first_rows_are_those_of_a_sort(spark, bounds):
    df = spark.createDataFrame(rows(), "t string, x double, b boolean, i long").repartition(3)
    keys = [F.md5(F.col("i").cast("string")), F.col("i")]
    expected = [r["i"] for r in df.orderBy(*keys).limit(13).collect()]
    got = runtime.first_rows(df, keys, 13)
    assert sorted(r["i"] for r in got.collect()) == sorted(expected)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "checkpoint" not in plan.lower()
    assert runtime.first_rows(df, ["i"], 0).count() == 0 and runtime.first_rows(df, ["i"], 99).count() == 60
    assert runtime.first_rows(df.limit(0), ["i"], 5).count() == 0


def test_a_key_that_a_third_of_all_rows_share(spark, bounds):
    df = spark.range(3000, numPartitions=5).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.hex("id")).alias("k"), "id")
    expected = [r["id"] for r in df.orderBy("k", "id").limit(2500).collect()]
    assert sorted(r["id"] for r in runtime.first_rows(df, ["k", "id"], 2500).collect()) == sorted(expected)
