import random

import pytest
from pyspark.sql import functions as F

from convograph.operators.ranking import number_rows, running_sum, with_previous


@pytest.fixture(scope="module")
def rows():
    r = random.Random(1)
    return [(r.choice(["a", "a", "a", "b", None]), r.randrange(40), i) for i in range(300)]


@pytest.mark.parametrize("hot", [10, 10_000])
def test_numbers_do_not_depend_on_slices(spark, rows, hot):
    df = spark.createDataFrame(rows, "k string, t long, i long")
    got = {r.i: r.n for r in number_rows(df, ["k"], [F.col("t"), F.col("i")], "t", "n", hot).collect()}
    want = {}
    for k in {x[0] for x in rows}:
        for n, x in enumerate(sorted((x for x in rows if x[0] == k), key=lambda x: x[1:]), 1):
            want[x[2]] = n
    assert got == want


@pytest.mark.parametrize("hot", [10, 10_000])
def test_running_sum_and_previous(spark, rows, hot):
    df = spark.createDataFrame(rows, "k string, t long, i long")
    got = {r.i: r.s for r in running_sum(df, ["k"], [F.col("t"), F.col("i")], "t", F.col("t"), "s", hot).collect()}
    before = {r.i: r.previous and r.previous.i for r in with_previous(df, ["k"], [F.col("t"), F.col("i")], "t", ["i"], hot).collect()}
    for k in {x[0] for x in rows}:
        s, last = 0, None
        for x in sorted((x for x in rows if x[0] == k), key=lambda x: x[1:]):
            s += x[1]
            assert got[x[2]] == s and before[x[2]] == last
            last = x[2]


def test_empty(spark):
    df = spark.createDataFrame([], "k string, t long")
    assert number_rows(df, ["k"], [F.col("t")], "t", "n").collect() == []
