import random

import pytest

from convograph.llm.groups import group_matches

SCHEMA = "chat_id string, a_id string, b_id string, score double, u string, v string, best string, centre string"


def frame(spark, pairs):
    return spark.createDataFrame([("c", a, b, s, *"wxyz") for a, b, s in pairs], SCHEMA)


def model(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b, s in pairs:
        if a and b and a != b and s is not None and s == s and s >= 0.88:
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return {(x, find(x)) for x in list(up)}


def got(df):
    return {(r.node_id, r.group_id) for r in df.collect()}


@pytest.mark.parametrize("shape", ["random", "chain", "star"])
def test_equals_union_find(spark, shape):
    r = random.Random(5)
    if shape == "random":
        pairs = [(f"n{r.randrange(150)}", f"n{r.randrange(150)}", r.choice([0.5, 0.88, 0.9, 1.0, None, float("nan")])) for _ in range(160)]
    elif shape == "chain":
        names = [f"n{i:03}" for i in range(120)]
        r.shuffle(names)
        pairs = [(a, b, 0.9) for a, b in zip(names, names[1:])]
    else:
        pairs = [("hub", f"n{i}", 0.95) for i in range(200)]
    assert got(group_matches(frame(spark, pairs))) == model(pairs)


def test_dirty_pairs(spark):
    pairs = [("a", "a", 1.0), ("a", None, 1.0), (None, "b", 1.0), ("", "b", 1.0), ("p", "q", 0.879), ("x", "y", 0.88), ("y", "x", 0.1), ("x", "y", 0.99)]
    assert got(group_matches(frame(spark, pairs * 2))) == {("x", "x"), ("y", "x")}
    assert got(group_matches(frame(spark, []))) == set()


def test_levels_before_the_last_task(spark):
    r = random.Random(7)
    pairs = [(f"n{r.randrange(120)}", f"n{r.randrange(120)}", 0.9) for _ in range(110)]
    df = frame(spark, pairs)
    assert got(group_matches(df, last_links=10)) == got(group_matches(df, beta=2.0)) == model(pairs)
