"""Merges along chains against plain Python."""
import datetime as dt

from pyspark.sql import functions as F

from convograph.lineage import Cuts
from convograph.operators import graph
from convograph.plans import graph as plans

T0 = dt.datetime(2025, 1, 1)
EDGE = ("chat_id string, source_id string, relationship_name string, target_id string, valid_at timestamp, invalid_at timestamp, edge_text string, created_at timestamp")


def edge(s, t, v=0, text="x", c=0, i=None, rel="likes"):
    h = lambda x: None if x is None else T0 + dt.timedelta(hours=x)
    return ("c", s, rel, t, h(v), h(i), text, h(c))


def components(pairs):
    group = {x: {x} for p in pairs for x in p}
    for a, b in pairs:
        if group[a] is not group[b]:
            group[a] |= group[b]
            for x in group[b]:
                group[x] = group[a]
    return group


def test_chains_and_hubs_end_at_one_node(spark):
    pairs = [(f"n{i:02}", f"n{i + 1:02}") for i in range(40)] + [("hub", f"z{i}") for i in range(9)] + [("z3", "y")]
    names = sorted({x for p in pairs for x in p})
    stats = {x: (len(x) * 7 + sum(map(ord, x)) * 31 % 5, 100 + sum(map(ord, x)) * 13 % 11) for x in names if x != "y"}
    rank = lambda x: (-stats.get(x, (0, 0))[0], stats.get(x, (0, 2**62))[1], x)
    group = components(pairs)
    want = {(x, w) for x in names if (w := min(group[x], key=rank)) != x}
    s = spark.createDataFrame([("c", x, d, t) for x, (d, t) in stats.items()], "chat_id string, id string, degree long, created_us long")
    p = spark.createDataFrame([("c", *x) for x in pairs], "chat_id string, x string, y string")
    assert {(r.loser, r.survivor) for r in graph.final_survivors(p, s, Cuts(spark, "t")).collect()} == want


def test_equivalent_edges_go_and_history_stays(spark):
    rows = [edge("a", "o", 0, "one"), edge("b", "o", 5, "one"), edge("b", "o", 0, "two", c=1), edge("b", "o", 7, "three", c=2), edge("b", "o", 7, "four", c=3),
            edge("b", "o", 0, "one", c=4, i=9), edge("b", "a"), edge("o", "b", 0, "one"), edge("d", "d"),
            edge("a", "p", 3, "lives p", rel="lives_in"), edge("b", "q", 8, "lives q", rel="lives_in"), edge("e", "q", 1, rel="lives_in"), edge("e", "p", 2, rel="lives_in")]
    kinds = spark.createDataFrame([("lives_in", True), ("likes", False)], "relationship_name string, single_value boolean")
    one = spark.createDataFrame([("c", "b", "a")], "chat_id string, loser string, survivor string")
    got = sorted((r.source_id, r.target_id, r.edge_text, r.valid_at.hour, r.still_valid) for r in graph.merge_edge_ends(spark.createDataFrame(rows, EDGE), one, kinds).collect())
    assert got == sorted([("a", "o", "one", 0, True), ("a", "o", "three", 7, True), ("a", "o", "one", 0, False), ("o", "a", "one", 0, True), ("d", "d", "x", 0, True),
                          ("a", "p", "lives p", 3, False), ("a", "q", "lives q", 8, True), ("e", "q", "x", 1, True), ("e", "p", "x", 2, True)])


def test_no_merged_node_is_left(spark, small):
    gone = plans.final(spark, small).select("chat_id", F.col("loser").alias("id")).cache()
    assert gone.count() > 0
    for df, ends in ((plans.final(spark, small), ["survivor"]), (plans.merged_edges(spark, small), ["source_id", "target_id"]), (plans.merged_pairs(spark, small), ["x", "y"])):
        for c in ends:
            assert df.join(gone.withColumnRenamed("id", c), ["chat_id", c], "left_semi").count() == 0


def test_rounds_and_one_task_end_alike(spark):
    pairs = [(f"n{i:02}", f"n{i + 1:02}") for i in range(25)] + [("hub", f"z{i}") for i in range(9)] + [("z3", "n07"), ("p", "q")]
    p = spark.createDataFrame([("c", *x) for x in pairs] + [("d", "p", "n01")], "chat_id string, x string, y string")
    s = spark.createDataFrame([("c", f"n{i:02}", i * 7 % 5, i) for i in range(26)], "chat_id string, id string, degree long, created_us long")
    a, b = ({tuple(r) for r in graph.final_survivors(p, s, Cuts(spark, "t"), n).collect()} for n in (0, 1000))
    assert a == b and len(a) == 25 + 10 + 1 + 1
