"""Operators without SQL against plain Python, and invariants."""
import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from convograph.operators import graph, log, recall, triggers, vector

T0 = dt.datetime(2025, 1, 1)
EDGE = ("edge_no long, chat_id string, source_id string, target_id string, relationship_name string, valid_at timestamp, invalid_at timestamp, "
        "edge_text string, created_at timestamp, updated_at timestamp, properties string")


def edge(no, s, t, rel="owns", v=0, i=None, text="x", c=0, u=0, p=None, chat="c"):
    h = lambda x: None if x is None else T0 + dt.timedelta(hours=x)
    return (no, chat, s, t, rel, h(v), h(i), text, h(c), h(u), p)


def test_wake_and_digest_folds_equal_a_loop(spark, small):
    m = spark.read.parquet(f"{small}/messages.parquet")
    rows = sorted((r.chat_id, r.id, int(r.timestamp.replace(tzinfo=dt.timezone.utc).timestamp())) for r in m.where("direction = 'inbound' and event_type not in ('join','leave')").collect())
    want, state = set(), {}
    for chat, i, t in rows:
        if reason := state.setdefault(chat, triggers.Wake()).step(t):
            want.add((chat, i, reason))
    assert {tuple(r) for r in triggers.wake_fires(m).select("chat_id", "id", "reason").collect()} == want and want
    assert triggers.digest_batches(m.limit(0)).count() == 0


def test_two_hop_keeps_first_hop_and_limits_each_node(spark):
    e = graph.merge_edges(spark.createDataFrame([edge(n, "a", f"b{n}", c=n) for n in range(4)] + [edge(9, "b3", "z"), edge(10, "b0", "y"), edge(11, "b3", "w", i=5)], EDGE))
    entries = spark.createDataFrame([("c", "a")], "chat_id string, node string")
    got = {(r.source_id, r.target_id): r.hop for r in graph.two_hop(e, entries, 0, most=2).collect()}
    assert got == {("a", "b3"): 1, ("a", "b2"): 1, ("b3", "z"): 2}


def test_upserts_are_idempotent(spark, small):
    rows = spark.read.parquet(f"{small}/memory_edges.parquet")
    once, twice = graph.merge_edges(rows), graph.merge_edges(rows.union(rows))
    assert once.exceptAll(twice).count() == 0 and twice.exceptAll(once).count() == 0
    assert graph.set_difference(once, twice, graph.KEY, "edge_text").count() == 0


def test_merge_drops_new_self_loops_only(spark):
    e = graph.merge_edges(spark.createDataFrame([edge(1, "a", "b"), edge(2, "a", "c"), edge(3, "b", "c", c=1), edge(4, "d", "d")], EDGE))
    s = spark.createDataFrame([("c", "b", "a")], "chat_id string, loser string, survivor string")
    got = {(r.source_id, r.target_id, r.folded) for r in graph.repoint(e, s).collect()}
    assert got == {("a", "c", 2), ("d", "d", 1)}


def test_quota(spark):
    c = spark.createDataFrame([("r", f"{n:02}", "wake" if n < 6 else "term", "s", "o", str(n), n) for n in range(9)],
                              "request string, seq string, origin string, source_id string, relationship_name string, target_id string, valid_at long")
    got = [r.target_id for r in recall.source_quota(c, 6, 2).orderBy("place").collect()]
    assert got == ["0", "1", "6", "7", "8", "2"]


def test_terms(spark):
    m = spark.createDataFrame([("c", 1, "The Garden garden x 東京都 1a"), ("c", 2, None), ("c", 3, "")], "chat_id string, id long, text string")
    got = {(r.id, r.term) for r in recall.budget_terms(recall.term_pool(m)).collect()}
    assert got == {(1, "garden"), (1, "1a"), (1, "東京都"), (1, "東京"), (1, "京都")}


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=(120, 8))
    a[7] = 0
    a[11] = a[12]
    rows = [(i, a[i].tolist()) for i in range(120)] + [(500, None)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in vector.nearest(v.where("vec_id % 20 = 0"), v, 4, query_block=3, row_block=50).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    n = a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-300)
    for q in range(0, 120, 20):
        s = n @ n[q]
        s[7] = -np.inf
        assert [x for _, x in sorted(got[q])] == sorted(range(120), key=lambda i: (-round(s[i], 9), i))[:4]


def test_log_reads_of_an_empty_table(spark, small):
    m = spark.read.parquet(f"{small}/messages.parquet").limit(0)
    assert log.latest_n(m, 5).count() == log.tail_stats(m).count() == log.staleness(m).count() == log.real_edits(m).count() == 0


def test_latest_n_ties_none(spark, small):
    m = spark.read.parquet(f"{small}/messages.parquet")
    assert log.latest_n(m, 3).groupBy("chat_id").agg(F.max("position").alias("n")).where("n > 3").count() == 0
