"""Presented candidates at the reference's quota."""
from collections import Counter

import __spark_entry__ as entry
from convograph.operators import recall
from convograph.plans import graph as plans

CANDIDATE = "request string, seq string, origin string, source_id string, relationship_name string, target_id string, valid_at long"


def test_forty_are_presented_24_of_wake_first(spark, monkeypatch):
    rows = [("r", f"{n:03}", "wake" if n < 30 else "term", "s", "o", str(n), n) for n in range(60)] + [("q", f"{n:03}", "term", "s", "o", str(n), n) for n in range(9)]
    monkeypatch.setattr(plans, "collapse", lambda s, d: s.createDataFrame(rows, CANDIDATE))
    got = {}
    for r in entry.queries()["q_recall_presented"](spark, "").orderBy("request", "place").collect():
        got.setdefault(r.request, []).append(int(r.target_id))
    assert got == {"r": [*range(24), *range(30, 46)], "q": [*range(9)]}
    new = Counter(r.request for r in entry.queries()["q_recall_presented_new"](spark, "").collect())
    assert new == {"r": 39, "q": 8}


def test_tight_quotas(spark):
    c = spark.createDataFrame([("r", f"{n}", "wake" if n < 2 else "term", "s", "o", str(n), n) for n in range(6)], CANDIDATE)
    got = lambda total, wake: [r.target_id for r in recall.source_quota(c, total, wake).orderBy("place").collect()]
    assert got(1, 5) == ["0"] and got(0, 0) == [] and got(5, 4) == ["0", "1", "2", "3", "4"] and got(3, 0) == ["2", "3", "4"]
