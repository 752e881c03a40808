"""The history against a row-by-row model."""
import datetime as dt
import random

import pytest

from convograph.operators import history

SCHEMA = ("chat_id string, source_id string, target_id string, relationship_name string, valid_at timestamp, invalid_at timestamp, "
          "created_at timestamp, updated_at timestamp, edge_no long, version_no string, bucket string")
KINDS = [("lives_in", True), ("likes", False), ("has_job", True)]
T0 = dt.datetime(2025, 1, 1)


def at(h):
    return None if h is None else T0 + dt.timedelta(hours=h)


def us(h):
    return int((T0 - dt.datetime(1970, 1, 1)).total_seconds() * 1_000_000) + h * 3_600_000_000


def model(rows):
    facts = {}
    names = {"lives_in": "lives_in", "has_job": "has_job"}
    for c, s, t, r, v, i, cr, up, no, *_ in rows:
        if None in (c, s, t, r, v):
            continue
        r = names.get("_".join(r.strip().lower().replace("-", " ").replace("_", " ").split()))
        if r:
            k = (c, s, r, t, v)
            if k not in facts or (up is not None, up or 0, no) > facts[k][0]:
                facts[k] = ((up is not None, up or 0, no), i, cr, no)
    starts = {}
    for (c, s, r, t, v), (_, i, cr, no) in facts.items():
        k = (c, s, r)
        if v not in starts.setdefault(k, {}) or (cr, no) > starts[k][v][2:]:
            starts[k][v] = (t, i if i is not None and i > v else None, cr, no)
    out = set()
    for k, by in starts.items():
        spans, order = [], sorted(by)
        for n, v in enumerate(order):
            t, end = by[v][:2]
            if n + 1 < len(order) and (end is None or order[n + 1] < end):
                end = order[n + 1]
            if spans and spans[-1][0] == t and spans[-1][2] == v:
                spans[-1][2] = end
            else:
                spans.append([t, v, end])
        out |= {(*k, n, t, us(v), -1 if e is None else us(e)) for n, (t, v, e) in enumerate(spans, 1)}
    return out


def sample(seed, n=160):
    r = random.Random(seed)
    rows = []
    for no in range(n):
        v = r.randrange(12)
        rows.append((r.choice("xy"), r.choice(["s1", "s1", "s1", "s2", None] if no % 9 == 0 else ["s1", "s1", "s2"]), r.choice("pq"),
                     r.choice(["lives_in", " Lives In", "LIVES-IN", "has_job", "likes"]), v, r.choice([None, None, v - 1, v, v + 1, v + 3]), r.randrange(4), r.randrange(30), no, "z", "z"))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*x[:4], *map(at, x[4:8]), *x[8:]) for x in rows], SCHEMA)


def got(df):
    return {tuple(r[c] for c in ("chat_id", "source_id", "relationship_name", "version_no", "target_id", "valid_from_us", "valid_to_us")) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("snapshots", [1, 3])
def test_history_equals_model(spark, seed, snapshots):
    rows = sample(seed)
    kinds = spark.createDataFrame(KINDS, "relationship_name string, single_value boolean")
    out = history.keep_history(frame(spark, rows), kinds, snapshots, fan=2, depth=3)
    assert got(out) == model(rows)


def test_hot_subject_in_slices(spark):
    rows = [("c", "s", "p" if n // 3 % 2 else "q", "lives_in", n, n + 1, 0, 0, n, "z", "z") for n in range(200)]
    kinds = spark.createDataFrame(KINDS, "relationship_name string, single_value boolean")
    facts = history.resolve_facts(frame(spark, rows), kinds)
    assert got(history.versions(facts, hot_rows=20)) == got(history.versions(facts)) == model(rows)


def test_changed_buckets_finds_all_and_only_changes(spark):
    kinds = spark.createDataFrame(KINDS, "relationship_name string, single_value boolean")
    rows = [("c", f"s{n}", "p", "lives_in", 1, None, 0, 0, n, "z", "z") for n in range(50)]
    changed = [(*x[:2], "q" if x[8] in (3, 17) else "p", *x[3:]) for x in rows]
    facts = [history.resolve_facts(frame(spark, x), kinds) for x in (rows, changed)]
    trees = [history.leaf_hashes(f, 4, 3) for f in facts]
    assert history.changed_buckets(trees[0], trees[0], 4, 3).count() == 0
    found = {r.bucket for r in history.changed_buckets(*trees, 4, 3).collect()}
    plain = [{(r.bucket, r.hash) for r in t.collect()} for t in trees]
    assert found == {b for b, _ in plain[0] ^ plain[1]}


def test_empty_and_nulls(spark):
    kinds = spark.createDataFrame(KINDS, "relationship_name string, single_value boolean")
    assert got(history.keep_history(frame(spark, []), kinds)) == set()
    rows = [("c", "s", "t", "lives_in", 1, None, None, None, 1, None, None), (None, "s", "t", "lives_in", 1, None, 0, 0, 2, None, None),
            ("c", "s", "t", None, 1, None, 0, 0, 3, None, None), ("c", "s", "t", "lives_in", None, None, 0, 0, 4, None, None)] * 2
    assert got(history.keep_history(frame(spark, rows), kinds)) == {("c", "s", "lives_in", 1, "t", us(1), -1)}


def test_advance_appends_and_reads_changed_branches_only(spark):
    import shutil

    from pyspark.sql import functions as F

    from convograph.lineage import Cuts

    kinds = spark.createDataFrame(KINDS, "relationship_name string, single_value boolean")
    rows = [("c", f"s{n}", "p", "lives_in", 1, None, 0, 0, n, "z", "z") for n in range(60)]
    changed = [(*x[:2], "q" if x[8] == 3 else "p", *x[3:]) for x in rows if x[8] != 17]
    cuts = Cuts(spark, "t")
    first = history.advance(None, history.resolve_facts(frame(spark, rows), kinds), cuts, fan=16, depth=2)
    branch = F.floor(history.bucket_of(16, 2) / 16)
    touched = {r[0] for r in frame(spark, [rows[3], rows[17]]).withColumn("relationship_name", F.lit("lives_in")).select(branch).collect()}
    path = cuts.tables[id(first.facts)][0].removeprefix("file:")
    for k in set(range(16)) - touched:
        shutil.rmtree(f"{path}/branch={k}", ignore_errors=True)
    second = history.advance(first, history.resolve_facts(frame(spark, changed), kinds), cuts)
    assert got(second.versions(cuts)) == model(changed)
    assert second.log[0] is first.log[0] and {(r.source_id, r.version_no, r.target_id) for r in second.log[1].collect()} == {("s3", 1, "q"), ("s17", None, None)}
    third = history.advance(second, history.resolve_facts(frame(spark, changed), kinds), cuts)
    assert third.log is second.log
    last = history.advance(third, history.resolve_facts(frame(spark, rows), kinds), cuts)
    assert got(last.versions(cuts)) == model(rows)


def test_depth_follows_the_subjects():
    assert [history.depth_for(n, 16) for n in (0, 900, 16_000, 17_000, 10**9)] == [1, 1, 1, 2, 5]
