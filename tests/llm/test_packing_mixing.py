import os
import random

import pytest
from pyspark.sql import functions as F

import numpy as np

from convograph.llm.mixing import mix, mixture_faults, poisson_below, share_report, solve_rate
from convograph.llm.packing import best_fit, best_pair, fill_report, improve, pack, packing_faults
from convograph.llm.tokens import RANKS, encoding

needs_ranks = pytest.mark.skipif(not os.path.exists(RANKS), reason="no tokenizer file")


def test_local_search_keeps_items_and_never_gets_worse():
    r = random.Random(2)
    for _ in range(20):
        sizes = [r.choice([r.randrange(1, 100), r.randrange(30, 60)]) for _ in range(120)]
        before = best_fit(sizes, 100)
        after = improve([list(b) for b in before], sizes, 100)
        assert sorted(i for b in after for i in b) == list(range(120)) and all(sum(sizes[i] for i in b) <= 100 for b in after)
        squares = lambda bins: sum(sum(sizes[i] for i in b) ** 2 for b in bins)
        assert squares(after) >= squares(before) and len(after) <= len(before)


def test_search_finds_what_best_fit_misses():
    sizes = [6, 4, 4, 3, 3]  # 6 + 4, 4 + 3 + 3
    assert len(improve([[0, 3], [1, 2], [4]], sizes, 10)) == 2


@needs_ranks
def test_every_token_has_its_place(spark):
    r = random.Random(3)
    texts = ["word " * r.choice([3, 40, 200, 900]) for _ in range(80)] + ["long text " * 3000, "", "<|endoftext|>"]
    rows = [(i, t, "z") for i, t in enumerate(texts)] + [(500, None, "z"), (None, "x", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, container string")
    for shard in (15, 2000):
        out = pack(df, 512, shard)
        e = encoding(RANKS)
        got = {x.doc_id: x.n for x in out.groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()}
        assert got == {i: n for i, t in enumerate(texts) if (n := len(e.encode_ordinary(t)))}
        assert {x.fault: x.n for x in packing_faults(out, df, 512).collect()} == dict.fromkeys(["over_capacity", "tokens_not_once", "split_needlessly"], 0)
        rep = fill_report(out, 512).first()
        pieces = [x.n_tokens for x in out.collect()]
        # no worse than best fit over everything, but that a shard leaves about one bin with room
        most = len(best_fit(pieces, 512)) + (len(texts) / shard if shard < len(texts) else 0)
        assert rep.fullest <= 512 and rep.least_containers <= rep.containers <= most
        split = out.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("first_token").alias("t")).where("n > 1").collect()
        assert {s.doc_id for s in split} == {i for i, n in got.items() if n > 512}
    assert pack(df.limit(0)).count() == 0


@needs_ranks
def test_shares_caps_and_report(spark):
    r = random.Random(4)
    docs = [(i, "some words " * r.randrange(5, 30), s, "z") for i, s in enumerate(["big"] * 300 + ["small"] * 60 + ["tiny"] * 2 + [None] * 5 + ["other"] * 9)] + [(999, None, "big", "z")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, rate string")
    targets = spark.createDataFrame([("big", 0.5, 2), ("small", 0.4, 6), ("tiny", 0.1, 3), ("none", 0.0, 3)], "source string, target_share double, max_repeats long")
    out = mix(df, targets).cache()
    total = sum(len(encoding(RANKS).encode_ordinary(t)) for _, t, s, _ in docs if s and t)
    per = {x.source: x for x in share_report(out, targets).collect()}
    assert abs(per["big"].n_tokens / total - 0.5) < 0.01 and abs(per["small"].n_tokens / total - 0.4) < 0.02
    assert per["tiny"].most_repeats == 3 and per["tiny"].copies == 6 and per["none"].n_tokens == 0
    assert out.groupBy("doc_id", "copy_no").count().where("count > 1").count() == 0
    assert out.where("source = 'small'").agg(F.max("copy_no")).first()[0] <= 6
    place = [x.place for x in out.collect()]
    assert place == sorted(place)
    assert {x.fault: x.n for x in mixture_faults(out, df, targets).collect()} == dict.fromkeys(["beyond_max_repeats", "gap_in_copies", "unknown_document", "other_size"], 0)
    assert {tuple(x) for x in mix(df, targets).collect()} == {tuple(x) for x in out.collect()}
    assert mix(df.limit(0), targets).count() == 0 and mix(df, targets.limit(0)).count() == 0


def test_poisson_inverse_of_any_size():
    assert np.allclose(poisson_below(2.0, 4), [0.135335, 0.406006, 0.676676, 0.857123], atol=1e-6)
    assert poisson_below(900.0, 1000)[-1] > 0.999 and poisson_below(2000.0, 1000)[-1] < 1e-20 and poisson_below(0.0, 3).tolist() == [1, 1, 1]
    draws = np.full(1000, 10.0)  # ten tokens in each of 1,000 steps
    above = np.append(np.cumsum(draws[::-1])[::-1], 0)
    for goal in (2_500.0, 10_000.0, 4_000_000.0):
        below = poisson_below(solve_rate(above, goal, 1000), 1000)
        assert abs(above[np.minimum(np.ceil(below * 1000).astype(int), 1000)].sum() - goal) < max(20, goal * 0.005)


def test_many_repeats_plan_alike(spark):
    docs = [(i, "some words here " * 3, "s" if i % 50 else "t") for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("s", 0.5, 2), ("t", 0.5, 1000), ("t", None, 3)], "source string, target_share double, max_repeats long")
    got = {r.source: r.actual_share for r in share_report(mix(df, targets), targets.where("target_share > 0")).collect()}
    assert abs(got["t"] - 0.5) < 0.03


def test_best_pair_equals_all_pairs():
    r = random.Random(8)
    for _ in range(200):
        keys, most = sorted(r.choices(range(1, 30), k=r.randrange(0, 9))), r.randrange(2, 60)
        sums = [x + y for i, x in enumerate(keys) for y in keys[i + 1:] if x + y <= most]
        at = best_pair(keys, most)
        assert (at is None) == (not sums) and (at is None or keys[at[0]] + keys[at[1]] == max(sums))
