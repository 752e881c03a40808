import random

import pytest
from pyspark.sql import functions as F

from convograph.llm.subjects import assign_subjects, digamma, sentences

WORDS = {
    "music": "melody chord drummer bassline ukulele soprano tempo vinyl".split(), "law": "verdict plaintiff lawsuit statute notary clause tenant judge".split(),
    "sport": "goalkeeper striker referee tournament offside coach relay sprint".split(), "cooking": "oven skillet marinade dough broth cumin roast whisk".split(),
}
CHAT = ["we moved the picnic to friday", "somebody left the keys again", "thanks for the lift", "the bus was late today"]


@pytest.fixture(scope="module")
def docs():
    r = random.Random(6)
    rows, truth = [], {}
    for i in range(240):
        subjects = r.sample(sorted(WORDS), r.choice([0, 1, 1, 2]))
        said = [f"nobody agreed on the {a} but the {b} was clear" for s in subjects for _ in range(6) for a, b in [r.sample(WORDS[s], 2)]]
        said += r.choices(CHAT, k=4 if subjects else 8)
        if len(subjects) == 1 and i % 3 == 0:
            said.append("nobody agreed on the oven but the verdict was clear" if subjects == ["sport"] else "the referee was late")
            said += said[:6]
        r.shuffle(said)
        rows.append((i, "\n".join(f"[10:{n % 60:02}] Ann: {s}." for n, s in enumerate(said)), "z"))
        truth[i] = set(subjects)
    return rows, truth


def test_sentences():
    assert sentences("[12:27] Pebble: First the oven. Then the broth!\ndigest run 4578: 4 nodes, 24 edges\n- Zu spät?\n\n> ok") == [["first", "the", "oven"], ["then", "the", "broth"], ["zu", "spät"]]
    assert sentences("") == [] and sentences("​") == []


def test_digamma():
    import numpy as np

    x = np.array([0.1, 1.0, 2.5, 30.0])
    assert np.allclose(digamma(x), [-10.4237549404, -0.5772156649, 0.7031566406, 3.3844380956], atol=1e-6)


def test_subjects_of_planted_documents(spark, docs):
    rows, truth = docs
    df = spark.createDataFrame(rows + [(900, None, "z"), (901, "", "z"), (902, "x " * 50_000, "z"), (None, "melody", "z")], "doc_id long, text string, subject string")
    areas = spark.createDataFrame([(s, s, "z") for s in WORDS], "subject string, title string, share string")
    labels = spark.createDataFrame([(i, s) for i in range(20) for s in truth[i]] + [(None, "law"), (3, None)], "doc_id long, subject string")
    got = {i: set() for i in truth}
    for r in assign_subjects(df, areas, labels).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    hit = sum(len(got[i] & truth[i]) for i in truth)
    assert hit / sum(map(len, truth.values())) > 0.97 and hit / sum(map(len, got.values())) > 0.97
    assert not any(got.get(i) for i in (900, 901, 902))


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    areas = spark.createDataFrame([("law", "Law")], "subject string, title string")
    assert assign_subjects(df, areas).count() == 0 and assign_subjects(df, areas.limit(0)).agg(F.count("*")).first()[0] == 0


def test_a_subject_nobody_inspected(spark):
    r = random.Random(12)
    words = {"astrology": "zodiac ascendant horoscope quincunx retrograde cusp natal trine".split(), "knots": "bowline halyard splice hitch becket lashing grommet toggle".split()}
    rows = []
    for i in range(200):
        s = r.choice([*words, None])
        said = [f"nobody agreed on the {a} but the {b} was clear" for _ in range(5) for a, b in [r.sample(words[s], 2)]] if s else r.choices(CHAT, k=6)
        rows.append((i, ". ".join(said), s))
    df = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    areas = spark.createDataFrame([(s, s) for s in words], "subject string, title string")
    labels = spark.createDataFrame([(i, s) for i, _, s in rows[:40] if s], "doc_id long, subject string")
    got = {(x.doc_id, x.subject) for x in assign_subjects(df, areas, labels).collect()}
    want = {(i, s) for i, _, s in rows if s}
    assert len(got & want) >= 0.97 * max(len(got), len(want))
    assert assign_subjects(df, areas.limit(0), labels).count() == 0
