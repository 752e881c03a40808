import numpy as np
import pytest

from convograph.lineage import Cuts
from convograph.llm.given_names import short_forms
from convograph.llm.names import Reader, average_linkage, dimensions, edits, likeness, link_in_memory, link_names, linkage_rounds, organisation_likeness, person_likeness, same_entity_pairs, similar_spellings, vectors, weigh

R = Reader(frozenset(short_forms()))


@pytest.mark.parametrize("a,b,same", [
    ("Robert Gagestofan", "Bob Gagestofan", True), ("Robert Gagestofan", "Gagestofan, R.", True), ("Robert Gagestofan", "r_gagestofan48", True),
    ("Robert Gagestofan", "robertgagestofan", True), ("Robert Gagestofan", "GAGESTOFAN Robert (work)", True), ("Robert Gagestofan", "Dr Rоbеrt K. Gagstofan", True),
    ("Robert Gagestofan", "Farida Gagestofan", False), ("Robert Gagestofan", "Robert Minnelapo", False), ("Robert Gagestofan", "T Gagestofan", False),
    ("Søren Bösulezi", "Soren Bosulezi | away", True),
])
def test_people(a, b, same):
    assert (person_likeness(R.person(a), R.person(b)) > 0) is same


@pytest.mark.parametrize("a,b,same", [
    ("Dolani Bakery Limited", "The DOLANI Bkry", True), ("Dolani Cycling Club GmbH", "dolani cyc. club G.m.b.H.", True), ("Laboratories Dolani", "Dolani Labs Inc.", True),
    ("Dolani Bakery", "Dolani Foundation", False), ("Dolani Bakery", "Dolaini Bakery", True), ("Dolani Bakery", "Mustero Bakery", False),
])
def test_organisations(a, b, same):
    assert (organisation_likeness(R.organisation(a), R.organisation(b)) > 0) is same


def test_edits():
    assert edits("abcd", "abdc", 2) == 1 and edits("abc", "abxyc", 2) == 2 and edits("abc", "xyz", 2) == 3 and edits("", "ab", 2) == 2


def cosines(words, kind):
    df = {}
    for w in words:
        for g in dimensions(kind, w):
            df[g] = df.get(g, 0) + 1
    v = {w: {g: float(weigh(len(words), np.array([df[g]]))[0]) for g in dimensions(kind, w)} for w in words}
    norm = {w: np.sqrt(sum(v[w].values())) for w in words}
    return {(a, b): sum(v[a][g] for g in v[a].keys() & v[b].keys()) / norm[a] / norm[b] for a in words for b in words if a < b}


@pytest.mark.parametrize("kind", ["org", "person"])
def test_prefix_join_finds_all_similar_pairs_and_cuts(spark, kind):
    rng = np.random.default_rng(4)
    syllables = ["ba", "ko", "mi", "ter", "lan", "zu", "fe", "go"]
    words = sorted({"".join(rng.choice(syllables, 4)) for _ in range(150)})
    if kind == "person":
        words = sorted(f"{w}|{g}|{i}" for w in words for g, i in [[("robert", ""), ("samantha,samuel", ""), ("", "r")][int(rng.integers(0, 3))]])
    df = spark.createDataFrame([("c", kind, w) for w in words], "chat_id string, kind string, spelling string")
    want = {k: x for k, x in cosines(words, kind).items() if x >= 0.5}
    for block in (5, 2000):
        got = {(r.a, r.b): r.cosine for r in similar_spellings(df, Cuts(spark, "t"), 0.5, block).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    v = vectors(df, 0.5, Cuts(spark, "t")).collect()
    # no longer prefix than needed: without its last n-gram what remains would reach the threshold
    for r in v:
        w2 = [(c & (1 << 26) - 1) / 1e6 for c in r.codes]
        assert sum(w2[len(r.prefix):]) < 0.25 * r.norm**2 + 1e-9 <= sum(w2[len(r.prefix) - 1:]) + 2e-9
        assert [c >> 26 for c in r.codes][:len(r.prefix)] == r.prefix
    assert sum(len(r.prefix) for r in v) < 0.85 * sum(len(r.codes) for r in v)


def test_the_check_bridges_but_does_not_link(spark):
    rows = [("c", "person", "fapaloi|edward|", "fapakobi|edward|", 0.7), ("c", "person", "fapalobi|edward|", "fapakobi|edward|", 0.7), ("c", "person", "fapalobi|edward|", "fapalobi|farida|", 0.9),
            ("c", "org", "dolani bakery", "dolani foundation", 0.8), ("c", "org", "dolani bakery", "dolaini bakery", 0.8)]
    got = {(r.a, r.b): r.s for r in likeness(spark.createDataFrame(rows, "chat_id string, kind string, a string, b string, cosine double"), 0.4).collect()}
    assert got.pop(("fapaloi|edward|", "fapakobi|edward|")) < 0.4
    assert got == {("fapalobi|edward|", "fapakobi|edward|"): 0.7, ("dolani bakery", "dolaini bakery"): 0.8}


def test_names_in_other_scripts():
    assert R.person("Иван Петров")[0] and R.person("王小明")[0] and person_likeness(R.person("Иван Петров"), R.person("иван  ПЕТРОВ")) > 0


def linkage_model(links, least):
    s = {frozenset(p[:2]): p[2] for p in links}
    groups = [frozenset([x]) for x in {x for p in links for x in p[:2]}]
    while True:
        best = max(((sum(s.get(frozenset((x, y)), 0) for x in a for y in b) / len(a) / len(b), a, b) for i, a in enumerate(groups) for b in groups[:i]), key=lambda t: t[0], default=None)
        if not best or best[0] < least:
            return set(groups)
        groups = [g for g in groups if g not in best[1:]] + [best[1] | best[2]]


@pytest.mark.parametrize("way", ["memory", "rounds", "groups"])
def test_average_linkage_equals_one_at_a_time(spark, way):
    rng = np.random.default_rng(9)
    links = sorted({(f"n{a:02}", f"n{b:02}") for a, b in rng.integers(0, 24, (70, 2)) if a < b} | {("x", "y"), ("y", "z")})
    links = [(a, b, float(x)) for (a, b), x in zip(links, rng.permutation(len(links)) / len(links) * 0.6 + 0.4)]
    if way == "memory":
        pairs = link_in_memory(links, 0.5).items()
    else:
        df = spark.createDataFrame(links, "a string, b string, s double")
        out = linkage_rounds(df, 0.5, Cuts(spark, "t")) if way == "rounds" else average_linkage(df, 0.5, Cuts(spark, "t"), most_links=2)
        pairs = [tuple(r) for r in out.select("member", "cluster").collect()]
    got = {}
    for member, cluster in pairs:
        got.setdefault(cluster, set()).add(member)
    assert set(map(frozenset, got.values())) == linkage_model(links, 0.5)
    assert all(c == min(ms) for c, ms in got.items())


def test_records_of_a_chat(spark):
    nodes = spark.createDataFrame([
        ("c", "n1", "Robert Gagestofan", "Person", None), ("c", "n2", "Gagestofan, R.", "Alias", None), ("c", "n3", "Dolani Bakery", "Concept", '{"category":"organisation"}'),
        ("c", "n4", "Dolani Bkry Ltd", "Concept", '{"category":"organisation"}'), ("c", "n5", "Dolani Bakery", "Concept", '{"category":"place"}'), ("d", "n6", "Robert Gagestofan", "Person", None),
        ("c", "n7", " ", "Person", None), ("c", "n8", None, "Person", "{}"), (None, "n9", "x", "Person", "{")], "chat_id string, id string, name string, node_type string, properties string")
    messages = spark.createDataFrame([("c", "s1", "Bob Gagestofan", "inbound"), ("c", "s1", "​", "inbound"), ("c", "bot", "Robert Gagestofan", "outbound"), ("c", None, "Bob Gagestofan", "inbound"),
                                      ("c", "s2", None, "inbound")] * 2, "chat_id string, sender_id string, sender_display_name string, direction string")
    pairs = spark.createDataFrame([("c", "n1", "n2", "Rob Gagestofan", None)], "chat_id string, a_id string, b_id string, a_name string, b_name string")
    got = {tuple(r) for r in same_entity_pairs(link_names(messages, nodes, pairs)).collect()}
    assert got == {("c", "node:n1", "node:n2"), ("c", "node:n1", "sender:s1"), ("c", "node:n2", "sender:s1"), ("c", "node:n3", "node:n4")}
    assert same_entity_pairs(link_names(messages.limit(0), nodes.limit(0), pairs.limit(0))).count() == 0
