"""Variant spellings of names of people and organisations, linked within a chat."""
from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import Cuts
from .conversations import unseen
from .given_names import PARTICLES, TITLES, plain, short_forms
from .groups import group_matches
from .pii import learned_given, plain_letters

# Legal forms and articles, which do not tell organisations apart.
LEGAL = frozenset("company co corporation corp gmbh limited ltd incorporated inc llc plc ag kg sa sl srl spa bv nv oy ab the".split())
WORDS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*")


def edits(a: str, b: str, most: int) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours between two words; most + 1 if there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            now.append(d)
        if min(now) > most:
            return most + 1
        before, last = last, now
    return last[-1]


def allowed(length: int) -> int:
    return 0 if length < 4 else 1 if length < 8 else 2


class Reader:
    """Takes names apart with a bounded set of given names."""

    def __init__(self, given: frozenset[str]):
        self.given = given
        self.short = short_forms()
        self.by_length: dict[int, list[str]] = {}
        for g in given:
            if len(g) > 2:
                self.by_length.setdefault(len(g), []).append(g)
        self.near = lru_cache(200_000)(self._near)

    def _near(self, word: str) -> tuple[str, ...]:
        """The given names that a word may misspell: itself if it is one, otherwise all that are equally close."""
        if word in self.given:
            return (word,)
        if len(word) < 3:
            return ()
        most = 1 if len(word) < 8 else 2
        best, found = most, []
        for n in range(len(word) - most, len(word) + most + 1):
            for g in self.by_length.get(n, ()):
                if g[0] == word[0] or g[1:3] == word[1:3] or sorted(g[:2]) == sorted(word[:2]):
                    d = edits(word, g, best)
                    # of a short name only a doubled or swapped letter is taken for a slip
                    if d <= best and (len(g) >= 5 or sorted(g) == sorted(word) or re.sub(r"(.)\1", r"\1", word) == g):
                        found = [g] if d < best else [*found, g]
                        best = d
        return tuple(sorted(found))

    def standard(self, given: str) -> str:
        """A given name without what is only another way to write it: umlauts in two letters, a doubled letter."""
        if given in self.short:
            return given
        for other in (given.replace("oe", "o").replace("ue", "u").replace("ae", "a"), re.sub(r"(.)\1+", r"\1", given)):
            if other != given and (other in self.given or other in self.short):
                return other
        return given

    def person(self, name: str) -> tuple[str, str, str]:
        """(family, full given names that may be meant, initials), each in plain letters."""
        t = re.split(r"[|(\[]", plain_letters(name).text)[0] or name
        handle = " " not in t.strip() and re.search(r"[._\d]", t)
        low = plain(t)
        words = [w.replace("'", "") for w in WORDS.findall(re.sub(r"[\d._]+", " ", low) if handle else low)]
        words = [w for w in words if w not in TITLES and (w not in PARTICLES or len(words) < 2)]
        if len(words) == 1 and len(words[0]) > 7 and words[0] not in self.given:
            # a name written in one word starts with a given name
            for n in range(min(len(words[0]) - 4, 14), 3, -1):
                if words[0][:n] in self.given:
                    words = [words[0][:n], words[0][n:]]
                    break
        letters = [w for w in words if len(w) == 1]
        words = [w for w in words if len(w) > 1]
        at = next((i for i, w in enumerate(words) if w in self.given), None)
        if at is None and (len(words) > 1 or len(words) == 1 and not letters):
            near = [(edits(w, g[0], 3), i) for i, w in enumerate(words) if (g := self.near(w))] if len(words) > 1 else []
            if near:
                at = min(near)[1]
        if at is None and not letters and len(words) > 1:
            at = len(words) - 1 if "," in low else 0
        who: set[str] = set()
        if at is not None:
            for g in self.near(words[at]) or (words[at],):
                known = self.standard(g)
                who.update(self.short.get(known, (known,)))
            words = words[:at] + words[at + 1:]
            letters = []
        return "".join(words), ",".join(sorted(who)), "".join(letters[:1])

    def organisation(self, name: str) -> str:
        low = plain(plain_letters(name).text).replace("g.m.b.h", "gmbh")
        words = [w for w in WORDS.findall(low)]
        return " ".join(w for w in words if w not in LEGAL) or " ".join(words)


def grams(text: str) -> set[str]:
    """The character trigrams of each word between its bounds."""
    return {f"^{w}$"[i:i + 3] for w in text.split() for i in range(max(1, len(w) + 3 - 3))}


def gapped(text: str) -> set[str]:
    """Trigrams that may leave out a letter: three letters in order out of four neighbours of a word between its bounds. A swap or a
    slip changes fewer of them than of plain trigrams."""
    out = set()
    for w in text.split():
        w = f"^{w}$"
        for i in range(len(w) - 2):
            for j, k in ((1, 2), (1, 3), (2, 3)):
                if i + k < len(w):
                    out.add(w[i] + w[i + j] + w[i + k])
    return out


def name_grams(kind: str, spelling: str) -> list[str]:
    """The n-grams of a whole normalised name. Of a person's these are gapped trigrams of the family name and plain ones of each given
    name it may stand for, with the initial as one more, so that nicknames, initials and the order of parts cost little."""
    if kind != "person":
        return sorted(gapped(spelling))
    family, given, initial = spelling.split("|")
    first = {f"^{g[0]}" for g in given.split(",") if g} | ({f"^{initial}"} if initial else set())
    return sorted(gapped(family)) + sorted("+" + g for g in grams(given.replace(",", " ")) | first)


def person_likeness(a: tuple[str, str, str], b: tuple[str, str, str], times: int = 1) -> float:
    """How far two people's names agree part by part; 0 if they cannot be one person's, however similar their letters. Family names
    may differ by ``times`` the allowed edits."""
    fa, ga, ia = a
    fb, gb, ib = b
    if not fa or not fb:
        return 1.0 if a == b else 0.0
    most = times * min(allowed(len(fa)), allowed(len(fb)))
    d = edits(fa, fb, most)
    if d > most:
        return 0.0
    base = 1 - 0.1 * d
    if ga and gb:
        return base if set(ga.split(",")) & set(gb.split(",")) else 0.0
    if ga or gb:
        initial = ia or ib
        return base * (0.85 if initial and initial in {g[0] for g in (ga or gb).split(",")} else 0.0)
    return base * 0.85 if ia == ib else 0.0


def word_likeness(a: str, b: str, times: int = 1) -> float:
    if a == b:
        return 1.0
    s, t = sorted((a, b), key=len)
    if 3 <= len(s) <= 5 and len(t) - len(s) >= 2 and s[0] == t[0]:  # an abbreviation leaves letters out
        rest = iter(t)
        if all(c in rest for c in s):
            return 0.95
    most = times * min(allowed(len(a)), allowed(len(b)))
    d = edits(a, b, most)
    return 1 - 0.1 * d if d <= most else 0.0


def organisation_likeness(a: str, b: str, times: int = 1) -> float:
    """How far two organisations' names agree word by word; 0 if a word has no counterpart within ``times`` the allowed edits."""
    x, y = a.split(), b.split()
    if len(x) != len(y):
        # one word may be torn in two or two joined
        return 0.9 if a.replace(" ", "") == b.replace(" ", "") else 0.0
    total, left = 1.0, list(y)
    for w in sorted(x, key=lambda w: -len(w)):
        best = max(left, key=lambda v: word_likeness(w, v, times))
        total *= word_likeness(w, best, times)
        left.remove(best)
    return total


NAMED = "chat_id string, ref string, kind string, spelling string"


def records(messages: DataFrame, nodes: DataFrame, candidates: DataFrame) -> DataFrame:
    """(chat_id, ref, kind, name): people and organisations with each name they stood under. Nodes of type Person or Alias
    and Concept nodes of category organisation, also as spelled when a pair was scored; senders but the bot, which is who
    writes outbound messages. Blank names are none."""
    organisation = (F.col("node_type") == "Concept") & (F.get_json_object("properties", "$.category") == "organisation")
    node = nodes.where(F.col("node_type").isin("Person", "Alias") | organisation).select(
        "chat_id", F.concat(F.lit("node:"), "id").alias("ref"), F.when(F.col("node_type") == "Concept", "org").otherwise("person").alias("kind"), "name")
    scored = candidates.select("chat_id", F.col("a_id").alias("id"), F.col("a_name").alias("name")).union(
        candidates.select("chat_id", "b_id", "b_name")).select("chat_id", F.concat(F.lit("node:"), "id").alias("ref"), "name").distinct()
    scored = scored.join(node.select("chat_id", "ref", "kind").distinct(), ["chat_id", "ref"])
    bots = messages.where("direction = 'outbound'").select("sender_id").distinct()
    sender = messages.select("chat_id", "sender_id", F.col("sender_display_name").alias("name")).distinct().join(bots, "sender_id", "left_anti").select(
        "chat_id", F.concat(F.lit("sender:"), "sender_id").alias("ref"), F.lit("person").alias("kind"), "name")
    every = node.unionByName(sender).unionByName(scored.select("chat_id", "ref", "kind", "name"))
    return every.where(F.col("chat_id").isNotNull() & F.col("ref").isNotNull() & ~unseen(F.col("name"))).distinct()


def read_names(named: DataFrame, given: frozenset[str]) -> DataFrame:
    """(chat_id, ref, kind, spelling): the spelling is a name's parts in plain letters, whatever their order."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        r = Reader(given)
        for batch in batches:
            out = ["|".join(r.person(n)) if k == "person" else r.organisation(n)
                   for k, n in zip(batch.column("kind").to_pylist(), batch.column("name").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("chat_id", "ref", "kind")), pa.array(out, pa.string())],
                                             names=["chat_id", "ref", "kind", "spelling"])

    return named.select("chat_id", "ref", "kind", "name").mapInArrow(run, NAMED).where("spelling not in ('', '||')").distinct()


DIMENSIONS = 1 << 18
WEIGHT_BITS = 26


def dimensions(kind: str, spelling: str) -> list[int]:
    """The dimensions of a name's n-grams: a checksum folds them into a fixed number, so that tables by n-gram have a bounded size in any script."""
    return sorted({crc32(g.encode()) % DIMENSIONS for g in name_grams(kind, spelling)})


def weigh(names: int, holders: np.ndarray) -> np.ndarray:
    """The squared weight of each dimension in millionths: the square of the logarithm of how rare it is among all names of its kind. Below one
    in a thousand it no longer rises, so that a slip, which makes n-grams nobody else has, does not outweigh what is left of the name."""
    return np.rint(np.log(1 + names / np.maximum(holders + names / 1000, 1e-9)) ** 2 * 1e6).astype(np.int64)


def vectors(spellings: DataFrame, least: float, cuts: Cuts) -> DataFrame:
    """(id, chat_id, kind, spelling, codes, norm, prefix): the n-gram vector of each spelling, and the dimensions of its prefix.

    A code is a dimension and its squared weight in one number, so that the codes two vectors share give their product. The
    prefix is the rarest dimensions, all ranked alike, up to where what remains is shorter than ``least``: two vectors
    with a cosine of ``least`` share a dimension of both prefixes, or all they share would lie in what remains of one. The weights are
    two arrays of a fixed size, which go to every task. ``id`` is a hash: equal ids of different spellings only make pairs that are then told apart."""
    def counted(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            kinds, found = batch.column("kind").to_pylist(), []
            for k, s in zip(kinds, batch.column("spelling").to_pylist(), strict=True):
                found.append(np.array(dimensions(k, s)) + (DIMENSIONS if k == "person" else 0))
            at, n = np.unique(np.concatenate(found) if found else np.array([], int), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n, pa.int64())], names=["at", "n"])

    held = spellings.select("kind", "spelling").mapInArrow(counted, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    holders = np.zeros(2 * DIMENSIONS)
    holders[held.column("at").to_numpy()] = held.column("n").to_numpy()
    size = {r.kind: r.n for r in spellings.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    weights = spellings.sparkSession.sparkContext.broadcast({k: weigh(size.get(k, 0), h) for k, h in (("org", holders[:DIMENSIONS]), ("person", holders[DIMENSIONS:]))})

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        w = weights.value
        for batch in batches:
            codes, norms, prefixes = [], [], []
            for k, s in zip(batch.column("kind").to_pylist(), batch.column("spelling").to_pylist(), strict=True):
                d = np.array(dimensions(k, s))
                w2 = w[k][d]
                order = np.lexsort((d, -w2))
                d, w2 = d[order], w2[order]
                total = int(w2.sum())
                rest = total - np.cumsum(w2)  # what remains behind each
                codes.append((d << WEIGHT_BITS) | w2)
                norms.append((total / 1e6) ** 0.5)
                prefixes.append(d[:1 + int(np.argmax(rest < least * least * total))])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(codes, pa.list_(pa.int64())), pa.array(norms, pa.float64()), pa.array(prefixes, pa.list_(pa.int32()))],
                names=[*batch.schema.names, "codes", "norm", "prefix"])

    s = spellings.select(F.xxhash64("chat_id", "kind", "spelling").alias("id"), "chat_id", "kind", "spelling")
    return cuts.cut(s.mapInArrow(run, "id long, chat_id string, kind string, spelling string, codes array<long>, norm double, prefix array<int>"))


def similar_spellings(spellings: DataFrame, cuts: Cuts, least: float = 0.4, block: int = 2000) -> DataFrame:
    """(chat_id, kind, a, b, cosine): all pairs of spellings of one chat whose n-gram vectors have a cosine of at least ``least``.

    A join by prefixes (see ``vectors``) finds the pairs that may reach it, and only these are compared in full. The n of the
    top-n of a spelling is the number of its partners above the threshold: it differs between spellings, and none is cut off.
    Where a dimension occurs more than ``block`` times in a chat, its pairs are made block by block in different tasks."""
    v = vectors(spellings, least, cuts)
    p = v.select("id", F.explode("prefix").alias("d"), "chat_id", "kind").select(F.xxhash64("chat_id", "kind", "d").alias("key"), "id")
    busy = p.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    p = cuts.cut(p.join(busy, "key").select("key", "id", F.ceil(F.col("m") / block).cast("int").alias("blocks")))
    a = p.select("key", F.col("id").alias("i"), F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"))
    b = p.select("key", F.col("id").alias("j"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    pairs = a.join(b, ["key", "block"]).where("i < j").select("i", "j").distinct()
    side = lambda c, n: v.select(F.col("id").alias(c), *[F.col(x).alias(f"{x}{n}") for x in ("chat_id", "kind", "spelling", "codes", "norm")])
    shared = F.aggregate(F.array_intersect("codes1", "codes2"), F.lit(0).cast("long"), lambda t, x: t + x.bitwiseAND(F.lit((1 << WEIGHT_BITS) - 1)))
    cosine = shared / 1e6 / (F.col("norm1") * F.col("norm2"))
    return (
        pairs.join(side("i", 1), "i").join(side("j", 2), "j").where("chat_id1 = chat_id2 and kind1 = kind2")
        .select(F.col("chat_id1").alias("chat_id"), F.col("kind1").alias("kind"), F.least("spelling1", "spelling2").alias("a"), F.greatest("spelling1", "spelling2").alias("b"), cosine.alias("cosine"))
        .where(F.col("cosine") >= least)
    )


def likeness(pairs: DataFrame, least: float) -> DataFrame:
    """(chat_id, kind, a, b, s) of the similar pairs whose parts agree: given names that may be one person's, family names within the
    allowed edits, a counterpart for each word of an organisation. ``s`` is the cosine. Two variants of one name may lie twice the
    allowed edits apart; such a pair speaks for clusters that others link, with a cosine kept under ``least``, but cannot link two by itself.
    What the check refuses is left out."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        under = np.nextafter(least, 0)
        for batch in batches:
            s = []
            for k, a, b, c in zip(*(batch.column(c).to_pylist() for c in ("kind", "a", "b", "cosine")), strict=True):
                agree, x, y = (person_likeness, tuple(a.split("|")), tuple(b.split("|"))) if k == "person" else (organisation_likeness, a, b)
                s.append(c if agree(x, y) > 0 else min(c, under) if agree(x, y, 2) > 0 else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(s, pa.float64())], names=["chat_id", "kind", "a", "b", "s"])

    return pairs.select("chat_id", "kind", "a", "b", "cosine").mapInArrow(run, "chat_id string, kind string, a string, b string, s double").where("s > 0")


def link_in_memory(links: list[tuple[str, str, float]], least: float) -> dict[str, str]:
    """Average linkage of one connected group, pair by pair from the most alike: {member: cluster} of the members that have a link."""
    near: dict[str, dict[str, float]] = {}
    for a, b, s in links:
        near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = s
    size, of = dict.fromkeys(near, 1), {x: [x] for x in near}
    heap = [(-s, *sorted((a, b))) for a, b, s in links if s >= least]
    heapify(heap)
    while heap:
        m, a, b = heappop(heap)
        # a pair that has merged or changed since is passed over
        if b not in near.get(a, ()) or -m != near[a][b] / (size[a] * size[b]):
            continue
        for c, s in near.pop(b).items():
            del near[c][b]
            if c != a:
                near[a][c] = near[c][a] = near[a].get(c, 0.0) + s
        size[a] += size.pop(b)
        of[a] += of.pop(b)
        for c, s in near[a].items():
            if (mean := s / (size[a] * size[c])) >= least:
                heappush(heap, (-mean, *sorted((a, c))))
    return {x: c for c, xs in of.items() for x in xs}


def average_linkage(links: DataFrame, least: float, cuts: Cuts, most_links: int = 50_000) -> DataFrame:
    """(member, cluster) of all members of links (a, b, s), a < b; pairs without a link have likeness 0.

    Clusters never reach beyond a connected group, so groups are worked on apart. One of at most ``most_links`` links is linked by
    the task that reads its rows; a larger one by ``linkage_rounds``, with the same result."""
    group = group_matches(links.select(F.col("a").alias("a_id"), F.col("b").alias("b_id"), F.lit(1.0).alias("score")), levels=0)
    known = links.join(group.withColumnRenamed("node_id", "a"), "a").select("group_id", "a", "b", "s")
    known = cuts.cut(known)
    large = known.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most_links).select("group_id")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def ended(now: list) -> tuple[list, list]:
            got = sorted(link_in_memory(now, least).items())
            return [x for x, _ in got], [y for _, y in got]

        last, now = None, []
        for batch in batches:
            members, clusters = [], []
            for g, a, b, s in zip(*(batch.column(c).to_pylist() for c in ("group_id", "a", "b", "s")), strict=True):
                if g != last:
                    x, y = ended(now)
                    members += x
                    clusters += y
                    last, now = g, []
                now.append((a, b, s))
            yield pa.RecordBatch.from_arrays([pa.array(members, pa.string()), pa.array(clusters, pa.string())], names=["member", "cluster"])
        x, y = ended(now)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()), pa.array(y, pa.string())], names=["member", "cluster"])

    small = known.join(large, "group_id", "left_anti").repartition("group_id").sortWithinPartitions("group_id")
    out = small.mapInArrow(run, "member string, cluster string")
    if large.take(1):
        out = out.unionByName(linkage_rounds(known.join(large, "group_id", "left_semi").select("a", "b", "s"), least, cuts))
    return cuts.cut(out)


def linkage_rounds(links: DataFrame, least: float, cuts: Cuts) -> DataFrame:
    """(member, cluster) as ``average_linkage``, for groups of any size.

    Average linkage may merge all pairs of clusters that are each other's nearest at once without changing the result, so each
    round is a few joins over the links between clusters, whatever a group's size; rounds end when no
    pair has an average likeness of ``least``."""
    both = links.select("a", "b", "s").union(links.select(F.col("b"), F.col("a"), F.col("s")))
    edges = cuts.cut(both.groupBy("a", "b").agg(F.max("s").alias("s"), F.lit(1).cast("long").alias("na"), F.lit(1).cast("long").alias("nb")))
    owner = cuts.cut(edges.select(F.col("a").alias("member"), F.col("a").alias("cluster")).distinct())
    while True:
        mean = F.col("s") / (F.col("na") * F.col("nb"))
        # of equal averages the smaller pair of names, the same for both sides
        pick = F.struct((-mean).alias("m"), F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
        best = edges.where(mean >= least).groupBy("a").agg(F.min_by(F.struct("b", "na", "nb"), pick).alias("t")).select("a", "t.*")
        other = best.select(F.col("a").alias("b"), F.col("b").alias("a"))
        merge = cuts.cut(best.join(other, ["a", "b"]).select(F.col("a").alias("old"), F.least("a", "b").alias("new"), (F.col("na") + F.col("nb")).alias("n")))
        if not merge.take(1):
            return owner
        side = lambda x: merge.select(F.col("old").alias(x), F.col("new").alias(f"new_{x}"), F.col("n").alias(f"m{x}"))  # noqa: B023, E731
        after = cuts.cut(
            edges.join(side("a"), "a", "left").join(side("b"), "b", "left")
            .select(F.coalesce("new_a", "a").alias("a"), F.coalesce("new_b", "b").alias("b"), "s", F.coalesce("ma", "na").alias("na"), F.coalesce("mb", "nb").alias("nb"))
            .where("a <> b").groupBy("a", "b", "na", "nb").agg(F.sum("s").alias("s")).select("a", "b", "s", "na", "nb")
        )
        moved = cuts.cut(owner.join(side("a").withColumnRenamed("a", "cluster"), "cluster", "left").select("member", F.coalesce("new_a", "cluster").alias("cluster")))
        cuts.drop(edges, owner, merge)
        edges, owner = after, moved


def link_names(messages: DataFrame, nodes: DataFrame, candidates: DataFrame, least: float = 0.4, near: float = 0.3) -> DataFrame:
    """(chat_id, ref, entity): records of people and organisations with the entity they belong to; entity is
    comparable within a chat only. Spellings of one record, and records of one spelling, belong together; other
    spellings are compared by the cosine of their n-gram vectors where it is ``near`` or more and their parts agree, and grouped by
    average linkage over these cosines, cut at ``least``."""
    cuts = Cuts(messages.sparkSession, "names")
    named = cuts.cut(read_names(records(messages, nodes, candidates), learned_given(nodes)))
    spellings = named.select("chat_id", "kind", "spelling").distinct()
    ident = lambda c: F.concat_ws("\u0001", "chat_id", "kind", c)
    scored = cuts.cut(likeness(similar_spellings(spellings, cuts, near), least).select(ident("a").alias("a"), ident("b").alias("b"), "s"))
    cuts.keep(named, scored)
    # spellings that share a record are one item, however they differ
    first = named.groupBy("chat_id", "ref", "kind").agg(F.min("spelling").alias("a"))
    same = named.join(first, ["chat_id", "ref", "kind"]).where("a <> spelling").select(
        ident("a").alias("a_id"), ident("spelling").alias("b_id"), F.lit(1.0).alias("score")).distinct()
    item = group_matches(same, levels=0)
    of = lambda x: item.select(F.col("node_id").alias(x), F.col("group_id").alias(f"item_{x}"))
    links = (
        scored.join(of("a"), "a", "left").join(of("b"), "b", "left")
        .select(F.coalesce("item_a", "a").alias("x"), F.coalesce("item_b", "b").alias("y"), "s").where("x <> y")
        .groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.max("s").alias("s"))
    )
    cluster = average_linkage(cuts.cut(links), least, cuts)
    return cuts.finish(
        named.withColumn("spelt", ident("spelling")).join(of("spelt"), "spelt", "left").withColumn("member", F.coalesce("item_spelt", "spelt"))
        .join(cluster, "member", "left").groupBy("chat_id", "ref").agg(F.min(F.coalesce("cluster", "member")).alias("entity"))
    )


def same_entity_pairs(linked: DataFrame) -> DataFrame:
    """(chat_id, a_ref, b_ref): the pairs of records of one entity, a_ref < b_ref."""
    return linked.withColumnRenamed("ref", "a_ref").join(linked.withColumnRenamed("ref", "b_ref"), ["chat_id", "entity"]).where("a_ref < b_ref").select(
        "chat_id", "a_ref", "b_ref")
