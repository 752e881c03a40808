"""Languages of texts and of their segments by cross-parsing against suffix automata."""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pii import plain_letters

LANGUAGES = ("de", "en", "es", "fr", "ja", "pt", "ru", "zh")
# What ends a sentence.
SENTENCE_ENDS = ".!?。！？…；;\n\r/|"
#: Handles, addresses and links are codes, not words of a language.
CODE = re.compile(r"\S*@\S+|https?://\S+")
LETTER = re.compile(r"[^\W\d_]")


def _kinds() -> np.ndarray:
    """Of each character of the basic plane: 1 letter, 2 letter of a script without blanks, 3 end of a sentence, 4 end of a text, 0 other."""
    kind = np.array([LETTER.match(chr(i)) is not None for i in range(0x10000)], np.int8)
    for a, b in ((0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF)):
        kind[a:b + 1] *= 2
    kind[[ord(c) for c in SENTENCE_ENDS]] = 3
    kind[0] = 4
    return kind


KINDS = _kinds()


def letters_only(text: str) -> str:
    """Plain lower-case letters; blanks, digits and signs between words are one blank, between sentences a line break."""
    t = CODE.sub(" ", plain_letters(text).text.lower())
    return re.sub(r"[\W\d_]+", lambda m: "\n" if any(c in SENTENCE_ENDS for c in m[0]) else " ", t).strip()


def label_language(label: str | None) -> str | None:
    """The language part of a label, whatever its case and region; None where it is missing."""
    part = re.split(r"[-_]", (label or "").strip().lower())[0]
    return None if part in ("", "und") else part


# ------------------------------------------------------------------ the model


class Automaton:
    """Suffix automaton of one language's text with a dense transition table. State 0 is the root; column 0 stands for
    every symbol that the text lacks and leads nowhere (-1)."""

    def __init__(self, text: str, rare: int = 2):
        counts = Counter(text)
        self.symbols = {c: i + 1 for i, c in enumerate(sorted(c for c, n in counts.items() if n >= rare))}
        moves, link, length, last = [{}], [-1], [0], 0
        for ch in text:
            c = self.symbols.get(ch)
            if c is None:
                last = 0  # no match runs over a rare symbol
                continue
            if c in moves[last]:  # after a rare symbol a piece of text may go on as an earlier one did
                q = moves[last][c]
                if length[q] > length[last] + 1:
                    clone = len(moves)
                    moves.append(dict(moves[q])), link.append(link[q]), length.append(length[last] + 1)
                    p = last
                    while p != -1 and moves[p].get(c) == q:
                        moves[p][c] = clone
                        p = link[p]
                    link[q], q = clone, clone
                last = q
                continue
            cur = len(moves)
            moves.append({}), link.append(0), length.append(length[last] + 1)
            p = last
            while p != -1 and c not in moves[p]:
                moves[p][c] = cur
                p = link[p]
            if p != -1:
                q = moves[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(moves)
                    moves.append(dict(moves[q])), link.append(link[q]), length.append(length[p] + 1)
                    while p != -1 and moves[p].get(c) == q:
                        moves[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        self.width = len(self.symbols) + 1
        table = np.full((len(moves), self.width), -1, np.int32)
        for s, row in enumerate(moves):
            for c, to in row.items():
                table[s, c] = to
        self.table = table.ravel()
        self.size = max(2, len(text))
        letters = [(n, c) for c, n in counts.items() if c.isalpha()]
        core, total = set(), 0
        for n, c in sorted(letters, reverse=True):
            if total > 0.8 * sum(n for n, _ in letters):
                break
            core.add(c)
            total += n
        self.core = core


class Model:
    """One automaton a language, and one numbering of symbols for all."""

    def __init__(self, texts: dict[str, str]):
        self.languages = tuple(sorted(texts))
        self.automata = [Automaton(texts[x]) for x in self.languages]
        chars = sorted(set().union(*(a.symbols for a in self.automata), " \n"))
        self.symbols = {c: i + 1 for i, c in enumerate(chars)}
        self.local = [np.array([0, *(a.symbols.get(c, 0) for c in chars)], np.int32) for a in self.automata]
        self.number = np.zeros(0x10000, np.int32)
        for c, i in self.symbols.items():
            if ord(c) < 0x10000:
                self.number[ord(c)] = i
        self.latin_symbol = np.array([False, *("a" <= c <= "\u024f" for c in chars)])
        self.latin = [sum(c <= "\u024f" for c in a.core) * 2 > len(a.core) for a in self.automata]
        # matches in a longer text are longer: a phrase costs the logarithm of the size of the text it is found in
        self.weight = np.array([np.log(a.size) for a in self.automata]) / np.log(max(a.size for a in self.automata))

    def costs(self, codes: np.ndarray, starts: np.ndarray, lane: int = 2048, quoted: float = 0.4) -> np.ndarray:
        """For each language and symbol of the joined texts, the share of a phrase it takes: a phrase is the longest match
        from where the last ended, and its normalised cost is shared among its symbols.

        All texts are parsed side by side in every language, in lanes of at most ``lane`` symbols, one symbol of every lane at
        a time, so a very long text takes no more steps than others; the end of a lane ends a phrase."""
        lengths = np.diff(np.append(starts, len(codes)))
        pieces = np.maximum(1, -(-lengths // lane))
        first = np.repeat(starts, pieces) + lane * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        size = np.minimum(first + lane, np.repeat(starts + lengths, pieces)) - first
        order = np.argsort(-size, kind="stable")
        first_, size_ = first, size
        out = np.empty((len(self.languages), len(codes)), np.float32)
        for k, a in enumerate(self.automata):
            begin, long_ = first_[order], size_[order]
            mine = self.local[k][codes]
            head = np.ones(len(codes), bool)
            state = np.zeros(len(order), np.int32)
            steps = int(long_[0]) if len(order) else 0
            active = np.searchsorted(-long_, -np.arange(steps), side="left")  # lanes longer than t
            for t in range(steps):
                n = active[t]
                at = begin[:n] + t
                s, c = state[:n], mine[at]
                to = a.table[s * a.width + c]
                lost = to < 0
                head[at] = lost | (s == 0)
                if lost.any():
                    to = np.where(lost, np.maximum(a.table[c], 0), to)
                state[:n] = to
            heads = np.flatnonzero(head)
            run = np.diff(np.append(heads, len(codes)))
            out[k] = np.repeat((self.weight[k] / run).astype(np.float32), run)
            if not self.latin[k]:  # texts of other scripts quote Latin names and terms
                out[k] = np.where(self.latin_symbol[codes], np.minimum(out[k], quoted), out[k])
        return out

    def segments(self, texts: list[str], inside: float = 4.5, at_end: float = 2.0, least: int = 12) -> tuple[list[list[tuple[str, float]]], np.ndarray]:
        """The languages of each text's segments and their confidence; and the cost of each whole text in each language.

        The language that needs the fewest normalised phrases wins. Where the units of a text (words, or up to four
        characters of a script without blanks) would together save more phrases in different languages than a
        change costs, the cheapest sequence of languages is found, a change costing ``at_end`` phrases at the
        end of a sentence and ``inside`` elsewhere; a segment of fewer than ``least`` letters (half of it in
        scripts without blanks) joins its neighbour. Confidence is the winner's lead over the next language as a
        share of the latter's cost. A text without letters, handles and links aside, has no segment."""
        result: list[list[tuple[str, float]]] = [[] for _ in texts]
        totals = np.zeros((len(self.languages), len(texts)))
        plain = [CODE.sub(" ", plain_letters(t).text.lower().replace("\0", " ")) for t in texts]
        worth = [i for i, t in enumerate(plain) if LETTER.search(t)]
        if not worth or not self.languages:
            return result, totals
        points = np.frombuffer("\0".join([plain[i] for i in worth] + [""]).encode("utf-32-le"), np.uint32)
        points = np.where(points < 0x10000, points, 1)
        kind = KINDS[points]
        letter = (kind == 1) | (kind == 2)
        heads = np.flatnonzero(~letter & np.concatenate([[True], letter[:-1]]))  # of what stands between words
        between = np.maximum.reduceat(np.where(letter, 0, kind), heads) if len(heads) else heads
        keep = letter.copy()
        keep[heads] = True
        codes = self.number[points]
        codes[heads] = np.where(between >= 3, self.symbols["\n"], self.symbols[" "])
        mark = kind.copy()
        mark[heads] = between
        codes, kind = codes[keep], mark[keep]
        starts = np.concatenate([[0], np.flatnonzero(kind == 4)[:-1] + 1])
        cost = self.costs(codes, starts)
        total = np.add.reduceat(cost, starts, axis=1).astype(float)
        totals[:, worth] = total
        # units
        letter = (kind == 1) | (kind == 2)
        turn = np.concatenate([[True], kind[1:] != kind[:-1]])
        since = np.arange(len(kind)) - np.maximum.accumulate(np.where(turn, np.arange(len(kind)), 0))
        unit_at = np.flatnonzero(letter & (turn | ((kind == 2) & (since % 4 == 0))))
        units = np.add.reduceat(cost, unit_at, axis=1)  # a unit's stretch ends with the blank or sign behind it
        weigh = np.add.reduceat(np.where(letter, kind, 0).astype(np.int32), unit_at)
        ended = np.concatenate([[False], kind[:-1] >= 3])[unit_at]
        bounds = np.append(np.searchsorted(unit_at, starts), len(unit_at))
        ideal = np.add.reduceat(units.min(axis=0), bounds[:-1])
        order = np.argsort(total, axis=0, kind="stable")
        best = np.take_along_axis(total, order[:1], 0)[0]
        second = np.take_along_axis(total, order[1:2], 0)[0] if len(self.languages) > 1 else best
        sure = 1 - best / np.maximum(second, 1e-9)
        for j, i in enumerate(worth):
            if best[j] - ideal[j] < at_end:
                result[i] = [(self.languages[order[0, j]], float(sure[j]))]
                continue
            lo, hi = bounds[j], bounds[j + 1]
            path = self._path(units[:, lo:hi], ended[lo:hi], inside, at_end)
            spans: list[list] = []
            for u, k in enumerate(path, lo):
                if spans and spans[-1][0] == k:
                    spans[-1][1] += weigh[u]
                    spans[-1][3] = u + 1
                else:
                    spans.append([k, weigh[u], u, u + 1])
            while len(spans) > 1 and (small := min(spans, key=lambda s: s[1]))[1] < least:
                at = spans.index(small)
                near = max([x for x in (at - 1, at + 1) if 0 <= x < len(spans)], key=lambda x: spans[x][1])
                spans[at][0] = spans[near][0]
                merged: list[list] = []
                for s in spans:
                    if merged and merged[-1][0] == s[0]:
                        merged[-1][1] += s[1]
                        merged[-1][3] = s[3]
                    else:
                        merged.append(s)
                spans = merged
            for k, _, a, b in spans:
                own = units[:, a:b].sum(axis=1)
                other = np.delete(own, k).min() if len(own) > 1 else own[k]
                result[i].append((self.languages[k], float(max(0.0, 1 - own[k] / max(other, 1e-9)))))
        return result, totals

    @staticmethod
    def _path(units: np.ndarray, after_end: np.ndarray, inside: float, at_end: float) -> list[int]:
        cost, back = units[:, 0], []
        for j in range(1, units.shape[1]):
            k = int(cost.argmin())
            change = cost[k] + (at_end if after_end[j] else inside)
            back.append(np.where(cost <= change, np.arange(len(cost)), k))
            cost = np.minimum(cost, change) + units[:, j]
        path = [int(cost.argmin())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]


# ---------------------------------------------------------------- training


def clean_labelled(rows: list[tuple[str, str]], most: dict[str, int], rounds: int = 3, new: float = 0.2,
                   window: int = 20, lead: float = 0.8) -> dict[str, str]:
    """Training text a language from (language, text) rows of which some labels are wrong and some texts mixed.

    Sentences whose character trigrams speak for another language than their label are left out; a wrong label is
    outvoted by the right ones of its language, as long as these are the larger part. A sentence joins the text
    only if a share of at least ``new`` of its 5-grams is not there yet, so that rare phrases find room."""
    pieces = [(x, s) for x, t in rows for s in letters_only(t).split("\n") if s and len(s) >= (8 if max(s) >= "぀" else 16)]
    if not pieces:
        return {}
    tally = Counter(pieces)
    pieces = sorted(tally)
    times = np.array([tally[p] for p in pieces], float)
    langs = sorted({x for x, _ in pieces})
    label = np.array([langs.index(x) for x, _ in pieces])
    joined = "".join(f" {s} " for _, s in pieces)
    code = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
    gram = ((code[:-2] * 1_000_003 + code[1:-1]) * 1_000_003 + code[2:]) % 262_139
    starts = np.concatenate([[0], np.cumsum([len(s) + 2 for _, s in pieces])[:-1]])
    sizes = np.array([len(s) for _, s in pieces])
    gram = np.append(gram, [0, 0]).astype(np.int64)
    keep = label.copy()
    odds = np.empty((len(langs), 262_139), np.float32)
    for _ in range(rounds):
        for k in range(len(langs)):
            n = np.bincount(gram, np.repeat(np.where(keep == k, times, 0), sizes + 2), minlength=262_139)
            odds[k] = np.log((n + 0.05) / (n.sum() + 0.05 * 262_139))
        keep = np.stack([np.add.reduceat(odds[k][gram], starts) for k in range(len(langs))]).argmax(axis=0)
    # within a sentence, stretches that speak for another language are cut out
    whose = np.repeat(keep, sizes + 2)
    own, other = odds[whose, gram], np.full(len(gram), -np.inf, np.float32)
    for k in range(len(langs)):
        other = np.where(whose == k, other, np.maximum(other, odds[k][gram]))
    run = np.concatenate([[0], np.cumsum(own - other, dtype=float)])
    foreign = np.zeros(len(gram) + 1, np.int32)
    at = np.flatnonzero(run[window:] - run[:-window] < -lead * window)
    np.add.at(foreign, at, 1)
    np.add.at(foreign, at + window, -1)
    foreign = np.cumsum(foreign)[:-1] > 0
    out: dict[str, list[str]] = {x: [] for x in langs}
    room, known = {x: most[x] for x in langs}, {x: set() for x in langs}
    for i in sorted(range(len(pieces)), key=lambda i: hash_order(pieces[i][1])):
        x, s = pieces[i]
        if langs[keep[i]] != x or room[x] <= 0:
            continue
        bad = foreign[starts[i]:starts[i] + len(s)]
        s = "".join("\n" if b else c for c, b in zip(s, bad, strict=True))
        s = "\n".join(p.strip() for p in re.split("\n+", s) if len(p) > 5)
        if not s:
            continue
        grams = {s[j:j + 5] for j in range(max(1, len(s) - 4))}
        if len(grams - known[x]) >= new * len(grams):
            known[x] |= grams
            out[x].append(s)
            room[x] -= len(s) + 1
    return {x: "\n".join(v) + "\n" for x, v in out.items() if v}


def hash_order(s: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(s)


def fit_languages(texts: DataFrame, rows_each: int = 2500, letters: int = 40_000, letters_cjk: int = 16_000, most_letters: int = 4000) -> Model:
    """The model of the languages in (src, row_no, text, lang). It is fitted on a bounded sample: about ``rows_each``
    labelled rows a language of at most ``most_letters`` characters, chosen by a hash of their key, of which at most ``letters`` characters (``letters_cjk``
    in Chinese and Japanese, whose tables are wide) go into a language's automaton."""
    lang = F.element_at(F.split(F.lower(F.trim("lang")), "[-_]"), 1)
    labelled = texts.select("src", "row_no", "text", lang.alias("lang")).where(F.col("lang").isin(*LANGUAGES))
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = F.pmod(F.xxhash64("src", "row_no"), F.lit(1_000_000))
    picked = F.lit(False)
    for x, n in counts.items():
        picked = picked | ((F.col("lang") == x) & (draw < int(1_000_000 * min(1.0, rows_each / n))))
    # the draw is even, so the bound holds up to chance; the limit makes it hard
    rows = labelled.where(picked & (F.char_length("text") <= most_letters)).select("lang", "text").limit(2 * rows_each * len(LANGUAGES)).collect()
    most = {x: letters_cjk if x in ("ja", "zh") else letters for x in LANGUAGES}
    return Model(clean_labelled([(r.lang, r.text) for r in rows if r.text], most))


SEGMENTS = "src string, row_no long, seg_no long, seg_lang string, confidence double, label string"


def label_segments(texts: DataFrame, model: Model, only_wrong: bool = False, benefit: float = 1.0) -> DataFrame:
    """(src, row_no, seg_no, seg_lang, confidence, label) for every text with at least 12 letters, from (src, row_no,
    text, lang); with ``only_wrong`` only where the label is missing (null, empty, und) or wrong or the text has
    segments in several languages. A label is taken as right if a text of one language needs less than ``benefit`` phrases
    more in it than in the best language. Whole texts are parsed, in one pass without a shuffle; null and shorter texts
    give no rows. The model's size is bounded by its parameters, so each executor gets a copy."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        m = shared.value
        place = {x: k for k, x in enumerate(m.languages)}
        for batch in batches:
            srcs, numbers, bodies, labels = (batch.column(c).to_pylist() for c in ("src", "row_no", "text", "lang"))
            found, totals = m.segments(bodies)
            rows = []
            for i, parts in enumerate(found):
                label = label_language(labels[i])
                if len(parts) == 1 and parts[0][0] != label and (k := place.get(label)) is not None and totals[k, i] - totals[:, i].min() < benefit:
                    parts = [(label, 0.0)]
                if only_wrong and len(parts) == 1 and parts[0][0] == label:
                    continue
                rows += [(srcs[i], numbers[i], n, x, sure, labels[i]) for n, (x, sure) in enumerate(parts, 1)]
            types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.string()]
            cols = zip(*rows, strict=True) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                                             names=["src", "row_no", "seg_no", "seg_lang", "confidence", "label"])

    enough = texts.where(F.regexp_count("text", F.lit(r"\p{L}")) >= 12)
    return enough.select("src", "row_no", "text", "lang").mapInArrow(run, SEGMENTS)
