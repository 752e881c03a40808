"""Subject areas of documents by latent Dirichlet topics."""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import Cuts
from .pii import plain_letters

# Top terms of fitted topics, read and named by hand. They name a topic once it is fitted; they take no part in fitting it, and a subject
# that is not listed is named by its labelled documents.
INSPECTED = {
    "science": "hypothesis electron microscope genome enzyme isotope hypothese mikroskop elektron genom enzym hipótesis microscopio electrón genoma isótopo",
    "law": "verdict plaintiff lawsuit statute injunction notary urteil klage richterin berufung paragraf tribunal contrato notaría testigo apelación",
    "sport": "goalkeeper striker referee tournament halftime offside torwart schiedsrichter turnier elfmeter abseits portero árbitro torneo delantero penalti",
    "software": "compiler database refactoring rollback unit-test webhook datenbank quellcode schnittstelle absturz zwischenspeicher compilador repositorio depurador servidor despliegue",
    "cooking": "oven skillet marinade dough broth cumin ofen pfanne teig braten knoblauch horno sartén receta caldo ajo",
    "travel": "passport luggage itinerary airport hostel visa gepäck flughafen rucksack visum herberge pasaporte mochila albergue equipaje aeropuerto",
    "music": "melody chord drummer bassline ukulele soprano melodie akkord schlagzeug geige tonleiter melodía acorde violín bajista compás",
    "health": "diagnosis prescription vaccine clinic migraine fever diagnose impfung fieber klinik verband diagnóstico vacuna enfermera clínica alergia",
    "finance": "mortgage dividend invoice pension savings loan hypothek dividende zinsen kredit rechnung hipoteca préstamo intereses factura ahorro",
    "gardening": "compost pruning seedling mulch hedge greenhouse kompost blattlaus setzling gewächshaus hecke invernadero poda riego seto plántula",
}

WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
# a stamp, a speaker, a bullet or a quotation mark before what is said
LEAD = re.compile(r"^\s*(?:[-*>•]+\s+)?(?:[\[(][^\])\n]{1,40}[\])]\s*)?(?:[^\W\d_][\w .'-]{0,30}:\s+(?=\S))?(?:[-*>•]+\s+)?")
SENTENCE = re.compile(r"[^.!?。！？]+[.!?。！？]*")
TOKEN = re.compile(r"\S+")


def sentences(text: str) -> list[list[str]]:
    """The words of each sentence. Lines that are records (a quarter of their tokens with digits or more) and pieces
    of fewer than two words are no sentences; stamps, speakers and bullets before a line are left out. A tag of at most five words
    that begins without a capital belongs to the sentence before it on its line."""
    out = []
    for line in plain_letters(text).text.split("\n"):
        line = LEAD.sub("", line, count=1)
        tokens = TOKEN.findall(line)
        if not tokens or sum(any(c.isdigit() for c in t) for t in tokens) * 4 >= len(tokens):
            continue
        first = True
        for piece in SENTENCE.findall(line):
            words = WORD.findall(piece)
            if len(words) < 2:
                continue
            tag = len(words) <= 5 and (words[0][0].islower() or words[0] == "I")
            words = [w.lower() for w in words]
            if tag and not first:
                out[-1] += words
            else:
                out.append(words)
            first = False
    return out


DOCS = "doc_id long, labels array<string>, words array<string>, sentence array<int>, n_sentences int"
TERM = {w: s for s, ws in INSPECTED.items() for w in ws.split()}
SLICE = 500  # documents worked on at once


def read_sentences(documents: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(doc_id, labels, words, sentence, n_sentences) of documents with a text."""
    docs = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    if labels is None:
        docs = docs.withColumn("labels", F.array().cast("array<string>"))
    else:
        known = labels.where("doc_id is not null and subject is not null").groupBy("doc_id").agg(F.collect_set("subject").alias("labels"))
        docs = docs.join(known, "doc_id", "left")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                words, owner, n = [], [], []
                for text in batch.column("text").to_pylist():
                    found = sentences(text)
                    words.append([w for s in found for w in s])
                    owner.append([i for i, s in enumerate(found) for _ in s])
                    n.append(len(found))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("labels").cast(pa.list_(pa.string())), pa.array(words, pa.list_(pa.string())),
                     pa.array(owner, pa.list_(pa.int32())), pa.array(n, pa.int32())],
                    names=["doc_id", "labels", "words", "sentence", "n_sentences"])

    return docs.select("doc_id", "text", "labels").mapInArrow(run, DOCS)


def digamma(x: np.ndarray) -> np.ndarray:
    out = np.zeros_like(x)
    x = x.copy()
    for _ in range(6):
        out -= 1 / x
        x += 1
    f = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f / 252))


class Topics:
    """Topic-word weights over a vocabulary, and how they read documents. The first topics stand for the subjects, the rest for what is
    said about anything; these have the larger prior, so that a document without a subject is theirs."""

    def __init__(self, vocabulary: list[str], counts: np.ndarray, subjects: list[str], background: int, seed: int):
        self.vocabulary, self.counts, self.subjects = vocabulary, counts, subjects
        self.size, self.rng = len(subjects) + background, np.random.default_rng(seed)
        self.alpha = np.array([0.05] * len(subjects) + [0.5] * background)
        self.weights = np.ones((self.size, len(vocabulary)))

    def anchor(self, held: np.ndarray, documents: np.ndarray, least: float) -> None:
        """Starts the topics from documents known or found to be about a subject: ``held`` counts, for each subject and word, those with the
        word, ``documents`` all. A topic begins with the words most of whose documents are its own, by more than ``least``; a subject
        without documents begins at random, as the background does with all other words."""
        rate = held / np.maximum(documents, 1)[:, None]
        mean = documents.mean()
        own = np.maximum(0.0, rate * mean / (rate.sum(axis=0) * mean + 1.0) - least)
        free = np.concatenate([documents == 0, np.ones(self.size - len(self.subjects), bool)])
        self.weights = np.zeros((self.size, len(self.vocabulary)))
        self.weights[:len(self.subjects)] = own * self.counts + 0.001 * self.counts / self.size
        rest = np.maximum(0.001, 1 - 2 * own.max(axis=0, initial=0.0)) * self.counts / max(1, free.sum())
        self.weights[free] = self.rng.gamma(100.0, 0.01, (free.sum(), len(self.vocabulary))) * rest
        self.update(self.weights)

    def update(self, found: np.ndarray) -> None:
        self.weights = found + 0.02
        self.spread = np.exp(digamma(self.weights) - digamma(self.weights.sum(axis=1, keepdims=True))).T.copy()

    def read(self, starts: np.ndarray, word: np.ndarray, times: np.ndarray, alpha: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        """Topic weights of units (documents or sentences) that start at ``starts``, and of each of their words."""
        owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(word))))
        spread, gamma = self.spread[word], alpha + 1.0
        for _ in range(rounds):
            at = np.exp(digamma(gamma) - digamma(gamma.sum(axis=1, keepdims=True)))
            p = at[owner] * spread
            p *= (times / np.maximum(p.sum(axis=1), 1e-100))[:, None]
            gamma = alpha + np.add.reduceat(p, starts, axis=0)
        return gamma, p

    def subject_of(self, top: int = 60, least: int = 3) -> list[str | None]:
        """The subject of each topic: that of most inspected terms among its top terms, if these are at least ``least`` and more than of any
        other; otherwise the one whose documents it started from. A term counts where the topic holds a quarter of its occurrences."""
        out: list[str | None] = [*self.subjects, *[None] * (self.size - len(self.subjects))]
        held = self.weights / np.maximum(self.weights.sum(axis=0), 1e-9)
        for k in range(self.size):
            votes: dict[str, int] = {}
            for i in np.argsort(-self.weights[k], kind="stable")[:top]:
                if held[k, i] >= 0.25 and (s := TERM.get(self.vocabulary[i])) in self.subjects:
                    votes[s] = votes.get(s, 0) + 1
            ranked = sorted(votes, key=lambda s: (-votes[s], s))
            if ranked and votes[ranked[0]] >= least and (len(ranked) == 1 or votes[ranked[1]] < votes[ranked[0]]):
                out[k] = ranked[0]
        return out


BAGS = "doc_id long, labels array<int>, word array<int>, times array<int>, said array<int>, sentence array<int>, n_sentences int"


def _starts(column) -> np.ndarray:
    return column.offsets.to_numpy()[:-1] - column.offsets[0].as_py()


def encode(docs: DataFrame, vocabulary: list[str], subjects: list[str]) -> DataFrame:
    """The documents with a known word as numbers: their different words and how often each stands there, and all words in order with their
    sentence. No later step looks up a word."""
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, subjects))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        words, places = (pa.array(x, pa.string()) for x in shared.value)
        ints = pa.list_(pa.int32())

        def lists(owner: np.ndarray, n: int, *columns: np.ndarray) -> list:
            cut = pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32))
            return [pa.ListArray.from_arrays(cut, pa.array(c.astype(np.int32))).cast(ints) for c in columns]

        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                n, column = batch.num_rows, batch.column("words")
                doc = np.repeat(np.arange(n), np.diff(column.offsets.to_numpy()))
                number = pc.fill_null(pc.index_in(column.flatten(), value_set=words), -1).to_numpy(zero_copy_only=False)
                known = number >= 0
                doc, said, sentence = doc[known], number[known], batch.column("sentence").flatten().to_numpy()[known]
                both, times = np.unique(doc * np.int64(len(words) or 1) + said, return_counts=True)
                own = both // (len(words) or 1)
                word, count = lists(own, n, both % (len(words) or 1), times)
                lab = batch.column("labels").fill_null([])
                who = np.repeat(np.arange(n), np.diff(lab.offsets.to_numpy()))
                told = pc.fill_null(pc.index_in(lab.flatten(), value_set=places), -1).to_numpy(zero_copy_only=False)
                cols = [batch.column("doc_id"), *lists(who[told >= 0], n, told[told >= 0]), word, count, *lists(doc, n, said, sentence), batch.column("n_sentences")]
                out = pa.RecordBatch.from_arrays(cols, names=["doc_id", "labels", "word", "times", "said", "sentence", "n_sentences"])
                yield out.filter(pa.array(np.bincount(doc, minlength=n) > 0))

    return docs.mapInArrow(run, BAGS)


def _summed(bags: DataFrame, model: Topics, step) -> np.ndarray:
    """The sum over all documents of ``step(model, starts, word, times, labels)``, a matrix of topics by words and one column more; each task
    adds up its own, a shuffle the tasks'. The driver and a task hold matrices of the model's size only."""
    shared = bags.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        m = shared.value
        total = np.zeros((m.size, len(m.vocabulary) + 1))
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                word, times = (batch.column(c).flatten().to_numpy() for c in ("word", "times"))
                known = np.zeros((batch.num_rows, len(m.subjects)))
                lab = batch.column("labels")
                known[np.repeat(np.arange(batch.num_rows), np.diff(lab.offsets.to_numpy())), lab.flatten().to_numpy()] = 1.0
                total += step(m, _starts(batch.column("word")), word, times, known)
        k, w = np.nonzero(np.abs(total) > 1e-3)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(w, pa.int32()), pa.array(total[k, w])], names=["k", "w", "v"])

    sums = bags.select("labels", "word", "times").mapInArrow(run, "k int, w int, v double").groupBy("k", "w").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros((model.size, len(model.vocabulary) + 1))
    out[sums.column("k").to_numpy(), sums.column("w").to_numpy()] = sums.column("v").to_numpy()
    shared.destroy()
    return out


def _by_word(p: np.ndarray, word: np.ndarray, width: int) -> np.ndarray:
    order = np.argsort(word, kind="stable")
    heads = np.flatnonzero(np.diff(word[order], prepend=-1))
    out = np.zeros((p.shape[1], width))
    out[:, word[order][heads]] = np.add.reduceat(p[order], heads, axis=0).T
    return out


def _expected(m: Topics, starts, word, times, known) -> np.ndarray:
    alpha = np.tile(m.alpha, (len(starts), 1))
    alpha[:, :len(m.subjects)] += 3.0 * known
    return _by_word(m.read(starts, word, times, alpha, 4)[1], word, len(m.vocabulary) + 1)


def _holders(about: np.ndarray, m: Topics, starts, word) -> np.ndarray:
    owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(word))))
    out = np.zeros((m.size, len(m.vocabulary) + 1))
    out[:len(m.subjects)] = _by_word(about[owner], word, len(m.vocabulary) + 1)
    out[:len(m.subjects), -1] = about.sum(axis=0)
    return out


def _labelled(m: Topics, starts, word, times, known) -> np.ndarray:
    return _holders(known, m, starts, word)


def _found(m: Topics, starts, word, times, known) -> np.ndarray:
    """Documents are taken to be about the subjects that have a fifth of what its subject topics have, if that is three words or more."""
    gamma, _ = m.read(starts, word, times, np.tile(m.alpha, (len(starts), 1)), 4)
    of = m.subject_of()
    amount = np.zeros((len(starts), len(m.subjects)))
    for k, s in enumerate(of):
        if s is not None:
            amount[:, m.subjects.index(s)] += gamma[:, k] - m.alpha[k]
    total = amount.sum(axis=1, keepdims=True)
    return _holders(((amount >= 0.2 * total) & (total >= 3.0)).astype(float), m, starts, word)


def vocabulary_of(docs: DataFrame, common: float = 0.5, rare: int = 3, share: float = 1 / 20_000) -> tuple[list[str], np.ndarray]:
    """The words that tell topics apart, with the documents of each: in no more than the share ``common`` of all documents, and in at least
    ``rare`` and the share ``share`` of them. A share, not a number of words, bounds the vocabulary: a document has few
    different words, so at most the mean of these by 1 / ``share`` words are kept however many documents there are."""
    n = docs.count()
    words = docs.select(F.explode(F.array_distinct("words")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    got = words.where((F.col("n") >= max(rare, share * n)) & (F.col("n") <= max(rare, common * n))).toArrow().sort_by("w")
    return got.column("w").to_pylist(), got.column("n").to_numpy().astype(float)


def fit_topics(bags: DataFrame, vocabulary: list[str], counts: np.ndarray, subjects: list[str], background: int = 2, passes: tuple[int, ...] = (2, 3), seed: int = 7) -> Topics:
    """Latent Dirichlet topics by variational Bayes, distributed, one for each subject and ``background`` more.

    The topics start from the documents labelled by hand, whose labels are also a prior for them throughout; after the first passes they
    start again from all documents that were found to be about a subject, of which there are many more, and are fitted to the end."""
    model = Topics(vocabulary, counts, subjects, background, seed)
    if not vocabulary or not subjects:
        return model
    for stage, n in enumerate(passes):
        held = _summed(bags, model, _found if stage else _labelled)[:len(subjects)]
        model.anchor(held[:, :-1], held[:, -1], 0.4 if stage else 0.3)
        for _ in range(n):
            model.update(_summed(bags, model, _expected)[:, :-1])
    return model


def document_subjects(bags: DataFrame, model: Topics, share: float = 0.2, enough: float = 0.6) -> DataFrame:
    """(doc_id, subject, share of sentences): the subjects that at least ``share`` of a document's sentences are about.

    A document's topic proportions are the prior of its sentences'; a sentence is about the subject to whose topics most
    of its words belong, if these add up to ``enough`` of a word. Words of background topics speak for none. The share of the
    sentences is the document's proportion of the subject, counted in sentences instead of words, as the subjects are defined."""
    shared = bags.sparkSession.sparkContext.broadcast(model)
    of = model.subject_of()
    subjects = sorted({s for s in of if s})
    gather = np.array([[s == t for t in of] for s in subjects], float).T if subjects else np.zeros((len(of), 0))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        m = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows if subjects else 0, SLICE):
                batch = whole.slice(at, SLICE)
                n = batch.num_rows
                word, times, said, sentence = (batch.column(c).flatten().to_numpy() for c in ("word", "times", "said", "sentence"))
                theta, _ = m.read(_starts(batch.column("word")), word, times, np.tile(m.alpha, (n, 1)), 8)
                theta /= theta.sum(axis=1, keepdims=True)
                doc = np.repeat(np.arange(n), np.diff(batch.column("said").offsets.to_numpy()))
                first = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(sentence, prepend=-1) != 0))
                _, p = m.read(first, said, np.ones(len(said)), 0.02 + 1.5 * theta[doc[first]], 8)
                told = np.add.reduceat(p, first, axis=0) @ gather
                about = told.argmax(axis=1)
                sure = told[np.arange(len(first)), about] >= enough
                tally = np.zeros((n, len(subjects)))
                np.add.at(tally, (doc[first][sure], about[sure]), 1)
                part = tally / np.maximum(batch.column("n_sentences").to_numpy(), 1)[:, None]
                i, k = np.nonzero((part >= share) & (part > 0))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(i)), pa.array([subjects[x] for x in k], pa.string()), pa.array(part[i, k])], names=["doc_id", "subject", "share"])

    return bags.select("doc_id", "word", "times", "said", "sentence", "n_sentences").mapInArrow(run, "doc_id long, subject string, share double")


def assign_subjects(documents: DataFrame, areas: DataFrame, labels: DataFrame | None = None, share: float = 0.2) -> DataFrame:
    """(doc_id, subject, share): the subjects of each document, possibly several or none. The subjects are those of
    ``areas``, a fixed list, whichever they are, as long as some documents carry their label or their topic shows inspected terms. A document
    exported twice under one id gives its rows once; null and empty texts have no subject."""
    subjects = sorted(r.subject for r in areas.where("subject is not null").select("subject").distinct().collect())
    cuts = Cuts(documents.sparkSession, "subjects")
    docs = cuts.cut(read_sentences(documents, labels))
    vocabulary, counts = vocabulary_of(docs)
    bags = cuts.cut(encode(docs, vocabulary, subjects))
    cuts.keep(bags)
    found = document_subjects(bags, fit_topics(bags, vocabulary, counts, subjects), share)
    return cuts.finish(found.groupBy("doc_id", "subject").agg(F.max("share").alias("share")))
