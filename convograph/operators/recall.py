"""Candidate memories for a question: terms, entries, collapse, quota."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CJK_RUN, STOPWORDS


def term_pool(messages: DataFrame) -> DataFrame:
    """Terms of each message (chat_id, id, text): words of letters and digits outside scripts without blanks, and of those
    scripts the n-grams of 2 to 5 characters of every run, in lower case; (chat_id, id, kind, position, term). One-character terms and
    stop words are none."""
    low = F.lower("text")
    words = F.filter(F.split(low, rf"({CJK_RUN}|[^\p{{IsAlphabetic}}\p{{N}}])+"), lambda w: (F.char_length(w) >= 2) & ~w.isin(STOPWORDS))
    runs = F.filter(F.split(low, rf"[^\x{{3040}}-\x{{30FF}}\x{{3400}}-\x{{4DBF}}\x{{4E00}}-\x{{9FFF}}]+"), lambda r: F.char_length(r) >= 2)

    def pieces(r):
        starts = F.sequence(F.lit(1), F.char_length(r) - 1)
        sizes = lambda s: F.sequence(F.lit(2), F.least(F.lit(5), F.char_length(r) - s + 1))
        return F.flatten(F.transform(starts, lambda s: F.transform(sizes(s), lambda n: r.substr(s, n))))

    alnum = messages.select("chat_id", "id", F.lit("word").alias("kind"), F.posexplode(words).alias("position", "term"))
    grams = messages.select("chat_id", "id", F.lit("gram").alias("kind"), F.posexplode(F.flatten(F.transform(runs, pieces))).alias("position", "term"))
    return alnum.unionByName(grams)


def budget_terms(pool: DataFrame, words: int = 20, grams: int = 40) -> DataFrame:
    """The first ``words`` different words and ``grams`` different n-grams of each message, longer n-grams first."""
    once = pool.groupBy("chat_id", "id", "kind", "term").agg(F.min("position").alias("position"))
    length = F.when(F.col("kind") == "gram", -F.char_length("term")).otherwise(F.lit(0))
    w = Window.partitionBy("chat_id", "id", "kind").orderBy(length, "position")
    ranked = once.withColumn("rank", F.row_number().over(w).cast("long"))
    return ranked.where(F.col("rank") <= F.when(F.col("kind") == "gram", grams).otherwise(words)).select("chat_id", "id", "kind", "term", "rank")


def collapse_facts(candidates: DataFrame) -> DataFrame:
    """Candidates (request, seq, origin, source_id, relationship_name, target_id, valid_at) of one fact become one: position and
    origin of the first, start of the latest (of equal starts the first)."""
    return candidates.groupBy("request", "source_id", "relationship_name", "target_id").agg(
        F.min("seq").alias("seq"), F.min_by("origin", "seq").alias("origin"), F.max("valid_at").alias("valid_at"))


def source_quota(candidates: DataFrame, total: int = 40, wake: int = 24) -> DataFrame:
    """The presented candidates of each request: up to ``wake`` of origin wake and ``total - wake`` of origin term, then what is left
    of wake, then of term, ``total`` in all; place counts from 1."""
    w = Window.partitionBy("request", "origin").orderBy("seq")
    place = Window.partitionBy("request").orderBy("block", "rank")
    share = F.when(F.col("origin") == "wake", min(wake, total)).otherwise(max(0, total - wake))
    # no more than total of an origin can be presented, so the rank limit cuts before anything is ordered
    r = candidates.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= total)
    block = F.when(F.col("origin") == "wake", 0).otherwise(1) + F.when(F.col("rank") > share, 2).otherwise(0)
    return r.withColumn("block", block).withColumn("place", F.row_number().over(place).cast("long")).where(F.col("place") <= total).drop("block", "rank")


KEY = ["source_id", "relationship_name", "target_id", "valid_at"]


def union_in_order(*sources: DataFrame) -> DataFrame:
    """Candidates (request, seq, KEY, ...) of several sources as one list without repeats: a candidate stands where its first source put it; ``seq``
    is then (source, place)."""
    every = None
    for n, s in enumerate(sources):
        part = s.select("request", F.struct(F.lit(n).alias("source"), F.col("seq").alias("place")).alias("seq"), *KEY)
        every = part if every is None else every.unionByName(part)
    return every.groupBy("request", *KEY).agg(F.min("seq").alias("seq"))


def selected(presented: DataFrame, selections: DataFrame, most: int = 5) -> DataFrame:
    """What is injected of the presented candidates (request, place, ...): ``selections`` (request, picks) holds 1-based numbers as a model gives
    them. Zero and negative ones and those beyond the list are passed over, repeated ones count once, and the first ``most`` are taken."""
    p = selections.select("request", F.posexplode("picks").alias("at", "place")).where("place >= 1").groupBy("request", "place").agg(F.min("at").alias("at"))
    j = p.join(presented, ["request", "place"])
    w = Window.partitionBy("request").orderBy("at")
    return j.withColumn("slot", F.row_number().over(w).cast("long")).where(F.col("slot") <= most).drop("at")


def prompt(presented: DataFrame, text: str, since: str) -> DataFrame:
    """(request, prompt): the presented candidates, forty at most, as a numbered list with the day each is valid since."""
    line = F.concat(F.col("place").cast("string"), F.lit(". "), F.col(text), F.lit(" (since "), F.date_format(since, "yyyy-MM-dd"), F.lit(")"))
    rows = presented.groupBy("request").agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("x"))
    return rows.select("request", F.array_join(F.col("x.line"), "\n").alias("prompt"))
