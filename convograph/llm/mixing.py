"""Mixing sources to target weights by Poisson replication."""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import Cuts
from .tokens import RANKS, count_tokens


def poisson_below(rate: float, most: int) -> np.ndarray:
    """P(X <= k) for k from 0 to ``most - 1`` of a Poisson distribution with mean ``rate``, from logarithms, so that no mean is too large."""
    if rate <= 0:
        return np.ones(most)
    k = np.arange(most)
    log_p = k * np.log(rate) - rate - np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, most)))])
    return np.minimum(1.0, np.cumsum(np.exp(log_p)))


def solve_rate(above: np.ndarray, goal: float, most: int) -> float:
    """The mean at which documents come nearest to ``goal`` tokens, where ``above[i]`` tokens have a draw in bucket i or higher.

    Copy k + 1 of a document exists if its draw is above P(X <= k), so the tokens used are a sum over k; they grow with the mean."""
    buckets = len(above) - 1

    def used(rate: float) -> float:
        at = np.ceil(poisson_below(rate, most) * buckets).astype(int)
        return float(above[np.minimum(at, buckets)].sum())

    low, high = 0.0, most + 12.0 * most**0.5 + 60.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if used(mid) < goal else (low, mid)
    return min((low, high), key=lambda r: abs(used(r) - goal))


def mix(documents: DataFrame, targets: DataFrame, seed: int = 17, buckets: int = 1 << 16, path: str = RANKS) -> DataFrame:
    """(doc_id, copy_no, source, n_tokens, place): documents repeated so that each source comes to its target share of a total as
    large as all documents with a source, in a global shuffle: ``place`` is a hash, the rows are sorted by it.

    A document's number of copies is the inverse of a Poisson distribution at a uniform draw from its hash, cut off at the
    source's max_repeats. One pass counts the tokens of each source by draw in ``buckets`` steps; from these counts the driver solves the
    mean repetition, so a source's size is exact to one step. The thresholds of the chosen distribution are a table with one row for each
    possible copy, and a document joins the rows below its draw: the plan has the same size whatever max_repeats is.

    A source that cannot come to its share even if each document is used max_repeats times stays below it. Documents without source, of a
    source without target, or without tokens are not used. ``targets`` is a fixed list with one row for each source (of more the largest
    share and repeats count), so it is broadcast, and the driver holds ``buckets`` counts for each of its rows."""
    cuts = Cuts(documents.sparkSession, "mixing")
    sized = count_tokens(documents.where("doc_id is not null and source is not null and text is not null"), "text", "n_tokens", "doc_id", "source", path=path)
    u = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    sized = cuts.cut(sized.where("n_tokens > 0").withColumn("u", u))
    wanted = targets.where("target_share > 0 and max_repeats > 0").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").cast("int").alias("most"))
    total = sized.agg(F.sum("n_tokens")).first()[0] or 0
    counted = sized.join(F.broadcast(wanted), "source").groupBy("source", "share", "most", F.floor(F.col("u") * buckets).cast("int").alias("b")).agg(F.sum("n_tokens").alias("n")).collect()
    at: dict[tuple, np.ndarray] = {}
    for r in counted:
        at.setdefault((r.source, r.share, r.most), np.zeros(buckets + 1))[r.b] += r.n
    copies = []
    for (source, share, most), n in sorted(at.items()):
        below = poisson_below(solve_rate(np.cumsum(n[::-1])[::-1], share * total, most), most)
        # the same steps as the counts, so that the size is the one that was solved
        copies += [(source, k + 1, float(x)) for k, x in enumerate(np.ceil(below * buckets) / buckets) if x < 1.0]
    table = documents.sparkSession.createDataFrame(copies, "source string, copy_no long, above double")
    out = sized.join(F.broadcast(table), "source").where("u >= above").select("doc_id", "copy_no", "source", "n_tokens")
    return out.withColumn("place", F.xxhash64("doc_id", "copy_no", F.lit(seed + 1))).orderBy("place", "doc_id", "copy_no")


def share_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source of ``targets``: its target, the tokens and documents used, its actual share of the mixture, and how often a
    document is used at most and on average."""
    per = mixed.groupBy("source").agg(
        F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("copies"), F.count_distinct("doc_id").alias("documents"), F.max("copy_no").alias("most_repeats"))
    all_ = mixed.agg(F.sum("n_tokens").alias("total"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return targets.select("source", "target_share", "max_repeats").join(per, "source", "left").crossJoin(F.broadcast(all_)).select(
        "source", "target_share", "max_repeats", zero("n_tokens"), zero("copies"), zero("documents"), zero("most_repeats"),
        F.round(F.coalesce(F.col("n_tokens") / F.col("total"), F.lit(0.0)), 6).alias("actual_share"),
        F.round(F.coalesce(F.col("copies") / F.col("documents"), F.lit(0.0)), 6).alias("mean_repeats"))


def mixture_faults(mixed: DataFrame, documents: DataFrame, targets: DataFrame, path: str = RANKS) -> DataFrame:
    """(fault, n): copies beyond max_repeats, copy numbers that do not count from 1 without a gap, copies of unknown documents, and
    token counts that differ from the document's; all 0 if the mixture is right."""
    per = mixed.groupBy("doc_id", "source").agg(F.count(F.lit(1)).alias("n"), F.max("copy_no").alias("top"), F.min("n_tokens").alias("low"), F.max("n_tokens").alias("high"))
    own = count_tokens(documents.where("doc_id is not null"), "text", "size", "doc_id", "source", path=path).groupBy("doc_id", "source").agg(F.max("size").alias("size"), F.min("size").alias("least"))
    j = per.join(own, ["doc_id", "source"], "left").join(F.broadcast(targets.groupBy("source").agg(F.max("max_repeats").alias("most"))), "source", "left")
    fault = lambda name, c: F.struct(F.lit(name).alias("fault"), F.count_if(c).alias("n"))
    return j.agg(F.array(
        fault("beyond_max_repeats", F.col("top") > F.col("most")), fault("gap_in_copies", F.col("top") > F.col("n")),
        fault("unknown_document", F.col("size").isNull()), fault("other_size", (F.col("low") < F.col("least")) | (F.col("high") > F.col("size")))).alias("f")).select(F.inline("f"))
