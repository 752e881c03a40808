"""Keyed tables that are only written by rule: first or last write wins, queues with attempts, ledgers, pairs with a status, counters.

Every write is a pure function from the stored table and the new rows to the next table: group, join and coalesce, so that a repeated or lost
task gives the same rows. Null keys equal each other; extra columns are carried along where the stored table has them."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ATTEMPTS = 3  # an item fails for good at its third failed attempt


def first_write(rows: DataFrame, key: Sequence[str], order: Column) -> DataFrame:
    """The first row of each key in ``order``."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("__r")).select(*key, "__r.*")


def last_write(rows: DataFrame, key: Sequence[str], order: Column) -> DataFrame:
    """The last row of each key in ``order``."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("__r")).select(*key, "__r.*")


def _match(key: Sequence[str]) -> Column:
    out = F.lit(True)
    for k in key:
        out = out & F.col(f"s.{k}").eqNullSafe(F.col(f"n.{k}"))
    return out


def insert_first(stored: DataFrame, new: DataFrame, key: Sequence[str], order: Column) -> DataFrame:
    """The stored rows and those of ``new`` whose key is not stored yet, the first of each key: a stored row is never changed."""
    fresh = first_write(new, key, order).alias("n").join(stored.select(*key).alias("s"), _match(key), "left_anti")
    return stored.unionByName(fresh.select(*stored.columns))


def outcomes(stored: DataFrame, new: DataFrame, key: Sequence[str], order: Column) -> DataFrame:
    """(inserted, duplicate) rows of ``new`` as ``insert_first`` takes them."""
    known = stored.select(*key).distinct().withColumn("__known", F.lit(True))
    n = new.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    j = n.alias("n").join(known.alias("s"), _match(key), "left")
    got = F.when(F.col("__known").isNull(), 1).otherwise(0)
    return j.agg(F.coalesce(F.sum(got), F.lit(0)).cast("long").alias("inserted"), F.coalesce(F.sum(F.col("n") - got), F.lit(0)).cast("long").alias("duplicate"))


def upsert(stored: DataFrame, new: DataFrame, key: Sequence[str], order: Column) -> DataFrame:
    """The stored rows with those of ``new`` in place of their key's, the last of each key."""
    fresh = last_write(new, key, order)
    return stored.alias("n").join(fresh.select(*key).alias("s"), _match(key), "left_anti").unionByName(fresh.select(*stored.columns))


def delete(stored: DataFrame, keys: DataFrame, key: Sequence[str]) -> DataFrame:
    return stored.alias("n").join(keys.select(*key).distinct().alias("s"), _match(key), "left_anti")


def newest(rows: DataFrame, group: Sequence[str], order: str, n: int) -> DataFrame:
    """The newest ``n`` rows of each group, numbered in ascending order; the rank limit cuts before the shuffle."""
    top = rows.withColumn("__r", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(order)))).where(F.col("__r") <= n).drop("__r")
    return top.withColumn("position", F.row_number().over(Window.partitionBy(*group).orderBy(order)).cast("long"))


# ------------------------------------------------------------------- queues: (chat_id, qid, node_id, hash, status, attempts)


def claim(queue: DataFrame, n: int, cap: int = ATTEMPTS) -> DataFrame:
    """The oldest ``n`` pending items of each chat with fewer than ``cap`` attempts."""
    w = Window.partitionBy("chat_id").orderBy("qid")
    ready = queue.where((F.col("status") == "pending") & (F.col("attempts") < cap))
    return ready.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= n)


def drain_size(queue: DataFrame, probe: int = 257, large: int = 64, small: int = 8) -> DataFrame:
    """How many items a round takes of each chat: ``large`` if at least ``probe`` are ready, ``small`` otherwise."""
    ready = queue.where((F.col("status") == "pending") & (F.col("attempts") < ATTEMPTS)).groupBy("chat_id").agg(F.count(F.lit(1)).alias("backlog"))
    return ready.select("chat_id", "backlog", F.when(F.col("backlog") >= probe, large).otherwise(small).alias("take"))


def done_hashes(queue: DataFrame) -> DataFrame:
    """The hash of each node's latest done item."""
    return queue.where("status = 'done'").groupBy("chat_id", "node_id").agg(F.max_by("hash", "qid").alias("hash"))


def stale(content: DataFrame, queue: DataFrame) -> DataFrame:
    """Nodes (chat_id, node_id, hash) whose content differs from what was done last, or was never done."""
    done = done_hashes(queue).withColumnRenamed("hash", "done_hash")
    return content.join(done, ["chat_id", "node_id"], "left").where(~F.col("hash").eqNullSafe(F.col("done_hash")))


def enqueue(queue: DataFrame, new: DataFrame) -> DataFrame:
    """The queue after (chat_id, node_id, hash) were put in: an item that failed for good starts again without attempts, one that is there in another
    status stays as it is, and what is not there is pending. ``revived`` and ``added`` tell which."""
    key = ["chat_id", "node_id", "hash"]
    asked = new.select(*key).distinct().withColumn("asked", F.lit(True))
    j = queue.join(asked, key, "full_outer")
    revived = F.coalesce(F.col("asked") & (F.col("status") == "failed"), F.lit(False))
    return j.select(
        *key, "qid", F.when(revived | F.col("status").isNull(), "pending").otherwise(F.col("status")).alias("status"),
        F.when(revived | F.col("attempts").isNull(), 0).otherwise(F.col("attempts")).alias("attempts"), revived.alias("revived"), F.col("status").isNull().alias("added"))


def record_attempts(queue: DataFrame, results: DataFrame) -> DataFrame:
    """The queue after attempts (chat_id, qid, ok): done, or one attempt more and failed for good at the third."""
    j = queue.join(results.groupBy("chat_id", "qid").agg(F.max("ok").alias("ok")), ["chat_id", "qid"], "left")
    attempts = F.when(F.col("ok") == False, F.col("attempts") + 1).otherwise(F.col("attempts"))  # noqa: E712
    status = F.when(F.col("ok"), "done").when((F.col("ok") == False) & (attempts >= ATTEMPTS), "failed").otherwise(F.col("status"))  # noqa: E712
    return j.select("chat_id", "qid", "node_id", "hash", status.alias("status"), attempts.alias("attempts"))


# ------------------------------------------------------------------- ledgers, pairs, counters


def prune(ledger: DataFrame, bounds: DataFrame) -> DataFrame:
    """Rows above the bound (chat_id, upto) of their chat; a chat without bound keeps all."""
    return ledger.join(bounds.select("chat_id", F.col("upto").alias("__upto")), "chat_id", "left").where(F.col("__upto").isNull() | (F.col("id") > F.col("__upto"))).drop("__upto")


def unordered(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs in one order, (chat_id, x, y), without those of one node."""
    rest = [c for c in pairs.columns if c not in (a, b)]
    return pairs.where(F.col(a) != F.col(b)).select(*rest, F.least(a, b).alias("x"), F.greatest(a, b).alias("y"))


def set_pair_status(pairs: DataFrame, changes: DataFrame) -> DataFrame:
    """Pairs (chat_id, x, y, status) after changes (chat_id, x, y, to): only a pending pair is promoted or dismissed, so a second change has no effect;
    of several changes of one pair promotion comes first. ``moved`` tells if the pair changed."""
    to = changes.where(F.col("to").isin("promoted", "dismissed")).groupBy("chat_id", "x", "y").agg(F.max("to").alias("to"))
    j = pairs.join(to, ["chat_id", "x", "y"], "left")
    moves = F.coalesce((F.col("status") == "pending") & F.col("to").isNotNull(), F.lit(False))
    return j.select("chat_id", "x", "y", F.when(moves, F.col("to")).otherwise(F.col("status")).alias("status"), moves.alias("moved"))


def rewrite_pairs_first(pairs: DataFrame, survivors: DataFrame, order: Column) -> DataFrame:
    """Pairs after merges (chat_id, loser, survivor): losers become their survivor, pairs of one node go, and of pairs that became one the first
    in ``order`` stays."""
    to = lambda c: survivors.select("chat_id", F.col("loser").alias(c), F.col("survivor").alias(f"__{c}"))
    p = pairs.join(to("x"), ["chat_id", "x"], "left").join(to("y"), ["chat_id", "y"], "left")
    p = p.withColumn("a", F.coalesce("__x", "x")).withColumn("b", F.coalesce("__y", "y")).drop("x", "y", "__x", "__y")
    return first_write(unordered(p, "a", "b"), ["chat_id", "x", "y"], order)


def add_up(deltas: DataFrame, key: Sequence[str]) -> DataFrame:
    """Counters as sums of their increments; an overflow is an error, as it would be for the stored number."""
    total = F.sum(F.col("delta").cast("decimal(38,0)"))
    fits = total.between(-(2**63), 2**63 - 1)
    return deltas.groupBy(*key).agg(F.when(fits, total).otherwise(F.raise_error(F.lit("counter overflow"))).cast("long").alias("value"))


def state_map(state: DataFrame) -> DataFrame:
    """Each chat's keys and values as one map; a chat has a bounded number of state keys."""
    return state.groupBy("chat_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("state"))


def overlay(groups: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Settings of each group: its own value where it is set, the general one elsewhere."""
    return groups.select("chat_id", *[F.coalesce(F.col(k), F.lit(v)).alias(k) if k in groups.columns else F.lit(v).alias(k) for k, v in defaults.items()])
