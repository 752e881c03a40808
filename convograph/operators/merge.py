"""Merging nodes with a snapshot that a rollback restores, and the writes beside it: validity by key, alias links, merge plans."""
from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import KEY, one_winner, valid_now

OLD = [f"old_{c}" for c in KEY]
SNAPSHOT_VERSION = 2


def _equivalent_later(valid: DataFrame) -> DataFrame:
    """Adds ``same`` to the valid edges between two nodes: true for a moved one if an edge that stays before it, in order of the merges, has the same
    text or start. That is not transitive, so rows stream through in order and only texts and starts of one pair of nodes are held."""
    pair = ["chat_id", "source_id", "relationship_name", "target_id"]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        now, texts, starts = None, set(), set()
        for batch in batches:
            same = []
            for *key, text, start, moved in zip(*(batch.column(c).to_pylist() for c in (*pair, "edge_text", "__us", "moved")), strict=True):
                if key != now:
                    now, texts, starts = key, set(), set()
                same.append(bool(moved) and (text in texts or start in starts))
                if not same[-1]:
                    texts.add(text)
                    starts.add(start)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(same, pa.bool_())], names=[*batch.schema.names, "same"])

    v = valid.withColumn("__us", F.unix_micros("valid_at")).repartition(*pair)
    v = v.sortWithinPartitions(*pair, "moved", "loser", "created_at", "old_source_id", "old_target_id", "__us")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in v.schema.fields)
    return v.mapInArrow(run, f"{ddl}, same boolean").drop("__us")


def merge(edges: DataFrame, survivors: DataFrame, kinds: DataFrame) -> DataFrame:
    """What becomes of each edge when all nodes of ``survivors`` (chat_id, loser, survivor; no survivor is a loser) are merged.

    Columns: the key as it was (old_*) and as it is, the rest of the edge, ``loser`` (the greater merged end, null if none), and ``outcome``:
    kept, moved, self_loop (both ends became one, dropped), deduped (valid, and a valid edge of the same ends and relationship with the same text or
    start is there, dropped), invalidated (valid, but another target of a single-valued relationship of a survivor wins). Invalid
    edges move as they are and never take the place of a valid one. A row whose ``outcome`` is not kept is the merge's snapshot."""
    to = lambda c: survivors.select("chat_id", F.col("loser").alias(c), F.col("survivor").alias(f"new_{c}"))
    lost = lambda c: F.when(F.col(f"new_{c}").isNotNull(), F.col(c))
    m = edges.join(to("source_id"), ["chat_id", "source_id"], "left").join(to("target_id"), ["chat_id", "target_id"], "left")
    m = m.select(
        *[F.col(k).alias(o) for k, o in zip(KEY, OLD, strict=True)], "chat_id", F.coalesce("new_source_id", "source_id").alias("source_id"), "relationship_name",
        F.coalesce("new_target_id", "target_id").alias("target_id"), "valid_at", "invalid_at", "edge_text", "created_at", F.greatest(lost("source_id"), lost("target_id")).alias("loser"))
    m = m.withColumn("moved", F.col("loser").isNotNull())
    loop = (F.col("source_id") == F.col("target_id")) & F.col("moved")
    at = F.when(F.col("moved"), "moved").otherwise("kept")
    loops, rest = m.where(loop).withColumn("outcome", F.lit("self_loop")), m.where(~loop)
    valid = _equivalent_later(valid_now(rest))
    deduped, live = valid.where("same").drop("same").withColumn("outcome", F.lit("deduped")), valid.where("not same").drop("same")
    stay = survivors.select("chat_id", F.col("survivor").alias("source_id")).distinct()
    beaten = one_winner(live.join(stay, ["chat_id", "source_id"], "left_semi"), kinds).withColumn("__beaten", F.lit(True))
    live = live.join(beaten, KEY, "left").withColumn("outcome", F.when(F.col("__beaten"), "invalidated").otherwise(at)).drop("__beaten")
    history = rest.where("invalid_at is not null").withColumn("outcome", at)
    return loops.unionByName(deduped).unionByName(live).unionByName(history)


def edges_after(merged: DataFrame) -> DataFrame:
    """The edges a merge leaves; ``still_valid`` is false for history and for those that lost to a winner."""
    kept = merged.where(F.col("outcome").isin("kept", "moved", "invalidated"))
    return kept.withColumn("still_valid", F.col("invalid_at").isNull() & (F.col("outcome") != "invalidated"))


def snapshot_of(merged: DataFrame) -> DataFrame:
    """What a rollback needs: the rows of merged nodes as they were, the keys that were created, and the keys that were invalidated; one
    flat row each, so that a hub's snapshot is no one row."""
    return merged.where("moved or outcome = 'invalidated'").withColumn("version", F.lit(SNAPSHOT_VERSION))


def refusals(nodes: DataFrame, survivors: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Merges (chat_id, loser, survivor) that must not be rolled back, with the reason: the survivor was merged away since, the loser is there, or
    the snapshot is of a version not known."""
    there = nodes.select("chat_id", F.col("id").alias("survivor"), F.lit(True).alias("__s"))
    back = nodes.select("chat_id", F.col("id").alias("loser"), F.lit(True).alias("__l"))
    newer = snapshot.where(F.col("version") > SNAPSHOT_VERSION).select("chat_id", "loser").distinct().withColumn("__v", F.lit(True))
    j = survivors.join(there, ["chat_id", "survivor"], "left").join(back, ["chat_id", "loser"], "left").join(newer, ["chat_id", "loser"], "left")
    why = F.when(F.col("__v"), "version").when(F.col("__s").isNull(), "survivor_missing").when(F.col("__l"), "loser_exists")
    return j.select("chat_id", "loser", "survivor", why.alias("reason")).where("reason is not null")


def rollback(edges: DataFrame, snapshot: DataFrame) -> DataFrame:
    """``edges_after`` back to what they were: created keys go, the rows of merged nodes come back, and what the merge invalidated is valid again."""
    made = snapshot.where("moved and outcome in ('moved', 'invalidated')").select(*OLD)
    left = edges.join(made, OLD, "left_anti")
    row = [*KEY, "invalid_at", "edge_text", "created_at"]
    was = snapshot.where("moved").select(*[F.col(o).alias(k) for k, o in zip(KEY, OLD, strict=True)], *row[len(KEY):])
    return left.select(*row).unionByName(was)


def tallies(merged: DataFrame) -> DataFrame:
    """How many edges of each chat had which outcome."""
    n = lambda x: F.count_if(F.col("outcome") == x).alias(x)
    return merged.groupBy("chat_id").agg(n("kept"), n("moved"), n("self_loop"), n("deduped"), n("invalidated"))


def set_validity(edges: DataFrame, keys: DataFrame, at: Column | None) -> DataFrame:
    """Edges after those of ``keys`` were closed at ``at``, or opened again where that is None. ``outcome`` is changed, already, or untouched; a key
    that no edge has comes as a row with outcome unknown, which callers report as an error."""
    asked = keys.select(*KEY).distinct().withColumn("__asked", F.lit(True))
    j = edges.withColumn("__e", F.lit(True)).join(asked, KEY, "full_outer")
    there = F.col("invalid_at").isNull() if at is None else F.col("invalid_at").isNotNull()
    outcome = F.when(F.col("__e").isNull(), "unknown").when(F.col("__asked").isNull(), "untouched").when(there, "already").otherwise("changed")
    new = F.lit(None).cast("timestamp") if at is None else at
    return j.withColumn("outcome", outcome).withColumn("invalid_at", F.when(F.col("outcome") == "changed", new).otherwise(F.col("invalid_at"))).drop("__e", "__asked")


def link_aliases(edges: DataFrame, links: DataFrame, relationship: str = "also_known_as") -> DataFrame:
    """Edges to add for ``links`` (chat_id, source_id, target_id): those whose ends have no edge of that relationship yet, whenever it began."""
    known = edges.where(F.col("relationship_name") == relationship).select("chat_id", "source_id", "target_id")
    new = links.select("chat_id", "source_id", "target_id").distinct().join(known, ["chat_id", "source_id", "target_id"], "left_anti")
    return new.withColumn("relationship_name", F.lit(relationship)).withColumn("valid_at", F.timestamp_micros(F.lit(0)))


def dedupe_aliases(edges: DataFrame, relationships: list[str]) -> DataFrame:
    """(edge_no, action): of the rows of one alias fact the earliest is kept (its start set to the epoch: align, or keep if it is that already) and
    the others are removed."""
    w = Window.partitionBy("chat_id", "source_id", "relationship_name", "target_id").orderBy("valid_at", "edge_no")
    a = edges.where(F.col("relationship_name").isin(relationships)).withColumn("__n", F.row_number().over(w))
    action = F.when(F.col("__n") > 1, "remove").when(F.unix_micros("valid_at") != 0, "align").otherwise("keep")
    return a.select("edge_no", action.alias("action"))


def plan(pairs: DataFrame, budget: int, same: float = 0.88, related: float = 0.75) -> DataFrame:
    """Pairs (chat_id, x, y, score) with a verdict: the first ``budget`` of each chat by score are judged same, related or different; the rest
    is skipped. Equal scores are ordered by ids."""
    w = Window.partitionBy("chat_id").orderBy(F.desc("score"), "x", "y")
    r = pairs.withColumn("place", F.row_number().over(w).cast("long"))
    verdict = F.when(F.col("place") > budget, "skipped").when(F.col("score") >= same, "same").when(F.col("score") >= related, "related").otherwise("different")
    return r.withColumn("verdict", verdict)


def plan_hash(pairs: DataFrame) -> DataFrame:
    """A hash of each chat's candidate set that does not depend on the order of rows, by which a stored plan is known to be out of date."""
    line = F.xxhash64("x", "y", F.round("score", 12))
    return pairs.groupBy("chat_id").agg(F.hex(F.bit_xor(line)).alias("xor"), F.count(F.lit(1)).alias("pairs"))
