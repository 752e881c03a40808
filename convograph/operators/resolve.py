"""Binding extracted names to nodes: by mention, by alias, by vector, and what a batch writes for them."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import content_hash, normalized, uuid_of


def bind_alias(extracted: DataFrame, aliases: DataFrame, nodes: DataFrame, fold: Callable[[Column], Column] = normalized) -> DataFrame:
    """Extracted names (chat_id, name, kind) with ``node_id`` where an alias of the folded name (chat_id, alias_name, target_id) has exactly one target
    and that is a node of the same kind; ``targets`` counts them."""
    of = aliases.select("chat_id", fold(F.col("alias_name")).alias("__n"), "target_id").distinct()
    one = of.groupBy("chat_id", "__n").agg(F.count(F.lit(1)).alias("targets"), F.min("target_id").alias("target_id"))
    kind = nodes.select("chat_id", F.col("id").alias("target_id"), F.col("node_type").alias("__kind"))
    j = extracted.withColumn("__n", fold(F.col("name"))).join(one, ["chat_id", "__n"], "left").join(kind, ["chat_id", "target_id"], "left")
    bound = (F.col("targets") == 1) & (F.col("__kind") == F.col("kind"))
    return j.select("chat_id", "name", "kind", F.coalesce("targets", F.lit(0)).cast("long").alias("targets"), F.when(bound, F.col("target_id")).alias("node_id"))


def first_compatible(hits: DataFrame, infos: DataFrame, queries: DataFrame) -> DataFrame:
    """Of the ranked hits (query_id, rank, hit_id, similarity) of each query (query_id, batch, kind) the first of its kind, where an Alias with one
    target stands for that target; infos are (hit_id, hit_kind, target_id, target_kind)."""
    j = hits.join(queries, "query_id").join(infos, "hit_id")
    alias = F.col("hit_kind") == "Alias"
    kind, node = F.when(alias, F.col("target_kind")).otherwise(F.col("hit_kind")), F.when(alias, F.col("target_id")).otherwise(F.col("hit_id"))
    ok = j.withColumn("node_id", node).where((kind == F.col("kind")) & kind.isin("Person", "Concept"))
    return ok.groupBy("query_id", "batch").agg(F.min_by(F.struct("node_id", "similarity"), "rank").alias("h")).select("query_id", "batch", "h.*")


def confirm(screened: DataFrame, threshold: float, budget: int, readable: Column | None = None) -> DataFrame:
    """Screened hits with a ``decision``: below the threshold none is asked; of those that are to be asked and can be read, the first ``budget`` of each
    batch are confirmed, the rest is treated as below. Only asking uses up the budget."""
    ask = F.col("similarity") >= threshold if readable is None else (F.col("similarity") >= threshold) & readable
    asked = screened.withColumn("__ask", ask)
    w = Window.partitionBy("batch").orderBy("query_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = F.sum(F.when(F.col("__ask"), 1).otherwise(0)).over(w)
    decision = F.when(~F.col("__ask"), "below").when(n <= budget, "confirm").otherwise("exhausted")
    return asked.withColumn("decision", decision).drop("__ask")


def fallback(bound: DataFrame, fold: Callable[[Column], Column] = normalized) -> DataFrame:
    """Names that nothing bound get the id their name determines: a Person its own alias, a Concept itself."""
    label = F.concat(F.when(F.col("kind") == "Person", "alias:").otherwise("concept:"), fold(F.col("name")))
    return bound.withColumn("own", F.col("node_id").isNull()).withColumn("node_id", F.coalesce("node_id", uuid_of(label)))


EPOCH_US = 0


def assemble(batches: DataFrame, entities: DataFrame, facts: DataFrame) -> DataFrame:
    """The rows that a batch writes: (chat_id, batch, part, source_id, relationship_name, target_id, valid_us).

    batches (chat_id, batch, end_us), entities (chat_id, batch, name, alias_id, node_id), facts (chat_id, batch, source_id, relationship_name, target_id).
    Parts are the batch node, alias edges valid since the epoch, facts valid from the batch's end (those with an end that is no entity of the batch are
    dropped), and contains edges from the batch to its entities."""
    none = F.lit(None).cast("string")
    b = batches.select("chat_id", "batch", F.lit("batch").alias("part"), F.col("batch").alias("source_id"), none.alias("relationship_name"), none.alias("target_id"), F.col("end_us").alias("valid_us"))
    e = entities.where("alias_id <> node_id").select("chat_id", "batch", F.lit("alias").alias("part"), F.col("node_id").alias("source_id"), F.lit("known_as").alias("relationship_name"),
                                                      F.col("alias_id").alias("target_id"), F.lit(EPOCH_US).cast("long").alias("valid_us")).distinct()
    known = entities.select("chat_id", "batch", F.col("node_id").alias("__id")).distinct()
    end = lambda df, c: df.join(known.withColumnRenamed("__id", c), ["chat_id", "batch", c], "left_semi")
    f = end(end(facts, "source_id"), "target_id").join(batches, ["chat_id", "batch"]).select(
        "chat_id", "batch", F.lit("fact").alias("part"), "source_id", "relationship_name", "target_id", F.col("end_us").alias("valid_us")).distinct()
    c = known.join(batches, ["chat_id", "batch"]).select("chat_id", "batch", F.lit("contains").alias("part"), F.col("batch").alias("source_id"), F.lit("contains").alias("relationship_name"),
                                                         F.col("__id").alias("target_id"), F.col("end_us").alias("valid_us"))
    return b.unionByName(e).unionByName(f).unionByName(c)


def harvest(nodes: DataFrame) -> DataFrame:
    """Queue items (chat_id, node_id, hash) for the nodes of a batch, by name and description."""
    return nodes.select("chat_id", F.col("id").alias("node_id"), content_hash(F.col("name"), F.get_json_object("properties", "$.description")).alias("hash")).distinct()


def promoted(extracted: DataFrame, pairs: DataFrame) -> DataFrame:
    """Extracted edges (chat_id, seq, source_name, target_name) whose two names are a pending pair (chat_id, x, y, place) in either order: the
    direction is the edge's, and each pair is promoted by its first edge."""
    names = extracted.withColumn("x", F.least("source_name", "target_name")).withColumn("y", F.greatest("source_name", "target_name"))
    return names.join(pairs, ["chat_id", "x", "y"]).groupBy("chat_id", "x", "y").agg(F.min_by(F.struct("source_name", "target_name", "seq"), "seq").alias("e")).select("chat_id", "x", "y", "e.*")
