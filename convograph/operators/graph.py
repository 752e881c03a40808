"""Reads and writes over the bitemporal fact graph."""
from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import Cuts

KEY = ["chat_id", "source_id", "relationship_name", "target_id", "valid_at"]
ORDER = ["created_at", "valid_at"]


def merge_nodes(rows: DataFrame) -> DataFrame:
    """Node rows folded in order of updated_at: the name is the first one's, updated_at the last one's, properties the last that
    are not null, everything else the first one's. Equal times are ordered by name."""
    first = F.struct("updated_at", "name")
    return rows.groupBy("chat_id", "id").agg(
        F.min_by("name", first).alias("name"), F.min_by("node_type", first).alias("node_type"), F.min_by("created_at", first).alias("created_at"),
        F.max("updated_at").alias("updated_at"), F.max_by("properties", F.when(F.col("properties").isNotNull(), first)).alias("properties"))


def merge_edges(rows: DataFrame) -> DataFrame:
    """Edge rows folded by natural key in order of (updated_at, edge_no): text and updated_at of the last, end and properties
    of the last that has one, created_at of the first."""
    at = F.struct("updated_at", "edge_no")
    given = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c)
    return rows.groupBy(*KEY).agg(
        given("invalid_at"), F.max_by("edge_text", at).alias("edge_text"), F.min_by("created_at", at).alias("created_at"),
        F.max("updated_at").alias("updated_at"), given("properties"))


def valid_now(edges: DataFrame) -> DataFrame:
    return edges.where("invalid_at is null")


def both_ends(edges: DataFrame) -> DataFrame:
    """Each edge seen from its source and its target; a self-loop once."""
    out = edges.withColumn("node", F.col("source_id")).withColumn("other", F.col("target_id"))
    back = edges.where("source_id <> target_id").withColumn("node", F.col("target_id")).withColumn("other", F.col("source_id"))
    return out.unionByName(back)


def _newest_first(*ids: str) -> list[Column]:
    return [F.desc("created_at"), F.desc("valid_at"), F.col("source_id"), F.col("target_id"), F.col("relationship_name")]


def neighbors(edges: DataFrame, entries: DataFrame, most: int = 500, hidden: Sequence[str] = ("contains",)) -> DataFrame:
    """The valid neighbours of each entry (chat_id, node): up to ``most``, newest first. The rank limit also cuts before the shuffle."""
    seen = both_ends(valid_now(edges).where(~F.col("relationship_name").isin(*hidden)))
    w = Window.partitionBy("chat_id", "node").orderBy(*_newest_first())
    return (
        seen.join(entries, ["chat_id", "node"], "left_semi").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
        .select("chat_id", "node", "other", "relationship_name", F.unix_micros("valid_at").alias("valid_us"), F.col("rank").cast("long").alias("rank"))
    )


def two_hop(edges: DataFrame, entries: DataFrame, since_us: int, most: int = 500,
            hidden: Sequence[str] = ("contains", "known_as"), exempt: Sequence[str] = ("also_known_as",)) -> DataFrame:
    """Edges within two hops of the entries, each once with its first hop: valid, not hidden, and valid or learned since ``since_us``
    unless of an exempt relationship. The frontier is what hop one reached and is no entry itself."""
    recent = (F.unix_micros("valid_at") >= since_us) | (F.unix_micros("created_at") >= since_us) | F.col("relationship_name").isin(*exempt)
    seen = both_ends(valid_now(edges).where(~F.col("relationship_name").isin(*hidden) & recent))
    w = Window.partitionBy("chat_id", "node").orderBy(*_newest_first())
    reach = lambda front: seen.join(front, ["chat_id", "node"], "left_semi").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    hop1 = reach(entries)
    front = hop1.select("chat_id", F.col("other").alias("node")).distinct().join(entries, ["chat_id", "node"], "left_anti")
    every = hop1.withColumn("hop", F.lit(1)).unionByName(reach(front).withColumn("hop", F.lit(2)))
    return every.groupBy(*KEY).agg(F.min("hop").cast("long").alias("hop"))


def alias_targets(edges: DataFrame, relationships: Sequence[str]) -> DataFrame:
    """Sources of valid alias edges into a node."""
    return valid_now(edges).where(F.col("relationship_name").isin(*relationships)).select("chat_id", F.col("target_id").alias("alias_id"), "source_id").distinct()


def resolution_info(nodes: DataFrame, edges: DataFrame, relationships: Sequence[str]) -> DataFrame:
    """Every node with the number of its alias targets, and the target where an Alias has just one."""
    t = alias_targets(edges, relationships).groupBy("chat_id", F.col("alias_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min("source_id").alias("only"))
    n = nodes.join(t, ["chat_id", "id"], "left")
    one = (F.col("n") == 1) & (F.col("node_type") == "Alias")
    return n.select("chat_id", "id", "node_type", F.coalesce("n", F.lit(0)).cast("long").alias("targets"), F.when(one, F.col("only")).alias("target_id"))


def linked_pairs(edges: DataFrame) -> DataFrame:
    """Unordered pairs of nodes with any edge between them."""
    return edges.select("chat_id", F.least("source_id", "target_id").alias("x"), F.greatest("source_id", "target_id").alias("y")).distinct()


def unlinked(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs (chat_id, x, y), x < y, without an edge either way."""
    return pairs.join(linked_pairs(edges), ["chat_id", "x", "y"], "left_anti")


def hydrate(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Valid edges with the names of both ends; an edge whose end is unknown is dropped."""
    name = lambda c: nodes.select("chat_id", F.col("id").alias(f"{c}_id"), F.col("name").alias(f"{c}_name"))
    return valid_now(edges).join(name("source"), ["chat_id", "source_id"]).join(name("target"), ["chat_id", "target_id"])


def merge_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Undirected degree of every node, a self-loop counted once."""
    d = both_ends(edges).groupBy("chat_id", F.col("node").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    return nodes.join(d, ["chat_id", "id"], "left").select("chat_id", "id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"),
                                                            F.unix_micros("created_at").alias("created_us"))


def topics(nodes: DataFrame, edges: DataFrame, most: int = 20) -> DataFrame:
    """The ``most`` Concepts of highest degree in each chat with their last activity; those without edges have degree 0."""
    d = both_ends(valid_now(edges)).groupBy("chat_id", F.col("node").alias("id")).agg(
        F.count(F.lit(1)).alias("degree"), F.greatest(F.max("valid_at"), F.max("created_at")).alias("active"))
    w = Window.partitionBy("chat_id").orderBy(F.desc("degree"), "id")
    n = nodes.where("node_type = 'Concept'").join(d, ["chat_id", "id"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))
    return n.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= most).select("chat_id", "id", "degree", F.unix_micros("active").alias("active_us"), "rank")


def one_winner(edges: DataFrame, kinds: DataFrame) -> DataFrame:
    """Valid edges of single-valued relationships that lose to a newer one of their subject: newest start wins, of equal starts the
    smallest target. The fixed list of kinds is broadcast."""
    single = kinds.where("single_value").select("relationship_name")
    w = Window.partitionBy("chat_id", "source_id", "relationship_name").orderBy(F.desc("valid_at"), "target_id")
    e = valid_now(edges).join(F.broadcast(single), "relationship_name", "left_semi")
    return e.withColumn("place", F.row_number().over(w)).where("place > 1").select(*KEY)


def last_write_wins(rows: DataFrame, kinds: DataFrame) -> DataFrame:
    """Batch order: of the delivered edges of a subject's single-valued relationship only the last one stays valid; (natural key, still_valid),
    a key delivered again takes the place of its last delivery."""
    single = kinds.where("single_value").select("relationship_name")
    e = rows.join(F.broadcast(single), "relationship_name", "left_semi").groupBy(*KEY).agg(F.max("edge_no").alias("seq"))
    w = Window.partitionBy("chat_id", "source_id", "relationship_name").orderBy(F.desc("seq"))
    return e.select(*KEY, (F.row_number().over(w) == 1).alias("still_valid"))


def repoint(edges: DataFrame, survivors: DataFrame) -> DataFrame:
    """Edges folded by natural key once their ends moved to a survivor (chat_id, loser, survivor): self-loops that arise are dropped, and of
    edges that become equal the earliest created stays with the last end known. This does not tell valid edges from history; ``merge.merge`` does."""
    to = lambda c: survivors.select("chat_id", F.col("loser").alias(c), F.col("survivor").alias(f"new_{c}"))
    m = edges.join(to("source_id"), ["chat_id", "source_id"], "left").join(to("target_id"), ["chat_id", "target_id"], "left")
    moved = F.col("new_source_id").isNotNull() | F.col("new_target_id").isNotNull()
    m = m.withColumn("moved", moved).withColumn("source_id", F.coalesce("new_source_id", "source_id")).withColumn("target_id", F.coalesce("new_target_id", "target_id"))
    m = m.where((F.col("source_id") != F.col("target_id")) | ~F.col("moved"))
    return m.groupBy(*KEY).agg(F.min("created_at").alias("created_at"), F.max("invalid_at").alias("invalid_at"), F.count(F.lit(1)).alias("folded"))


RANK = "struct<d:bigint,t:bigint,id:string>"


def _best_of_groups(links: DataFrame) -> DataFrame:
    """(chat_id, u, up): each node of links between ranks with the best of its connected group, by one task; for a bounded number of links."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        up: dict[tuple, tuple] = {}

        def root(x: tuple) -> tuple:
            while (y := up.setdefault(x, x)) != x:
                up[x] = up[y]
                x = up[x]
            return x

        for batch in batches:
            for chat, u, v in zip(*(batch.column(c).to_pylist() for c in ("chat_id", "u", "v")), strict=True):
                x, y = root((chat, u["d"], u["t"], u["id"])), root((chat, v["d"], v["t"], v["id"]))
                up[max(x, y)] = min(x, y)
        kind = pa.struct([("d", pa.int64()), ("t", pa.int64()), ("id", pa.string())])
        rank = lambda xs: pa.array([dict(zip(("d", "t", "id"), x[1:], strict=True)) for x in xs], kind)
        nodes = list(up)
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in nodes], pa.string()), rank(nodes), rank([root(x) for x in nodes])], names=["chat_id", "u", "up"])

    return links.where("u < v").select("chat_id", "u", "v").coalesce(1).mapInArrow(run, f"chat_id string, u {RANK}, up {RANK}")


def final_survivors(pairs: DataFrame, stats: DataFrame, cuts: Cuts, last_links: int = 200_000) -> DataFrame:
    """(chat_id, loser, survivor): every node of a connected group of matched pairs (chat_id, x, y) but the one that stays, which is the
    best of the group by ``stats`` (chat_id, id, degree, created_us): higher degree, earlier created, smaller id.

    Each node hooks to its best neighbour where that is better, pointers are doubled up to the roots, and links between roots stay for
    the next round. A root that nothing hooked to has a better neighbour in the next round, so every two rounds halve what is left. Once at
    most ``last_links`` links are left, one task joins them, which gives the same nodes."""
    rank = F.struct((-F.coalesce("degree", F.lit(0))).cast("long").alias("d"), F.coalesce("created_us", F.lit(2**62)).cast("long").alias("t"), F.col("id"))
    ids = pairs.select("chat_id", F.col("x").alias("id")).union(pairs.select("chat_id", "y")).distinct()
    node = cuts.cut(ids.join(stats, ["chat_id", "id"], "left").select("chat_id", "id", rank.alias("r")))
    side = lambda c, r: node.select("chat_id", F.col("id").alias(c), F.col("r").alias(r))
    p = pairs.join(side("x", "u"), ["chat_id", "x"]).join(side("y", "v"), ["chat_id", "y"]).where("u <> v")
    links = cuts.cut(p.select("chat_id", "u", "v").union(p.select("chat_id", "v", "u")).distinct())
    owner = cuts.cut(node.select("chat_id", F.col("r").alias("node"), F.col("r").alias("at")))
    while n := links.count() // 2:
        small = n <= last_links
        up = cuts.cut(_best_of_groups(links) if small else links.groupBy("chat_id", "u").agg(F.min("v").alias("up")).where("up < u"))
        while not small:
            far = up.select("chat_id", F.col("u").alias("up"), F.col("up").alias("next"))
            step = cuts.cut(up.join(far, ["chat_id", "up"], "left").select("chat_id", "u", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")))
            cuts.drop(up)
            up = step
            if not up.where("moved").take(1):
                break
        root = lambda c: up.select("chat_id", F.col("u").alias(c), F.col("up").alias(f"root_{c}"))  # noqa: B023, E731
        moved = cuts.cut(owner.join(root("at"), ["chat_id", "at"], "left").select("chat_id", "node", F.coalesce("root_at", "at").alias("at")))
        between = links.join(root("u"), ["chat_id", "u"], "left").join(root("v"), ["chat_id", "v"], "left")
        after = cuts.cut(between.select("chat_id", F.coalesce("root_u", "u").alias("u"), F.coalesce("root_v", "v").alias("v")).where("u <> v").distinct())
        cuts.drop(owner, links, up)
        owner, links = moved, after
    cuts.keep(owner)
    return owner.where("node <> at").select("chat_id", F.col("node.id").alias("loser"), F.col("at.id").alias("survivor"))


def merge_edge_ends(edges: DataFrame, survivors: DataFrame, kinds: DataFrame) -> DataFrame:
    """Edges after all merges of ``survivors`` (chat_id, loser, survivor), where no survivor is a loser, with ``still_valid``; see ``merge.merge``."""
    from .merge import edges_after, merge

    return edges_after(merge(edges, survivors, kinds)).select(*KEY, "invalid_at", "edge_text", "created_at", "still_valid")


def alias_audit(edges: DataFrame) -> DataFrame:
    """Per chat: rows, distinct facts regardless of time, duplicates, self-loops, most rows of one fact."""
    per = edges.groupBy("chat_id", "source_id", "relationship_name", "target_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("chat_id").agg(
        F.sum("n").cast("long").alias("rows"), F.count(F.lit(1)).alias("facts"), F.sum(F.col("n") - 1).cast("long").alias("duplicates"),
        F.count_if(F.col("source_id") == F.col("target_id")).alias("self_loops"), F.max("n").alias("most_rows"))


def set_difference(graph: DataFrame, sidecar: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """What brings a derived text table in line with the graph: (keys, action) with upsert where text is missing or differs and is not
    empty, and delete where the key is gone."""
    g = graph.select(*keys, F.col(text).alias("__new"), F.lit(True).alias("__g"))
    s = sidecar.select(*keys, F.col(text).alias("__old"), F.lit(True).alias("__s"))
    action = F.when(F.col("__g").isNull(), "delete").when((F.col("__s").isNull() | ~F.col("__new").eqNullSafe(F.col("__old"))) & (F.coalesce("__new", F.lit("")) != ""), "upsert")
    return g.join(s, list(keys), "full_outer").select(*keys, action.alias("action")).where("action is not null")
