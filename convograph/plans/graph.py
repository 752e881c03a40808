"""Graph, vector, recall and merge queries over nodes, edges, scored pairs and embeddings."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids
from ..functions.text import RESERVED, contains_literal, fold_ascii
from ..lineage import Cuts
from ..operators import graph, merge, recall, vector
from ..sources import table

ALIAS = ("knows",)
SINCE_US = 1_743_465_600_000_000  # 2025-04-01
MATCH, BAND = 0.30, 0.20


def _nodes(spark, folder):
    return graph.merge_nodes(table(spark, folder, "memory_nodes"))


def _edges(spark, folder):
    return graph.merge_edges(table(spark, folder, "memory_edges"))


def _people(spark, folder):
    return table(spark, folder, "memory_nodes").where("node_type = 'Person'").select("chat_id", F.col("id").alias("node")).distinct()


def _pairs(spark, folder):
    c = table(spark, folder, "merge_candidates").where("a_id <> b_id")
    return c.select("chat_id", F.least("a_id", "b_id").alias("x"), F.greatest("a_id", "b_id").alias("y"), "score")


def nodes(spark, folder):
    n = _nodes(spark, folder)
    return n.select("chat_id", "id", "name", "node_type", F.unix_micros("created_at").alias("created_us"), F.unix_micros("updated_at").alias("updated_us"), "properties")


def edges(spark, folder):
    e = _edges(spark, folder)
    return e.select("chat_id", "source_id", "relationship_name", "target_id", F.unix_micros("valid_at").alias("valid_us"), F.unix_micros("invalid_at").alias("invalid_us"),
                    "edge_text", F.unix_micros("created_at").alias("created_us"), "properties")


def _key(e):
    return e.select("chat_id", "source_id", "relationship_name", "target_id", F.unix_micros("valid_at").alias("valid_us"), *[c for c in e.columns if c not in graph.KEY])


def unlinked(spark, folder):
    return graph.unlinked(_pairs(spark, folder).select("chat_id", "x", "y").distinct(), _edges(spark, folder))


def hydrate(spark, folder):
    h = graph.hydrate(_edges(spark, folder), _nodes(spark, folder))
    return h.select("chat_id", "source_id", "source_name", "relationship_name", "target_id", "target_name", F.unix_micros("valid_at").alias("valid_us"))


def facts(spark, folder):
    """Facts about each person: valid and invalid edges of either direction, newest first."""
    seen = graph.both_ends(_edges(spark, folder)).join(_people(spark, folder), ["chat_id", "node"], "left_semi")
    return seen.groupBy("chat_id", "node").agg(F.count(F.lit(1)).alias("facts"), F.count_if(F.col("invalid_at").isNull()).alias("valid"), F.unix_micros(F.max("valid_at")).alias("newest_us"))


def edge_text_diff(spark, folder):
    """The text table as it was after half of the rows, against all rows."""
    rows = table(spark, folder, "memory_edges")
    half = rows.agg(F.floor(F.max("edge_no") / 2).alias("h"))
    old = rows.crossJoin(F.broadcast(half)).where("edge_no <= h").drop("h")
    return _key(graph.set_difference(graph.merge_edges(rows), graph.merge_edges(old), graph.KEY, "edge_text"))


def missing_names(spark, folder):
    """Nodes whose current name differs from the last one they were scored under, and scored ids without node."""
    c = table(spark, folder, "merge_candidates")
    scored = c.select("chat_id", F.col("a_id").alias("id"), F.col("a_name").alias("name"), "score").union(c.select("chat_id", "b_id", "b_name", "score")).where("id is not null")
    last = scored.groupBy("chat_id", "id").agg(F.max("name").alias("name"))
    return graph.set_difference(_nodes(spark, folder), last, ["chat_id", "id"], "name")


def ids_union(spark, folder):
    c = table(spark, folder, "merge_candidates")
    every = table(spark, folder, "memory_nodes").select("chat_id", "id").union(c.select("chat_id", "a_id")).union(c.select("chat_id", "b_id"))
    return every.where("id is not null").distinct()


def orphans(spark, folder):
    """Ids that were scored or stored as nodes but that no edge uses."""
    e = table(spark, folder, "memory_edges")
    ends = e.select("chat_id", F.col("source_id").alias("id")).union(e.select("chat_id", "target_id"))
    return ids_union(spark, folder).join(ends, ["chat_id", "id"], "left_anti")


def text_search(spark, folder):
    """Edges whose text contains a term, ASCII case folded; the terms are stated here."""
    terms = spark.createDataFrame([("street FOOD",), ("100%",), ("someone_",), ("КАРАОКЕ",), ("さん",), (" ",)], "term string")
    e = table(spark, folder, "memory_edges").select("edge_no", "edge_text")
    return e.crossJoin(F.broadcast(terms)).where(contains_literal(F.col("edge_text"), F.col("term"))).groupBy("term").agg(F.count(F.lit(1)).alias("hits"), F.min("edge_no").alias("first_edge"))


def name_validation(spark, folder):
    r = F.col("relationship_name")
    ok = r.rlike("^[a-z][a-z0-9_]{0,63}$") & ~r.isin(RESERVED)
    return table(spark, folder, "memory_edges").groupBy(r.alias("given"), F.when(ok, r).otherwise("related_to").alias("kept")).agg(F.count(F.lit(1)).alias("n"))


def survivors(spark, folder):
    """Of each matched pair the node that stays: higher degree, earlier created, smaller id; unknown nodes have neither."""
    s = graph.merge_stats(_nodes(spark, folder), _edges(spark, folder))
    side = lambda c: s.select("chat_id", F.col("id").alias(c), F.col("degree").alias(f"d_{c}"), F.col("created_us").alias(f"t_{c}"))
    p = _pairs(spark, folder).where("score >= 0.88 and not isnan(score)").select("chat_id", "x", "y").distinct()
    p = p.join(side("x"), ["chat_id", "x"], "left").join(side("y"), ["chat_id", "y"], "left")
    rank = lambda c: F.struct(-F.coalesce(f"d_{c}", F.lit(0)), F.coalesce(f"t_{c}", F.lit(2**62)), F.col(c))
    win = F.when(rank("x") <= rank("y"), F.col("x")).otherwise(F.col("y"))
    return p.select("chat_id", win.alias("survivor"), F.when(win == F.col("x"), F.col("y")).otherwise(F.col("x")).alias("loser"))


def final(spark, folder):
    """Every merged node with the one node that stays of its group, however long the chain of matches."""
    p = _pairs(spark, folder).where("score >= 0.88 and not isnan(score)").select("chat_id", "x", "y").distinct()
    return graph.final_survivors(p, graph.merge_stats(_nodes(spark, folder), _edges(spark, folder)), Cuts(spark, "merge"))


def merged_edges(spark, folder):
    """Edges after all merges, chains followed to their end."""
    e = graph.merge_edge_ends(_edges(spark, folder), final(spark, folder), table(spark, folder, "relationship_kinds"))
    return _key(e).withColumn("created_at", F.unix_micros("created_at")).withColumn("invalid_at", F.unix_micros("invalid_at"))


def _merged(spark, folder):
    """What each edge becomes, written once as several steps read it."""
    return Cuts(spark, "merged").cut(merge.merge(_edges(spark, folder), final(spark, folder), table(spark, folder, "relationship_kinds")))


def rolled_back(spark, folder):
    """All merges and their rollback: the edges as they were."""
    m = _merged(spark, folder)
    back = merge.rollback(merge.edges_after(m), merge.snapshot_of(m))
    return back.select("chat_id", "source_id", "relationship_name", "target_id", F.unix_micros("valid_at").alias("valid_us"), F.unix_micros("invalid_at").alias("invalid_us"),
                       "edge_text", F.unix_micros("created_at").alias("created_us"))


def merge_totals(spark, folder):
    """Edges of each chat before the merges, and how many are accounted for by an outcome."""
    t = merge.tallies(_merged(spark, folder))
    return t.select("chat_id", (F.col("kept") + F.col("moved") + F.col("self_loop") + F.col("deduped") + F.col("invalidated")).alias("edges"), F.col("self_loop").alias("self_loops"))


def rollback_refusals(spark, folder):
    """Of all one-step merges those that could not be rolled back after all merges took place."""
    gone = final(spark, folder)
    left = _nodes(spark, folder).join(gone.select("chat_id", F.col("loser").alias("id")), ["chat_id", "id"], "left_anti")
    one = survivors(spark, folder).groupBy("chat_id", "loser").agg(F.min("survivor").alias("survivor"))
    none = spark.createDataFrame([], "chat_id string, loser string, version int")
    return merge.refusals(left, one, none)


def _last_keys(spark, folder):
    e = table(spark, folder, "memory_edges")
    return e.groupBy("chat_id", "source_id").agg(F.max_by(F.struct(*graph.KEY[2:]), "edge_no").alias("k")).select("chat_id", "source_id", "k.*")


def _outcomes(changed):
    return changed.groupBy("chat_id", "outcome").agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("invalid_at").isNull()).alias("valid"))


def invalidate(spark, folder):
    """The fact each subject wrote last is closed."""
    return _outcomes(merge.set_validity(_edges(spark, folder), _last_keys(spark, folder), F.timestamp_micros(F.lit(SINCE_US))))


def revalidate(spark, folder):
    """It is opened again, together with a fact nobody knows."""
    keys = _last_keys(spark, folder)
    ghost = keys.limit(0).unionByName(spark.createDataFrame([("-1", "ghost", "knows", "ghost")], "chat_id string, source_id string, relationship_name string, target_id string")
                                      .withColumn("valid_at", F.timestamp_micros(F.lit(0))))
    return _outcomes(merge.set_validity(_edges(spark, folder), keys.unionByName(ghost), None))


def alias_links(spark, folder):
    """Matched pairs that no alias edge joins yet; edges of the relationship ``knows`` stand for alias edges."""
    p = _pairs(spark, folder).where("score >= 0.88 and not isnan(score)").select("chat_id", F.col("x").alias("source_id"), F.col("y").alias("target_id"))
    return merge.link_aliases(_edges(spark, folder), p, "knows").select("chat_id", "source_id", "target_id", "relationship_name", F.unix_micros("valid_at").alias("valid_us"))


def alias_dedupe(spark, folder):
    return merge.dedupe_aliases(table(spark, folder, "memory_edges"), list(ALIAS))


def merge_plan(spark, folder):
    best = _pairs(spark, folder).where("score is not null and not isnan(score)").groupBy("chat_id", "x", "y").agg(F.max("score").alias("score"))
    return merge.plan(best, 5).select("chat_id", "x", "y", "score", "place", "verdict")


def _rewritten(pairs, one):
    to = lambda c: one.select("chat_id", F.col("loser").alias(c), F.col("survivor").alias(f"s_{c}"))
    p = pairs.where("not isnan(score)").join(to("x"), ["chat_id", "x"], "left").join(to("y"), ["chat_id", "y"], "left")
    p = p.select("chat_id", F.coalesce("s_x", "x").alias("a"), F.coalesce("s_y", "y").alias("b"), "score").where("a <> b")
    return p.groupBy("chat_id", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.max("score").alias("score"))


def merged_pairs(spark, folder):
    """Scored pairs after all merges, chains followed to their end."""
    return _rewritten(_pairs(spark, folder), final(spark, folder))


def mentions(spark, folder):
    """Senders bound to the Person nodes of their chat by folded name; the node first created wins."""
    m = table(spark, folder, "messages").where("sender_id is not null").select("chat_id", "sender_id", fold_ascii(F.trim("sender_display_name")).alias("n")).distinct()
    p = _nodes(spark, folder).where("node_type = 'Person'").select("chat_id", fold_ascii(F.trim("name")).alias("n"), "id", "created_at")
    return m.join(p, ["chat_id", "n"]).groupBy("chat_id", "sender_id").agg(F.min_by("id", F.struct("created_at", "id")).alias("node_id"))


def names_in_texts(names, texts, gram=4):
    """(chat_id, id, n): names (chat_id, n) that a text (chat_id, id, t) of their chat contains anywhere, blank names in none. A name is looked
    up by its piece of ``gram`` characters (all of it if shorter) that fewest names share, and then compared with the whole text."""
    names = names.where(F.trim("n") != "").distinct()
    size = F.least(F.lit(gram), F.char_length("n"))
    pieces = lambda c, k: F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(c) - k + 1), lambda i: F.col(c).substr(i, k)))
    own = names.select("chat_id", "n", size.alias("k"), F.explode(pieces("n", size)).alias("piece"))
    share = own.groupBy("chat_id", "piece").agg(F.count(F.lit(1)).alias("names"))
    key = own.join(share, ["chat_id", "piece"]).groupBy("chat_id", "n", "k").agg(F.min_by("piece", F.struct("names", "piece")).alias("piece"))
    lengths = key.groupBy("chat_id").agg(F.collect_set("k").alias("lengths"))  # at most gram of them
    t = texts.join(lengths, "chat_id").select("chat_id", "id", "t", F.explode("lengths").alias("k")).where(F.char_length("t") >= F.col("k"))
    t = t.select("chat_id", "id", F.explode(pieces("t", F.col("k"))).alias("piece"))
    maybe = t.join(key.drop("k"), ["chat_id", "piece"]).select("chat_id", "id", "n")
    return maybe.join(texts, ["chat_id", "id"]).where(F.instr("t", F.col("n")) > 0).select("chat_id", "id", "n").distinct()


def promotion(spark, folder):
    """Scored pairs both of whose names a message of the chat contains, anywhere in its text."""
    return _named_together(spark, folder, table(spark, folder, "messages").select("chat_id", "id", "text"))


def promotion_facts(spark, folder):
    """The same for the texts of facts."""
    return _named_together(spark, folder, table(spark, folder, "memory_edges").select("chat_id", F.col("edge_no").alias("id"), F.col("edge_text").alias("text")))


def _named_together(spark, folder, texts):
    c = table(spark, folder, "merge_candidates").where("a_id <> b_id and a_name <> b_name").select("chat_id", fold_ascii("a_name").alias("a"), fold_ascii("b_name").alias("b")).distinct()
    names = c.select("chat_id", F.col("a").alias("n")).union(c.select("chat_id", "b"))
    m = texts.where("text is not null").select("chat_id", "id", fold_ascii("text").alias("t"))
    hit = names_in_texts(names, m)
    a, b = hit.select("chat_id", "id", F.col("n").alias("a")), hit.select("chat_id", "id", F.col("n").alias("b"))
    return c.join(a, ["chat_id", "a"]).join(b, ["chat_id", "b", "id"]).groupBy("chat_id", "a", "b").agg(F.count_distinct("id").alias("messages"))


def _candidates(spark, folder):
    """Recall candidates: a request per person, edges from it (wake) and to it (term), oldest first."""
    e = graph.both_ends(_edges(spark, folder)).join(_people(spark, folder), ["chat_id", "node"], "left_semi")
    origin = F.when(F.col("node") == F.col("source_id"), "wake").otherwise("term")
    seq = F.concat_ws("|", F.lpad(F.unix_micros("created_at").cast("string"), 20, "0"), "source_id", "relationship_name", "target_id", F.unix_micros("valid_at").cast("string"))
    return e.select(F.concat_ws("|", "chat_id", "node").alias("request"), seq.alias("seq"), origin.alias("origin"), "source_id", "relationship_name", "target_id",
                    F.unix_micros("valid_at").alias("valid_at"))


def collapse(spark, folder):
    return recall.collapse_facts(_candidates(spark, folder))


def quota(spark, folder):
    return recall.source_quota(collapse(spark, folder)).select("request", "place", "origin", "source_id", "relationship_name", "target_id")


def not_injected(spark, folder):
    """Presented candidates less those in the ledger of facts already told: the presented ones of place 1."""
    q = quota(spark, folder)
    ledger = q.where("place = 1").select("source_id", "relationship_name", "target_id").distinct()
    return q.join(ledger, ["source_id", "relationship_name", "target_id"], "left_anti")


def _queries(v):
    return v.where("vec_id % 20 = 0")


def knn(spark, folder):
    v = table(spark, folder, "embeddings")
    return vector.nearest(_queries(v), v, 10).select("query_id", "rank", "vec_id", F.round("similarity", 6).alias("similarity"))


def vec_merge(spark, folder, k=5, least=MATCH):
    v = table(spark, folder, "embeddings")
    m = vector.unordered_matches(vector.nearest(v, v, k), v.select("vec_id", (F.col("label") % 2).alias("kind")), least)
    return m.select("x", "y", F.round("similarity", 6).alias("similarity"))


def vec_bands(spark, folder):
    m = vec_merge(spark, folder, 32, BAND)
    band = F.when(F.col("similarity") >= 0.35, "merge").when(F.col("similarity") >= MATCH, "high").otherwise("low")
    return m.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("pairs"), F.max("similarity").alias("best"))


def node_ids(spark, folder):
    n = _nodes(spark, folder)
    norm = ids.normalized(F.col("name"))
    return n.select("chat_id", "id", norm.alias("normalized"), ids.uuid_of(F.concat(F.lit("concept:"), norm)).alias("concept_id"),
                    ids.content_hash(F.col("name"), F.get_json_object("properties", "$.description")).alias("content_hash"))


def _graph(f):
    return lambda s, d: f(_edges(s, d), s, d)


QUERIES = {
    "q_upsert_nodes": nodes, "q_upsert_edges": edges,
    "q_graph_neighbors": _graph(lambda e, s, d: graph.neighbors(e, _people(s, d))),
    "q_graph_two_hop": _graph(lambda e, s, d: _key(graph.two_hop(e, _people(s, d), SINCE_US))),
    "q_graph_alias_targets": _graph(lambda e, s, d: graph.alias_targets(e, ALIAS)),
    "q_graph_resolution_info": _graph(lambda e, s, d: graph.resolution_info(_nodes(s, d), e, ALIAS)),
    "q_graph_linked_pairs": unlinked, "q_graph_hydrate": hydrate, "q_graph_facts": facts,
    "q_graph_merge_stats": _graph(lambda e, s, d: graph.merge_stats(_nodes(s, d), e)),
    "q_graph_topics": _graph(lambda e, s, d: graph.topics(_nodes(s, d), e)),
    "q_merge_invariant": _graph(lambda e, s, d: _key(graph.one_winner(e, table(s, d, "relationship_kinds")))),
    "q_write_invalidate": lambda s, d: _key(graph.last_write_wins(table(s, d, "memory_edges"), table(s, d, "relationship_kinds"))),
    "q_merge_survivor": survivors, "q_merge_repoint": merged_edges, "q_pairs_rewrite": merged_pairs,
    "q_merge_final": final, "q_merge_edges": merged_edges, "q_merge_pairs": merged_pairs,
    "q_merge_rollback": rolled_back, "q_merge_totals": merge_totals, "q_rollback_refusals": rollback_refusals, "q_invalidate": invalidate, "q_revalidate": revalidate,
    "q_link_alias": alias_links, "q_alias_dedupe": alias_dedupe, "q_merge_plan": merge_plan,
    "q_alias_audit": lambda s, d: graph.alias_audit(table(s, d, "memory_edges")),
    "q_reconcile_edge_text_diff": edge_text_diff, "q_reconcile_missing": missing_names, "q_embed_ids_union": ids_union, "q_reconcile_orphans": orphans,
    "q_text_search": text_search, "q_name_validation": name_validation, "q_resolve_mentions": mentions, "q_promotion_pairs": promotion, "q_promotion_facts": promotion_facts,
    "q_recall_collapse": collapse, "q_recall_quota": quota, "q_recall_dedup_injected": not_injected,
    "q_recall_presented": quota, "q_recall_presented_new": not_injected,
    "q_vec_knn": knn, "q_vec_merge_scan": vec_merge, "q_vec_pair_bands": vec_bands, "q_ids_and_hashes": node_ids,
}

NODES = """nodes as (select chat_id, id, arg_min(name, (updated_at, name)) as name, arg_min(node_type, (updated_at, name)) as node_type,
  arg_min(created_at, (updated_at, name)) as created_at, max(updated_at) as updated_at,
  arg_max(properties, (updated_at, name)) filter (properties is not null) as properties from memory_nodes group by chat_id, id)"""
FOLD = """select chat_id, source_id, relationship_name, target_id, valid_at, arg_max(invalid_at, (updated_at, edge_no)) filter (invalid_at is not null) as invalid_at,
  arg_max(edge_text, (updated_at, edge_no)) as edge_text, arg_min(created_at, (updated_at, edge_no)) as created_at, max(updated_at) as updated_at,
  arg_max(properties, (updated_at, edge_no)) filter (properties is not null) as properties from memory_edges"""
EDGES = f"edges as ({FOLD} group by 1, 2, 3, 4, 5)"
ENDS = """ends as (select *, source_id as node, target_id as other from {0} union all select *, target_id, source_id from {0} where source_id <> target_id)"""
VALID = "valid as (select * from edges where invalid_at is null)"
PEOPLE = "people as (select distinct chat_id, id as node from memory_nodes where node_type = 'Person')"
NEW = "order by created_at desc, valid_at desc, source_id, target_id, relationship_name"
PAIRS = "pairs as (select chat_id, least(a_id, b_id) as x, greatest(a_id, b_id) as y, score from merge_candidates where a_id <> b_id)"
KEYS = "chat_id, source_id, relationship_name, target_id, epoch_us(valid_at) as valid_us"
STATS = f"""{ENDS.format('edges')}, deg as (select chat_id, node as id, count(*) as degree from ends group by 1, 2),
  stats as (select n.chat_id, n.id, coalesce(degree, 0) as degree, epoch_us(created_at) as created_us from nodes n left join deg using (chat_id, id))"""
SURV = f"""{NODES}, {EDGES}, {STATS}, {PAIRS}, m as (select distinct chat_id, x, y from pairs where score >= 0.88 and not isnan(score)),
  r as (select m.*, (-coalesce(a.degree, 0), coalesce(a.created_us, 4611686018427387904), x) <= (-coalesce(b.degree, 0), coalesce(b.created_us, 4611686018427387904), y) as xw
    from m left join stats a on a.chat_id = m.chat_id and a.id = x left join stats b on b.chat_id = m.chat_id and b.id = y),
  surv as (select chat_id, case when xw then x else y end as survivor, case when xw then y else x end as loser from r),
  one as (select chat_id, loser, min(survivor) as survivor from surv group by 1, 2)"""
CAND = f"""{EDGES}, {PEOPLE}, {ENDS.format('edges')}, cand as (select chat_id || '|' || node as request,
  lpad(cast(epoch_us(created_at) as varchar), 20, '0') || '|' || source_id || '|' || relationship_name || '|' || target_id || '|' || epoch_us(valid_at) as seq,
  case when node = source_id then 'wake' else 'term' end as origin, source_id, relationship_name, target_id, epoch_us(valid_at) as valid_at
  from ends join people using (chat_id, node)),
  coll as (select request, source_id, relationship_name, target_id, min(seq) as seq, arg_min(origin, seq) as origin, max(valid_at) as valid_at from cand group by 1, 2, 3, 4)"""
QUOTA = f"""{CAND}, rk as (select *, row_number() over (partition by request, origin order by seq) as rank from coll),
  bl as (select *, case when origin = 'wake' then 0 else 1 end + case when rank > case when origin = 'wake' then 24 else 16 end then 2 else 0 end as block from rk),
  pl as (select *, row_number() over (partition by request order by block, rank) as place from bl),
  quota as (select request, place, origin, source_id, relationship_name, target_id from pl where place <= 40)"""
ALL_LOW = _low = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')".format
SIM = """sim as (select q.vec_id as query_id, r.vec_id, list_cosine_similarity(cast(q.embedding as double[]), cast(r.embedding as double[])) as similarity
  from embeddings q, embeddings r {0}), rk as (select *, row_number() over (partition by query_id order by round(similarity, 9) desc, vec_id) as rank from sim)"""
MATCHES = """m as (select least(query_id, rk.vec_id) as x, greatest(query_id, rk.vec_id) as y, max(similarity) as s from rk join embeddings a on a.vec_id = query_id
  join embeddings b on b.vec_id = rk.vec_id where rank <= {0} and query_id <> rk.vec_id and similarity >= {1} and a.label % 2 = b.label % 2 group by 1, 2)"""

FINAL = f"""{NODES}, {EDGES}, {STATS}, {PAIRS}, m as (select distinct chat_id, x, y from pairs where score >= 0.88 and not isnan(score)),
  sy as (select chat_id, x as u, y as v from m union select chat_id, y, x from m), reach(chat_id, n, o) as (select chat_id, u, v from sy union select r.chat_id, r.n, sy.v from reach r join sy on sy.chat_id = r.chat_id and sy.u = r.o),
  ranked as (select r.chat_id, r.n, r.o, (-coalesce(degree, 0), coalesce(created_us, 4611686018427387904), r.o) as k from reach r left join stats s on s.chat_id = r.chat_id and s.id = r.o),
  final as (select chat_id, n as loser, arg_min(o, k) as survivor from ranked group by 1, 2 having arg_min(o, k) <> n)"""
LAST = """lk as (select distinct chat_id, source_id, relationship_name, target_id, valid_at from (select * from memory_edges qualify row_number() over (partition by chat_id, source_id order by edge_no desc) = 1))"""
LASTJ = "e.chat_id = k.chat_id and e.source_id = k.source_id and e.relationship_name = k.relationship_name and e.target_id = k.target_id and e.valid_at = k.valid_at"

# merges in order of the loser: an edge is dropped if one that stays before it says the same, which is not transitive, so the rows of two nodes are taken one by one
MERGED = f"""{FINAL}, mv as (select e.chat_id, coalesce(a.survivor, source_id) as s, relationship_name as r, coalesce(b.survivor, target_id) as t, valid_at, invalid_at, edge_text, created_at,
    a.survivor is not null or b.survivor is not null as moved, greatest(case when a.survivor is not null then source_id end, case when b.survivor is not null then target_id end) as turn, source_id as os, target_id as ot
    from edges e left join final a on a.chat_id = e.chat_id and a.loser = source_id left join final b on b.chat_id = e.chat_id and b.loser = target_id),
  kept as (select * from mv where s <> t or not moved),
  lined as (select *, row_number() over (partition by chat_id, s, r, t order by moved, turn, created_at, os, ot, valid_at) as n from kept where invalid_at is null),
  walk(chat_id, s, r, t, n, texts, starts, stays) as (select chat_id, s, r, t, n, [edge_text], [valid_at], true from lined where n = 1 union all
    select chat_id, s, r, t, n, case when x then texts || [edge_text] else texts end, case when x then starts || [valid_at] else starts end, x
    from (select l.*, w.texts, w.starts, not l.moved or not (list_contains(w.texts, l.edge_text) or list_contains(w.starts, l.valid_at)) as x
      from lined l join walk w on w.chat_id = l.chat_id and w.s = l.s and w.r = l.r and w.t = l.t and l.n = w.n + 1)),
  live as (select l.* from lined l join walk w using (chat_id, s, r, t, n) where stays),
  stay as (select distinct chat_id, survivor as s from final),
  lose as (select chat_id, s, r, t, valid_at from live join stay using (chat_id, s) where r in (select relationship_name from relationship_kinds where single_value)
    qualify row_number() over (partition by chat_id, s, r order by valid_at desc, t) > 1)
  select chat_id, s as source_id, r as relationship_name, t as target_id, epoch_us(valid_at) as valid_us, epoch_us(invalid_at) as invalid_at, edge_text, epoch_us(created_at) as created_at,
    not exists (select 1 from lose o where o.chat_id = live.chat_id and o.s = live.s and o.r = live.r and o.t = live.t and o.valid_at = live.valid_at) as still_valid from live
  union all select chat_id, s, r, t, epoch_us(valid_at), epoch_us(invalid_at), edge_text, epoch_us(created_at), false from kept where invalid_at is not null"""

SQL = {
    "q_merge_repoint": f"with recursive {MERGED}",
    "q_merge_edges": f"with recursive {MERGED}",
    "q_merge_final": f"with recursive {FINAL} select * from final",
    "q_merge_pairs": f"""with recursive {FINAL}, p as (select pairs.chat_id, coalesce(a.survivor, x) as a, coalesce(b.survivor, y) as b, score from pairs
        left join final a on a.chat_id = pairs.chat_id and a.loser = x left join final b on b.chat_id = pairs.chat_id and b.loser = y where not isnan(score))
        select chat_id, least(a, b) as x, greatest(a, b) as y, max(score) as score from p where a <> b group by 1, 2, 3""",
    "q_pairs_rewrite": f"""with recursive {FINAL}, p as (select pairs.chat_id, coalesce(a.survivor, x) as a, coalesce(b.survivor, y) as b, score from pairs
        left join final a on a.chat_id = pairs.chat_id and a.loser = x left join final b on b.chat_id = pairs.chat_id and b.loser = y where not isnan(score))
        select chat_id, least(a, b) as x, greatest(a, b) as y, max(score) as score from p where a <> b group by 1, 2, 3""",
    "q_merge_rollback": f"with {EDGES} select {KEYS}, epoch_us(invalid_at) as invalid_us, edge_text, epoch_us(created_at) as created_us from edges",
    "q_merge_totals": f"""with recursive {FINAL}, mv as (select e.chat_id, coalesce(a.survivor, source_id) as s, coalesce(b.survivor, target_id) as t, a.survivor is not null or b.survivor is not null as moved
        from edges e left join final a on a.chat_id = e.chat_id and a.loser = source_id left join final b on b.chat_id = e.chat_id and b.loser = target_id)
        select chat_id, count(*) as edges, count(*) filter (s = t and moved) as self_loops from mv group by 1""",
    "q_rollback_refusals": f"""with recursive {FINAL}, r as (select m.*, (-coalesce(a.degree, 0), coalesce(a.created_us, 4611686018427387904), x) <= (-coalesce(b.degree, 0), coalesce(b.created_us, 4611686018427387904), y) as xw
        from m left join stats a on a.chat_id = m.chat_id and a.id = x left join stats b on b.chat_id = m.chat_id and b.id = y),
        one as (select chat_id, case when xw then y else x end as loser, min(case when xw then x else y end) as survivor from r group by 1, 2),
        left_ as (select chat_id, id from nodes except select chat_id, loser from final)
        select * from (select one.chat_id, one.loser, one.survivor, case when s.id is null then 'survivor_missing' when l.id is not null then 'loser_exists' end as reason from one
        left join left_ s on s.chat_id = one.chat_id and s.id = one.survivor left join left_ l on l.chat_id = one.chat_id and l.id = one.loser) where reason is not null""",
    "q_invalidate": f"""with {EDGES}, {LAST}, j as (select e.*, case when k.chat_id is null then 'untouched' when invalid_at is not null then 'already' else 'changed' end as outcome from edges e left join lk k on {LASTJ})
        select chat_id, outcome, count(*) as edges, count(*) filter (invalid_at is null and outcome <> 'changed') as valid from j group by 1, 2""",
    "q_revalidate": f"""with {EDGES}, {LAST}, j as (select e.*, case when k.chat_id is null then 'untouched' when invalid_at is null then 'already' else 'changed' end as outcome from edges e left join lk k on {LASTJ})
        select chat_id, outcome, count(*) as edges, count(*) filter (invalid_at is null or outcome = 'changed') as valid from j group by 1, 2 union all select '-1', 'unknown', 1, 1""",
    "q_link_alias": f"""with {PAIRS} select distinct chat_id, x as source_id, y as target_id, 'knows' as relationship_name, cast(0 as bigint) as valid_us from pairs p where score >= 0.88 and not isnan(score)
        and not exists (select 1 from memory_edges e where e.chat_id = p.chat_id and e.source_id = x and e.target_id = y and e.relationship_name = 'knows')""",
    "q_alias_dedupe": """select edge_no, case when row_number() over (partition by chat_id, source_id, target_id order by valid_at, edge_no) > 1 then 'remove' when epoch_us(valid_at) <> 0 then 'align' else 'keep' end as action
        from memory_edges where relationship_name = 'knows'""",
    "q_merge_plan": f"""with {PAIRS}, b as (select chat_id, x, y, max(score) as score from pairs where score is not null and not isnan(score) group by 1, 2, 3),
        r as (select *, row_number() over (partition by chat_id order by score desc, x, y) as place from b)
        select *, case when place > 5 then 'skipped' when score >= 0.88 then 'same' when score >= 0.75 then 'related' else 'different' end as verdict from r""",
    "q_upsert_nodes": f"with {NODES} select chat_id, id, name, node_type, epoch_us(created_at) as created_us, epoch_us(updated_at) as updated_us, properties from nodes",
    "q_upsert_edges": f"with {EDGES} select {KEYS}, epoch_us(invalid_at) as invalid_us, edge_text, epoch_us(created_at) as created_us, properties from edges",
    "q_graph_neighbors": f"""with {EDGES}, v as (select * from edges where invalid_at is null and relationship_name <> 'contains'), {PEOPLE}, {ENDS.format('v')},
        r as (select *, row_number() over (partition by chat_id, node {NEW}) as rank from ends join people using (chat_id, node))
        select chat_id, node, other, relationship_name, epoch_us(valid_at) as valid_us, rank from r where rank <= 500""",
    "q_graph_two_hop": f"""with {EDGES}, v as (select * from edges where invalid_at is null and relationship_name not in ('contains', 'known_as')
        and (epoch_us(valid_at) >= {SINCE_US} or epoch_us(created_at) >= {SINCE_US} or relationship_name = 'also_known_as')), {PEOPLE}, {ENDS.format('v')},
        h1 as (select ends.* from ends join people using (chat_id, node) qualify row_number() over (partition by chat_id, node {NEW}) <= 500),
        front as (select distinct chat_id, other as node from h1 except select chat_id, node from people),
        h2 as (select ends.* from ends join front using (chat_id, node) qualify row_number() over (partition by chat_id, node {NEW}) <= 500)
        select {KEYS}, cast(min(hop) as bigint) as hop from (select *, 1 as hop from h1 union all select *, 2 from h2) group by 1, 2, 3, 4, valid_at""",
    "q_graph_alias_targets": f"with {EDGES}, {VALID} select distinct chat_id, target_id as alias_id, source_id from valid where relationship_name = 'knows'",
    "q_graph_resolution_info": f"""with {NODES}, {EDGES}, {VALID}, t as (select chat_id, target_id as id, count(distinct source_id) as n, min(source_id) as s from valid
        where relationship_name = 'knows' group by 1, 2) select nodes.chat_id, nodes.id, node_type, coalesce(n, 0) as targets, case when n = 1 and node_type = 'Alias' then s end as target_id
        from nodes left join t using (chat_id, id)""",
    "q_graph_linked_pairs": f"""with {EDGES}, {PAIRS} select distinct chat_id, x, y from pairs p where not exists (select 1 from edges e where e.chat_id = p.chat_id
        and least(source_id, target_id) = x and greatest(source_id, target_id) = y)""",
    "q_graph_hydrate": f"""with {NODES}, {EDGES}, {VALID} select v.chat_id, source_id, a.name as source_name, relationship_name, target_id, b.name as target_name, epoch_us(valid_at) as valid_us
        from valid v join nodes a on a.chat_id = v.chat_id and a.id = source_id join nodes b on b.chat_id = v.chat_id and b.id = target_id""",
    "q_graph_facts": f"""with {EDGES}, {PEOPLE}, {ENDS.format('edges')} select chat_id, node, count(*) as facts, count(*) filter (invalid_at is null) as valid, epoch_us(max(valid_at)) as newest_us
        from ends join people using (chat_id, node) group by 1, 2""",
    "q_graph_merge_stats": f"with {NODES}, {EDGES}, {STATS} select chat_id, id, degree, created_us from stats",
    "q_graph_topics": f"""with {NODES}, {EDGES}, {VALID}, {ENDS.format('valid')}, d as (select chat_id, node as id, count(*) as degree, greatest(max(valid_at), max(created_at)) as active from ends group by 1, 2),
        r as (select n.chat_id, n.id, coalesce(degree, 0) as degree, epoch_us(active) as active_us,
          row_number() over (partition by n.chat_id order by coalesce(degree, 0) desc, n.id) as rank from nodes n left join d using (chat_id, id) where node_type = 'Concept')
        select chat_id, id, degree, active_us, rank from r where rank <= 20""",
    "q_merge_invariant": f"""with {EDGES}, {VALID}, r as (select v.*, row_number() over (partition by chat_id, source_id, relationship_name order by valid_at desc, target_id) as place
        from valid v join relationship_kinds k using (relationship_name) where single_value) select {KEYS} from r where place > 1""",
    "q_write_invalidate": f"""with e as (select chat_id, source_id, relationship_name, target_id, valid_at, max(edge_no) as seq from memory_edges join relationship_kinds using (relationship_name)
        where single_value group by 1, 2, 3, 4, 5) select {KEYS}, row_number() over (partition by chat_id, source_id, relationship_name order by seq desc) = 1 as still_valid from e""",
    "q_merge_survivor": f"with {SURV} select chat_id, survivor, loser from surv",
    "q_alias_audit": """with p as (select chat_id, source_id, relationship_name, target_id, count(*) as n from memory_edges group by 1, 2, 3, 4)
        select chat_id, cast(sum(n) as bigint) as rows, count(*) as facts, cast(sum(n - 1) as bigint) as duplicates, count(*) filter (source_id = target_id) as self_loops, max(n) as most_rows from p group by 1""",
    "q_reconcile_edge_text_diff": f"""with {EDGES}, old as ({FOLD} where edge_no <= (select max(edge_no) // 2 from memory_edges) group by 1, 2, 3, 4, 5),
        j as (select coalesce(g.chat_id, o.chat_id) as chat_id, coalesce(g.source_id, o.source_id) as source_id, coalesce(g.relationship_name, o.relationship_name) as relationship_name,
          coalesce(g.target_id, o.target_id) as target_id, coalesce(g.valid_at, o.valid_at) as valid_at,
          case when g.chat_id is null then 'delete' when (o.chat_id is null or g.edge_text is distinct from o.edge_text) and coalesce(g.edge_text, '') <> '' then 'upsert' end as action
        from edges g full join old o on g.chat_id = o.chat_id and g.source_id = o.source_id and g.relationship_name = o.relationship_name and g.target_id = o.target_id and g.valid_at = o.valid_at)
        select {KEYS}, action from j where action is not null""",
    "q_reconcile_missing": f"""with {NODES}, s as (select chat_id, id, max(name) as name from (select chat_id, a_id as id, a_name as name from merge_candidates
        union all select chat_id, b_id, b_name from merge_candidates) where id is not null group by 1, 2)
        select * from (select coalesce(n.chat_id, s.chat_id) as chat_id, coalesce(n.id, s.id) as id, case when n.id is null then 'delete'
        when (s.id is null or n.name is distinct from s.name) and coalesce(n.name, '') <> '' then 'upsert' end as action from nodes n full join s on n.chat_id = s.chat_id and n.id = s.id) where action is not null""",
    "q_embed_ids_union": "select chat_id, id from memory_nodes union select chat_id, a_id from merge_candidates where a_id is not null union select chat_id, b_id from merge_candidates where b_id is not null",
    "q_reconcile_orphans": """select distinct chat_id, id from (select chat_id, id from memory_nodes union select chat_id, a_id from merge_candidates
        union select chat_id, b_id from merge_candidates) n where id is not null and not exists (select 1 from memory_edges e where e.chat_id = n.chat_id and n.id in (source_id, target_id))""",
    "q_text_search": f"""with t(term) as (values ('street FOOD'), ('100%'), ('someone_'), ('КАРАОКЕ'), ('さん'), (' '))
        select term, count(*) as hits, min(edge_no) as first_edge from memory_edges, t where trim(term) <> '' and instr({_low('edge_text')}, {_low('term')}) > 0 group by 1""",
    "q_name_validation": f"""select relationship_name as given, case when regexp_full_match(relationship_name, '[a-z][a-z0-9_]{{0,63}}')
        and relationship_name not in ({', '.join(f"'{r}'" for r in RESERVED)}) then relationship_name else 'related_to' end as kept, count(*) as n from memory_edges group by 1, 2""",
    "q_resolve_mentions": f"""with {NODES}, m as (select distinct chat_id, sender_id, {_low('trim(sender_display_name)')} as n from messages where sender_id is not null)
        select m.chat_id, sender_id, arg_min(p.id, (p.created_at, p.id)) as node_id from m join nodes p on p.chat_id = m.chat_id and {_low('trim(p.name)')} = n and node_type = 'Person' group by 1, 2""",
    "q_promotion_pairs": f"""with c as (select distinct chat_id, {_low('a_name')} as a, {_low('b_name')} as b from merge_candidates where a_id <> b_id and a_name <> b_name and trim(a_name) <> '' and trim(b_name) <> ''),
        t as (select chat_id, id, {_low('text')} as t from messages where text is not null)
        select c.chat_id, a, b, count(distinct t.id) as messages from c join t on t.chat_id = c.chat_id and contains(t, a) and contains(t, b) group by 1, 2, 3""",
    "q_promotion_facts": f"""with c as (select distinct chat_id, {_low('a_name')} as a, {_low('b_name')} as b from merge_candidates where a_id <> b_id and a_name <> b_name and trim(a_name) <> '' and trim(b_name) <> ''),
        t as (select chat_id, edge_no as id, {_low('edge_text')} as t from memory_edges where edge_text is not null)
        select c.chat_id, a, b, count(distinct t.id) as messages from c join t on t.chat_id = c.chat_id and contains(t, a) and contains(t, b) group by 1, 2, 3""",
    "q_recall_collapse": f"with {CAND} select request, source_id, relationship_name, target_id, seq, origin, valid_at from coll",
    "q_recall_presented": f"with {QUOTA} select * from quota",
    "q_recall_presented_new": f"""with {QUOTA} select * from quota q where not exists (select 1 from quota l where l.place = 1 and l.source_id = q.source_id
        and l.relationship_name = q.relationship_name and l.target_id = q.target_id)""",
    "q_recall_quota": f"with {QUOTA} select * from quota",
    "q_recall_dedup_injected": f"""with {QUOTA} select * from quota q where not exists (select 1 from quota l where l.place = 1 and l.source_id = q.source_id
        and l.relationship_name = q.relationship_name and l.target_id = q.target_id)""",
    "q_vec_knn": f"with {SIM.format('where q.vec_id % 20 = 0')} select query_id, rank, vec_id, round(similarity, 6) as similarity from rk where rank <= 10",
    "q_vec_merge_scan": f"with {SIM.format('')}, {MATCHES.format(5, MATCH)} select x, y, round(s, 6) as similarity from m",
    "q_vec_pair_bands": f"""with {SIM.format('')}, {MATCHES.format(32, BAND)}, r as (select round(s, 6) as s from m)
        select case when s >= 0.35 then 'merge' when s >= {MATCH} then 'high' else 'low' end as band, count(*) as pairs, max(s) as best from r group by 1""",
}
