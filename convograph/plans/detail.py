"""Reports and reads that combine several operators: facts of a node, status, reconcile counts, alias quality, batch writes."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import RESERVED
from ..operators import graph, lab, log
from ..sources import table
from .graph import ALIAS, EDGES, ENDS, NODES, VALID, _edges, _key, _nodes, knn


def node_content(spark, folder):
    """Name and description of every node; an absent description is empty."""
    n = _nodes(spark, folder)
    return n.select("chat_id", "id", "name", F.coalesce(F.get_json_object("properties", "$.description"), F.lit("")).alias("description"))


def fact_rows(spark, folder):
    """The facts of each person, valid and invalid: an alias with one target is asked as that target. Place is by start, newest first."""
    e, n = _edges(spark, folder), _nodes(spark, folder)
    entry = graph.resolution_info(n, e, ALIAS).where("node_type in ('Person', 'Alias')").select("chat_id", F.col("id").alias("asked"), F.coalesce("target_id", "id").alias("node"))
    seen = graph.both_ends(e).join(entry, ["chat_id", "node"])
    w = Window.partitionBy("chat_id", "asked").orderBy(F.desc("valid_at"), "relationship_name", "other", "source_id")
    r = seen.withColumn("place", F.row_number().over(w).cast("long"))
    return r.select("chat_id", "asked", "node", "place", "relationship_name", "other", F.unix_micros("valid_at").alias("valid_us"), F.col("invalid_at").isNull().alias("valid"))


def status_report(spark, folder):
    """One row a chat: rows by direction, dead letters, state keys, newest id."""
    m = table(spark, folder, "messages").where("chat_id is not null")
    base = m.groupBy("chat_id").agg(F.count_if(F.col("direction") == "inbound").alias("inbound"), F.count_if(F.col("direction") == "outbound").alias("outbound"), F.max("id").alias("newest_id"))
    dead = m.where("sender_id is null and event_type in ('message', 'edit')").groupBy("chat_id").agg(F.count(F.lit(1)).alias("dead"))
    state = m.where("sender_id is not null").groupBy("chat_id").agg(F.count_distinct("sender_id").alias("state_keys"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return base.join(dead, "chat_id", "left").join(state, "chat_id", "left").select("chat_id", "inbound", "outbound", "newest_id", zero("dead"), zero("state_keys"))


def reconcile_counts(spark, folder):
    """How many texts of each chat would be written and removed to bring the text table, as of half of the rows, in line with the graph."""
    rows = table(spark, folder, "memory_edges")
    old = rows.join(F.broadcast(rows.agg(F.floor(F.max("edge_no") / 2).alias("h")))).where("edge_no <= h").drop("h")
    d = graph.set_difference(graph.merge_edges(rows), graph.merge_edges(old), graph.KEY, "edge_text")
    return d.groupBy("chat_id").agg(F.count_if(F.col("action") == "upsert").alias("upserted"), F.count_if(F.col("action") == "delete").alias("pruned"))


def alias_quality(spark, folder):
    """Alias rows of each chat (``knows`` stands for them): all, different facts, repeated ones, self-loops, closed ones, those whose start is not the
    epoch, most rows of a fact, and a hash of which nodes they join that does not depend on order."""
    a = table(spark, folder, "memory_edges").where(F.col("relationship_name").isin(*ALIAS))
    key = ["chat_id", "source_id", "target_id"]
    per = a.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("invalid_at").isNotNull()).alias("stale"), F.count_if(F.unix_micros("valid_at") != 0).alias("off"))
    pair = F.conv(F.substring(F.md5(F.concat_ws("|", "source_id", "target_id").cast("binary")), 1, 12), 16, 10).cast("decimal(38,0)")
    return per.groupBy("chat_id").agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("facts"), F.sum(F.col("n") - 1).alias("duplicates"), F.count_if(F.col("source_id") == F.col("target_id")).alias("self_loops"),
        F.sum("stale").alias("stale"), F.sum("off").alias("misaligned"), F.max("n").alias("most_rows"), F.sum(pair).cast("string").alias("topology"))


def batch_write(spark, folder):
    """Facts after the second half of the rows was written as a batch: stored facts of a single-valued relationship give way to the last one the batch brings for their
    subject, never to their own key."""
    rows = table(spark, folder, "memory_edges")
    half = rows.join(F.broadcast(rows.agg(F.floor(F.max("edge_no") / 2).alias("h"))))
    batch = half.where("edge_no > h").drop("h")
    kinds = table(spark, folder, "relationship_kinds").where("single_value").select("relationship_name")
    subject = ["chat_id", "source_id", "relationship_name"]
    last = batch.join(F.broadcast(kinds), "relationship_name", "left_semi").groupBy(*subject).agg(F.max_by(F.struct("target_id", "valid_at"), "edge_no").alias("w"))
    e = graph.merge_edges(rows).join(last, subject, "left")
    own = (F.col("w.target_id") == F.col("target_id")) & (F.col("w.valid_at") == F.col("valid_at"))
    return _key(e.withColumn("valid", F.col("invalid_at").isNull() & (F.col("w").isNull() | own)).select(*graph.KEY, "valid"))


def related_names(spark, folder):
    """Relationship names as they would be stored, with the name that was given kept where it had to change."""
    r = F.col("relationship_name")
    ok = r.rlike("^[a-z][a-z0-9_]{0,63}$") & ~r.isin(RESERVED)
    e = table(spark, folder, "memory_edges").where("relationship_name is not null").select("edge_no", r.alias("given"), F.when(ok, r).otherwise("related_to").alias("kept"))
    return e.select("edge_no", "kept", F.when(F.col("kept") != F.col("given"), F.to_json(F.struct(F.col("given").alias("original_relationship")))).alias("properties"))


def band_sample(spark, folder):
    """Of the pairs with a middling score 300, drawn by digest."""
    c = table(spark, folder, "merge_candidates").where("score >= 0.75 and score < 0.88 and a_id is not null and b_id is not null")
    p = c.groupBy("chat_id", F.least("a_id", "b_id").alias("x"), F.greatest("a_id", "b_id").alias("y")).agg(F.max("score").alias("score"))
    return p.orderBy(lab.shuffled("chat_id", "x", "y"), "chat_id", "x", "y").limit(300)


def sorted_pairs(spark, folder):
    """Matched pairs of each chat in order of score, then ids, with those that an edge joins left out."""
    c = table(spark, folder, "merge_candidates").where("score >= 0.88 and not isnan(score) and a_id <> b_id")
    p = c.groupBy("chat_id", F.least("a_id", "b_id").alias("x"), F.greatest("a_id", "b_id").alias("y")).agg(F.max("score").alias("score"))
    w = Window.partitionBy("chat_id").orderBy(F.desc("score"), "x", "y")
    return graph.unlinked(p, _edges(spark, folder)).withColumn("place", F.row_number().over(w).cast("long"))


def engaged_unseen(spark, folder):
    """Replies to the bot within half an hour that are no redelivery of an earlier row."""
    m = table(spark, folder, "messages")
    first = log.first_writes(m).select("id")
    sent = log.first_by(m.where("direction = 'outbound'"), False, F.unix_timestamp("timestamp").alias("t")).withColumnRenamed("platform_msg_id", "reply_to_platform_msg_id")
    r = m.where("direction = 'inbound'").join(first, "id", "left_semi").join(sent, ["chat_id", "reply_to_platform_msg_id"])
    at = F.unix_timestamp("timestamp")
    return r.where((at > F.col("t")) & (at <= F.col("t") + 1800)).select("chat_id", "id", F.col("reply_to_platform_msg_id").alias("answered"))


def predicate_recall(spark, folder):
    """How far nearest vectors share their label, by rank: the share of hits of the asked vector's label."""
    v = table(spark, folder, "embeddings")
    lab_ = lambda n, c: v.select(F.col("vec_id").alias(c), F.col("label").alias(n))
    k = knn(spark, folder).join(lab_("a", "query_id"), "query_id").join(lab_("b", "vec_id"), "vec_id")
    return k.groupBy("rank").agg(F.round(F.avg((F.col("a") == F.col("b")).cast("double")), 9).alias("same_label"), F.count(F.lit(1)).alias("n"))


QUERIES = {
    "q_node_content": node_content, "q_graph_fact_rows": fact_rows, "q_status_report": status_report, "q_reconcile_counts": reconcile_counts, "q_alias_quality": alias_quality,
    "q_batch_write": batch_write, "q_relationship_properties": related_names, "q_band_sample": band_sample, "q_pairs_sorted": sorted_pairs, "q_engagement_replies": engaged_unseen,
    "q_vec_label_agreement": predicate_recall,
}

SQL = {
    "q_node_content": f"with {NODES} select chat_id, id, name, coalesce(properties ->> '$.description', '') as description from nodes",
    "q_graph_fact_rows": f"""with {NODES}, {EDGES}, {VALID}, t as (select chat_id, target_id as id, count(distinct source_id) as k, min(source_id) as s from valid where relationship_name = 'knows' group by 1, 2),
        en as (select n.chat_id, n.id as asked, case when k = 1 and node_type = 'Alias' then s else n.id end as node from nodes n left join t on t.chat_id = n.chat_id and t.id = n.id where node_type in ('Person', 'Alias')), {ENDS.format('edges')}
        select ends.chat_id, asked, ends.node, row_number() over (partition by ends.chat_id, asked order by valid_at desc, relationship_name, other, source_id) as place, relationship_name, other, epoch_us(valid_at) as valid_us, invalid_at is null as valid
        from ends join en on en.chat_id = ends.chat_id and en.node = ends.node""",
    "q_status_report": """select chat_id, count(*) filter (direction = 'inbound') as inbound, count(*) filter (direction = 'outbound') as outbound, max(id) as newest_id,
        count(*) filter (sender_id is null and event_type in ('message', 'edit')) as dead, count(distinct sender_id) as state_keys from messages where chat_id is not null group by 1""",
    "q_reconcile_counts": """with h as (select max(edge_no) // 2 as h from memory_edges),
        k as (select chat_id, source_id, relationship_name, target_id, valid_at, arg_max(edge_text, (updated_at, edge_no)) as now_, arg_max(edge_text, (updated_at, edge_no)) filter (edge_no <= h) as was, min(edge_no) <= any_value(h) as there from memory_edges, h group by all)
        select * from (select chat_id, count(*) filter ((not there or now_ is distinct from was) and coalesce(now_, '') <> '') as upserted, cast(0 as bigint) as pruned from k group by 1) where upserted > 0""",
    "q_alias_quality": """with p as (select chat_id, source_id, target_id, count(*) as n, count(invalid_at) as stale, count(*) filter (epoch_us(valid_at) <> 0) as off from memory_edges where relationship_name = 'knows' group by 1, 2, 3)
        select chat_id, cast(sum(n) as bigint) as rows, count(*) as facts, cast(sum(n - 1) as bigint) as duplicates, count(*) filter (source_id = target_id) as self_loops, cast(sum(stale) as bigint) as stale, cast(sum(off) as bigint) as misaligned,
        max(n) as most_rows, cast(sum(cast('0x' || substr(md5(source_id || '|' || target_id), 1, 12) as bigint)) as varchar) as topology from p group by 1""",
    "q_batch_write": f"""with {EDGES}, h as (select max(edge_no) // 2 as h from memory_edges), l as (select chat_id, source_id, relationship_name, target_id, valid_at from memory_edges, h
          where edge_no > h and relationship_name in (select relationship_name from relationship_kinds where single_value) qualify row_number() over (partition by chat_id, source_id, relationship_name order by edge_no desc) = 1)
        select e.chat_id, e.source_id, e.relationship_name, e.target_id, epoch_us(e.valid_at) as valid_us, e.invalid_at is null and (l.chat_id is null or (l.target_id = e.target_id and l.valid_at = e.valid_at)) as valid
        from edges e left join l on l.chat_id = e.chat_id and l.source_id = e.source_id and l.relationship_name = e.relationship_name""",
    "q_relationship_properties": f"""with k as (select edge_no, relationship_name as g, case when regexp_full_match(relationship_name, '[a-z][a-z0-9_]{{0,63}}') and relationship_name not in ({', '.join(f"'{r}'" for r in RESERVED)}) then relationship_name else 'related_to' end as kept
        from memory_edges where relationship_name is not null) select edge_no, kept, case when kept <> g then '{{"original_relationship":"' || g || '"}}' end as properties from k""",
    "q_band_sample": """with p as (select chat_id, least(a_id, b_id) as x, greatest(a_id, b_id) as y, max(score) as score from merge_candidates where score >= 0.75 and score < 0.88 and a_id is not null and b_id is not null group by 1, 2, 3)
        select * from p order by md5(chat_id || '|' || x || '|' || y || '|0'), chat_id, x, y limit 300""",
    "q_pairs_sorted": """with p as (select chat_id, least(a_id, b_id) as x, greatest(a_id, b_id) as y, max(score) as score from merge_candidates where score >= 0.88 and not isnan(score) and a_id <> b_id group by 1, 2, 3)
        select *, row_number() over (partition by chat_id order by score desc, x, y) as place from p where not exists (select 1 from memory_edges e where e.chat_id = p.chat_id and least(source_id, target_id) = x and greatest(source_id, target_id) = y)""",
    "q_engagement_replies": """with f as (select min(id) as id from messages group by chat_id, platform_msg_id, direction, event_type, timestamp, text), o as (select chat_id, platform_msg_id as p, arg_min(epoch(timestamp), id) as t from messages where direction = 'outbound' and platform_msg_id is not null group by 1, 2)
        select m.chat_id, m.id, o.p as answered from messages m join f using (id) join o on o.chat_id = m.chat_id and o.p = m.reply_to_platform_msg_id where direction = 'inbound' and epoch(timestamp) > t and epoch(timestamp) <= t + 1800""",
    "q_vec_label_agreement": """with sim as (select q.vec_id as query_id, q.label as a, r.vec_id, r.label as b, list_cosine_similarity(cast(q.embedding as double[]), cast(r.embedding as double[])) as s from embeddings q, embeddings r where q.vec_id % 20 = 0),
        rk as (select *, row_number() over (partition by query_id order by round(s, 9) desc, vec_id) as rank from sim) select rank, round(avg(case when a = b then 1.0 else 0.0 end), 9) as same_label, count(*) as n from rk where rank <= 10 group by 1""",
}
