"""Queues, ledgers, pairs and counters over tables derived from the stored ones: a queue item is an edge row, done if it is closed, failed
without properties; a state row is a sender of a chat; the ledger is what the bot said."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import excerpt, fold_ascii
from ..operators import ledger
from ..sources import table


def queue(spark, folder):
    e = table(spark, folder, "memory_edges").where("chat_id is not null and source_id is not null and edge_text is not null")
    status = F.when(F.col("invalid_at").isNotNull(), "done").when(F.col("properties").isNull(), "failed").otherwise("pending")
    return e.select("chat_id", F.col("edge_no").alias("qid"), F.col("source_id").alias("node_id"), F.md5(F.col("edge_text").cast("binary")).alias("hash"),
                    status.alias("status"), (F.char_length("relationship_name") % 4).alias("attempts"))


def items(spark, folder):
    """The queue with one item for each node and content, as enqueueing keeps it."""
    return ledger.first_write(queue(spark, folder), ["chat_id", "node_id", "hash"], F.col("qid"))


def content(spark, folder):
    """What each node says now: the text of its last edge row."""
    e = queue(spark, folder)
    return e.groupBy("chat_id", "node_id").agg(F.max_by("hash", "qid").alias("hash"))


def claim(spark, folder):
    return ledger.claim(queue(spark, folder), 5).select("chat_id", "place", "qid", "node_id", "attempts")


def revive(spark, folder):
    return ledger.enqueue(items(spark, folder), content(spark, folder)).where("revived or added or status = 'pending'").select("chat_id", "node_id", "hash", "status", "attempts", "revived")


def attempts(spark, folder):
    q = queue(spark, folder)
    ready = q.where("status = 'pending' and attempts < 3").select("chat_id", "qid", (F.col("attempts") == 0).alias("ok"))
    return ledger.record_attempts(q, ready).groupBy("chat_id", "status", "attempts").agg(F.count(F.lit(1)).alias("n"))


def intake(spark, folder):
    m = table(spark, folder, "messages").select("chat_id", "platform_msg_id", "direction", "event_type", "timestamp", "text", "id")
    half = m.agg(F.floor(F.max("id") / 2).alias("h"))
    old = m.join(F.broadcast(half), F.col("id") <= F.col("h")).drop("h")
    new = m.join(F.broadcast(half), F.col("id") > F.col("h")).drop("h")
    key = ["chat_id", "platform_msg_id", "direction", "event_type", "timestamp", "text"]
    return ledger.outcomes(ledger.first_write(old, key, F.col("id")), new, key, F.col("id"))


def vectors(spark, folder):
    """Text vectors kept beside the graph: stored from the first half of the rows, replaced by the second, and gone for nodes that no row uses."""
    e = table(spark, folder, "memory_edges").select("chat_id", F.col("source_id").alias("node_id"), F.char_length("edge_text").alias("vector"), "edge_no", "invalid_at")
    half = e.agg(F.floor(F.max("edge_no") / 2).alias("h"))
    rows = e.join(F.broadcast(half))
    key = ["chat_id", "node_id"]
    stored = ledger.last_write(rows.where("edge_no <= h").select(*key, "vector", "edge_no"), key, F.col("edge_no"))
    new = rows.where("edge_no > h").select(*key, "vector", "edge_no")
    dead = rows.groupBy(*key).agg(F.every(F.col("invalid_at").isNotNull()).alias("dead")).where("dead")
    return ledger.delete(ledger.upsert(stored, new, key, F.col("edge_no")), dead, key).select(*key, "vector", "edge_no")


def pruned(spark, folder):
    """What the bot said after the chat's second-newest edit, which a rebuild would keep."""
    m = table(spark, folder, "messages")
    bound = m.where("event_type = 'edit'").groupBy("chat_id").agg(F.max("id").alias("upto"))
    return ledger.prune(m.where("direction = 'outbound'").select("chat_id", "id", "platform_msg_id"), bound)


def pairs(spark, folder):
    c = table(spark, folder, "merge_candidates").where("chat_id is not null").select("chat_id", "a_id", "b_id", "score", "a_name", "b_name")
    return ledger.unordered(c, "a_id", "b_id")


def pair_insert(spark, folder):
    order = F.struct(-F.coalesce(F.nanvl("score", F.lit(-1.0)), F.lit(-1.0)), F.coalesce("a_name", F.lit("")), F.coalesce("b_name", F.lit("")))
    return ledger.first_write(pairs(spark, folder), ["chat_id", "x", "y"], order).select("chat_id", "x", "y", "a_name", "b_name")


def pair_status(spark, folder):
    """Pairs start pending, or dismissed where they were first scored with nothing usable; a match promotes them, a low score dismisses them."""
    p = pairs(spark, folder)
    start = p.groupBy("chat_id", "x", "y").agg(F.when(F.max(F.when(~F.isnan("score"), F.col("score"))).isNull(), "dismissed").otherwise("pending").alias("status"))
    to = F.when((F.col("score") >= 0.88) & ~F.isnan("score"), "promoted").when(F.col("score") < 0.5, "dismissed")
    return ledger.set_pair_status(start, p.select("chat_id", "x", "y", to.alias("to"))).groupBy("chat_id", "status", "moved").agg(F.count(F.lit(1)).alias("n"))


def audit(spark, folder):
    """One row for each pair that was ever a match, with its last outcome; a later unusable score rolls it back. Rows have no time, so the lowest
    score is the last."""
    p = pairs(spark, folder).where("score is not null and not isnan(score)")
    g = p.groupBy("chat_id", "x", "y").agg(F.max("score").alias("best"), F.min("score").alias("last"), F.count(F.lit(1)).alias("scored"))
    return g.where("best >= 0.88").select("chat_id", "x", "y", "best", "scored", F.when(F.col("last") < 0.5, "rolled_back").otherwise("applied").alias("outcome"))


def counters(spark, folder):
    m = table(spark, folder, "messages").where("chat_id is not null")
    delta = m.select("chat_id", F.concat_ws("_", "direction", "event_type").alias("name"), F.char_length(F.coalesce("text", F.lit(""))).alias("delta"))
    return ledger.add_up(delta, ["chat_id", "name"])


def state(spark, folder):
    m = table(spark, folder, "messages").where("chat_id is not null and sender_id is not null")
    kv = ledger.last_write(m.select("chat_id", F.concat(F.lit("name:"), "sender_id").alias("key"), F.col("sender_display_name").alias("value"), "id"), ["chat_id", "key"], F.col("id"))
    return ledger.state_map(kv.select("chat_id", "key", "value")).select("chat_id", F.size("state").alias("keys"), F.concat_ws("|", F.transform(F.map_entries("state"), lambda x: F.concat(x["key"], F.lit("="), x["value"]))).alias("entries"))


def dead_letters(spark, folder):
    """Rows nothing can be made of: no sender and no text. Newest ten of each chat."""
    m = table(spark, folder, "messages").where("sender_id is null and event_type in ('message', 'edit')").select("chat_id", "id", excerpt(F.coalesce("text", F.lit(""))).alias("excerpt"))
    return ledger.newest(m, ["chat_id"], "id", 10)


def minted(spark, folder):
    """A key for each chat and purpose, the first that was written."""
    m = table(spark, folder, "messages").where("chat_id is not null").select("chat_id", F.col("event_type").alias("purpose"), F.col("platform_msg_id").alias("key"), "id")
    return ledger.first_write(m, ["chat_id", "purpose"], F.col("id")).select("chat_id", "purpose", "key")


def edge_lookup(spark, folder):
    """Rows by natural key for the facts each chat wrote last, with how many rows hold the key."""
    e = table(spark, folder, "memory_edges")
    key = ["chat_id", "source_id", "relationship_name", "target_id", "valid_at"]
    asked = e.groupBy("chat_id").agg(F.max_by(F.struct(*key[1:]), "edge_no").alias("k")).select("chat_id", "k.*")
    return e.join(asked, key).groupBy(*key).agg(F.count(F.lit(1)).alias("rows"), F.max("invalid_at").alias("invalid_at")).select(
        *key[:4], F.unix_micros("valid_at").alias("valid_us"), "rows", F.unix_micros("invalid_at").alias("invalid_us"))


def predicate_edges(spark, folder):
    """Valid outgoing facts of one predicate for each node."""
    e = table(spark, folder, "memory_edges").where("invalid_at is null and relationship_name = 'works_at'")
    return e.groupBy("chat_id", "source_id").agg(F.count_distinct("target_id").alias("targets"))


def embedded_kinds(spark, folder):
    """Nodes that get a vector: all kinds but batches, an unknown kind as well, with the text that is embedded."""
    n = table(spark, folder, "memory_nodes").where(F.coalesce(F.col("node_type") != "MessageBatch", F.lit(True)))
    text = F.concat_ws("\n", "name", F.coalesce(F.get_json_object("properties", "$.description"), F.lit("")))
    return n.select("chat_id", "id", F.md5(text.cast("binary")).alias("text_md5")).distinct()


def mention_detect(spark, folder):
    """Rows that name a sender of their chat by @username, whatever the case of ASCII letters."""
    m = table(spark, folder, "messages")
    asked = m.where("text is not null").select("chat_id", "id", F.explode(F.array_distinct(F.regexp_extract_all(fold_ascii(F.col("text")), F.lit(r"@([a-z0-9_]{2,})"), 1))).alias("u"))
    users = m.where("sender_username is not null").select("chat_id", fold_ascii(F.col("sender_username")).alias("u"), "sender_id").distinct()
    return asked.join(users, ["chat_id", "u"]).select("chat_id", "id", "sender_id").distinct()


def overlay(spark, folder):
    """Settings of each chat: its own digest size where it has a usual one, the general values elsewhere."""
    m = table(spark, folder, "messages").where("chat_id is not null").groupBy("chat_id").agg(F.count(F.lit(1)).alias("n"))
    own = m.select("chat_id", F.when(F.col("n") > 100, (F.col("n") / 10).cast("int")).alias("digest_max_messages"))
    return ledger.overlay(own, {"digest_max_messages": 100, "injection_cap": 5})


def latest_edits(spark, folder):
    """The newest three edits of each chat, ascending; ids order them, as times of one second do not."""
    e = table(spark, folder, "messages").where("event_type = 'edit'").select("chat_id", "id", "platform_msg_id")
    return ledger.newest(e, ["chat_id"], "id", 3)


QUERIES = {
    "q_queue_claim": claim, "q_queue_drain": lambda s, d: ledger.drain_size(queue(s, d)), "q_queue_done_hash": lambda s, d: ledger.done_hashes(queue(s, d)),
    "q_queue_stale": lambda s, d: ledger.stale(content(s, d), queue(s, d)), "q_queue_revive": revive, "q_queue_attempts": attempts, "q_intake_outcomes": intake,
    "q_vector_upsert": vectors, "q_ledger_prune": pruned, "q_pairs_insert": pair_insert, "q_pair_status": pair_status, "q_audit_log": audit, "q_counters": counters,
    "q_state_all": state, "q_dead_letters": dead_letters, "q_get_or_mint": minted, "q_edge_lookup": edge_lookup, "q_predicate_edges": predicate_edges,
    "q_embedded_kinds": embedded_kinds, "q_mention_detect": mention_detect, "q_config_overlay": overlay, "q_latest_edits": latest_edits,
}

Q = """q as (select chat_id, edge_no as qid, source_id as node_id, md5(edge_text) as hash, case when invalid_at is not null then 'done' when properties is null then 'failed' else 'pending' end as status,
  cast(length(relationship_name) % 4 as int) as attempts from memory_edges where chat_id is not null and source_id is not null and edge_text is not null)"""
NOW = "now_ as (select chat_id, node_id, arg_max(hash, qid) as hash from q group by 1, 2)"
DONE = "done as (select chat_id, node_id, arg_max(hash, qid) as done_hash from q where status = 'done' group by 1, 2)"
P = "p as (select chat_id, least(a_id, b_id) as x, greatest(a_id, b_id) as y, score, a_name, b_name from merge_candidates where a_id <> b_id and chat_id is not null)"
DK = "chat_id, platform_msg_id, direction, event_type, timestamp, text"

SQL = {
    "q_queue_claim": f"""with {Q} select * from (select chat_id, row_number() over (partition by chat_id order by qid) as place, qid, node_id, attempts from q where status = 'pending' and attempts < 3) where place <= 5""",
    "q_queue_drain": f"with {Q} select chat_id, count(*) as backlog, case when count(*) > 256 then 64 else 8 end as take from q where status = 'pending' and attempts < 3 group by 1",
    "q_queue_done_hash": f"with {Q}, {DONE} select chat_id, node_id, done_hash as hash from done",
    "q_queue_stale": f"with {Q}, {NOW}, {DONE} select n.chat_id, n.node_id, hash, done_hash from now_ n left join done d on n.chat_id = d.chat_id and n.node_id = d.node_id where hash is distinct from done_hash",
    "q_queue_revive": f"""with {Q}, i as (select chat_id, node_id, hash, arg_min(status, qid) as status, arg_min(attempts, qid) as attempts from q group by 1, 2, 3), {NOW},
        j as (select i.*, n.hash is not null and status = 'failed' as revived from i left join now_ n on n.chat_id = i.chat_id and n.node_id = i.node_id and n.hash = i.hash)
        select chat_id, node_id, hash, case when revived then 'pending' else status end as status, case when revived then 0 else attempts end as attempts, revived from j where revived or status = 'pending'""",
    "q_queue_attempts": f"""with {Q}, a as (select chat_id, case when status = 'pending' and attempts = 0 then 'done' when status = 'pending' and attempts = 2 then 'failed' else status end as status,
        case when status = 'pending' and attempts between 1 and 2 then attempts + 1 else attempts end as attempts from q) select chat_id, status, attempts, count(*) as n from a group by 1, 2, 3""",
    "q_intake_outcomes": f"""with h as (select max(id) // 2 as h from messages), k as (select {DK}, min(id) <= any_value(h) as stored, count(*) filter (id > h) as new_rows from messages, h group by all)
        select cast(count(*) filter (not stored) as bigint) as inserted, cast(sum(new_rows) - count(*) filter (not stored) as bigint) as duplicate from k""",
    "q_vector_upsert": """select chat_id, source_id as node_id, cast(arg_max(length(edge_text), edge_no) as int) as vector, max(edge_no) as edge_no from memory_edges group by 1, 2 having not bool_and(invalid_at is not null)""",
    "q_ledger_prune": """select chat_id, id, platform_msg_id from messages m where direction = 'outbound' and not exists (select 1 from messages e where e.chat_id = m.chat_id and e.event_type = 'edit' and e.id >= m.id)""",
    "q_pairs_insert": f"""with {P} select chat_id, x, y, a_name, b_name from p qualify row_number() over (partition by chat_id, x, y
        order by -coalesce(case when isnan(score) then -1 else score end, -1), coalesce(a_name, ''), coalesce(b_name, '')) = 1""",
    "q_pair_status": f"""with {P}, g as (select chat_id, x, y, count(score) filter (not isnan(score)) > 0 as usable, bool_or(score >= 0.88 and not isnan(score)) as up, bool_or(score < 0.5) as down from p group by 1, 2, 3)
        select chat_id, case when not usable then 'dismissed' when up then 'promoted' when down then 'dismissed' else 'pending' end as status, usable and (coalesce(up, false) or coalesce(down, false)) as moved, count(*) as n
        from g group by 1, 2, 3""",
    "q_audit_log": f"""with {P} select chat_id, x, y, max(score) as best, count(*) as scored, case when min(score) < 0.5 then 'rolled_back' else 'applied' end as outcome
        from p where score is not null and not isnan(score) group by 1, 2, 3 having max(score) >= 0.88""",
    "q_counters": "select chat_id, direction || '_' || event_type as name, cast(sum(length(coalesce(text, ''))) as bigint) as value from messages where chat_id is not null group by 1, 2",
    "q_state_all": """with k as (select chat_id, 'name:' || sender_id as key, arg_max(sender_display_name, id) as value from messages where chat_id is not null and sender_id is not null group by 1, 2)
        select chat_id, cast(count(*) as int) as keys, string_agg(key || '=' || value, '|' order by key) as entries from k group by 1""",
    "q_dead_letters": """with r as (select chat_id, id, case when length(coalesce(text, '')) > 60 then substr(text, 1, 60) || '…' else coalesce(text, '') end as excerpt from messages
        where sender_id is null and event_type in ('message', 'edit') qualify row_number() over (partition by chat_id order by id desc) <= 10) select *, row_number() over (partition by chat_id order by id) as position from r""",
    "q_get_or_mint": "select chat_id, event_type as purpose, arg_min(platform_msg_id, id) as key from messages where chat_id is not null group by 1, 2",
    "q_edge_lookup": """with l as (select * from memory_edges qualify row_number() over (partition by chat_id order by edge_no desc) = 1)
        select e.chat_id, e.source_id, e.relationship_name, e.target_id, epoch_us(e.valid_at) as valid_us, count(*) as rows, epoch_us(max(e.invalid_at)) as invalid_us from memory_edges e
        join l using (chat_id, source_id, relationship_name, target_id, valid_at) group by e.chat_id, e.source_id, e.relationship_name, e.target_id, e.valid_at""",
    "q_predicate_edges": "select chat_id, source_id, count(distinct target_id) as targets from memory_edges where invalid_at is null and relationship_name = 'works_at' group by 1, 2",
    "q_embedded_kinds": """select distinct chat_id, id, md5(name || chr(10) || coalesce(properties ->> '$.description', '')) as text_md5 from memory_nodes where node_type is distinct from 'MessageBatch'""",
    "q_mention_detect": """with a as (select chat_id, id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '@([a-z0-9_]{2,})', 1)) as u from messages where text is not null)
        select distinct a.chat_id, a.id, m.sender_id from a join messages m on m.chat_id = a.chat_id and translate(m.sender_username, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') = u""",
    "q_config_overlay": "select chat_id, case when count(*) > 100 then cast(floor(count(*) / 10) as int) else 100 end as digest_max_messages, 5 as injection_cap from messages where chat_id is not null group by 1",
    "q_latest_edits": """with r as (select chat_id, id, platform_msg_id from messages where event_type = 'edit' qualify row_number() over (partition by chat_id order by id desc) <= 3)
        select *, row_number() over (partition by chat_id order by id) as position from r""",
}
