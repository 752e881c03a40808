"""Binding, recall, context and warm-up queries. Where the stored tables have no row of a kind, the docstring says what stands for it."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import hygiene, schedule
from ..functions.text import excerpt, fold_ascii
from ..operators import context, graph, log, recall, resolve, vector
from ..sources import table
from .graph import ALIAS, ALL_LOW, EDGES, ENDS, KEYS, NODES, PEOPLE, QUOTA, VALID, _edges, _nodes, names_in_texts, quota

NOW_US = 1_767_225_600_000_000  # 2026-01-01
fold = lambda c: fold_ascii(F.trim(c))


def extracted(spark, folder):
    """Names as they were spelled when a pair was scored, with their kind."""
    c = table(spark, folder, "merge_candidates")
    return c.select("chat_id", F.col("a_name").alias("name"), F.col("node_kind").alias("kind")).union(c.select("chat_id", "b_name", "node_kind")).dropna().distinct()


def aliases(spark, folder):
    """Alias names with the nodes they stand for: edges of the relationship ``knows`` into a node stand for alias edges."""
    t = graph.alias_targets(_edges(spark, folder), ALIAS)
    return t.join(_nodes(spark, folder).select("chat_id", F.col("id").alias("alias_id"), F.col("name").alias("alias_name")), ["chat_id", "alias_id"]).select("chat_id", "alias_name", F.col("source_id").alias("target_id"))


def resolve_alias(spark, folder):
    return resolve.bind_alias(extracted(spark, folder), aliases(spark, folder), _nodes(spark, folder), fold)


def resolve_fallback(spark, folder):
    """Every extracted name with a node: bound by alias, or by the id of its normalised name."""
    return resolve.fallback(resolve.bind_alias(extracted(spark, folder), aliases(spark, folder), _nodes(spark, folder))).select("chat_id", "name", "kind", "node_id", "own")


def resolve_vector(spark, folder):
    """Vectors of label 0 are Persons, of 1 Concepts, of others Aliases of the vector before them; every twentieth is asked for, in batches of 200 ids."""
    v = table(spark, folder, "embeddings")
    kind = F.when(F.col("label") == 0, "Person").when(F.col("label") == 1, "Concept").otherwise("Alias")
    k = v.select(F.col("vec_id").alias("hit_id"), kind.alias("hit_kind"))
    infos = k.withColumn("target_id", F.when(F.col("hit_kind") == "Alias", F.col("hit_id") - 1)).join(
        k.select(F.col("hit_id").alias("target_id"), F.col("hit_kind").alias("target_kind")), "target_id", "left").select("hit_id", "hit_kind", "target_id", "target_kind")
    asked = v.where("vec_id % 20 = 0")
    q = asked.select(F.col("vec_id").alias("query_id"), F.floor(F.col("vec_id") / 200).alias("batch"), F.when(F.col("label") % 2 == 0, "Person").otherwise("Concept").alias("kind"))
    hits = vector.nearest(asked, v, 10).select("query_id", "rank", F.col("vec_id").alias("hit_id"), "similarity").where("hit_id <> query_id")
    return resolve.confirm(resolve.first_compatible(hits, infos, q), 0.2, 3).select("query_id", "batch", "node_id", F.round("similarity", 6).alias("similarity"), "decision")


def batch_rows(spark, folder):
    """What each day of a chat writes: its senders are entities known by their display names, a reply is a fact between two of them."""
    m = table(spark, folder, "messages").where("chat_id is not null").withColumn("batch", F.concat(F.lit("batch:"), "chat_id", F.lit(":"), log.day()))
    batches = m.groupBy("chat_id", "batch").agg(F.unix_micros(F.max("timestamp")).alias("end_us"))
    who = m.where("sender_id is not null and sender_display_name is not null")
    entities = who.select("chat_id", "batch", F.col("sender_display_name").alias("name"), F.concat(F.lit("alias:"), fold(F.col("sender_display_name"))).alias("alias_id"), F.col("sender_id").alias("node_id")).distinct()
    target = log.first_by(m, True, F.col("sender_id").alias("target_id")).withColumnRenamed("platform_msg_id", "reply_to_platform_msg_id")
    facts = m.join(target, ["chat_id", "reply_to_platform_msg_id"]).where("sender_id <> target_id").select("chat_id", "batch", F.col("sender_id").alias("source_id"), F.lit("replied_to").alias("relationship_name"), "target_id")
    return resolve.assemble(batches, entities, facts)


def promoted(spark, folder):
    """Edges whose ends' names are a pending pair: a pair that was scored, but is no match."""
    names = _nodes(spark, folder).select("chat_id", "id", "name")
    e = table(spark, folder, "memory_edges").select("chat_id", F.col("edge_no").alias("seq"), "source_id", "target_id")
    e = e.join(names.select("chat_id", F.col("id").alias("source_id"), F.col("name").alias("source_name")), ["chat_id", "source_id"]).join(
        names.select("chat_id", F.col("id").alias("target_id"), F.col("name").alias("target_name")), ["chat_id", "target_id"])
    c = table(spark, folder, "merge_candidates").where("a_name <> b_name")
    pairs = c.select("chat_id", F.least("a_name", "b_name").alias("x"), F.greatest("a_name", "b_name").alias("y")).distinct()
    return resolve.promoted(e, pairs)


def _requests(spark, folder):
    """A request for each person, whose entry is the person's node."""
    n = _nodes(spark, folder).where("node_type = 'Person'")
    return n.select(F.concat_ws("|", "chat_id", "id").alias("request"), "chat_id", F.col("id").alias("node"), "name")


def _place(*more):
    return F.concat_ws("|", *more, F.lpad((F.lit(2**62) - F.unix_micros("created_at")).cast("string"), 20, "0"), "source_id", "relationship_name", "target_id", F.unix_micros("valid_at").cast("string"))


def candidates(spark, folder):
    """Recall candidates of each person in source order: facts about it, facts about those that facts about it name, facts whose text has its name."""
    e = graph.valid_now(_edges(spark, folder))
    ends = graph.both_ends(e.where("relationship_name <> 'contains'"))
    r = _requests(spark, folder)
    w = Window.partitionBy("request", "node").orderBy(F.desc("created_at"), F.desc("valid_at"), "source_id", "target_id", "relationship_name")
    reach = lambda front: ends.join(front.select("request", "chat_id", "node"), ["chat_id", "node"]).withColumn("__r", F.row_number().over(w)).where("__r <= 500")
    one = reach(r)
    front = one.select("request", "chat_id", F.col("other").alias("node")).distinct().join(r.select("request", "node"), ["request", "node"], "left_anti")
    hit = names_in_texts(r.select("chat_id", fold(F.col("name")).alias("n")), e.select("chat_id", F.xxhash64(*graph.KEY).alias("id"), fold_ascii(F.col("edge_text")).alias("t")))
    text = hit.join(r.select("request", "chat_id", fold(F.col("name")).alias("n")), ["chat_id", "n"]).join(e.withColumn("id", F.xxhash64(*graph.KEY)), ["chat_id", "id"])
    u = recall.union_in_order(*(x.withColumn("seq", _place()) for x in (one, reach(front), text)))
    return u.select("request", F.col("seq.source").alias("source"), "source_id", "relationship_name", "target_id", F.unix_micros("valid_at").alias("valid_us"))


def injected(spark, folder):
    """The first five of what a fixed selection picks from each request's list."""
    q = quota(spark, folder)
    picks = q.select("request").distinct().withColumn("picks", F.array(*[F.lit(x) for x in (0, 3, 3, 1, 99, -2, 2, 5, 4, 6)]))
    return recall.selected(q, picks).select("request", "slot", "place", "source_id", "relationship_name", "target_id")


def prompts(spark, folder):
    q = quota(spark, folder)
    since = _edges(spark, folder).groupBy("source_id", "relationship_name", "target_id").agg(F.max("valid_at").alias("valid_at"))
    line = F.concat_ws(" ", "source_id", "relationship_name", "target_id")
    return recall.prompt(q.join(since, ["source_id", "relationship_name", "target_id"]).withColumn("line", line), "line", "valid_at").select("request", F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"))


# ------------------------------------------------------------------- context


def _summaries(spark, folder):
    """The newest two days before each chat's last one stand summarised by their counts."""
    f = log.batch_frames(table(spark, folder, "messages"))
    last = f.groupBy("chat_id").agg(F.max("last_id").alias("end"))
    return context.keep_newest(f.join(last, "chat_id").where("last_id < end").drop("end")).withColumn("text", F.concat(F.col("row_count").cast("string"), F.lit(" rows & more")))


def _ledger(spark, folder):
    """Rows that mention the bot stand for memories injected at them."""
    m = table(spark, folder, "messages").where("mentions_bot")
    return m.select("chat_id", "id", F.col("id").alias("position"), F.concat(F.lit("<memory>"), F.coalesce("text", F.lit("")), F.lit("</memory>")).alias("content"))


def context_rebuild(spark, folder):
    s = _summaries(spark, folder)
    bounds = s.groupBy("chat_id").agg(F.max("last_id").alias("upto"))
    items = context.rebuild(table(spark, folder, "messages"), bounds, _ledger(spark, folder), s)
    return items.select("chat_id", "block", "position", "turn", "seq", "role", F.md5(F.col("content").cast("binary")).alias("content_md5"))


def context_stats(spark, folder):
    m = table(spark, folder, "messages")
    return context.context_stats(context.render_messages(m).unionByName(context.render_members(m)).unionByName(context.render_speech(m, "you")))


def wake_batches(spark, folder):
    """Rows since the bot spoke last: what a wake would be shown."""
    m = table(spark, folder, "messages")
    return log.tail_after(log.conversational(m), log.last_outbound(m), "upper").groupBy("chat_id").agg(F.count(F.lit(1)).alias("messages"), F.max("id").alias("marker"))


def staleness_decision(spark, folder):
    """Whether the bot would still answer a row: dropped when more than 20 rows followed, quoted when more than 10 did and the id is a plain one."""
    d = log.staleness(table(spark, folder, "messages")).join(table(spark, folder, "messages").select("chat_id", "id", "platform_msg_id"), ["chat_id", "id"])
    action = F.when(F.col("inbound_after") > 20, "discard").when((F.col("inbound_after") > 10) & ~F.col("platform_msg_id").contains(":"), "quote").otherwise("plain")
    return d.groupBy("chat_id", action.alias("action")).agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------- warm-ups


def topic_weights(spark, folder):
    t = graph.topics(_nodes(spark, folder), _edges(spark, folder))
    w = schedule.topic_weight(F.col("degree"), F.timestamp_micros("active_us"), F.timestamp_micros(F.lit(NOW_US)))
    return t.select("chat_id", "id", "rank", F.round(w, 9).alias("weight"))


def topic_pick(spark, folder, draw=0.5):
    """The topic of each chat at a draw in [0, 1): weights are added up in order of rank, topics that the newest 50 rows name are left out."""
    t = topic_weights(spark, folder).join(_nodes(spark, folder).select("chat_id", "id", fold(F.col("name")).alias("n")), ["chat_id", "id"])
    w50 = Window.partitionBy("chat_id").orderBy(F.desc("id"))
    tail = table(spark, folder, "messages").withColumn("__r", F.row_number().over(w50)).where("__r <= 50").select("chat_id", "id", fold_ascii(F.coalesce("text", F.lit(""))).alias("t"))
    named = names_in_texts(t.select("chat_id", "n"), tail).select("chat_id", "n").distinct()
    t = t.join(named, ["chat_id", "n"], "left_anti")
    run = F.sum("weight").over(Window.partitionBy("chat_id").orderBy("rank"))
    total = F.sum("weight").over(Window.partitionBy("chat_id"))
    c = t.withColumn("upto", run).withColumn("total", total).where((F.col("total") > 0) & (F.col("upto") > draw * F.col("total")))
    return c.groupBy("chat_id").agg(F.min_by("id", "rank").alias("id"))


def warmup_schedule(spark, folder):
    """The slots of the day after now for each chat: its backoff is how often the bot spoke twice in a row, 4 at most."""
    m = log.monologues(table(spark, folder, "messages")).select("chat_id", F.least(F.col("locks"), F.lit(4)).cast("int").alias("factor"))
    quota_ = schedule.effective_quota(F.lit(5), F.col("factor"))
    window = F.floor(F.lit(12 * 3600) / F.col("quota"))
    s = m.withColumn("quota", quota_).withColumn("window", window).withColumn("gap", F.col("window") * schedule.interval_multiplier(F.col("factor")))
    s = s.withColumn("at", F.explode(schedule.day_slots(F.col("quota"), F.col("window"), F.col("chat_id"))))
    return s.select("chat_id", "factor", "quota", F.col("gap").cast("long").alias("gap"), F.col("at").cast("long").alias("second"))


def silence_gate(spark, folder):
    """Chats by whether the newest conversational row lies in active hours and whether it is a day older than the newest of all."""
    m = log.conversational(table(spark, folder, "messages")).where("chat_id is not null").groupBy("chat_id").agg(F.max("timestamp").alias("last"))
    end = m.agg(F.max("last").alias("end"))
    return m.join(F.broadcast(end)).select("chat_id", schedule.in_active_hours(F.col("last"), 9 * 60, 21 * 60, "UTC").alias("active"),
                                           ((F.unix_timestamp("end") - F.unix_timestamp("last")) >= 86_400).alias("silent"), schedule.local_date(F.col("last"), "UTC").alias("day"))


def cooldowns(spark, folder):
    """Days on which each chat's edits fell, with whether they still cool down on its last day."""
    m = table(spark, folder, "messages").where("chat_id is not null")
    last = m.groupBy("chat_id").agg(F.date_format(F.max("timestamp"), "yyyy-MM-dd").alias("today"))
    d = m.where("event_type = 'edit'").select("chat_id", F.date_format("timestamp", "yyyy-MM-dd").alias("day")).distinct()
    return d.join(last, "chat_id").select("chat_id", "day", schedule.cooldown_active(F.col("day"), F.col("today"), 7).alias("active"))


def retries(spark, folder):
    """The delay before each attempt of the queue's items."""
    e = table(spark, folder, "memory_edges").select((F.char_length("relationship_name") % 9 + 1).alias("attempt"))
    return e.groupBy("attempt").agg(F.count(F.lit(1)).alias("n")).select("attempt", "n", schedule.retry_delay(F.lit(2.0), F.col("attempt")).alias("seconds"))


# ------------------------------------------------------------------- text


def hygiene_texts(spark, folder):
    """Messages wrapped as a model might write them, and cleaned again."""
    m = table(spark, folder, "messages").where("text is not null and instr(text, '<') = 0 and instr(text, '\\n') = 0 and trim(text) <> '' and text rlike '^[ -~]+$'")
    wrapped = F.concat(F.lit("<think>"), "text", F.lit("</think><pet at=\"1\">"), "text", F.lit("</pet> tail"))
    lines = F.concat(F.lit("<memory>\n"), "text", F.lit("\n</memory>\n"), "text", F.lit("\n</msg>"))
    return m.select("chat_id", "id", hygiene.extract_fence(hygiene.strip_reasoning(wrapped), "pet").alias("said"), hygiene.filter_lines(lines, "pet").alias("kept"))


def names_shown(spark, folder):
    m = table(spark, folder, "messages").where("chat_id is not null")
    parts = F.split(F.coalesce("sender_display_name", F.lit("")), " ", 2)
    shown = hygiene.display_name(parts[0], F.try_element_at(parts, F.lit(2)), F.col("sender_username"), F.coalesce("sender_id", F.lit("?")))
    return m.select("chat_id", hygiene.valid_chat_id(F.col("chat_id")).alias("valid"), shown.alias("shown"), hygiene.speech_tag(F.col("sender_username")).alias("tag")).distinct()


def excerpts(spark, folder):
    e = table(spark, folder, "memory_edges")
    return e.select("edge_no", excerpt(F.col("edge_text")).alias("excerpt"))


def extraction_lines(spark, folder):
    return context.extraction_input(table(spark, folder, "messages").where("event_type <> 'edit'")).select("chat_id", "id", "line")


def summary_lines(spark, folder):
    return context.summary_input(table(spark, folder, "messages").where("text is not null"), 200).select("chat_id", "id", "line")


QUERIES = {
    "q_resolve_alias": resolve_alias, "q_resolve_fallback": resolve_fallback, "q_resolve_vector": resolve_vector, "q_batch_assembly": batch_rows,
    "q_harvest": lambda s, d: resolve.harvest(_nodes(s, d)), "q_promotion_edges": promoted, "q_recall_candidates": candidates, "q_injection_cap": injected, "q_recall_prompt": prompts,
    "q_context_rebuild": context_rebuild, "q_context_stats": context_stats, "q_wake_batches": wake_batches, "q_staleness_decision": staleness_decision,
    "q_topic_weights": topic_weights, "q_topic_pick": topic_pick, "q_warmup_schedule": warmup_schedule, "q_silence_gate": silence_gate, "q_cooldowns": cooldowns, "q_retry_delays": retries,
    "q_text_hygiene": hygiene_texts, "q_names_shown": names_shown, "q_excerpts": excerpts, "q_extraction_lines": extraction_lines, "q_summary_lines": summary_lines,
}

_fold = "translate(trim({0}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')".format
_text = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')".format
_attr = lambda c: f"replace({_text(c)}, '\"', '&quot;')"
_msg = f"""'<msg from="' || {_attr("coalesce(m.sender_display_name, '')")} || '"' || case when m.sender_username is not null then ' user="' || {_attr('m.sender_username')} || '"' else '' end
  || ' at="' || strftime(m.timestamp, '%H:%M') || '" id="' || m.id || '"'"""
RENDER = f"""tg as (select chat_id, platform_msg_id as p, arg_min(id, id) as rid, arg_min(coalesce(sender_display_name, ''), id) as rname from messages where platform_msg_id is not null group by 1, 2),
  said as (select m.chat_id, m.id, {_msg} || case when m.event_type = 'edit' then ' kind="edit"' else '' end
    || case when m.is_reply_to_bot then ' reply="bot"' when tg.rid is not null then ' reply="user" reply_to_name="' || {_attr('tg.rname')} || '" reply_to_id="' || tg.rid || '"' when m.reply_to_platform_msg_id is not null then ' reply="user"' else '' end
    || case when m.mentions_bot then ' mention="bot"' else '' end || '>' || {_text("coalesce(m.text, '')")} || '</msg>' as content
    from messages m left join tg on tg.chat_id = m.chat_id and tg.p = m.reply_to_platform_msg_id where direction = 'inbound' and event_type in ('message', 'edit')),
  came as (select m.chat_id, m.id, {_msg} || ' kind="' || event_type || '">' || case when event_type = 'join' then 'joined the group' else 'left the group' end || '</msg>' as content
    from messages m where direction = 'inbound' and event_type in ('join', 'leave')),
  bot as (select chat_id, id, '<you at="' || strftime(timestamp, '%H:%M') || '" id="' || id || '">' || {_text("coalesce(text, '')")} || '</you>' as content from messages where direction = 'outbound')"""
TOPW = f"""{NODES}, {EDGES}, {VALID}, {ENDS.format('valid')}, d as (select chat_id, node as id, count(*) as degree, greatest(max(valid_at), max(created_at)) as active from ends group by 1, 2),
  tw as (select n.chat_id, n.id, n.name, coalesce(degree, 0) as degree, active, row_number() over (partition by n.chat_id order by coalesce(degree, 0) desc, n.id) as rank from nodes n left join d using (chat_id, id) where node_type = 'Concept'),
  weights as (select chat_id, id, name, rank, round(degree * power(0.5, case when active is null then 30.0 else greatest(0, ({NOW_US} - epoch_us(active)) // 1000000) / 86400.0 end / 7.0), 9) as weight from tw where rank <= 20)"""
MONO = """rows_ as (select chat_id, id, direction, sum(case when direction = 'inbound' then 1 else 0 end) over (partition by chat_id order by id) as humans from messages where event_type not in ('join', 'leave')),
  runs as (select chat_id, humans, count(*) as run from rows_ where direction = 'outbound' group by 1, 2), locks as (select chat_id, cast(least(count(*) filter (run >= 2), 4) as int) as factor from runs group by 1)"""

# the 64-bit FNV-1a hash, byte by byte
_bytes = "list_transform(range(1, length(h), 2), lambda i: cast('0x' || substr(h, i, 2) as hugeint))"
_fnv = f"list_reduce([cast(14695981039346656037 as hugeint)] || {_bytes}, lambda a, b: (xor(a, b) * cast(1099511628211 as hugeint)) % cast(18446744073709551616 as hugeint))"

SQL = {
    "q_harvest": f"""with {NODES}, b as (select chat_id, id, lower(hex(encode(name || chr(10) || coalesce(properties ->> '$.description', '')))) as h from nodes), f as (select chat_id, id, {_fnv} as x from b)
        select distinct chat_id, id as node_id, printf('%08x%08x', cast(x // 4294967296 as bigint), cast(x % 4294967296 as bigint)) as hash from f""",
    "q_resolve_alias": f"""with {NODES}, {EDGES}, {VALID}, al as (select distinct v.chat_id, {_fold('n.name')} as n, source_id as t from valid v join nodes n on n.chat_id = v.chat_id and n.id = target_id where relationship_name = 'knows'),
        one as (select chat_id, n, count(*) as targets, min(t) as t from al group by 1, 2),
        x as (select distinct * from (select chat_id, a_name as name, node_kind as kind from merge_candidates union all select chat_id, b_name, node_kind from merge_candidates) where chat_id is not null and name is not null and kind is not null)
        select x.chat_id, x.name, x.kind, coalesce(targets, 0) as targets, case when targets = 1 and k.node_type = x.kind then t end as node_id
        from x left join one on one.chat_id = x.chat_id and one.n = {_fold('x.name')} left join nodes k on k.chat_id = x.chat_id and k.id = t""",
    "q_resolve_vector": """with k as (select vec_id, case label when 0 then 'Person' when 1 then 'Concept' else 'Alias' end as kind from embeddings),
        sim as (select q.vec_id as query_id, q.label as ql, r.vec_id, list_cosine_similarity(cast(q.embedding as double[]), cast(r.embedding as double[])) as s from embeddings q, embeddings r where q.vec_id % 20 = 0),
        rk as (select *, row_number() over (partition by query_id order by round(s, 9) desc, vec_id) as rank from sim),
        c as (select query_id, query_id // 200 as batch, rank, s, case when k.kind = 'Alias' then k.vec_id - 1 else k.vec_id end as node_id, case when k.kind = 'Alias' then t.kind else k.kind end as kind, case when ql % 2 = 0 then 'Person' else 'Concept' end as want
          from rk join k using (vec_id) left join k t on t.vec_id = k.vec_id - 1 where rank <= 10 and vec_id <> query_id),
        f as (select query_id, batch, arg_min(node_id, rank) as node_id, arg_min(s, rank) as s from c where kind = want group by 1, 2)
        select query_id, batch, node_id, round(s, 6) as similarity, case when s < 0.2 then 'below' when sum(case when s >= 0.2 then 1 else 0 end) over (partition by batch order by query_id) <= 3 then 'confirm' else 'exhausted' end as decision from f""",
    "q_batch_assembly": f"""with m as (select *, 'batch:' || chat_id || ':' || strftime(timestamp, '%Y-%m-%d') as batch from messages where chat_id is not null), b as (select chat_id, batch, epoch_us(max(timestamp)) as e from m group by 1, 2),
        n as (select distinct chat_id, batch, 'alias:' || {_fold('sender_display_name')} as a, sender_id as node from m where sender_id is not null and sender_display_name is not null),
        t as (select chat_id, platform_msg_id as p, arg_max(struct_pack(s := sender_id), id).s as s from m where platform_msg_id is not null group by 1, 2)
        select chat_id, batch, 'batch' as part, batch as source_id, null as relationship_name, null as target_id, e as valid_us from b
        union all select distinct chat_id, batch, 'alias', node, 'known_as', a, cast(0 as bigint) from n where a <> node
        union all select distinct m.chat_id, m.batch, 'fact', m.sender_id, 'replied_to', t.s, b.e from m join t on t.chat_id = m.chat_id and t.p = m.reply_to_platform_msg_id join b on b.chat_id = m.chat_id and b.batch = m.batch
          where m.sender_id <> t.s and (m.chat_id, m.batch, m.sender_id) in (select chat_id, batch, node from n) and (m.chat_id, m.batch, t.s) in (select chat_id, batch, node from n)
        union all select distinct n.chat_id, n.batch, 'contains', n.batch, 'contains', node, e from n join b using (chat_id, batch)""",
    "q_promotion_edges": f"""with {NODES}, c as (select distinct chat_id, least(a_name, b_name) as x, greatest(a_name, b_name) as y from merge_candidates where a_name <> b_name),
        e as (select e.chat_id, edge_no as seq, a.name as s, b.name as t from memory_edges e join nodes a on a.chat_id = e.chat_id and a.id = source_id join nodes b on b.chat_id = e.chat_id and b.id = target_id)
        select c.chat_id, x, y, arg_min(s, seq) as source_name, arg_min(t, seq) as target_name, min(seq) as seq from e join c on c.chat_id = e.chat_id and x = least(s, t) and y = greatest(s, t) group by 1, 2, 3""",
    "q_recall_candidates": f"""with {NODES}, {EDGES}, {VALID}, v as (select * from valid where relationship_name <> 'contains'), {ENDS.format('v')}, r as (select chat_id || '|' || id as request, chat_id, id as node, name from nodes where node_type = 'Person'),
        one as (select r.request, ends.* from ends join r using (chat_id, node) qualify row_number() over (partition by r.request, node order by created_at desc, valid_at desc, source_id, target_id, relationship_name) <= 500),
        front as (select distinct request, chat_id, other as node from one except select request, chat_id, node from r),
        two as (select f.request, ends.* from ends join front f using (chat_id, node) qualify row_number() over (partition by f.request, node order by created_at desc, valid_at desc, source_id, target_id, relationship_name) <= 500),
        txt as (select r.request, e.* from valid e join r on r.chat_id = e.chat_id and trim(r.name) <> '' and contains({ALL_LOW('e.edge_text')}, {_fold('r.name')}))
        select request, cast(min(source) as int) as source, source_id, relationship_name, target_id, epoch_us(valid_at) as valid_us from (
          select request, 0 as source, source_id, relationship_name, target_id, valid_at from one union all select request, 1, source_id, relationship_name, target_id, valid_at from two
          union all select request, 2, source_id, relationship_name, target_id, valid_at from txt) group by request, source_id, relationship_name, target_id, valid_at""",
    "q_injection_cap": f"""with {QUOTA}, p as (select request, unnest([3, 1, 2, 5, 4, 6]) as place, unnest([1, 3, 6, 7, 8, 9]) as pos from (select distinct request from quota)),
        j as (select request, place, source_id, relationship_name, target_id, row_number() over (partition by request order by pos) as slot from p join quota using (request, place)) select * from j where slot <= 5""",
    "q_recall_prompt": f"""with {QUOTA}, sn as (select source_id, relationship_name, target_id, max(valid_at) as valid_at from edges group by 1, 2, 3)
        select request, md5(string_agg(place || '. ' || source_id || ' ' || relationship_name || ' ' || target_id || ' (since ' || strftime(valid_at, '%Y-%m-%d') || ')', chr(10) order by place)) as prompt_md5
        from quota join sn using (source_id, relationship_name, target_id) group by 1""",
    "q_context_rebuild": f"""with {RENDER}, f as (select chat_id, strftime(timestamp, '%Y-%m-%d') as day, min(id) as first_id, max(id) as last_id, count(*) as n from messages group by 1, 2),
        s as (select * from f where last_id < (select max(g.last_id) from f g where g.chat_id = f.chat_id) qualify row_number() over (partition by chat_id order by last_id desc) <= 2),
        bd as (select chat_id, max(last_id) as upto from s group by 1), tail as (select m.chat_id, m.id from messages m left join bd using (chat_id) where upto is null or m.id > upto),
        led as (select chat_id, id, '<memory>' || coalesce(text, '') || '</memory>' as c from messages where mentions_bot)
        select chat_id, 1 as block, last_id as position, 0 as turn, last_id as seq, 'user' as role, md5('<summary range="' || first_id || '-' || last_id || '">' || n || ' rows &amp; more</summary>') as content_md5 from s
        union all select chat_id, 2, id, 0, id, 'user', md5(content) from said join tail using (chat_id, id) union all select chat_id, 2, id, 0, id, 'user', md5(content) from came join tail using (chat_id, id)
        union all select chat_id, 2, id, 0, id, 'assistant', md5(content) from bot join tail using (chat_id, id)
        union all select led.chat_id, case when tail.id is null then 3 else 2 end, led.id, 1, led.id, 'user', md5(c) from led left join tail on tail.chat_id = led.chat_id and tail.id = led.id""",
    "q_context_stats": f"with {RENDER}, a as (select * from said union all select * from came union all select * from bot) select chat_id, count(*) as items, cast(sum(strlen(content)) as bigint) as bytes from a group by 1",
    "q_wake_batches": """select m.chat_id, count(*) as messages, max(id) as marker from messages m left join (select chat_id, max(id) as upper from messages where direction = 'outbound' group by 1) b using (chat_id)
        where event_type not in ('join', 'leave') and (upper is null or id > upper) group by 1""",
    "q_staleness_decision": """with r as (select * from messages where event_type not in ('join', 'leave')), d as (select chat_id, id, platform_msg_id, direction,
        coalesce(sum(case when direction = 'inbound' then 1 else 0 end) over (partition by chat_id order by id rows between 1 following and unbounded following), 0) as n from r)
        select chat_id, case when n > 20 then 'discard' when n > 10 and not contains(platform_msg_id, ':') then 'quote' else 'plain' end as action, count(*) as n from d where direction = 'outbound' group by 1, 2""",
    "q_topic_weights": f"with {TOPW} select chat_id, id, rank, weight from weights",
    "q_topic_pick": f"""with {TOPW}, tail as (select chat_id, {ALL_LOW("coalesce(text, '')")} as t from messages qualify row_number() over (partition by chat_id order by id desc) <= 50),
        left_ as (select * from weights w where not exists (select 1 from tail where tail.chat_id = w.chat_id and trim(w.name) <> '' and contains(t, {_fold('w.name')}))),
        c as (select *, sum(weight) over (partition by chat_id order by rank) as upto, sum(weight) over (partition by chat_id) as total from left_)
        select chat_id, arg_min(id, rank) as id from c where total > 0 and upto > 0.5 * total group by 1""",
    "q_warmup_schedule": f"""with {MONO}, q as (select chat_id, factor, greatest(1, 5 - factor) as quota from locks), w as (select *, 43200 // quota as win from q),
        s as (select *, unnest(range(0, quota)) as k from w)
        select chat_id, factor, cast(quota as int) as quota, cast(win * power(2, factor) as bigint) as gap,
        cast(k * win + floor(cast(('0x' || substr(md5(chat_id || '|' || k || '|1'), 1, 12)) as bigint) / cast(281474976710656 as double) * win) as bigint) as second from s""",
    "q_silence_gate": """with l as (select chat_id, max(timestamp) as last from messages where event_type not in ('join', 'leave') and chat_id is not null group by 1), e as (select max(last) as fin from l)
        select chat_id, hour(last) * 60 + minute(last) >= 540 and hour(last) * 60 + minute(last) < 1260 as active, epoch(fin) - epoch(last) >= 86400 as silent, strftime(last, '%Y-%m-%d') as day from l, e""",
    "q_cooldowns": """with t as (select chat_id, cast(max(timestamp) as date) as today from messages where chat_id is not null group by 1)
        select distinct m.chat_id, strftime(timestamp, '%Y-%m-%d') as day, datediff('day', cast(timestamp as date), today) < 7 as active from messages m join t using (chat_id) where event_type = 'edit'""",
    "q_retry_delays": """select cast(length(relationship_name) % 9 + 1 as int) as attempt, count(*) as n, least(2.0 * power(2.0, length(relationship_name) % 9), 60.0) as seconds from memory_edges group by all""",
    "q_text_hygiene": """select chat_id, id, text as said, trim(text) as kept from messages where text is not null and not contains(text, '<') and not contains(text, chr(10)) and trim(text) <> '' and regexp_full_match(text, '[ -~]+')""",
    "q_names_shown": """select distinct chat_id, true as valid, case when trim(coalesce(regexp_extract(sender_display_name, '^[^ ]* ((.|\\n)*)$', 1), '')) <> '' then sender_display_name
        when trim(coalesce(sender_username, '')) <> '' then '@' || sender_username else coalesce(sender_id, '?') end as shown,
        case when regexp_replace(lower(coalesce(sender_username, '')), '[^a-z0-9_-]', '', 'g') = '' then 'you' else regexp_replace(lower(sender_username), '[^a-z0-9_-]', '', 'g') end as tag from messages where chat_id is not null""",
    "q_excerpts": "select edge_no, case when length(edge_text) > 60 then substr(edge_text, 1, 60) || '…' else edge_text end as excerpt from memory_edges",
    "q_extraction_lines": """select chat_id, id, '[' || strftime(timestamp, '%H:%M') || '] ' || coalesce(sender_display_name, '') || case when forward_kind is not null then ' (forwarded ' || case when forward_automatic then 'auto' else forward_kind end
        || ' ' || coalesce(forward_label, '') || ')' else '' end || ': ' || case event_type when 'join' then '[joined]' when 'leave' then '[left]' else coalesce(text, '') end as line from messages where event_type <> 'edit'""",
    "q_summary_lines": """select chat_id, id, '[' || coalesce(sender_display_name, '') || ' ' || strftime(timestamp, '%H:%M') || '] ' || text as line from messages where text is not null
        qualify row_number() over (partition by chat_id order by id desc) <= 200""",
}
