"""Log, context and trigger queries over messages."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import STOPWORDS, GREETINGS
from ..operators import context, log, recall, triggers
from ..sources import table

CONV = "event_type not in ('join', 'leave')"


def _m(spark, folder):
    return table(spark, folder, "messages")


def tail_after(spark, folder):
    m = _m(spark, folder)
    return log.tail_after(m, log.last_outbound(m), "upper").select("chat_id", "id", "platform_msg_id", "text")


def id_range(spark, folder):
    m = _m(spark, folder)
    return log.id_range(m, log.last_outbound(m)).select("chat_id", "id", "direction")


def latest_n(spark, folder):
    return log.latest_n(_m(spark, folder), 50).select("chat_id", "position", "id", "text")


def count_after(spark, folder):
    m = _m(spark, folder)
    t = log.tail_after(m, log.last_outbound(m), "upper").where("direction = 'inbound' and " + CONV)
    return t.groupBy("chat_id").agg(F.count(F.lit(1)).alias("inbound_after"))


def sender_newest(spark, folder):
    return log.first_by(_m(spark, folder), True, "sender_id")


def reply_target(spark, folder):
    return log.reply_targets(_m(spark, folder))


def latest_version(spark, folder):
    return log.first_by(_m(spark, folder), True, "id", "event_type", "text")


def dedup(spark, folder):
    return log.first_writes(_m(spark, folder)).select("chat_id", "platform_msg_id", "event_type", "id")


def edit_delta(spark, folder):
    return log.real_edits(_m(spark, folder))


def batch_reply(spark, folder):
    return log.batch_replies(_m(spark, folder))


def state_last_write(spark, folder):
    s = _m(spark, folder).where("sender_id is not null")
    return s.groupBy("chat_id", "sender_id").agg(F.max_by("sender_display_name", "id").alias("display_name"), F.max_by("sender_username", "id").alias("username"))


def counters(spark, folder):
    s = _m(spark, folder)
    return s.groupBy("chat_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("mentions_bot").alias("mentions"), F.count_if("is_reply_to_bot").alias("bot_replies"))


def status_rates(spark, folder):
    m = _m(spark, folder).where(CONV)
    inbound, out = F.count_if(F.col("direction") == "inbound"), F.count_if(F.col("direction") == "outbound")
    rate = F.when(inbound > 0, F.round(100 * out / inbound, 6))
    return m.groupBy("chat_id").agg(inbound.alias("inbound"), out.alias("outbound"), rate.alias("participation_pct"), F.unix_micros(F.max("timestamp")).alias("newest_us"))


def keep_two(spark, folder):
    return context.keep_newest(log.batch_frames(_m(spark, folder))).select("chat_id", "position", "first_id", "last_id", "row_count")


def ingest_delay(spark, folder):
    from ..operators.metrics import latency

    m = _m(spark, folder).select("chat_id", (F.unix_timestamp("ingested_at") - F.unix_timestamp("timestamp")).alias("delay"))
    return latency(m, ["chat_id"], "delay")


def edge_ids(spark, folder):
    """Both forms of each fact's id, and whether the JSON one reads back."""
    from ..functions import ids

    e = table(spark, folder, "memory_edges").select("chat_id", "source_id", "relationship_name", "target_id", "valid_at").distinct()
    key = [F.col(c) for c in ("source_id", "relationship_name", "target_id", "valid_at")]
    e = e.withColumn("json_id", ids.json_edge_id(*key)).withColumn("pipe_id", ids.pipe_edge_id(*key))
    back = ids.decode_edge_id(F.col("json_id"))
    return e.select("chat_id", "json_id", "pipe_id", F.coalesce((back["source_id"] == F.col("source_id")) & (back["valid_at"] == F.col("valid_at")), F.lit(False)).alias("reads_back"))


QUERIES = {
    "q_log_tail_after": tail_after, "q_log_range": id_range, "q_log_latest_n": latest_n, "q_log_count_after": count_after,
    "q_log_sender_newest": sender_newest, "q_log_reply_target": reply_target, "q_log_latest_version": latest_version, "q_log_dedup": dedup,
    "q_edit_delta": edit_delta, "q_batch_reply": batch_reply, "q_state_last_write": state_last_write, "q_state_counters": counters,
    "q_status_rates": status_rates, "q_keep_two": keep_two, "q_metric_latency": ingest_delay,
    "q_trigger_tail_stats": lambda s, f: log.tail_stats(_m(s, f)), "q_batch_frames": lambda s, f: log.batch_frames(_m(s, f)),
    "q_staleness": lambda s, f: log.staleness(_m(s, f)), "q_trigger_monologue": lambda s, f: log.monologues(_m(s, f)),
    "q_skeleton_batches": lambda s, f: log.skeleton_batches(_m(s, f)), "q_engagement": lambda s, f: log.engagement(_m(s, f)),
    "q_origin_verified": lambda s, f: log.verified_origins(_m(s, f)), "q_context_render": lambda s, f: context.render_messages(_m(s, f)),
    "q_context_islands": lambda s, f: context.islands(_m(s, f)),
    "q_terms_budget": lambda s, f: recall.budget_terms(recall.term_pool(_m(s, f))),
    "q_terms_alnum": lambda s, f: recall.term_pool(_m(s, f)).where("kind = 'word'").groupBy("term").agg(F.count(F.lit(1)).alias("n")),
    "q_wake_fires": lambda s, f: triggers.wake_fires(_m(s, f)), "q_digest_batches": lambda s, f: triggers.digest_batches(_m(s, f)),
    "q_digest_boundaries": lambda s, f: triggers.digest_boundaries(triggers.digest_batches(_m(s, f))), "q_session_wakes": lambda s, f: triggers.session_wakes(_m(s, f)),
    "q_edge_ids": edge_ids,
}

_bounds = "b as (select chat_id, min(id) as lower, max(id) as upper from messages where direction = 'outbound' group by chat_id)"
_day = "strftime(timestamp, '%Y-%m-%d')"
_esc = lambda x: f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_att = lambda x: f"replace({_esc(x)}, '\"', '&quot;')"
_greet = ", ".join(f"'{g}'" for g in GREETINGS)

# sequential rules, row by row
_c = r"len(regexp_extract_all({0}, '[\x{{3040}}-\x{{30FF}}\x{{3400}}-\x{{4DBF}}\x{{4E00}}-\x{{9FFF}}\x{{AC00}}-\x{{D7AF}}]'))".format("coalesce(text, '')")
_w = r"len(list_filter(regexp_split_to_array({0}, '[\s\p{{Z}}\x{{0B}}\x{{85}}]+'), lambda w: w <> ''))".format("coalesce(text, '')")
WAKES = f"""r as (select chat_id, id, cast(epoch(timestamp) as bigint) as t, row_number() over (partition by chat_id order by id) as n from messages where direction = 'inbound' and {CONV}),
  w(chat_id, n, id, last, cnt, reason) as (select chat_id, n, id, t, 1, cast(null as varchar) from r where n = 1 union all
    select chat_id, n, id, case when f is null then last else t end, case when f is null then cnt else 0 end, f from (
      select r.chat_id, r.n, r.id, r.t, w.last, w.cnt + 1 as cnt, case when r.t - w.last >= 300 then case when w.cnt + 1 >= 5 then 'count' when r.t - w.last >= 3600 then 'interval' end end as f
      from r join w on w.chat_id = r.chat_id and r.n = w.n + 1))"""
DIGESTS = f"""r as (select chat_id, id, cast(epoch(timestamp) as bigint) as t, row_number() over (partition by chat_id order by id) as n, {_c} as c, {_w} as w, octet_length(encode(coalesce(text, ''))) as b from messages where {CONV}),
  d(chat_id, n, id, last, m, c, w, b, got) as (select distinct chat_id, cast(0 as bigint), cast(null as bigint), cast(null as bigint), cast(0 as bigint), cast(0 as bigint), cast(0 as bigint), cast(0 as bigint), cast(0 as bigint) from r union all
    select chat_id, n, id, case when f then t else last end, case when f then 0 else m end, case when f then 0 else c end, case when f then 0 else w end, case when f then 0 else b end, case when f then m else 0 end from (
      select *, m >= 100 or c >= 5000 or w >= 2500 or b >= 20480 or coalesce(t - last >= 21600, false) as f from (
        select r.chat_id, r.n, r.id, r.t, d.last, d.m + 1 as m, d.c + r.c as c, d.w + r.w as w, d.b + r.b as b from r join d on d.chat_id = r.chat_id and r.n = d.n + 1)))"""

CJK = r"\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}"
_stop = ", ".join(f"'{w}'" for w in STOPWORDS)
TERMS = rf"""wd as (select chat_id, id, list_filter(regexp_split_to_array(lower(text), '([{CJK}]|[^\p{{L}}\p{{N}}])+'), lambda w: length(w) >= 2 and w not in ({_stop})) as ws,
    list_filter(regexp_split_to_array(lower(text), '[^{CJK}]+'), lambda r: length(r) >= 2) as rs from messages where text is not null),
  words as (select chat_id, id, unnest(ws) as term, unnest(range(1, len(ws) + 1)) as position from wd)"""

SESSIONS = f"""r as (select chat_id, id, cast(epoch(timestamp) as bigint) as t, coalesce(mentions_bot, false) or coalesce(is_reply_to_bot, false) as f, row_number() over (partition by chat_id order by id) as n from messages where direction = 'inbound' and {CONV}),
  s(chat_id, n, last, cnt, busy, cool, wait, mark, ev) as (
    select distinct chat_id, cast(0 as bigint), cast(null as bigint), 0, cast(-1 as bigint), cast(-1 as bigint), cast(null as bigint), cast(null as bigint), cast([] as struct(id bigint, reason varchar, since bigint)[]) from r union all
    select chat_id, n, case when st then t else last end, case when st then 0 else cnt end, case when st then t + 30 else busy end, case when f and t >= cool then t + 10 else cool end,
      case when f and t >= cool and t < busy then id else wait end, case when st then id else mark end, ev || case when st then [struct_pack(id := id, reason := coalesce(rs, 'forced'), since := coalesce(mark, -1))] else [] end
    from (select *, case when f then t >= cool and t >= busy else rs is not null and t >= busy end as st from (select *, case when not f and t - last >= 300 then case when cnt >= 5 then 'count' when t - last >= 3600 then 'interval' end end as rs from (
      select r.chat_id, r.n, r.id, r.t, r.f, s.cool, coalesce(case when q then s.busy else s.last end, r.t) as last, case when q then 0 else s.cnt end + 1 as cnt, case when q then s.busy + 30 else s.busy end as busy,
        case when q then null else s.wait end as wait, case when q then s.wait else s.mark end as mark, case when q then [struct_pack(id := s.wait, reason := 'queued', since := coalesce(s.mark, -1))] else [] end as ev
      from r join (select *, n + 1 as nx from s) s on s.chat_id = r.chat_id and r.n = s.nx, lateral (select s.wait is not null and r.t >= s.busy as q) l))))"""

SQL = {
    "q_session_wakes": f"with recursive {SESSIONS}, e as (select chat_id, unnest(ev) as x from s) select chat_id, x.id as id, x.reason as reason, x.since as since from e",
    "q_terms_alnum": f"with {TERMS} select term, count(*) as n from words group by 1",
    "q_terms_budget": f"""with {TERMS}, runs as (select chat_id, id, unnest(rs) as r, unnest(range(1, len(rs) + 1)) as k from wd), starts as (select *, unnest(range(1, length(r))) as s from runs), sizes as (select *, unnest([2, 3, 4, 5]) as z from starts),
        grams as (select chat_id, id, substr(r, s, z) as term, k * 1000000000 + s * 10 + z as position from sizes where s + z - 1 <= length(r)),
        every as (select 'word' as kind, * from words union all select 'gram', * from grams), once as (select chat_id, id, kind, term, min(position) as position from every group by 1, 2, 3, 4),
        rk as (select chat_id, id, kind, term, row_number() over (partition by chat_id, id, kind order by case when kind = 'gram' then -length(term) else 0 end, position) as rank from once)
        select * from rk where rank <= case when kind = 'gram' then 40 else 20 end""",
    "q_wake_fires": f"with recursive {WAKES} select chat_id, id, reason from w where reason is not null",
    "q_digest_batches": f"with recursive {DIGESTS} select chat_id, id as last_id, got as messages from d where got > 0",
    "q_digest_boundaries": f"""with recursive {DIGESTS}, x as (select chat_id, id as last_id, lag(id) over (partition by chat_id order by id) as p, row_number() over (partition by chat_id order by id) as k from d where got > 0)
        select chat_id, last_id, coalesce(p, 0) as leave_upto, case when k = 1 then -1 else p end as previous from x""",
    "q_edge_ids": """select distinct chat_id, '{"relationship_name":"' || relationship_name || '","source_id":"' || source_id || '","target_id":"' || target_id || '","valid_at":"' || strftime(valid_at, '%Y-%m-%dT%H:%M:%S.%f') || 'Z"}' as json_id,
        source_id || '|' || relationship_name || '|' || target_id || '|' || epoch_us(valid_at) as pipe_id, true as reads_back from memory_edges""",
    "q_log_tail_after": f"with {_bounds} select m.chat_id, id, platform_msg_id, text from messages m left join b using (chat_id) where upper is null or id > upper",
    "q_log_range": f"with {_bounds} select m.chat_id, id, direction from messages m join b using (chat_id) where id > lower and id <= upper",
    "q_log_latest_n": f"""with t as (select * from messages where {CONV} qualify row_number() over (partition by chat_id order by id desc) <= 50)
        select chat_id, row_number() over (partition by chat_id order by id) as position, id, text from t""",
    "q_log_count_after": f"""with {_bounds} select m.chat_id, count(*) as inbound_after from messages m left join b using (chat_id)
        where (upper is null or id > upper) and direction = 'inbound' and {CONV} group by m.chat_id""",
    "q_log_sender_newest": """select chat_id, platform_msg_id, sender_id from messages where platform_msg_id is not null
        qualify row_number() over (partition by chat_id, platform_msg_id order by id desc) = 1""",
    "q_log_reply_target": """with t as (select chat_id, platform_msg_id, id as target_id, sender_display_name as target_name from messages
        qualify row_number() over (partition by chat_id, platform_msg_id order by id) = 1)
        select m.chat_id, m.id, target_id, target_name from messages m left join t on t.chat_id = m.chat_id and t.platform_msg_id = m.reply_to_platform_msg_id
        where m.reply_to_platform_msg_id is not null""",
    "q_log_latest_version": """select chat_id, platform_msg_id, id, event_type, text from messages where platform_msg_id is not null
        qualify row_number() over (partition by chat_id, platform_msg_id order by id desc) = 1""",
    "q_log_dedup": "select chat_id, platform_msg_id, event_type, min(id) as id from messages group by chat_id, platform_msg_id, direction, event_type, timestamp, text",
    "q_edit_delta": """with d as (select chat_id, platform_msg_id, direction, event_type, timestamp, text, min(id) as id from messages group by all),
        l as (select *, lag(text) over w as before, row_number() over w as n from d window w as (partition by chat_id, platform_msg_id order by id))
        select chat_id, platform_msg_id, id from l where event_type = 'edit' and (n = 1 or text is distinct from before)""",
    "q_batch_reply": f"""with r as (select chat_id, {_day} as batch, id, platform_msg_id, reply_to_platform_msg_id as r, sender_id from messages)
        select a.chat_id, a.batch, a.id, max(t.id) as target_id, arg_max(t.sender_id, t.id) as target_sender from r a
        join r t on t.chat_id = a.chat_id and t.batch = a.batch and t.platform_msg_id = a.r and t.id < a.id group by 1, 2, 3""",
    "q_state_last_write": """select chat_id, sender_id, sender_display_name as display_name, sender_username as username from messages where sender_id is not null
        qualify row_number() over (partition by chat_id, sender_id order by id desc) = 1""",
    "q_state_counters": """select chat_id, event_type, count(*) as n, count(*) filter (mentions_bot) as mentions, count(*) filter (is_reply_to_bot) as bot_replies
        from messages group by 1, 2""",
    "q_status_rates": f"""select chat_id, count(*) filter (direction = 'inbound') as inbound, count(*) filter (direction = 'outbound') as outbound,
        case when count(*) filter (direction = 'inbound') > 0 then round(100.0 * count(*) filter (direction = 'outbound') / count(*) filter (direction = 'inbound'), 6) end as participation_pct,
        epoch_us(max(timestamp)) as newest_us from messages where {CONV} group by 1""",
    "q_keep_two": f"""with f as (select chat_id, {_day} as batch, min(id) as first_id, max(id) as last_id, count(*) as row_count from messages group by 1, 2),
        t as (select * from f qualify row_number() over (partition by chat_id order by last_id desc) <= 2)
        select chat_id, row_number() over (partition by chat_id order by last_id) as position, first_id, last_id, row_count from t""",
    "q_metric_latency": """with d as (select chat_id, cast(epoch(ingested_at) - epoch(timestamp) as bigint) as delay from messages),
        r as (select *, row_number() over (partition by chat_id order by delay) as i, count(*) over (partition by chat_id) as c from d)
        select chat_id, count(*) as n, round(avg(delay), 6) as mean, min(delay) as least, max(delay) as most,
          max(delay) filter (i = least(cast(floor(0.5 * c) as bigint), c - 1) + 1) as p50, max(delay) filter (i = least(cast(floor(0.95 * c) as bigint), c - 1) + 1) as p95
        from r group by 1""",
    "q_trigger_tail_stats": rf"""select chat_id, count(*) as messages, cast(sum(octet_length(encode(text))) as bigint) as bytes,
        cast(sum(len(regexp_extract_all(text, '[\x{{3040}}-\x{{30FF}}\x{{3400}}-\x{{4DBF}}\x{{4E00}}-\x{{9FFF}}\x{{AC00}}-\x{{D7AF}}]'))) as bigint) as chars_cjk,
        cast(sum(len(list_filter(regexp_split_to_array(text, '[\s\p{{Z}}\x{{0B}}\x{{85}}]+'), lambda w: w <> ''))) as bigint) as words from messages where {CONV} group by 1""",
    "q_batch_frames": f"""select chat_id, {_day} as batch, min(id) as first_id, max(id) as last_id, count(*) as row_count,
        epoch_us(arg_min(timestamp, id)) as first_us, epoch_us(arg_max(timestamp, id)) as last_us from messages group by 1, 2""",
    "q_staleness": f"""with s as (select chat_id, id, direction, coalesce(sum(case when direction = 'inbound' then 1 else 0 end) over (partition by chat_id order by id
        rows between 1 following and unbounded following), 0) as n from messages where {CONV}) select chat_id, id, cast(n as bigint) as inbound_after from s where direction = 'outbound'""",
    "q_trigger_monologue": f"""with s as (select chat_id, direction, sum(case when direction = 'inbound' then 1 else 0 end) over (partition by chat_id order by id rows unbounded preceding) as h
        from messages where {CONV}), r as (select chat_id, h, count(*) as run from s where direction = 'outbound' group by 1, 2)
        select chat_id, max(run) as longest_run, count(*) filter (run >= 2) as locks from r group by 1""",
    "q_skeleton_batches": rf"""with t as (select chat_id, {_day} as batch, text, lower(regexp_replace(text, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')) as l from messages),
        u as (select *, regexp_replace(l, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g') as bare from t)
        select chat_id, batch, bool_and(not regexp_matches(coalesce(text, ''), '[\p{{L}}\p{{N}}]') or l in ({_greet}) or (bare <> '' and bare in ({_greet}))) as skeleton,
        count(*) as row_count from u group by 1, 2""",
    "q_engagement": """select o.chat_id, o.id, exists (select 1 from messages i where i.chat_id = o.chat_id and i.direction = 'inbound'
        and epoch(i.timestamp) > epoch(o.timestamp) and epoch(i.timestamp) <= epoch(o.timestamp) + 1800) as engaged from messages o where o.direction = 'outbound'""",
    "q_origin_verified": """with s as (select distinct chat_id, sender_id, lower(trim(sender_display_name)) as label from messages where sender_id is not null)
        select m.chat_id, m.id, m.forward_origin_id from messages m where forward_origin_id is not null
        and not exists (select 1 from s where s.chat_id = m.chat_id and s.label = lower(trim(m.forward_label)) and s.sender_id <> m.forward_origin_id)""",
    "q_context_render": f"""with t as (select chat_id, platform_msg_id, id as rid, sender_display_name as rname from messages
        qualify row_number() over (partition by chat_id, platform_msg_id order by id) = 1)
        select m.chat_id, m.id, '<msg from="' || {_att("coalesce(sender_display_name, '')")} || '"' ||
          case when sender_username is not null then ' user="' || {_att('sender_username')} || '"' else '' end || ' at="' || strftime(timestamp, '%H:%M') || '" id="' || m.id || '"' ||
          case when event_type = 'edit' then ' kind="edit"' else '' end ||
          case when is_reply_to_bot then ' reply="bot"' when rid is not null then ' reply="user" reply_to_name="' || {_att("coalesce(rname, '')")} || '" reply_to_id="' || rid || '"'
               when reply_to_platform_msg_id is not null then ' reply="user"' else '' end ||
          case when coalesce(mentions_bot, false) then ' mention="bot"' else '' end || '>' || {_esc("coalesce(text, '')")} || '</msg>' as content
        from messages m left join t on t.chat_id = m.chat_id and t.platform_msg_id = m.reply_to_platform_msg_id
        where direction = 'inbound' and event_type in ('message', 'edit')""",
    "q_context_islands": """select chat_id, id from (select chat_id, id, sender_id, text, lag(id) over w as p, lag(sender_id) over w as ps, lag(text) over w as pt
        from messages window w as (partition by chat_id order by id)) where p is null or sender_id is distinct from ps or text is distinct from pt""",
}
