"""The queries of this package and their SQL."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import table
from .conversations import dialogue, rebuild_conversations
from .groups import group_matches
from .languages import fit_languages, label_segments
from .lookalikes import BLANK, same_form
from .mixing import mix, mixture_faults, share_report
from .names import link_names, same_entity_pairs
from .packing import fill_report, pack, packing_faults
from .pii import find_pii, learned_given, redact, texts_of
from .subjects import assign_subjects
from .uniform import same_looking, uniform_text


def p1_found(spark, folder):
    return rebuild_conversations(table(spark, folder, "messages"))


def p1_dialogue(spark, folder):
    """The turns of all kept conversations with their roles and texts."""
    return dialogue(table(spark, folder, "messages"), p1_found(spark, folder))


def p6_found(spark, folder):
    return group_matches(table(spark, folder, "merge_candidates"))


def p2_found(spark, folder):
    return same_entity_pairs(link_names(*(table(spark, folder, t) for t in ("messages", "memory_nodes", "merge_candidates"))))


def p2_entities(spark, folder):
    """Every record with the entity it belongs to, one row each."""
    return link_names(*(table(spark, folder, t) for t in ("messages", "memory_nodes", "merge_candidates"))).withColumn("entity", F.md5(F.col("entity").cast("binary")))


def p3_occurrences(spark, folder):
    texts = texts_of(table(spark, folder, "messages"), table(spark, folder, "memory_edges"))
    return texts, find_pii(texts, learned_given(table(spark, folder, "memory_nodes")))


def p3_found(spark, folder):
    return p3_occurrences(spark, folder)[1].select("src", "row_no", "start_pos", "pii_type")


def p3_redacted(spark, folder):
    """Every message and edge text with typed placeholders."""
    return redact(*p3_occurrences(spark, folder))


def p4_found(spark, folder):
    texts = texts_of(table(spark, folder, "messages"), table(spark, folder, "memory_edges"), "lang")
    return label_segments(texts, fit_languages(texts), only_wrong=True).select("src", "row_no", "seg_no", "seg_lang")


def p4_segments(spark, folder):
    """The language of every segment of every text with its confidence, whatever the label says."""
    texts = texts_of(table(spark, folder, "messages"), table(spark, folder, "memory_edges"), "lang")
    return label_segments(texts, fit_languages(texts)).select("src", "row_no", "seg_no", "seg_lang", F.round("confidence", 6).alias("confidence"))


def p5_forms(spark, folder):
    """The consistent form of every text and name."""
    m = table(spark, folder, "messages").where("text is not null").select(F.lit("message").alias("src"), F.col("id").cast("string").alias("key"), "text")
    n = table(spark, folder, "memory_nodes").where("name is not null").select(F.lit("node").alias("src"), F.col("id").alias("key"), F.col("name").alias("text")).distinct()
    return uniform_text(m.unionByName(n), "text", "form").select("src", "key", "form")


def p5_found(spark, folder):
    return same_looking(table(spark, folder, "messages"), "id", "text", "message").unionByName(
        same_looking(table(spark, folder, "memory_nodes"), "id", "name", "node"))


def p8_packed(spark, folder):
    return pack(table(spark, folder, "documents"))


def p8_report(spark, folder):
    return fill_report(p8_packed(spark, folder))


def p8_faults(spark, folder):
    return packing_faults(p8_packed(spark, folder), table(spark, folder, "documents"))


def p9_mixed(spark, folder):
    return mix(table(spark, folder, "documents"), table(spark, folder, "source_targets"))


def p9_shares(spark, folder):
    return share_report(p9_mixed(spark, folder), table(spark, folder, "source_targets"))


def p9_faults(spark, folder):
    return mixture_faults(p9_mixed(spark, folder), table(spark, folder, "documents"), table(spark, folder, "source_targets"))


def p10_shares(spark, folder):
    """The subjects of each document with their share of its sentences."""
    return assign_subjects(*(table(spark, folder, t) for t in ("documents", "subject_areas", "subject_labels")))


def p10_found(spark, folder):
    return p10_shares(spark, folder).select("doc_id", "subject")


def p10_composition(spark, folder):
    """The make-up of the corpus: documents and characters by subject, none included."""
    docs = table(spark, folder, "documents")
    return (
        docs.select("doc_id", "n_chars").join(p10_found(spark, folder), "doc_id", "left")
        .groupBy(F.coalesce("subject", F.lit("none")).alias("subject"))
        .agg(F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("n_chars"))
    )


QUERIES = {
    "p1_found": p1_found, "p1_dialogue": p1_dialogue, "p2_found": p2_found, "p2_entities": p2_entities, "p3_found": p3_found, "p3_redacted": p3_redacted, "p4_found": p4_found, "p4_segments": p4_segments,
    "p5_found": p5_found, "p5_forms": p5_forms, "p6_found": p6_found, "p8_packed": p8_packed, "p8_report": p8_report, "p8_faults": p8_faults, "p9_mixed": p9_mixed, "p9_shares": p9_shares, "p9_faults": p9_faults,
    "p10_found": p10_found, "p10_composition": p10_composition,
}

P1_SQL = r"""
with recursive r as (
  select * from messages where event_type in ('message', 'edit') and chat_id is not null and platform_msg_id is not null),
m as (
  select chat_id, platform_msg_id as p, min(timestamp) as t, min(id) as i,
         regexp_full_match(coalesce(arg_max(text, (timestamp, event_type = 'edit', id)), ''),
           '(\s|\p{Z}|\p{C}|[\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180E}\x{2800}\x{3164}\x{FE00}-\x{FE0F}\x{FFA0}])*') as blank,
         min(reply_to_platform_msg_id) as reply, min(direction) as direction, bool_or(sender_id is null) as bad
  from r group by chat_id, platform_msg_id),
c as (
  select chat_id, p, p as root, 0 as depth, bad from m where reply is null
  union all
  select m.chat_id, m.p, c.root, c.depth + 1, m.bad or m.t < u.t
  from c join m on m.chat_id = c.chat_id and m.reply = c.p join m u on u.chat_id = c.chat_id and u.p = c.p),
k as (
  select c.chat_id, c.root from c join m using (chat_id, p) group by c.chat_id, c.root
  having not bool_or(c.bad) and count(*) filter (not blank) >= 2
     and arg_min(direction, (t, depth, i)) filter (not blank) = 'inbound'
     and arg_max(direction, (t, depth, i)) filter (not blank) = 'outbound')
select c.chat_id, c.root as root_msg_id, row_number() over (partition by c.chat_id, c.root order by t, depth, i) as turn_no,
       c.p as platform_msg_id
from c join k using (chat_id, root) join m using (chat_id, p) where not blank
"""

P1_ROLES_SQL = P1_SQL.replace("min(reply_to_platform_msg_id) as reply,", "arg_max(text, (timestamp, event_type = 'edit', id)) as text, min(reply_to_platform_msg_id) as reply,").replace(
    "c.p as platform_msg_id\nfrom", "case when direction = 'outbound' then 'assistant' else 'user' end as role, text\nfrom")

P6_SQL = """
with recursive l as (
  select a_id as u, b_id as v from merge_candidates
  where a_id <> b_id and a_id <> '' and b_id <> '' and score >= 0.88 and not isnan(score)),
s as (select u, v from l union select v, u from l),
c as (select u as node_id, u as other from s union select c.node_id, s.v from c join s on c.other = s.u)
select node_id, min(other) as group_id from c group by node_id
"""

P5_SQL = f"""
with m as (
  select 'message' as src, chat_id, cast(id as varchar) as k, text as stored, {same_form('text')} as form from messages
  union
  select 'node', chat_id, id, name, {same_form('name')} from memory_nodes)
select distinct a.src, a.k as a_key, b.k as b_key
from m a join m b on a.src = b.src and a.chat_id = b.chat_id and a.form = b.form and a.stored <> b.stored and a.k < b.k
where not regexp_full_match(a.form, '{BLANK}')
"""

FORMS_SQL = f"""
select 'message' as src, cast(id as varchar) as key, {same_form('text')} as form from messages where text is not null
union all select distinct 'node', id, {same_form('name')} from memory_nodes where name is not null
"""
# what the reports of faults must say: these are invariants, no second packing or mixture
P8_SQL = "select * from (values ('over_capacity', cast(0 as bigint)), ('tokens_not_once', 0), ('split_needlessly', 0)) t(fault, n)"
P9_SQL = "select * from (values ('beyond_max_repeats', cast(0 as bigint)), ('gap_in_copies', 0), ('unknown_document', 0), ('other_size', 0)) t(fault, n)"

SQL = {"p1_found": P1_SQL, "p1_dialogue": P1_ROLES_SQL, "p5_found": P5_SQL, "p5_forms": FORMS_SQL, "p6_found": P6_SQL, "p8_faults": P8_SQL, "p9_faults": P9_SQL}
