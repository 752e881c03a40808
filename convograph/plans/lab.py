"""Evaluation queries. An answer is a scored pair: its score is the probability, its kind of node the gold label, its names the tokens."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, lab
from ..sources import table
from .graph import FOLD, NODES, _edges, _nodes


def injection_windows(spark, folder):
    """Rows that mention the bot stand for injections at their second."""
    m = table(spark, folder, "messages").where("chat_id is not null")
    return lab.injection_windows(m, m.where("mentions_bot").select("chat_id", F.col("timestamp").alias("injected_at")))


def inbound_windows(spark, folder):
    return lab.inbound_windows(table(spark, folder, "messages").where("chat_id is not null"))


def _kinds(spark, folder):
    return _nodes(spark, folder).select("chat_id", "id", F.col("node_type").alias("kind"))


def hard_negatives(spark, folder):
    c = table(spark, folder, "merge_candidates")
    known = c.select("chat_id", F.least("a_id", "b_id").alias("x"), F.greatest("a_id", "b_id").alias("y")).dropna()
    return lab.hard_negatives(_kinds(spark, folder), known)


def easy_negatives(spark, folder):
    return lab.easy_negatives(_kinds(spark, folder), 100)


def buried(spark, folder):
    return lab.buried_windows(table(spark, folder, "memory_edges"))


def _answers(spark, folder):
    c = table(spark, folder, "merge_candidates").where("b_id is not null and a_name is not null")
    n = lambda x: F.char_length(F.coalesce(x, F.lit("")))
    return c.groupBy("chat_id", "a_id", "b_id", "node_kind").agg(F.max(F.when(~F.isnan("score"), F.col("score"))).alias("p"), F.max(n(F.col("a_name"))).alias("tokens_in"), F.max(n(F.col("b_name"))).alias("tokens_out")).select(
        F.concat_ws("|", "chat_id", "a_id", "b_id").alias("task_id"), F.col("node_kind").alias("suite"), "p", F.when(F.col("tokens_in") % 3 > 0, (F.col("node_kind") == "Person").cast("int")).alias("gold"),
        F.when(F.col("p").isNull(), "no answer").alias("error"), (F.col("tokens_in") + F.col("tokens_out")).alias("cost"), "tokens_in", "tokens_out", (F.col("tokens_out") / 10).alias("seconds"))


def suites(spark, folder):
    return lab.suite_totals(_answers(spark, folder), ["suite"])


def sample(spark, folder):
    a = _answers(spark, folder).where("p is not null")
    return lab.stratified(a, "p", ["task_id"], 300).select("task_id", "stratum")


def labels(spark, folder):
    """Labels of tasks: gold where there is one, the reference's (a match or not) otherwise."""
    a = _answers(spark, folder)
    gold = a.where("gold is not null").select("task_id", F.col("gold").cast("string").alias("label"))
    reference = a.where("p is not null").select("task_id", F.when(F.col("p") >= 0.88, "1").otherwise("0").alias("label"))
    t = lab.with_labels(a.select("task_id"), gold, reference)
    return t.groupBy("label", "label_source").agg(F.count(F.lit(1)).alias("n"))


def alignment(spark, folder):
    """Pairs that were scored in both orders, as two wordings of one question."""
    a = _answers(spark, folder)
    c = table(spark, folder, "merge_candidates").where("b_id is not null and a_name is not null")
    both = lambda x, y: c.groupBy("chat_id", x, y).agg(F.max(F.when(~F.isnan("score"), F.col("score"))).alias("p")).select(F.concat_ws("|", "chat_id", x, y).alias("task_id"), "p")
    return lab.align(both("a_id", "b_id"), both("b_id", "a_id").where("p is not null"), "task_id", "p").where("a is not null").select("task_id", "a", "b", (F.abs(F.col("a") - F.col("b")) > 0.1).alias("differs"))


def sanity(spark, folder):
    """The text table as it was after half of the rows, against the graph."""
    rows = table(spark, folder, "memory_edges")
    half = rows.join(F.broadcast(rows.agg(F.floor(F.max("edge_no") / 2).alias("h")))).where("edge_no <= h")
    return lab.sidecar_sanity(half, rows, graph.KEY)


def fixture_meta(spark, folder):
    """Rows of each chat by table."""
    every = None
    for name in ("messages", "memory_nodes", "memory_edges", "merge_candidates", "documents"):
        part = table(spark, folder, name).where("chat_id is not null").groupBy("chat_id").agg(F.count(F.lit(1)).alias("n")).withColumn("name", F.lit(name))
        every = part if every is None else every.unionByName(part)
    return every


def variants(spark, folder):
    return lab.variants(_nodes(spark, folder).where("name rlike '^[ -~]+$'"))


QUERIES = {
    "q_injection_windows": injection_windows, "q_inbound_windows": inbound_windows, "q_hard_negatives": hard_negatives, "q_easy_negatives": easy_negatives, "q_buried_windows": buried,
    "q_suite_totals": suites, "q_stratified_sample": sample, "q_label_precedence": labels, "q_alignment": alignment, "q_sidecar_sanity": sanity, "q_fixture_meta": fixture_meta,
    "q_label_distribution": lambda s, d: lab.label_distribution(table(s, d, "subject_labels"), "subject"), "q_name_variants": variants,
}

ANS = """ans as (select chat_id || '|' || a_id || '|' || b_id as task_id, node_kind as suite, p, case when ti % 3 > 0 then case when node_kind = 'Person' then 1 else 0 end end as gold, p is null as bad, ti, t_o
  from (select chat_id, a_id, b_id, node_kind, max(case when not isnan(score) then score end) as p, max(length(a_name)) as ti, max(length(coalesce(b_name, ''))) as t_o
    from merge_candidates where b_id is not null and a_name is not null group by 1, 2, 3, 4))"""
TERMS = " ".join(f"when contains(lower(name), '{en}') then regexp_replace(name, '{en}', '{zh}', 'gi')" for en, zh in lab.GLOSSARY.items())
HASH = "md5({0} || '|{1}')".format

SQL = {
    "q_injection_windows": """with r as (select chat_id, id, cast(epoch(timestamp) as bigint) as t from messages where direction = 'inbound' and chat_id is not null), s as (select distinct chat_id, cast(epoch(timestamp) as bigint) as second from messages where mentions_bot and chat_id is not null),
        j as (select s.chat_id, second, id, t, row_number() over (partition by s.chat_id, second order by t desc, id desc) as back, count(*) over (partition by s.chat_id, second) as n from s join r on r.chat_id = s.chat_id and t <= second)
        select chat_id, second, row_number() over (partition by chat_id, second order by t, id) as place, id from j where back <= 5 and n >= 2""",
    "q_inbound_windows": """with r as (select chat_id, id, row_number() over (partition by chat_id order by id) as k, count(*) over (partition by chat_id) as n from messages where direction = 'inbound' and chat_id is not null),
        g as (select distinct chat_id, n, w, case when w = 0 then n else w * greatest(1, n // 9) end as fin from r, range(0, 9) t(w)), h as (select * from g where w = 0 or n >= 20 and fin >= 5)
        select h.chat_id, w as window, row_number() over (partition by h.chat_id, w order by k) as place, id from h join r on r.chat_id = h.chat_id and k > fin - 5 and k <= fin""",
    "q_hard_negatives": f"""with {NODES}, p as (select chat_id, node_type as kind, id, lead(id) over (partition by chat_id, node_type order by {HASH("chat_id || '|' || id", 0)}, id) as nx from nodes)
        select chat_id, kind, least(id, nx) as x, greatest(id, nx) as y from p where nx is not null and not exists (select 1 from merge_candidates c where c.chat_id = p.chat_id and least(a_id, b_id) = least(id, nx) and greatest(a_id, b_id) = greatest(id, nx))""",
    "q_easy_negatives": f"""with n as (select distinct chat_id, id from memory_nodes), d as (select *, row_number() over (order by {HASH("chat_id || '|' || id", 1)}, chat_id, id) as k from n qualify k <= 200),
        p as (select *, lead(chat_id) over (order by k) as bc, lead(id) over (order by k) as bi from d) select chat_id as a_chat, id as a_id, bc as b_chat, bi as b_id from p where k % 2 = 1 and bc is not null and bc <> chat_id""",
    "q_buried_windows": f"""with e as (select edge_no, chat_id, {HASH('edge_no', 0)} as o from memory_edges), w as (select edge_no as true_no, chat_id, row_number() over (order by o, edge_no) - 1 as win from e qualify win < 80),
        c as (select win, true_no, e.edge_no, row_number() over (partition by win order by e.chat_id <> w.chat_id, o, e.edge_no) as r from w join e on e.edge_no <> true_no),
        a as (select win, true_no, edge_no from c where r < 40 union all select win, true_no, true_no from w), t as (select *, ['direct', 'direct', 'topic', 'topic', 'chitchat'][win % 5 + 1] as template from a)
        select win as window, template, row_number() over (partition by win order by {HASH("edge_no || '|' || win", 0)}, edge_no) as place, edge_no, edge_no = true_no and template <> 'chitchat' as gold from t""",
    "q_suite_totals": f"""with {ANS} select suite, count(*) as n_tasks, count(*) filter (bad) as n_errors, cast(sum(ti + t_o) filter (not bad) as bigint) as cost_total, cast(sum(ti) filter (not bad) as bigint) as tokens_in_total,
        cast(sum(t_o) filter (not bad) as bigint) as tokens_out_total, round(avg(t_o / 10), 6) as seconds_mean, max(t_o / 10) as seconds_max, round(avg(case when gold is not null then 1.0 else 0.0 end), 9) as gold_coverage,
        round(avg(case when (p > 0.5) = (gold = 1) then 1.0 else 0.0 end) filter (p is not null and gold is not null), 9) as accuracy from ans group by 1""",
    "q_stratified_sample": f"""with {ANS}, r as (select task_id, row_number() over (order by p, task_id) as k, count(*) over () as n from ans where p is not null),
        s as (select *, cast((k > n // 5) as int) + cast((k > 2 * n // 5) as int) + cast((k > 3 * n // 5) as int) + cast((k > 4 * n // 5) as int) as stratum from r),
        z as (select stratum, count(*) as size, any_value(n) as n from s group by 1), q as (select *, least(300, n) * size // n as base, least(300, n) * size / n - least(300, n) * size // n as rest from z),
        q2 as (select stratum, n, size, base + case when row_number() over (order by rest desc, stratum) <= least(300, n) - sum(base) over () then 1 else 0 end as quota from q)
        select task_id, cast(case when q2.n <= 300 then 0 else stratum end as bigint) as stratum from s join q2 using (stratum) qualify q2.n <= 300 or row_number() over (partition by stratum order by {HASH('task_id', 0)}) <= quota""",
    "q_label_precedence": f"""with {ANS} select coalesce(cast(gold as varchar), case when p >= 0.88 then '1' when p is not null then '0' end) as label, case when gold is not null then 'gold' when p is not null then 'reference' end as label_source, count(*) as n from ans group by 1, 2""",
    "q_alignment": """with a as (select chat_id, a_id, b_id, max(case when not isnan(score) then score end) as p from merge_candidates where b_id is not null and a_name is not null group by 1, 2, 3)
        select x.chat_id || '|' || x.a_id || '|' || x.b_id as task_id, x.p as a, y.p as b, abs(x.p - y.p) > 0.1 as differs from a x join a y on y.chat_id = x.chat_id and y.a_id = x.b_id and y.b_id = x.a_id where x.p is not null and y.p is not null""",
    "q_sidecar_sanity": """with k as (select chat_id, source_id, relationship_name, target_id, valid_at, min(edge_no) as first from memory_edges group by all), h as (select max(edge_no) // 2 as h from memory_edges)
        select count(*) filter (first <= h) as both, cast(0 as bigint) as only_sidecar, count(*) filter (first > h) as only_graph from k, h""",
    "q_fixture_meta": " union all ".join(f"select chat_id, count(*) as n, '{t}' as name from {t} where chat_id is not null group by 1" for t in ("messages", "memory_nodes", "memory_edges", "merge_candidates", "documents")),
    "q_label_distribution": "select subject as label, count(*) as n from subject_labels where subject is not null group by 1",
    "q_name_variants": f"""with {NODES}, a as (select chat_id, id, name, list_filter(string_split(name, ' '), lambda x: x <> '') as w, regexp_extract_all(name, '[A-Za-z]+') as l from nodes where regexp_full_match(name, '[ -~]+')),
        v as (select chat_id, id, name, 'nickname' as transform, w[1] as v from a union all select chat_id, id, name, 'abbreviation', case when len(l) >= 2 then upper(list_aggregate(list_transform(l, lambda x: x[1]), 'string_agg', ''))
          when len(l) = 0 and length(name) >= 3 then name[1] || name[-1] end from a
        union all select chat_id, id, name, 'translation', case {TERMS} end from a) select chat_id, id, transform, v as name from v where v is not null and v <> name and v <> ''""",
}
