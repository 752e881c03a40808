"""Metric queries; a row of merge_candidates is a scored verdict whose truth stands in for by its kind of node."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics
from ..sources import table

SAME = 0.88


def _scored(spark, folder):
    c = table(spark, folder, "merge_candidates").where("score is not null and not isnan(score)")
    return c.select("chat_id", "a_id", F.coalesce("b_id", F.lit("")).alias("b_id"), F.col("score").alias("p"), (F.col("node_kind") == "Person").cast("int").alias("gold"),
                    "node_kind", F.when(F.col("score") >= SAME, "Person").otherwise("Concept").alias("guess"), F.length("a_name").alias("length"))


def _pairs(spark, folder):
    s = _scored(spark, folder)
    return s.select("chat_id", F.least("a_id", "b_id").alias("x"), F.greatest("a_id", "b_id").alias("y"), "p", (F.col("p") >= SAME).alias("same"))


def alignment(spark, folder):
    """Per chat, the nodes that matched pairs name against those that edges use: hits, false positives and negatives."""
    c, e = table(spark, folder, "merge_candidates"), table(spark, folder, "memory_edges")
    said = c.select("chat_id", F.col("a_id").alias("id")).union(c.select("chat_id", "b_id")).where("id is not null").distinct().withColumn("s", F.lit(1))
    used = e.select("chat_id", F.col("source_id").alias("id")).union(e.select("chat_id", "target_id")).distinct().withColumn("u", F.lit(1))
    j = said.join(used, ["chat_id", "id"], "full_outer")
    hits, fp, fn = F.count_if(F.col("s").isNotNull() & F.col("u").isNotNull()), F.count_if(F.col("u").isNull()), F.count_if(F.col("s").isNull())
    return j.groupBy("chat_id").agg(hits.alias("hits"), fp.alias("fp"), fn.alias("fn"), F.round(F.when(hits + fp > 0, hits / (hits + fp)), 9).alias("precision"),
                                    F.round(F.when(hits + fn > 0, hits / (hits + fn)), 9).alias("recall"))


ORDER = ["chat_id", "a_id", "b_id", "gold"]
QUERIES = {
    "q_metric_accuracy": lambda s, d: metrics.accuracy(_scored(s, d), "guess", "node_kind"),
    "q_metric_macro_f1": lambda s, d: metrics.macro_f1(_scored(s, d), "guess", "node_kind"),
    "q_metric_mae": lambda s, d: metrics.errors(_scored(s, d), "p", "gold", 0.25),
    "q_metric_spearman": lambda s, d: metrics.spearman(_scored(s, d), "p", "length"),
    "q_metric_brier_logloss": lambda s, d: metrics.brier_log_loss(_scored(s, d)),
    "q_metric_reliability": lambda s, d: metrics.reliability(_scored(s, d)),
    "q_metric_ece": lambda s, d: metrics.ece(_scored(s, d)),
    "q_metric_auroc": lambda s, d: metrics.auroc(_scored(s, d)),
    "q_metric_risk_coverage": lambda s, d: metrics.risk_coverage(_scored(s, d).withColumn("confidence", F.col("p")).withColumn("correct", F.col("gold")), [F.col(c) for c in ORDER]),
    "q_metric_selective": lambda s, d: metrics.selective(QUERIES["q_metric_risk_coverage"](s, d)),
    "q_metric_ece_top_label": lambda s, d: metrics.top_label_ece(_scored(s, d).select(F.greatest("p", 1 - F.col("p")).alias("confidence"), ((F.col("p") > 0.5) == (F.col("gold") == 1)).alias("correct"))),
    "q_metric_flip_rate": lambda s, d: metrics.flips(_pairs(s, d), ["chat_id", "x", "y"], "same"),
    "q_metric_pairwise_dev": lambda s, d: metrics.pairwise_deviation(_pairs(s, d), ["chat_id", "x", "y"], "p"),
    "q_metric_alignment": alignment,
    "q_sample_stratified": lambda s, d: metrics.strata(_scored(s, d), "p", [F.col(c) for c in ORDER]),
}

S = f"""s as (select chat_id, a_id, coalesce(b_id, '') as b_id, score as p, cast(node_kind = 'Person' as int) as gold, node_kind,
  case when score >= {SAME} then 'Person' else 'Concept' end as guess, length(a_name) as length from merge_candidates where score is not null and not isnan(score))"""
G = f"""{S}, g as (select chat_id, least(a_id, b_id) as x, greatest(a_id, b_id) as y, p, p >= {SAME} as same from s)"""
REL = """rel as (select cast(least(floor(p * 10), 9) as bigint) as bin, count(*) as n, round(avg(p), 9) as mean_p, round(avg(gold), 9) as rate from s group by 1)"""
RANK = "select *, rank() over (order by {0}) + (count(*) over (partition by {0}) - 1) / 2.0 as r{1} from {2}"
SQL = {
    "q_metric_accuracy": f"with {S} select round(avg(cast(guess = node_kind as int)), 9) as accuracy, count(*) as n from s where node_kind is not null",
    "q_metric_macro_f1": f"""with {S}, l as (select guess as label from s union select node_kind from s), f as (select label, count(*) filter (guess = label and node_kind = label) as tp,
        count(*) filter (guess = label) as pp, count(*) filter (node_kind = label) as gg from s, l group by 1) select round(avg(2.0 * tp / (pp + gg)), 9) as macro_f1, count(*) as labels from f""",
    "q_metric_mae": f"with {S} select round(avg(abs(p - gold)), 9) as mae, round(avg(cast(abs(p - gold) <= 0.25 as int)), 9) as within from s",
    "q_metric_spearman": f"with {S}, a as ({RANK.format('p', 'a', 's')}), b as ({RANK.format('length', 'b', 'a')}) select round(corr(ra, rb), 6) as spearman from b",
    "q_metric_brier_logloss": f"""with {S} select round(avg(pow(p - gold, 2)), 9) as brier,
        round(avg(-case when gold = 1 then ln(least(greatest(p, 1e-7), 1 - 1e-7)) else ln(1 - least(greatest(p, 1e-7), 1 - 1e-7)) end), 9) as log_loss from s""",
    "q_metric_reliability": f"with {S}, {REL} select * from rel",
    "q_metric_ece": f"with {S}, {REL} select round(sum(n * abs(mean_p - rate)) / sum(n), 6) as ece from rel",
    "q_metric_auroc": f"""with {S}, a as ({RANK.format('p', 'a', 's')}) select round((sum(ra) filter (gold = 1) - sum(gold) * (sum(gold) + 1) / 2.0) / (sum(gold) * (count(*) - sum(gold))), 9) as auroc from a""",
    "q_metric_risk_coverage": f"""with {S}, r as (select gold, row_number() over (order by p desc, chat_id, a_id, b_id, gold) as pos, count(*) over () as n from s),
        steps as (select step, greatest(1, cast(round_even((select count(*) from s) * step / 20.0, 0) as bigint)) as rows from range(21) t(step))
        select step, rows, round(sum(gold) filter (pos <= rows) / rows, 9) as accuracy from steps, r group by step, rows""",
    "q_metric_selective": f"""with {S}, r as (select gold, row_number() over (order by p desc, chat_id, a_id, b_id, gold) as pos, count(*) over () as n from s),
        steps as (select step, greatest(1, cast(round_even((select count(*) from s) * step / 20.0, 0) as bigint)) as rows from range(21) t(step)),
        c as (select step, rows, round(sum(gold) filter (pos <= rows) / rows, 9) as a from steps, r group by step, rows), l as (select *, lag(a) over (order by step) as b from c)
        select round(sum((1 - a + 1 - b) / 2 / 20), 9) as aurc, max(a) filter (step = 10) as acc_50, max(a) filter (step = 16) as acc_80, max(a) filter (step = 20) as acc_100 from l""",
    "q_metric_ece_top_label": f"""with {S}, c as (select greatest(p, 1 - p) as c, case when (p > 0.5) = (gold = 1) then 1.0 else 0.0 end as ok from s),
        b as (select least(floor(c * 10), 9) as bin, count(*) as n, avg(c) as c, avg(ok) as a from c group by 1) select round(sum(n * abs(c - a)) / sum(n), 6) as ece_top_label from b""",
    "q_metric_flip_rate": f"""with {G}, f as (select count(distinct same) > 1 as flip from g group by chat_id, x, y having count(*) >= 2)
        select count(*) as groups, round(avg(cast(flip as int)), 9) as flip_rate from f""",
    "q_metric_pairwise_dev": f"""with {G}, n as (select *, row_number() over () as i from g), d as (select avg(abs(a.p - b.p)) as d from n a join n b
        on a.chat_id = b.chat_id and a.x = b.x and a.y = b.y and a.i < b.i group by a.chat_id, a.x, a.y) select count(*) as groups, round(avg(d), 9) as deviation from d""",
    "q_metric_alignment": """with a as (select chat_id, a_id as id from merge_candidates where a_id is not null union select chat_id, b_id from merge_candidates where b_id is not null),
        u as (select chat_id, source_id as id from memory_edges union select chat_id, target_id from memory_edges),
        j as (select coalesce(a.chat_id, u.chat_id) as chat_id, a.id as ai, u.id as ui from a full join u on a.chat_id = u.chat_id and a.id = u.id),
        c as (select chat_id, count(*) filter (ai is not null and ui is not null) as hits, count(*) filter (ui is null) as fp, count(*) filter (ai is null) as fn from j group by 1)
        select *, case when hits + fp > 0 then round(hits / (hits + fp), 9) end as precision, case when hits + fn > 0 then round(hits / (hits + fn), 9) end as recall from c""",
    "q_sample_stratified": f"""with {S}, r as (select p, row_number() over (order by p, chat_id, a_id, b_id, gold) as pos, count(*) over () as n from s)
        select (pos > n // 5)::bigint + (pos > 2 * n // 5)::bigint + (pos > 3 * n // 5)::bigint + (pos > 4 * n // 5)::bigint as stratum, count(*) as n, min(p) as least, max(p) as most from r group by 1""",
}
