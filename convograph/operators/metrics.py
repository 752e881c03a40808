"""Calibration and ranking metrics as aggregates over (p, gold), p in [0, 1] and gold 0 or 1."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import number_rows, running_sum

R = 9


def accuracy(df: DataFrame, predicted: str, gold: str) -> DataFrame:
    both = df.where(F.col(predicted).isNotNull() & F.col(gold).isNotNull())
    return both.agg(F.round(F.avg((F.col(predicted) == F.col(gold)).cast("double")), R).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def macro_f1(df: DataFrame, predicted: str, gold: str) -> DataFrame:
    """Mean F1 over the labels of either side; a label never hit has F1 0."""
    side = F.explode(F.array_distinct(F.array(predicted, gold))).alias("label")
    tp = F.count_if((F.col("label") == F.col(predicted)) & (F.col("label") == F.col(gold)))
    f = df.select(predicted, gold, side).groupBy("label").agg(
        tp.alias("tp"), F.count_if(F.col("label") == F.col(predicted)).alias("pp"), F.count_if(F.col("label") == F.col(gold)).alias("gg"))
    return f.agg(F.round(F.avg(2 * F.col("tp") / (F.col("pp") + F.col("gg"))), R).alias("macro_f1"), F.count(F.lit(1)).alias("labels"))


def errors(df: DataFrame, x: str, y: str, within: float) -> DataFrame:
    d = F.abs(F.col(x) - F.col(y))
    return df.agg(F.round(F.avg(d), R).alias("mae"), F.round(F.avg((d <= within).cast("double")), R).alias("within"))


def average_ranks(df: DataFrame, x: str) -> DataFrame:
    """(x, n, rank): each value with its count and average rank. Equal values are counted before they are ordered, and the
    order is summed slice by slice where there are many."""
    n = df.where(F.col(x).isNotNull()).groupBy(F.col(x).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("n")).withColumn("one", F.lit(1))
    return running_sum(n, ["one"], [F.col("x")], "x", F.col("n"), "upto").select("x", "n", (F.col("upto") - (F.col("n") - 1) / 2).alias("rank"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Correlation of average ranks; null below three rows or without variance."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("a"), F.col(y).cast("double").alias("b"))
    ra = average_ranks(d, "a").select(F.col("x").alias("a"), F.col("rank").alias("ra"))
    rb = average_ranks(d, "b").select(F.col("x").alias("b"), F.col("rank").alias("rb"))
    j = d.join(ra, "a").join(rb, "b")
    some = (F.count(F.lit(1)) >= 3) & (F.stddev_pop("ra") > 0) & (F.stddev_pop("rb") > 0)
    return j.agg(F.round(F.when(some, F.corr("ra", "rb")), 6).alias("spearman"))


def brier_log_loss(df: DataFrame, eps: float = 1e-7) -> DataFrame:
    p = F.least(F.greatest(F.col("p"), F.lit(eps)), F.lit(1 - eps))
    loss = -F.when(F.col("gold") == 1, F.ln(p)).otherwise(F.ln(1 - p))
    return df.agg(F.round(F.avg(F.pow(F.col("p") - F.col("gold"), F.lit(2.0))), R).alias("brier"), F.round(F.avg(loss), R).alias("log_loss"))


def reliability(df: DataFrame) -> DataFrame:
    """Ten bins of equal width; empty ones are left out."""
    b = F.least(F.floor(F.col("p") * 10), F.lit(9)).cast("long").alias("bin")
    return df.groupBy(b).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), R).alias("mean_p"), F.round(F.avg(F.col("gold").cast("double")), R).alias("rate"))


def ece(df: DataFrame) -> DataFrame:
    b = reliability(df)
    return b.agg(F.round(F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("rate"))) / F.sum("n"), 6).alias("ece"))


def auroc(df: DataFrame) -> DataFrame:
    """Mann-Whitney from average ranks; null with one class only."""
    j = df.select(F.col("p").cast("double").alias("x"), "gold").groupBy("x").agg(F.sum("gold").alias("pos")).join(average_ranks(df, "p"), "x")
    pos, n = F.sum("pos"), F.sum("n")
    u = F.sum(F.col("rank") * F.col("pos")) - pos * (pos + 1) / 2
    return j.agg(F.round(F.when((pos > 0) & (pos < n), u / (pos * (n - pos))), R).alias("auroc"))


def risk_coverage(df: DataFrame, order: list, steps: int = 21) -> DataFrame:
    """Accuracy of the most confident share of the rows at ``steps`` coverages; (confidence, correct) and the tie-break ``order``."""
    ranked = number_rows(df.withColumn("one", F.lit(1)).withColumn("__lead", -F.col("confidence")), ["one"], [F.col("__lead"), *order], "__lead", "at")
    n = df.count()
    cut = [(k, max(1, round(n * k / (steps - 1)))) for k in range(steps)]
    sums = ranked.agg(*[F.sum(F.when(F.col("at") <= c, F.col("correct")).otherwise(0)).alias(f"c{k}") for k, c in cut])
    return sums.select(F.explode(F.array(*[
        F.struct(F.lit(k).cast("long").alias("step"), F.lit(c).cast("long").alias("rows"), F.round(F.col(f"c{k}") / c, R).alias("accuracy")) for k, c in cut])).alias("r")).select("r.*")


def flips(df: DataFrame, group: list[str], verdict: str) -> DataFrame:
    """Share of groups of at least two rows whose verdicts differ."""
    g = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), (F.min(verdict) != F.max(verdict)).alias("flip")).where("n >= 2")
    return g.agg(F.count(F.lit(1)).alias("groups"), F.round(F.avg(F.col("flip").cast("double")), R).alias("flip_rate"))


def pairwise_deviation(df: DataFrame, group: list[str], x: str) -> DataFrame:
    """Mean absolute difference over the pairs of each group of at least two rows, then over groups; from ordered values, without pairs."""
    w = Window.partitionBy(*group)
    r = df.withColumn("__i", F.row_number().over(w.orderBy(x))).withColumn("__n", F.count(F.lit(1)).over(w)).where("__n >= 2")
    g = r.groupBy(*group).agg((F.sum((2 * F.col("__i") - F.col("__n") - 1) * F.col(x)) / (F.first("__n") * (F.first("__n") - 1) / 2)).alias("d"))
    return g.agg(F.count(F.lit(1)).alias("groups"), F.round(F.avg("d"), R).alias("deviation"))


def latency(df: DataFrame, group: list[str], x: str, shares: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Count, mean, least, greatest and percentiles by truncated rank, exact however large a group."""
    n = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(x), 6).alias("mean"), F.min(x).alias("least"), F.max(x).alias("most"))
    ranked = number_rows(df.select(*group, x), group, [F.col(x)], x, "__at").join(n.select(*group, "n"), group)
    at = lambda s: F.max(F.when(F.col("__at") == F.least(F.floor(F.lit(s) * F.col("n")), F.col("n") - 1) + 1, F.col(x))).alias(f"p{int(s * 100)}")
    return n.join(ranked.groupBy(*group).agg(*map(at, shares)), group)


def strata(df: DataFrame, x: str, order: list, parts: int = 5) -> DataFrame:
    """Strata of equal frequency by ``x``: stratum i holds ranks from i*n//parts to (i+1)*n//parts."""
    n = df.count()
    ranked = number_rows(df.withColumn("one", F.lit(1)), ["one"], [F.col(x), *order], x, "at")
    bounds = [(i * n) // parts for i in range(1, parts)]
    s = sum((F.when(F.col("at") > b, 1).otherwise(0) for b in bounds), F.lit(0)).cast("long").alias("stratum")
    return ranked.groupBy(s).agg(F.count(F.lit(1)).alias("n"), F.min(x).alias("least"), F.max(x).alias("most"))


def top_label_ece(df: DataFrame, parts: int = 10) -> DataFrame:
    """Weighted gap between confidence and accuracy over ``parts`` bins of (confidence, correct)."""
    b = F.least(F.floor(F.col("confidence") * parts), F.lit(parts - 1))
    g = df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("c"), F.avg(F.col("correct").cast("double")).alias("a"))
    return g.agg(F.round(F.sum(F.col("n") * F.abs(F.col("c") - F.col("a"))) / F.sum("n"), 6).alias("ece_top_label"))


def selective(curve: DataFrame, steps: int = 21) -> DataFrame:
    """One row from a risk-coverage curve (step, rows, accuracy): the area under the risk by the trapezoid rule, and the accuracy at half, four fifths
    and all of the rows."""
    w = Window.orderBy("step")  # over the curve's few rows
    area = (1 - F.col("accuracy") + 1 - F.lag("accuracy").over(w)) / 2 / (steps - 1)
    at = lambda share, name: F.max(F.when(F.col("step") == round(share * (steps - 1)), F.col("accuracy"))).alias(name)
    c = curve.withColumn("area", area)
    return c.agg(F.round(F.sum("area"), R).alias("aurc"), at(0.5, "acc_50"), at(0.8, "acc_80"), at(1.0, "acc_100"))
