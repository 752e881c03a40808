"""Evaluation sets: windows, negatives, buried facts, stratified samples, and what a suite of answers adds up to.

A draw is the order of a digest of the row and a seed, so that it does not depend on partitions and any engine can repeat it."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import number_rows


def shuffled(*parts: Column | str, seed: int = 0) -> Column:
    """A random order that only depends on the row and the seed."""
    return F.md5(F.concat_ws("|", *parts, F.lit(str(seed))).cast("binary"))


def injection_windows(log: DataFrame, injections: DataFrame, n: int = 5) -> DataFrame:
    """(chat_id, second, place, id): the newest ``n`` inbound rows at or before each second with an injection (chat_id, injected_at), oldest first;
    seconds with fewer than two rows give none.

    Rows and seconds meet on one time line: each second finds the number of rows up to it by a running count, and rows are joined by their number,
    so no row is paired with all seconds."""
    rows = log.where("direction = 'inbound'").select("chat_id", "id", F.unix_timestamp("timestamp").alias("t"))
    asked = injections.select("chat_id", F.unix_timestamp("injected_at").alias("t")).distinct()
    numbered = number_rows(rows, ["chat_id"], [F.col("t"), F.col("id")], "t", "at")
    # the last number of each second, carried forward to the seconds asked for
    ends = numbered.groupBy("chat_id", "t").agg(F.max("at").alias("at"))
    line = ends.join(asked.withColumn("asked", F.lit(True)), ["chat_id", "t"], "full_outer")
    w = Window.partitionBy("chat_id").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = line.withColumn("upto", F.max("at").over(w)).where("asked and upto >= 2").select("chat_id", F.col("t").alias("second"), "upto")
    picks = upto.select("chat_id", "second", F.posexplode(F.sequence(F.greatest(F.lit(1).cast("long"), F.col("upto") - (n - 1)), F.col("upto"))).alias("place", "at"))
    return picks.join(numbered, ["chat_id", "at"]).select("chat_id", "second", (F.col("place") + 1).cast("long").alias("place"), "id")


def inbound_windows(log: DataFrame, n: int = 5, windows: int = 8) -> DataFrame:
    """(chat_id, window, place, id): the last ``n`` inbound rows of each chat as window 0, and ``windows`` more of them that end evenly spaced over
    all; chats with fewer than four windows of rows give the last one only."""
    rows = log.where("direction = 'inbound'").select("chat_id", "id")
    numbered = number_rows(rows, ["chat_id"], [F.col("id")], "id", "at")
    size = numbered.groupBy("chat_id").agg(F.max("at").alias("n"))
    stride = F.greatest(F.lit(1).cast("long"), F.floor(F.col("n") / (windows + 1)))
    grid = F.transform(F.sequence(F.lit(1), F.lit(windows)), lambda i: F.struct(i.alias("window"), (i * stride).alias("end")))
    last = F.array(F.struct(F.lit(0).alias("window"), F.col("n").alias("end")))
    ends = size.select("chat_id", F.explode(F.concat(last, F.when(F.col("n") >= 4 * n, grid).otherwise(F.filter(grid, lambda x: F.lit(False))))).alias("w")).select("chat_id", "w.*")
    picks = ends.where((F.col("end") >= n) | (F.col("window") == 0)).select(
        "chat_id", "window", F.posexplode(F.sequence(F.greatest(F.lit(1).cast("long"), F.col("end") - (n - 1)), F.col("end"))).alias("place", "at"))
    return picks.join(numbered, ["chat_id", "at"]).select("chat_id", F.col("window").cast("long").alias("window"), (F.col("place") + 1).cast("long").alias("place"), "id")


def hard_negatives(nodes: DataFrame, known: DataFrame, seed: int = 0) -> DataFrame:
    """(chat_id, kind, x, y): pairs of different nodes (chat_id, id, kind) of one chat and kind that no known pair (chat_id, x, y) joins.

    Each node is paired with the next in a random order, which draws as many pairs as there are nodes without making all of them."""
    w = Window.partitionBy("chat_id", "kind").orderBy(shuffled("chat_id", "id", seed=seed), "id")
    p = nodes.select("chat_id", "kind", "id").distinct().withColumn("__next", F.lead("id").over(w)).where("__next is not null")
    p = p.select("chat_id", "kind", F.least("id", "__next").alias("x"), F.greatest("id", "__next").alias("y")).where("x <> y")
    return p.join(known.select("chat_id", "x", "y").distinct(), ["chat_id", "x", "y"], "left_anti").select("chat_id", "kind", "x", "y")


def easy_negatives(nodes: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """(a_chat, a_id, b_chat, b_id): ``n`` random pairs of nodes of different chats; each drawn node is paired with the next drawn one."""
    drawn = nodes.select("chat_id", "id").distinct().orderBy(shuffled("chat_id", "id", seed=seed), "chat_id", "id").limit(2 * n)
    w = Window.orderBy(shuffled("chat_id", "id", seed=seed), "chat_id", "id")  # over 2 n rows
    p = drawn.withColumn("k", F.row_number().over(w)).withColumn("b", F.lead(F.struct("chat_id", "id")).over(w)).where("k % 2 = 1 and b is not null")
    return p.where("chat_id <> b.chat_id").select(F.col("chat_id").alias("a_chat"), F.col("id").alias("a_id"), F.col("b.chat_id").alias("b_chat"), F.col("b.id").alias("b_id"))


TEMPLATES = ("direct", "direct", "topic", "topic", "chitchat")


def buried_windows(edges: DataFrame, windows: int = 80, most: int = 40, seed: int = 0) -> DataFrame:
    """(window, template, place, edge_no, gold): ``windows`` random edges (edge_no, chat_id), each among up to ``most`` - 1 others, those of its own
    chat first; all in a random order. Gold is the edge itself but for small talk, where nothing should be chosen; templates go 2 : 2 : 1.

    Only the first ``most`` edges of each chat in random order and of all can be drawn as others, so nothing is paired with everything."""
    order = lambda *more: shuffled(F.col("edge_no").cast("string"), *more, seed=seed)
    e = edges.select("edge_no", "chat_id").withColumn("o", order())
    drawn = e.orderBy("o", "edge_no").limit(windows)
    w = drawn.withColumn("window", F.row_number().over(Window.orderBy("o", "edge_no")).cast("long") - 1).select("window", "chat_id", F.col("edge_no").alias("true_no"))  # over the drawn ones
    near = e.withColumn("r", F.row_number().over(Window.partitionBy("chat_id").orderBy("o", "edge_no"))).where(F.col("r") <= most).select("chat_id", "edge_no", "o")
    far = e.orderBy("o", "edge_no").limit(most * (windows + 1)).select(F.col("chat_id").alias("other_chat"), "edge_no", "o")
    own = w.join(near, "chat_id").where("edge_no <> true_no").select("window", "true_no", "edge_no", F.lit(0).alias("near"), "o")
    rest = F.broadcast(w).crossJoin(far).where("other_chat <> chat_id").select("window", "true_no", "edge_no", F.lit(1).alias("near"), "o")
    o = own.unionByName(rest).withColumn("r", F.row_number().over(Window.partitionBy("window").orderBy("near", "o", "edge_no"))).where(F.col("r") < most).select("window", "true_no", "edge_no")
    every = o.unionByName(w.select("window", "true_no", F.col("true_no").alias("edge_no")))
    place = F.row_number().over(Window.partitionBy("window").orderBy(order(F.col("window").cast("string")), "edge_no"))
    template = F.element_at(F.array(*map(F.lit, TEMPLATES)), (F.col("window") % len(TEMPLATES) + 1).cast("int"))
    return every.select("window", template.alias("template"), place.cast("long").alias("place"), "edge_no",
                        ((F.col("edge_no") == F.col("true_no")) & (template != "chitchat")).alias("gold"))


def stratified(rows: DataFrame, x: str, order: list, n: int, parts: int = 5, seed: int = 0) -> DataFrame:
    """``n`` rows from ``parts`` strata of equal frequency by ``x``: each has its share of the sample, what is left over goes to the largest
    remainders, the first strata on ties; in a stratum the draw decides. ``order`` (names) makes the rows' order total."""
    total = rows.count()
    ranked = number_rows(rows.withColumn("__one", F.lit(1)), ["__one"], [F.col(x), *map(F.col, order)], x, "__at")
    if total <= n:
        return ranked.drop("__one", "__at").withColumn("stratum", F.lit(0).cast("long"))
    cuts = [i * total // parts for i in range(parts + 1)]
    sizes = [b - a for a, b in zip(cuts, cuts[1:], strict=False)]
    quotas = [n * s // total for s in sizes]
    for i in sorted(range(parts), key=lambda i: -(n * sizes[i] / total - quotas[i]))[: n - sum(quotas)]:
        quotas[i] += 1
    stratum = sum((F.when(F.col("__at") > c, 1).otherwise(0) for c in cuts[1:-1]), F.lit(0))
    s = ranked.withColumn("stratum", stratum.cast("long"))
    draw = F.row_number().over(Window.partitionBy("stratum").orderBy(shuffled(*[F.col(c).cast("string") for c in order], seed=seed)))
    quota = F.element_at(F.array(*map(F.lit, quotas)), (F.col("stratum") + 1).cast("int"))
    return s.withColumn("__draw", draw).where(F.col("__draw") <= quota).drop("__one", "__at", "__draw")


def with_labels(tasks: DataFrame, gold: DataFrame, reference: DataFrame) -> DataFrame:
    """Tasks (task_id, ...) with ``label``, the gold one if there is any and the reference's otherwise, and ``label_source``."""
    j = tasks.join(gold.select("task_id", F.col("label").alias("__g")), "task_id", "left").join(reference.select("task_id", F.col("label").alias("__r")), "task_id", "left")
    source = F.when(F.col("__g").isNotNull(), "gold").when(F.col("__r").isNotNull(), "reference")
    return j.withColumn("label", F.coalesce("__g", "__r")).withColumn("label_source", source).drop("__g", "__r")


def align(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """The values of both sides of the tasks that both have, for flips and deviations between two wordings."""
    return left.select(key, F.col(value).alias("a")).join(right.select(key, F.col(value).alias("b")), key)


def sidecar_sanity(sidecar: DataFrame, graph: DataFrame, keys: list[str]) -> DataFrame:
    """(both, only_sidecar, only_graph): how far the ids of a derived table and of the graph agree."""
    s, g = sidecar.select(*keys).distinct().withColumn("__s", F.lit(True)), graph.select(*keys).distinct().withColumn("__g", F.lit(True))
    j = s.join(g, keys, "full_outer")
    return j.agg(F.count_if(F.col("__s") & F.col("__g")).alias("both"), F.count_if(F.col("__g").isNull()).alias("only_sidecar"), F.count_if(F.col("__s").isNull()).alias("only_graph"))


def suite_totals(answers: DataFrame, group: list[str]) -> DataFrame:
    """Answers (p, gold, error, cost, tokens_in, tokens_out, seconds, ...) of each suite: tasks, errors, sums over those without error, mean and greatest
    latency, the share with a gold label, and accuracy at one half of those (strictly above)."""
    ok = F.col("error").isNull() & F.col("p").isNotNull()
    labelled = ok & F.col("gold").isNotNull()
    hit = ((F.col("p") > 0.5) == (F.col("gold") == 1)).cast("double")
    total = lambda c: F.sum(F.when(ok, F.col(c))).alias(f"{c}_total")
    return answers.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_tasks"), F.count_if(~ok).alias("n_errors"), total("cost"), total("tokens_in"), total("tokens_out"), F.round(F.avg("seconds"), 6).alias("seconds_mean"),
        F.max("seconds").alias("seconds_max"), F.round(F.avg(F.col("gold").isNotNull().cast("double")), 9).alias("gold_coverage"), F.round(F.avg(F.when(labelled, hit)), 9).alias("accuracy"))


def label_distribution(rows: DataFrame, label: str) -> DataFrame:
    return rows.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))


# Terms with their translation, and words of descriptions that may stand for each other.
GLOSSARY = {"machine learning": "机器学习", "deep learning": "深度学习", "artificial intelligence": "人工智能", "database": "数据库", "operating system": "操作系统", "compiler": "编译器",
            "algorithm": "算法", "open source": "开源", "programmer": "程序员", "engineer": "工程师"}


def variants(nodes: DataFrame) -> DataFrame:
    """(chat_id, id, transform, name): other ways to write the names of nodes: the first word or short form as nickname, the initials of several words or
    the outer characters of a longer East Asian name, and a known term in the other language. A name that a transform cannot change has none."""
    name, cjk = F.col("name"), F.col("name").rlike(r"[\x{4E00}-\x{9FFF}]")
    words = F.filter(F.split(name, r"\s+"), lambda w: w != "")
    latin = F.regexp_extract_all(name, F.lit("[A-Za-z]+"), 0)
    size = F.char_length(name)
    nick = F.when(cjk, F.when(size >= 2, F.concat(F.lit("小"), F.substring(name, 1, 1))).otherwise(F.concat(name, name))).otherwise(F.try_element_at(words, F.lit(1)))
    short = F.when(F.size(latin) >= 2, F.array_join(F.transform(latin, lambda w: F.upper(F.substring(w, 1, 1))), "")).when((F.size(latin) == 0) & (size >= 3), F.concat(F.substring(name, 1, 1), F.substring(name, size, F.lit(1))))
    term = F.lit(None).cast("string")
    for en, zh in reversed(GLOSSARY.items()):
        term = F.when(name.contains(zh), F.replace(name, F.lit(zh), F.lit(en))).when(F.lower(name).contains(en), F.regexp_replace(name, f"(?i){en}", zh)).otherwise(term)
    made = F.array(*[F.struct(F.lit(t).alias("transform"), c.alias("variant")) for t, c in (("nickname", nick), ("abbreviation", short), ("translation", term))])
    return nodes.select("chat_id", "id", "name", F.explode(made).alias("v")).where("v.variant is not null and v.variant <> name and v.variant <> ''").select("chat_id", "id", "v.transform", F.col("v.variant").alias("name"))
