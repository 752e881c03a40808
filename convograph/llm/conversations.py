"""Conversations from an append-only log of message rows."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import Cuts
from ..operators.ranking import number_rows

#: Characters outside the separator and control classes that print nothing.
BLANK_LETTERS = r"\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180E}\x{2800}\x{3164}\x{FE00}-\x{FE0F}\x{FFA0}\x{E0100}-\x{E01EF}"
UNSEEN = rf"^[\s\p{{Z}}\p{{C}}{BLANK_LETTERS}]*$"

KEY = ["chat_id", "platform_msg_id"]


def unseen(text: Column) -> Column:
    """True where a text is missing or shows nothing: white space and invisible characters only."""
    return F.coalesce(text.rlike(UNSEEN), F.lit(True))


def fold_messages(log: DataFrame) -> DataFrame:
    """One row per message from its message and edit rows (redeliveries and edits share the
    platform id). Its time is its earliest row's, its text that of the latest row (an edit
    before a message row, then the largest id); link and direction are of its earliest row.

    Only flags travel, no text, and partial aggregation thins repeated keys before the
    shuffle. Rows without chat or platform id belong to no message; a row without a time
    counts as the earliest for the text and not at all for the time."""
    rows = log.where(F.col("event_type").isin("message", "edit")).dropna(subset=KEY)
    late = F.struct("timestamp", (F.col("event_type") == "edit").alias("e"), "id")
    early = F.struct(F.coalesce(F.unix_micros("timestamp"), F.lit(2**62)).alias("t"), "id")
    return rows.groupBy(*KEY).agg(
        F.min(F.unix_micros("timestamp")).alias("t"),
        F.min("id").alias("first_id"),
        F.max_by(unseen(F.col("text")), late).alias("blank"),
        F.min_by("reply_to_platform_msg_id", early).alias("reply"),
        F.min_by("direction", early).alias("direction"),
        F.max(F.col("sender_id").isNull()).alias("bad"),
    )


def link_roots(messages: DataFrame, cuts: Cuts) -> DataFrame:
    """Gives each message that hangs on a root its root, its depth, and in ``bad`` also whether
    it is earlier than the message it replies to.

    Pointers are doubled: after k rounds every message at most 2**k links below its root has
    it, so a thread of a million replies takes twenty rounds. Messages leave the loop
    when they reach the root, and it ends when a round brings none there: what is left
    hangs on nothing or runs in a circle. A parent with very many replies makes one hot key on
    one side only, the other side is unique, which the adaptive skew join splits."""
    carried = ["t", "first_id", "blank", "direction", "bad"]
    replied = messages.where("reply is not null").select("chat_id", F.col("reply").alias("platform_msg_id")).distinct()
    # a message that neither replies nor is replied to cannot be part of two turns
    roots = messages.where("reply is null").join(replied, KEY, "left_semi").select(
        *KEY, *carried, F.col("platform_msg_id").alias("root"), F.lit(0).cast("long").alias("depth"))
    parents = messages.select("chat_id", F.col("platform_msg_id").alias("up"), F.col("t").alias("up_t"),
                              F.col("reply").isNull().alias("there"))
    step = cuts.cut(
        messages.where("reply is not null").withColumnRenamed("reply", "up").join(parents, ["chat_id", "up"])
        .withColumn("bad", F.col("bad") | F.coalesce(F.col("t") < F.col("up_t"), F.lit(False)))
        .select(*KEY, *carried, "up", F.lit(1).cast("long").alias("depth"), "there")
    )
    done = []
    while (hung := step.where("there")).take(1):
        done.append(hung.drop("there").withColumnRenamed("up", "root"))
        rest = step.where("not there").drop("there")
        if not rest.take(1):
            break
        landings = rest.select("chat_id", F.col("platform_msg_id").alias("up"), F.col("up").alias("next"),
                               F.col("depth").alias("way"), F.lit(False).alias("there"))
        for d in done:
            landings = landings.union(d.select("chat_id", "platform_msg_id", "root", "depth", F.lit(True)))
        step = cuts.cut(
            rest.join(landings, ["chat_id", "up"])
            .select(*KEY, *carried, F.col("next").alias("up"), (F.col("depth") + F.col("way")).alias("depth"), "there")
        )
    out = roots
    for d in done:
        out = out.unionByName(d)
    return out


def rebuild_conversations(log: DataFrame, hot_rows: int = 500_000) -> DataFrame:
    """The turns of all whole conversations: (chat_id, root_msg_id, turn_no, platform_msg_id).

    A conversation is a root and all messages below it. It is dropped if one of its messages has
    a row without sender or is earlier than its parent, if fewer than two messages show any
    text, if the first turn is not inbound or the last not outbound. Turns are in order of time;
    of one time, in order of depth and then of their first row's id, so a reply follows what it
    answers. ``hot_rows`` bounds the turns numbered by one task. An empty log gives no rows."""
    cuts = Cuts(log.sparkSession, "conversations")
    messages = cuts.cut(fold_messages(log))
    nodes = cuts.cut(link_roots(messages, cuts))
    cuts.keep(nodes)
    # a message without any time makes its conversation's order unknown, so it is broken too
    place = F.struct("t", "depth", "first_id")
    turn = ~F.col("blank")
    kept = (
        nodes.groupBy("chat_id", "root").agg(
            F.max(F.col("bad") | F.col("t").isNull()).alias("bad"), F.count_if(turn).alias("turns"),
            F.min_by("direction", F.when(turn, place)).alias("first"), F.max_by("direction", F.when(turn, place)).alias("last"))
        .where("not bad and turns >= 2 and first = 'inbound' and last = 'outbound'").select("chat_id", "root")
    )
    turns = cuts.cut(nodes.where(turn).join(kept, ["chat_id", "root"], "left_semi"))
    cuts.keep(turns)
    order = [F.col("t"), F.col("depth"), F.col("first_id")]
    return number_rows(turns, ["chat_id", "root"], order, "t", "turn_no", hot_rows).select(
        "chat_id", F.col("root").alias("root_msg_id"), "turn_no", "platform_msg_id")


def dialogue(log: DataFrame, turns: DataFrame) -> DataFrame:
    """Roles and text for the turns of ``rebuild_conversations``: (chat_id, root_msg_id, turn_no,
    role, text), role being user for inbound and assistant for outbound messages; the direction is that of the earliest row, as in the fold."""
    rows = log.where(F.col("event_type").isin("message", "edit")).dropna(subset=KEY)
    late = F.struct("timestamp", (F.col("event_type") == "edit").alias("e"), "id")
    early = F.struct(F.coalesce(F.unix_micros("timestamp"), F.lit(2**62)).alias("t"), "id")
    text = rows.join(turns, KEY, "left_semi").groupBy(*KEY).agg(
        F.max_by("text", late).alias("text"), F.min_by("direction", early).alias("direction"))
    return turns.join(text, KEY).select(
        "chat_id", "root_msg_id", "turn_no",
        F.when(F.col("direction") == "outbound", "assistant").otherwise("user").alias("role"), "text")
