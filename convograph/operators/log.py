"""Reads and folds over the append-only message log."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cjk_count, insubstantial, word_count
from .ranking import running_sum

DEDUP_KEY = ["chat_id", "platform_msg_id", "direction", "event_type", "timestamp", "text"]


def conversational(log: DataFrame) -> DataFrame:
    return log.where(~F.col("event_type").isin("join", "leave"))


def last_outbound(log: DataFrame) -> DataFrame:
    return log.where("direction = 'outbound'").groupBy("chat_id").agg(F.min("id").alias("lower"), F.max("id").alias("upper"))


def tail_after(log: DataFrame, bounds: DataFrame, column: str) -> DataFrame:
    """Rows with an id above the chat's bound; a chat without bound keeps all its rows."""
    b = bounds.select("chat_id", F.col(column).alias("__b"))
    return log.join(b, "chat_id", "left").where(F.col("__b").isNull() | (F.col("id") > F.col("__b"))).drop("__b")


def id_range(log: DataFrame, bounds: DataFrame) -> DataFrame:
    """Rows of the half-open range (lower, upper] of their chat."""
    return log.join(bounds, "chat_id").where("id > lower and id <= upper").drop("lower", "upper")


def latest_n(log: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` conversational rows of each chat, numbered in ascending order. The rank limit reaches below the shuffle,
    so no more than ``n`` rows of a chat leave a task."""
    down = Window.partitionBy("chat_id").orderBy(F.desc("id"))
    up = Window.partitionBy("chat_id").orderBy("id")
    top = conversational(log).withColumn("__r", F.row_number().over(down)).where(F.col("__r") <= n).drop("__r")
    return top.withColumn("position", F.row_number().over(up).cast("long"))


def first_by(log: DataFrame, newest: bool, *columns: str) -> DataFrame:
    """The newest or oldest row of each platform id."""
    pick = F.max_by if newest else F.min_by
    rows = log.dropna(subset=["platform_msg_id"])
    return rows.groupBy("chat_id", "platform_msg_id").agg(pick(F.struct(*columns), "id").alias("__p")).select("chat_id", "platform_msg_id", "__p.*")


def reply_targets(log: DataFrame) -> DataFrame:
    """Each reply with the oldest row of what it replies to, if there is one."""
    target = first_by(log, False, F.col("id").alias("target_id"), F.col("sender_display_name").alias("target_name"))
    replies = log.where("reply_to_platform_msg_id is not null").select("chat_id", "id", F.col("reply_to_platform_msg_id").alias("platform_msg_id"))
    return replies.join(target, ["chat_id", "platform_msg_id"], "left").select("chat_id", "id", "target_id", "target_name")


def first_writes(log: DataFrame) -> DataFrame:
    """The first row of each dedup key; nulls equal each other."""
    return log.groupBy(*DEDUP_KEY).agg(F.min("id").alias("id"))


def real_edits(log: DataFrame) -> DataFrame:
    """Edits of the deduplicated log that change the text of the row before them of the same message."""
    w = Window.partitionBy("chat_id", "platform_msg_id").orderBy("id")
    rows = first_writes(log).withColumn("before", F.lag("text").over(w)).withColumn("n", F.row_number().over(w))
    return rows.where("event_type = 'edit' and (n = 1 or not (text <=> before))").select("chat_id", "platform_msg_id", "id")


def tail_stats(log: DataFrame) -> DataFrame:
    """Messages, bytes, characters of scripts without blanks, and words of each chat's conversational rows."""
    return conversational(log).groupBy("chat_id").agg(
        F.count(F.lit(1)).alias("messages"), F.sum(F.octet_length("text")).cast("long").alias("bytes"),
        F.sum(cjk_count(F.col("text"))).cast("long").alias("chars_cjk"), F.sum(word_count(F.col("text"))).cast("long").alias("words"))


def day(ts: str = "timestamp") -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def batch_frames(log: DataFrame) -> DataFrame:
    """First and last row, count and times of each chat's batch; a batch is a day."""
    return log.groupBy("chat_id", day().alias("batch")).agg(
        F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count(F.lit(1)).alias("row_count"),
        F.unix_micros(F.min_by("timestamp", "id")).alias("first_us"), F.unix_micros(F.max_by("timestamp", "id")).alias("last_us"))


def batch_replies(log: DataFrame) -> DataFrame:
    """Replies bound to the latest earlier row, within their batch, of what they reply to."""
    rows = log.select("chat_id", day().alias("batch"), "id", "platform_msg_id", "reply_to_platform_msg_id", "sender_id")
    target = rows.select("chat_id", "batch", F.col("platform_msg_id").alias("reply_to_platform_msg_id"), F.col("id").alias("t"), F.col("sender_id").alias("s"))
    return (
        rows.join(target, ["chat_id", "batch", "reply_to_platform_msg_id"]).where("t < id")
        .groupBy("chat_id", "batch", "id").agg(F.max("t").alias("target_id"), F.max_by("s", "t").alias("target_sender"))
    )


def staleness(log: DataFrame) -> DataFrame:
    """For each outbound row the number of inbound conversational rows of its chat that follow it."""
    inbound = F.when(F.col("direction") == "inbound", 1).otherwise(0)
    rows = conversational(log).select("chat_id", "id", "direction")
    total = rows.groupBy("chat_id").agg(F.sum(inbound).alias("total"))
    run = running_sum(rows, ["chat_id"], [F.col("id")], "id", inbound, "upto")
    return run.where("direction = 'outbound'").join(total, "chat_id").select("chat_id", "id", (F.col("total") - F.col("upto")).cast("long").alias("inbound_after"))


def monologues(log: DataFrame) -> DataFrame:
    """Longest runs of outbound rows without an inbound row between: the group of a row is the number of inbound rows before it."""
    rows = conversational(log).select("chat_id", "id", "direction")
    run = running_sum(rows, ["chat_id"], [F.col("id")], "id", F.when(F.col("direction") == "inbound", 1).otherwise(0), "humans")
    runs = run.where("direction = 'outbound'").groupBy("chat_id", "humans").agg(F.count(F.lit(1)).alias("run"))
    return runs.groupBy("chat_id").agg(F.max("run").alias("longest_run"), F.count_if(F.col("run") >= 2).alias("locks"))


def skeleton_batches(log: DataFrame) -> DataFrame:
    """Batches, by day, with nothing to extract."""
    return log.groupBy("chat_id", day().alias("batch")).agg(F.every(insubstantial(F.col("text"))).alias("skeleton"), F.count(F.lit(1)).alias("row_count"))


def engagement(log: DataFrame, minutes: int = 30) -> DataFrame:
    """For each outbound row, whether an inbound row of its chat came within ``minutes`` after it. Time is cut into slots of that
    length, so a row only meets those of its own and the next slot."""
    slot = F.floor(F.unix_timestamp("timestamp") / (minutes * 60))
    sent = log.where("direction = 'outbound'").select("chat_id", "id", F.unix_timestamp("timestamp").alias("t"), slot.alias("s0"))
    sent = sent.withColumn("slot", F.explode(F.array("s0", F.col("s0") + 1))).drop("s0")
    got = log.where("direction = 'inbound'").groupBy("chat_id", slot.alias("slot"), F.unix_timestamp("timestamp").alias("r")).agg(F.lit(True).alias("hit"))
    hits = sent.join(got, ["chat_id", "slot"]).where((F.col("r") > F.col("t")) & (F.col("r") <= F.col("t") + minutes * 60)).select("chat_id", "id").distinct()
    out = log.where("direction = 'outbound'").select("chat_id", "id")
    return out.join(hits.withColumn("engaged", F.lit(True)), ["chat_id", "id"], "left").select("chat_id", "id", F.coalesce("engaged", F.lit(False)).alias("engaged"))


def verified_origins(log: DataFrame, people: DataFrame | None = None) -> DataFrame:
    """Forwards with an origin, if given only one among ``people`` (chat_id, person_id), unless a sender of the chat with another
    id shares the forward's name."""
    f = log.where("forward_origin_id is not null").select("chat_id", "id", "forward_origin_id", F.lower(F.trim("forward_label")).alias("label"))
    senders = log.where("sender_id is not null").select("chat_id", "sender_id", F.lower(F.trim("sender_display_name")).alias("label")).distinct()
    known = f if people is None else f.join(people.select("chat_id", F.col("person_id").alias("forward_origin_id")), ["chat_id", "forward_origin_id"], "left_semi")
    clash = known.join(senders, ["chat_id", "label"]).where("sender_id <> forward_origin_id").select("chat_id", "id").distinct()
    return known.join(clash, ["chat_id", "id"], "left_anti").select("chat_id", "id", "forward_origin_id")
