"""The log as context: rendered turns, collapsed repetitions, kept summaries."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hygiene import trusted_media
from ..functions.text import escape_attribute, escape_text
from .log import reply_targets
from .ranking import with_previous


def render_messages(log: DataFrame) -> DataFrame:
    """(chat_id, id, content): inbound message and edit rows as tagged lines with sender, time of day and id, the kind of an edit, whom it
    replies to by name and id of the oldest row of the target, and a mention of the bot. Null texts and names render empty."""
    t = reply_targets(log).withColumnRenamed("target_id", "rid").withColumnRenamed("target_name", "rname")
    m = log.where("direction = 'inbound' and event_type in ('message', 'edit')").join(t, ["chat_id", "id"], "left")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    optional = lambda cond, *parts: F.when(cond, F.concat(*parts)).otherwise("")
    lit = F.lit
    content = F.concat(
        lit('<msg from="'), escape_attribute(text("sender_display_name")), lit('"'),
        optional(F.col("sender_username").isNotNull(), lit(' user="'), escape_attribute(text("sender_username")), lit('"')),
        lit(' at="'), F.date_format("timestamp", "HH:mm"), lit('" id="'), F.col("id").cast("string"), lit('"'),
        optional(F.col("event_type") == "edit", lit(' kind="edit"')),
        F.when(F.col("is_reply_to_bot"), lit(' reply="bot"'))
        .when(F.col("rid").isNotNull(), F.concat(lit(' reply="user" reply_to_name="'), escape_attribute(text("rname")), lit('" reply_to_id="'), F.col("rid").cast("string"), lit('"')))
        .when(F.col("reply_to_platform_msg_id").isNotNull(), lit(' reply="user"')).otherwise(lit("")),
        optional(F.coalesce("mentions_bot", lit(False)), lit(' mention="bot"')), lit(">"), trusted_media(text("text")), lit("</msg>"))
    return m.select("chat_id", "id", content.alias("content"))


def islands(log: DataFrame) -> DataFrame:
    """Rows of a chat that do not repeat the row before them (same sender and text, in order of id)."""
    rows = log.select("chat_id", "id", "sender_id", "text")
    p = with_previous(rows, ["chat_id"], [F.col("id")], "id", ["id", "sender_id", "text"])
    same = F.col("previous.id").isNotNull() & F.col("previous.sender_id").eqNullSafe(F.col("sender_id")) & F.col("previous.text").eqNullSafe(F.col("text"))
    return p.where(~same).select("chat_id", "id")


def keep_newest(frames: DataFrame, n: int = 2) -> DataFrame:
    """The newest ``n`` ranges of each chat, oldest first."""
    down, up = Window.partitionBy("chat_id").orderBy(F.desc("last_id")), Window.partitionBy("chat_id").orderBy("last_id")
    top = frames.withColumn("__r", F.row_number().over(down)).where(F.col("__r") <= n).drop("__r")
    return top.withColumn("position", F.row_number().over(up).cast("long"))


def render_members(log: DataFrame) -> DataFrame:
    """(chat_id, id, content) of join and leave rows."""
    m = log.where("direction = 'inbound' and event_type in ('join', 'leave')")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    user = F.when(F.col("sender_username").isNotNull(), F.concat(F.lit(' user="'), escape_attribute(text("sender_username")), F.lit('"'))).otherwise("")
    body = F.when(F.col("event_type") == "join", "joined the group").otherwise("left the group")
    return m.select("chat_id", "id", F.concat(
        F.lit('<msg from="'), escape_attribute(text("sender_display_name")), F.lit('"'), user, F.lit(' at="'), F.date_format("timestamp", "HH:mm"), F.lit('" id="'),
        F.col("id").cast("string"), F.lit('" kind="'), F.col("event_type"), F.lit('">'), body, F.lit("</msg>")).alias("content"))


def render_speech(log: DataFrame, tag: str) -> DataFrame:
    """(chat_id, id, content) of what the bot said, under its own tag."""
    m = log.where("direction = 'outbound'")
    return m.select("chat_id", "id", F.concat(
        F.lit(f'<{tag} at="'), F.date_format("timestamp", "HH:mm"), F.lit('" id="'), F.col("id").cast("string"), F.lit('">'), escape_text(F.coalesce("text", F.lit(""))), F.lit(f"</{tag}>")).alias("content"))


def render_summaries(summaries: DataFrame) -> DataFrame:
    """(chat_id, id, content) of summaries (chat_id, first_id, last_id, text)."""
    span = F.concat_ws("-", F.col("first_id").cast("string"), F.col("last_id").cast("string"))
    return summaries.select("chat_id", F.col("last_id").alias("id"), F.concat(F.lit('<summary range="'), span, F.lit('">'), escape_text(F.coalesce("text", F.lit(""))), F.lit("</summary>")).alias("content"))


def collapse_injections(ledger: DataFrame) -> DataFrame:
    """Ledger rows (chat_id, id, position, content) that do not repeat the row before them of the same position."""
    p = with_previous(ledger, ["chat_id"], [F.col("id")], "id", ["position", "content"])
    same = F.col("previous.position").eqNullSafe(F.col("position")) & F.col("previous.content").eqNullSafe(F.col("content"))
    return p.where(~F.coalesce(same, F.lit(False)) | F.col("previous").isNull()).drop("previous")


def rebuild(log: DataFrame, bounds: DataFrame, ledger: DataFrame, summaries: DataFrame, tag: str = "you") -> DataFrame:
    """The live context of each chat as it would be without a restart: (chat_id, block, position, turn, seq, role, content).

    Block 1 holds the summaries, oldest first; block 2 the rows above the chat's bound (chat_id, upto; without bound all rows), each followed by the
    memories injected at it. Memories whose position is no row of the tail come last. Sorting by (block, position, turn, seq) gives
    the context; nothing is gathered into one row."""
    tail = log.join(bounds.select("chat_id", F.col("upto").alias("__upto")), "chat_id", "left").where(F.col("__upto").isNull() | (F.col("id") > F.col("__upto"))).drop("__upto")
    item = lambda df, block, role: df.select("chat_id", F.lit(block).alias("block"), F.col("id").alias("position"), F.lit(0).alias("turn"), F.col("id").alias("seq"), F.lit(role).alias("role"), "content")
    # replies look back beyond the tail, so messages are rendered over the whole log and then cut
    said = render_messages(log).join(tail.select("chat_id", "id"), ["chat_id", "id"], "left_semi")
    rows = item(said, 2, "user").unionByName(item(render_members(tail), 2, "user")).unionByName(item(render_speech(tail, tag), 2, "assistant"))
    i = collapse_injections(ledger)
    here = tail.select("chat_id", F.col("id").alias("position"), F.lit(True).alias("__here"))
    i = i.join(here, ["chat_id", "position"], "left").select(
        "chat_id", F.when(F.col("__here"), 2).otherwise(3).alias("block"), "position", F.lit(1).alias("turn"), F.col("id").alias("seq"), F.lit("user").alias("role"), "content")
    return item(render_summaries(summaries), 1, "user").unionByName(rows).unionByName(i)


def context_stats(items: DataFrame) -> DataFrame:
    """Items and bytes of each chat's context."""
    return items.groupBy("chat_id").agg(F.count(F.lit(1)).alias("items"), F.sum(F.octet_length("content")).cast("long").alias("bytes"))


def summary_input(log: DataFrame, most: int) -> DataFrame:
    """(chat_id, id, line): the newest ``most`` rows of each chat as ``[name HH:MM] text``; the rank limit cuts before the shuffle."""
    w = Window.partitionBy("chat_id").orderBy(F.desc("id"))
    top = log.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= most)
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return top.select("chat_id", "id", F.concat(F.lit("["), blank("sender_display_name"), F.lit(" "), F.date_format("timestamp", "HH:mm"), F.lit("] "), blank("text")).alias("line"))


def extraction_input(log: DataFrame) -> DataFrame:
    """(chat_id, id, line): rows as labelled lines for an extractor, joins and leaves as markers, a forward with where it came from (an
    automatic one as such)."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    kind = F.when(F.coalesce("forward_automatic", F.lit(False)), "auto").otherwise(F.col("forward_kind"))
    forward = F.when(F.col("forward_kind").isNotNull(), F.concat(F.lit(" (forwarded "), kind, F.lit(" "), blank("forward_label"), F.lit(")"))).otherwise("")
    body = F.when(F.col("event_type") == "join", "[joined]").when(F.col("event_type") == "leave", "[left]").otherwise(blank("text"))
    return log.select("chat_id", "id", F.concat(F.lit("["), F.date_format("timestamp", "HH:mm"), F.lit("] "), blank("sender_display_name"), forward, F.lit(": "), body).alias("line"))
