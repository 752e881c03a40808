"""Events and evaluation files: replay files, lines of JSON, labels, stored plans, and sinks. Schemas are stated, never inferred."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT = T.StructType([T.StructField(n, t) for n, t in (
    ("type", T.StringType()), ("platform_msg_id", T.StringType()), ("timestamp", T.TimestampType()), ("edit_timestamp", T.TimestampType()), ("sender_id", T.StringType()),
    ("sender_display_name", T.StringType()), ("sender_username", T.StringType()), ("text", T.StringType()), ("reply_to_platform_msg_id", T.StringType()), ("mentions_bot", T.BooleanType()),
    ("is_reply_to_bot", T.BooleanType()), ("users", T.ArrayType(T.StructType([T.StructField(x, T.StringType()) for x in ("user_id", "display_name", "username")]))),
    ("actor_id", T.StringType()), ("anonymous", T.BooleanType()), ("aggregated", T.BooleanType()), ("old_emojis", T.ArrayType(T.StringType())), ("new_emojis", T.ArrayType(T.StringType())))])
REPLAY = T.StructType([T.StructField("chat_id", T.StringType()), T.StructField("events", T.ArrayType(EVENT))])


def replay(spark: SparkSession, path: str) -> DataFrame:
    """The events of replay files ({chat_id, events}), numbered from 0 in the file's order."""
    files = spark.read.schema(REPLAY).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return files.select("chat_id", F.posexplode("events").alias("seq", "e")).select("chat_id", "seq", "e.*")


def as_log(events: DataFrame) -> DataFrame:
    """Log rows of message events. An edit has the time it was made at; a member event gives a row for each of its users, under the id
    ``message:user``, as one service message may name several."""
    base = ["chat_id", "seq"]
    said = events.where(F.col("type").isin("message", "edited_message")).select(
        *base, "platform_msg_id", F.when(F.col("type") == "edited_message", "edit").otherwise("message").alias("event_type"),
        F.when(F.col("type") == "edited_message", F.coalesce("edit_timestamp", "timestamp")).otherwise(F.col("timestamp")).alias("timestamp"), "sender_id", "sender_display_name", "sender_username", "text",
        "reply_to_platform_msg_id", F.coalesce("mentions_bot", F.lit(False)).alias("mentions_bot"), F.coalesce("is_reply_to_bot", F.lit(False)).alias("is_reply_to_bot"))
    came = events.where(F.col("type").isin("member_join", "member_leave")).select("*", F.explode("users").alias("u")).select(
        *base, F.concat_ws(":", "platform_msg_id", "u.user_id").alias("platform_msg_id"), F.when(F.col("type") == "member_join", "join").otherwise("leave").alias("event_type"), "timestamp",
        F.col("u.user_id").alias("sender_id"), F.col("u.display_name").alias("sender_display_name"), F.col("u.username").alias("sender_username"), F.lit("").alias("text"),
        F.lit(None).cast("string").alias("reply_to_platform_msg_id"), F.lit(False).alias("mentions_bot"), F.lit(False).alias("is_reply_to_bot"))
    return said.unionByName(came)


def reactions(events: DataFrame) -> DataFrame:
    """Reactions with emojis as JSON lists; one that neither adds nor takes an emoji is none. An anonymous or counted one has no reactor."""
    r = events.where("type = 'reaction'")
    lists = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    some = (F.size(lists("old_emojis")) > 0) | (F.size(lists("new_emojis")) > 0)
    no_one = F.coalesce("anonymous", F.lit(False)) | F.coalesce("aggregated", F.lit(False))
    return r.where(some).select("chat_id", "seq", "platform_msg_id", F.when(~no_one, F.col("actor_id")).alias("reactor_user_id"), F.coalesce("anonymous", F.lit(False)).alias("anonymous"),
                                F.coalesce("aggregated", F.lit(False)).alias("aggregated"), F.to_json(lists("old_emojis")).alias("old_emojis"), F.to_json(lists("new_emojis")).alias("new_emojis"), "timestamp")


REACTION_KEY = ["chat_id", "platform_msg_id", "reactor_user_id", "old_emojis", "new_emojis", "timestamp"]


def first_reactions(rows: DataFrame) -> DataFrame:
    """The first of each reaction that was delivered more than once; an absent reactor equals an empty one."""
    key = [F.coalesce("reactor_user_id", F.lit("")).alias("reactor_user_id") if k == "reactor_user_id" else F.col(k) for k in REACTION_KEY]
    return rows.groupBy(*key).agg(F.min("seq").alias("seq"))


def best_size(sizes: Column, cap: int = 2048) -> Column:
    """Of an array of (width, height, ...) the one whose longer edge is largest up to ``cap``, or the largest if all are beyond it; on equal edges the
    larger area. Null for none."""
    ranked = F.transform(sizes, lambda s: F.struct(F.greatest(s["width"], s["height"]).alias("edge"), (s["width"].cast("long") * s["height"]).alias("area"), s.alias("size")))
    fits = F.filter(ranked, lambda r: r["edge"] <= cap)
    return F.coalesce(F.array_max(fits), F.array_max(ranked))["size"]


def shrunk(width: Column, height: Column, cap: int = 2048) -> Column:
    """(width, height) scaled so that the longer edge is ``cap`` at most, each rounded down but one at least."""
    long = F.greatest(width, height)
    side = lambda d: F.when(long <= cap, d).otherwise(F.greatest(F.lit(1), F.floor(d * cap / long).cast("int")))
    return F.struct(side(width).alias("width"), side(height).alias("height"))


def media_text(caption: Column, element: Column) -> Column:
    """A caption, if it is not blank, and the media element behind it."""
    return F.when(F.coalesce(F.trim(caption), F.lit("")) == "", element).otherwise(F.concat_ws(" ", caption, element))


def write_lines(df: DataFrame, path: str) -> None:
    """One JSON document a line; fields without a value are left out."""
    df.write.mode("overwrite").json(path)


def read_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Lines of JSON; a path that does not exist has none."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Gold labels (task_id, label) of a CSV file with a header; rows without id or label are none, of more the last in order of the label counts."""
    rows = spark.read.schema("task_id string, label string").option("header", True).csv(path)
    return rows.where("trim(task_id) <> '' and trim(label) <> ''").groupBy(F.trim("task_id").alias("task_id")).agg(F.max(F.trim("label")).alias("label"))


def parsed_label(label: Column, suite: Column) -> Column:
    """Labels as their suite means them: yes or no as true or false, a list of numbers sorted, a class as it is."""
    low = F.lower(F.trim(label))
    flag = F.when(low.isin("true", "yes", "1", "same"), "true").when(low.isin("false", "no", "0", "different"), "false")
    index = F.array_join(F.array_sort(F.filter(F.transform(F.split(label, r"[,;\s]+"), lambda x: x.try_cast("int")), lambda x: x.isNotNull())), ",")
    return F.when(suite.isin("uc1a", "uc1b", "uc1s"), flag).when(suite.isin("uc3", "uc3s", "uc4"), index).otherwise(F.trim(label))


PLAN_VERSION = 1


def write_plan(plan: DataFrame, hashes: DataFrame, path: str) -> None:
    """A merge plan (chat_id, ...) with the hash of the candidate set it was made from."""
    plan.join(hashes, "chat_id").withColumn("version", F.lit(PLAN_VERSION)).write.mode("overwrite").json(path)


def stale_plans(spark: SparkSession, path: str, hashes: DataFrame, schema: str) -> DataFrame:
    """Chats whose stored plan must not be applied: of another version, or made from other candidates than there are now."""
    stored = spark.read.schema(schema).json(path).select("chat_id", F.col("xor").alias("__x"), F.col("pairs").alias("__n"), "version").distinct()
    j = stored.join(hashes, "chat_id", "left")
    why = F.when(F.col("version") != PLAN_VERSION, "version").when(~F.col("__x").eqNullSafe(F.col("xor")) | ~F.col("__n").eqNullSafe(F.col("pairs")), "candidates")
    return j.select("chat_id", why.alias("reason")).where("reason is not null")


def views(spark: SparkSession, folder: str, names: list[str]) -> None:
    """The stored tables as views, for reading with SQL."""
    for n in names:
        spark.read.parquet(f"{folder}/{n}.parquet").createOrReplaceTempView(n)


def outbound_sink(stream: DataFrame, path: str, most: int = 256):
    """Starts writing what is to be sent: of a micro-batch the first ``most`` rows by id are kept as a bounded channel would, the rest is counted as
    dropped. (sent under ``path/sent``, counts under ``path/dropped``)"""
    def write(batch: DataFrame, batch_id: int) -> None:
        first = batch.orderBy("id").limit(most)
        first.write.mode("overwrite").json(f"{path}/sent/batch={batch_id}")
        batch.agg(F.greatest(F.lit(0), F.count(F.lit(1)) - most).alias("dropped")).write.mode("overwrite").json(f"{path}/dropped/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint")
