"""Commands over a folder of tables: ``python -m convograph.commands COMMAND FOLDER [CHAT] [MORE...]``. Each prints rows as lines of JSON; those that
change something write the changed table under ``--out``. Writes never touch the folder that is read."""
from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import graph, ledger, log, merge
from .plans import graph as plans
from .sources import table
from .sources.files import as_log, replay


def status(spark: SparkSession, folder: str, chat: str | None = None) -> DataFrame:
    """Rows, tail and newest row of one or all chats."""
    m = table(spark, folder, "messages")
    m = m if chat is None else m.where(F.col("chat_id") == chat)
    counts = m.groupBy("chat_id").agg(F.count(F.lit(1)).alias("rows"), F.max("id").alias("newest_id"), F.max("timestamp").alias("newest_at"))
    return counts.join(log.tail_stats(m), "chat_id", "left")


def facts(spark: SparkSession, folder: str, chat: str, node: str) -> DataFrame:
    """Facts about a node, valid and invalid, newest first; an alias with one target stands for that."""
    e, n = plans._edges(spark, folder).where(F.col("chat_id") == chat), plans._nodes(spark, folder).where(F.col("chat_id") == chat)
    info = graph.resolution_info(n, e, plans.ALIAS).where(F.col("id") == node).select(F.coalesce("target_id", "id").alias("node"), "chat_id")
    return graph.both_ends(e).join(info, ["chat_id", "node"], "left_semi").orderBy(F.desc("valid_at"), "relationship_name", "other")


def related_pairs(spark: SparkSession, folder: str, chat: str) -> DataFrame:
    """Pairs that were scored but are no match, best first."""
    p = plans._pairs(spark, folder).where((F.col("chat_id") == chat) & ~F.isnan("score"))
    return p.groupBy("x", "y").agg(F.max("score").alias("score")).where("score < 0.88").orderBy(F.desc("score"), "x", "y")


def dismiss(spark: SparkSession, folder: str, chat: str, x: str, y: str) -> DataFrame:
    """The chat's pairs after one was dismissed; only a pending pair moves."""
    p = related_pairs(spark, folder, chat).select(F.lit(chat).alias("chat_id"), "x", "y", F.lit("pending").alias("status"))
    return ledger.set_pair_status(p, spark.createDataFrame([(chat, min(x, y), max(x, y), "dismissed")], "chat_id string, x string, y string, to string"))


def merge_tool(spark: SparkSession, folder: str, budget: int = 20) -> DataFrame:
    """The merge plan: what is judged of each chat and how."""
    p = plans._pairs(spark, folder).where("score is not null and not isnan(score)").groupBy("chat_id", "x", "y").agg(F.max("score").alias("score"))
    return merge.plan(p, budget)


def _merged(spark: SparkSession, folder: str, chat: str, loser: str, survivor: str) -> DataFrame:
    one = spark.createDataFrame([(chat, loser, survivor)], "chat_id string, loser string, survivor string")
    return merge.merge(plans._edges(spark, folder).where(F.col("chat_id") == chat), one, table(spark, folder, "relationship_kinds"))


def merge_pair(spark: SparkSession, folder: str, chat: str, loser: str, survivor: str) -> DataFrame:
    """What becomes of each edge of the chat when one node is merged into another; the rows that are not kept are the snapshot."""
    return _merged(spark, folder, chat, loser, survivor)


def merge_rollback(spark: SparkSession, folder: str, chat: str, loser: str, survivor: str) -> DataFrame:
    """The chat's edges after that merge was rolled back."""
    m = _merged(spark, folder, chat, loser, survivor)
    return merge.rollback(merge.edges_after(m), merge.snapshot_of(m))


def _validity(spark: SparkSession, folder: str, chat: str, source: str, relationship: str, target: str, micros: str, close: bool) -> DataFrame:
    key = spark.createDataFrame([(chat, source, relationship, target, int(micros))], "chat_id string, source_id string, relationship_name string, target_id string, us long")
    keys = key.withColumn("valid_at", F.timestamp_micros("us")).drop("us")
    out = merge.set_validity(plans._edges(spark, folder).where(F.col("chat_id") == chat), keys, F.current_timestamp() if close else None)
    if out.where("outcome = 'unknown'").take(1):
        raise SystemExit("no such edge")
    return out.where("outcome <> 'untouched'")


def invalidate(spark, folder, chat, source, relationship, target, micros):
    """Closes one fact, named by its key and start in microseconds."""
    return _validity(spark, folder, chat, source, relationship, target, micros, True)


def revalidate(spark, folder, chat, source, relationship, target, micros):
    """Opens it again."""
    return _validity(spark, folder, chat, source, relationship, target, micros, False)


def replay_log(spark: SparkSession, path: str) -> DataFrame:
    """The log rows of a replay file, each once."""
    rows = as_log(replay(spark, path)).withColumn("direction", F.lit("inbound"))
    return ledger.first_write(rows, ["chat_id", "platform_msg_id", "direction", "event_type", "timestamp", "text"], F.col("seq"))


COMMANDS = {
    "replay": replay_log, "status": status, "status-all": status, "facts": facts, "related-pairs": related_pairs, "dismiss-related-pair": dismiss, "merge-tool": merge_tool,
    "merge": merge_pair, "merge-rollback": merge_rollback, "invalidate": invalidate, "revalidate": revalidate,
}


def main(argv: list[str]) -> int:
    p = argparse.ArgumentParser(prog="convograph", description=__doc__)
    p.add_argument("command", choices=sorted(COMMANDS))
    p.add_argument("folder")
    p.add_argument("more", nargs="*")
    p.add_argument("--out", help="write the result as a table instead of printing it")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("convograph").getOrCreate()
    from .ship import ship

    ship(spark)
    got = COMMANDS[a.command](spark, a.folder, *a.more)
    if a.out:
        got.write.mode("errorifexists").parquet(a.out)
    else:
        for row in got.toJSON().toLocalIterator():
            print(row)
    return 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
