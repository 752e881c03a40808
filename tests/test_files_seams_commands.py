"""Replay files, lines, labels, plans, media rules, seams and commands."""
import json

import pytest
from pyspark.sql import functions as F

from convograph import commands, seams
from convograph.operators import merge
from convograph.sources import files

EVENTS = [
    {"type": "message", "platform_msg_id": "1", "timestamp": "2025-01-01T10:00:00Z", "sender_id": "u", "sender_display_name": "U", "text": "hi", "mentions_bot": True},
    {"type": "edited_message", "platform_msg_id": "1", "timestamp": "2025-01-01T10:00:00Z", "edit_timestamp": "2025-01-01T10:05:00Z", "sender_id": "u", "text": "hi!"},
    {"type": "member_join", "platform_msg_id": "2", "timestamp": "2025-01-01T10:06:00Z", "users": [{"user_id": "a", "display_name": "A"}, {"user_id": "b", "display_name": "B", "username": "bb"}]},
    {"type": "member_leave", "platform_msg_id": "3", "timestamp": "2025-01-01T10:07:00Z", "users": [{"user_id": "a", "display_name": "A"}]},
    {"type": "reaction", "platform_msg_id": "1", "timestamp": "2025-01-01T10:08:00Z", "actor_id": "u", "old_emojis": [], "new_emojis": ["👍"]},
    {"type": "reaction", "platform_msg_id": "1", "timestamp": "2025-01-01T10:08:00Z", "actor_id": "u", "old_emojis": [], "new_emojis": ["👍"]},
    {"type": "reaction", "platform_msg_id": "1", "timestamp": "2025-01-01T10:09:00Z", "actor_id": "ch", "anonymous": True, "new_emojis": ["x"]},
    {"type": "reaction", "platform_msg_id": "1", "timestamp": "2025-01-01T10:09:00Z", "actor_id": "u"},
    {"type": "message", "platform_msg_id": "1", "timestamp": "2025-01-01T10:00:00Z", "sender_id": "u", "sender_display_name": "U", "text": "hi"},
]


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    p = tmp_path_factory.mktemp("replay") / "chat.json"
    p.write_text(json.dumps({"chat_id": "c", "events": EVENTS}, indent=1, ensure_ascii=False))
    return str(p)


def test_replay(spark, path):
    e = files.replay(spark, path)
    assert [r.seq for r in e.orderBy("seq").collect()] == list(range(len(EVENTS)))
    rows = {(r.seq, r.platform_msg_id): r for r in files.as_log(e).collect()}
    assert set(rows) == {(0, "1"), (1, "1"), (2, "2:a"), (2, "2:b"), (3, "3:a"), (8, "1")}
    assert rows[1, "1"].timestamp.minute == 5 and rows[1, "1"].event_type == "edit" and rows[2, "2:b"].sender_username == "bb" and rows[0, "1"].mentions_bot and not rows[8, "1"].mentions_bot
    r = files.reactions(e)
    assert {(x.seq, x.reactor_user_id, x.new_emojis) for x in r.collect()} == {(4, "u", '["👍"]'), (5, "u", '["👍"]'), (6, None, '["x"]')}
    assert {x.seq for x in files.first_reactions(r).collect()} == {4, 6}
    assert commands.replay_log(spark, path).count() == 5


def test_media(spark):
    sizes = [[(100, 50), (2048, 100), (2048, 300), (4000, 9)], [(3000, 10), (5000, 2)], [], [(10, 10), (10, 9)]]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "i int, s array<struct<width:int,height:int>>")
    assert [tuple(r.b) if r.b else None for r in df.select("i", files.best_size(F.col("s")).alias("b")).orderBy("i").collect()] == [(2048, 300), (5000, 2), None, (10, 10)]
    one = spark.createDataFrame([(4096, 1), (100, 7), (2048, 2048), (3000, 1500)], "w int, h int").select(files.shrunk(F.col("w"), F.col("h")).alias("s"))
    assert [tuple(r.s) for r in one.collect()] == [(2048, 1), (100, 7), (2048, 2048), (2048, 1024)]
    assert [r[0] for r in spark.createDataFrame([(" ",), ("cap",), (None,)], "c string").select(files.media_text(F.col("c"), F.lit("<m>"))).collect()] == ["<m>", "cap <m>", "<m>"]


def test_lines_labels_and_plans(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, [1, 2]), ("b", None, [])], "task_id string, n int, xs array<int>")
    files.write_lines(df, f"{tmp_path}/x")
    assert sorted(map(tuple, files.read_lines(spark, f"{tmp_path}/x", df.schema).collect())) == [("a", 1, [1, 2]), ("b", None, [])]
    assert files.read_lines(spark, f"{tmp_path}/none", df.schema).count() == 0
    (tmp_path / "gold.csv").write_text("task_id,label\na,yes\nb,\n ,x\nc, 3 1;2 \na,yes\n")
    gold = {r.task_id: r.label for r in files.read_labels(spark, f"{tmp_path}/gold.csv").collect()}
    assert gold == {"a": "yes", "c": "3 1;2"}
    kinds = spark.createDataFrame([("yes", "uc1a"), ("0", "uc1s"), ("3 1;2 x", "uc3"), (" same ", "uc2"), ("maybe", "uc1b")], "l string, s string")
    assert [r[0] for r in kinds.select(files.parsed_label(F.col("l"), F.col("s"))).collect()] == ["true", "false", "1,2,3", "same", None]
    pairs = spark.createDataFrame([("c", "a", "b", 0.9), ("c", "a", "d", 0.8), ("e", "a", "b", 0.5)], "chat_id string, x string, y string, score double")
    plan, hashes = merge.plan(pairs, 1), merge.plan_hash(pairs)
    assert {(r.chat_id, r.y): r.verdict for r in plan.collect()} == {("c", "b"): "same", ("c", "d"): "skipped", ("e", "b"): "different"}
    files.write_plan(plan, hashes, f"{tmp_path}/plan")
    schema = "chat_id string, x string, y string, score double, place long, verdict string, xor string, pairs long, version int"
    assert files.stale_plans(spark, f"{tmp_path}/plan", merge.plan_hash(pairs.orderBy("score")), schema).count() == 0
    changed = pairs.where("y <> 'd'")
    assert [tuple(r) for r in files.stale_plans(spark, f"{tmp_path}/plan", merge.plan_hash(changed), schema).collect()] == [("c", "candidates")]


def test_views_and_sink(spark, small, tmp_path):
    files.views(spark, small, ["messages", "memory_nodes"])
    assert spark.sql("select count(*) from messages m join memory_nodes n using (chat_id)").first()[0] > 0
    spark.range(300).write.json(f"{tmp_path}/in")
    q = files.outbound_sink(spark.readStream.schema("id long").json(f"{tmp_path}/in"), f"{tmp_path}/out", 200).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.json(f"{tmp_path}/out/sent").count() == 200 and spark.read.json(f"{tmp_path}/out/dropped").agg(F.sum("dropped")).first()[0] == 100


def test_seams(spark):
    df = spark.createDataFrame([("a b", 0.9), ("b a", 0.1), (None, None)], "text string, score double")
    for s in (seams.Embedder(), seams.Threshold(), seams.Lookup({}), seams.Headline()):
        assert isinstance(s, seams.Seam)
    v = [r.v for r in seams.ask(df, seams.Embedder(8), "v", "array<float>").collect()]
    assert v[0] == v[1] != v[2] == [0.0] * 8
    assert [r.ok for r in seams.ask(df, seams.Threshold(), "ok", "boolean").collect()] == [True, False, False]
    assert [r.x for r in seams.ask(df, seams.Lookup({"a b": "yes"}), "x", "string", key="text").collect()] == ["yes", None, None]
    assert [r.x for r in seams.ask(df, seams.Headline(1), "x", "string").collect()] == ["a", "b", None]

    class Short(seams.Threshold):
        def answer(self, scores):
            return []

    with pytest.raises(Exception, match="0 answers"):
        seams.ask(df, Short(), "ok", "boolean").collect()


def test_commands(spark, small):
    e = spark.read.parquet(f"{small}/memory_edges.parquet")
    chat, source = e.groupBy("chat_id", "source_id").count().orderBy(F.desc("count"), "source_id").first()[:2]
    assert commands.status(spark, small).count() > commands.status(spark, small, chat).count() == 1
    got = commands.facts(spark, small, chat, source).collect()
    assert got and all(source in (r.source_id, r.target_id) for r in got)
    pairs = commands.related_pairs(spark, small, chat).collect()
    if pairs:
        moved = {(r.x, r.y) for r in commands.dismiss(spark, small, chat, pairs[0].y, pairs[0].x).where("moved").collect()}
        assert moved == {(pairs[0].x, pairs[0].y)}
    other = next(r.target_id for r in got if r.target_id != source)
    m = commands.merge_pair(spark, small, chat, source, other)
    assert m.where(F.col("outcome").isin("kept", "moved") & ((F.col("source_id") == source) | (F.col("target_id") == source))).count() == 0
    key = ["source_id", "relationship_name", "target_id", "valid_at"]
    back = {tuple(r) for r in commands.merge_rollback(spark, small, chat, source, other).select(*key, "invalid_at").collect()}
    from convograph.plans import graph as plans

    assert back == {tuple(r) for r in plans._edges(spark, small).where(F.col("chat_id") == chat).select(*key, "invalid_at").collect()}
    one = e.where((F.col("chat_id") == chat) & F.col("invalid_at").isNull()).select(*key, F.unix_micros("valid_at").alias("us")).first()
    args = (spark, small, chat, one.source_id, one.relationship_name, one.target_id, str(one.us))
    assert [r.outcome for r in commands.revalidate(*args).collect()] == ["already"]
    with pytest.raises(SystemExit):
        commands.invalidate(spark, small, chat, "nobody", "x", "y", "0")
    assert commands.merge_tool(spark, small, 2).where("verdict <> 'skipped'").groupBy("chat_id").count().agg(F.max("count")).first()[0] <= 2
