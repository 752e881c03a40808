"""Sequential session rules against cases worked out by hand, and their codecs."""
import datetime as dt

from pyspark.sql import functions as F

from convograph.functions import ids
from convograph.operators import log, metrics, triggers

T0 = dt.datetime(2025, 1, 1)


def messages(spark, rows):
    rows = [("c", i, T0 + dt.timedelta(seconds=t), f, "inbound", "message") for i, t, f in rows]
    return spark.createDataFrame(rows, "chat_id string, id long, timestamp timestamp, mentions_bot boolean, direction string, event_type string").withColumn("is_reply_to_bot", F.lit(None).cast("boolean"))


def wakes(spark, rows, **more):
    return [(r.id, r.reason, r.since) for r in triggers.session_wakes(messages(spark, rows), **more).orderBy("id").collect()]


def test_forced_wakes_cool_down_and_queue(spark):
    assert wakes(spark, [(1, 0, True), (2, 5, True), (3, 12, True), (4, 20, True), (5, 31, False)]) == [(1, "forced", -1), (3, "queued", 1)]
    # the newest forced row of those that wait is taken
    assert wakes(spark, [(1, 0, True), (2, 11, True), (3, 22, True), (4, 31, False)]) == [(1, "forced", -1), (3, "queued", 1)]


def test_count_waits_for_the_call_to_end(spark):
    rows = [(i, 60 * i, False) for i in range(1, 7)]
    assert wakes(spark, rows) == [(6, "count", -1)]
    assert wakes(spark, [(1, 0, False), (2, 3700, False)]) == [(2, "interval", -1)]
    assert wakes(spark, [(1, 0, False), (2, 3700, False)], jitter=1.3) == [] and wakes(spark, [(1, 0, False), (2, 2600, False)], jitter=0.7) == [(2, "interval", -1)]
    assert wakes(spark, []) == []


def test_boundaries_lag_one_chunk(spark):
    df = spark.createDataFrame([("c", 10), ("c", 20), ("c", 30), ("d", 5)], "chat_id string, last_id long")
    got = {(r.chat_id, r.last_id): (r.leave_upto, r.previous) for r in triggers.digest_boundaries(df).collect()}
    assert got == {("c", 10): (0, -1), ("c", 20): (10, 10), ("c", 30): (20, 20), ("d", 5): (0, -1)}


def test_circuit(spark):
    df = spark.createDataFrame([("c", i, ok) for i, ok in enumerate([False, True, False, False, False, True])], "chat_id string, id long, ok boolean")
    assert [r.state for r in triggers.circuit(df).orderBy("id").collect()] == ["failed", "done", "failed", "failed", "open", "dropped"]


def test_state_codec_is_total(spark):
    rows = [("a", {"last_digest_boundary_msg_id": "12", "muted_flag": "1", "last_digest_at": "2025-01-02T03:04:05Z", "consecutive_bot_msgs": "x"}), ("b", {}), ("d", None)]
    d = triggers.decode_state(spark.createDataFrame(rows, "chat_id string, state map<string,string>"))
    got = {r.chat_id: r for r in d.collect()}
    assert got["a"].last_digest_boundary_msg_id == 12 and got["a"].muted_flag and got["a"].consecutive_bot_msgs == 0 and got["a"].prev_digest_boundary_msg_id is None
    assert got["b"].wake_current_interval_ms == 3_600_000 and got["d"].warmup_topic_cooldowns == "{}"
    assert sorted(map(str, triggers.decode_state(triggers.encode_state(d)).collect())) == sorted(map(str, d.collect()))


def test_edge_ids(spark):
    df = spark.createDataFrame([("s", "r", 't"|', dt.datetime(2025, 1, 1, 2, 3, 4, 567))], "s string, r string, t string, at timestamp")
    e = df.select(ids.json_edge_id(*map(F.col, ("s", "r", "t", "at"))).alias("e"), "at")
    assert e.first().e == '{"relationship_name":"r","source_id":"s","target_id":"t\\"|","valid_at":"2025-01-01T02:03:04.000567Z"}'
    assert e.select(F.col("at") == ids.decode_edge_id(F.col("e"))["valid_at"]).first()[0]
    bad = spark.createDataFrame([("{",), ('{"source_id":"s"}',), ("s|r|t|0",), (None,)], "e string").select(ids.decode_edge_id(F.col("e")).alias("k"))
    assert all(r.k is None for r in bad.collect())
    one = df.select(ids.properties_of(F.lit("Person"), description=F.lit("d"), nothing=F.lit(None).cast("string")), ids.alias_text(F.col("s"), F.col("t")), ids.batch_text(F.lit(1), F.lit(2), F.col("s"))).first()
    assert tuple(one) == ('{"kind":"person","description":"d"}', 's is a surface form of t"|.', "batch 1-2 mentions s")


def test_selective_metrics(spark):
    curve = spark.createDataFrame([(k, k, 1 - k / 40) for k in range(21)], "step long, rows long, accuracy double")
    r = metrics.selective(curve).first()
    assert abs(r.aurc - 0.25) < 1e-9 and (r.acc_50, r.acc_80, r.acc_100) == (0.75, 0.6, 0.5)
    df = spark.createDataFrame([(0.95, 1), (0.95, 0), (1.0, 1), (0.05, 0)], "confidence double, correct int")
    assert abs(metrics.top_label_ece(df).first()[0] - (3 * abs(2.9 / 3 - 2 / 3) + 0.05) / 4) < 1e-6


def test_origins_only_of_known_people(spark):
    rows = [("c", 1, "p1", "Ann", "s", "Bob"), ("c", 2, "p2", "Zoe", "s", "Bob"), ("c", 3, "p1", "bob", "s", "Bob"), ("c", 4, None, "Ann", "s", "Bob")]
    df = spark.createDataFrame(rows, "chat_id string, id long, forward_origin_id string, forward_label string, sender_id string, sender_display_name string")
    people = spark.createDataFrame([("c", "p1"), ("d", "p2")], "chat_id string, person_id string")
    assert [r.id for r in log.verified_origins(df, people).collect()] == [1]
    assert sorted(r.id for r in log.verified_origins(df).collect()) == [1, 2]
