"""Text hygiene and time rules against cases worked out by hand."""
import random

import pytest
from pyspark.sql import functions as F

from convograph.functions import hygiene as h
from convograph.functions import schedule as sch


@pytest.mark.parametrize("text,want", [
    ("a<think>b</think>c", "ac"), ("reason</think>answer", "answer"), ("a<think>b", "a"), ("x<think>1</think>y</think>z", "xz"), ("", ""), ("<think><think>a</think>b", "b"),
    ("a</think>b</think>c<think>d</think>e", "ce"), ("plain", "plain"),
])
def test_reasoning(text, want):
    assert h.strip_reasoning_text(text) == want


def test_reasoning_is_linear_and_equals_a_rescan():
    def model(text):
        out, rest = "", text
        while True:
            o, c = rest.find("<think>"), rest.find("</think>")
            if 0 <= c and (o < 0 or c < o):
                rest = rest[c + 8:]
            elif o < 0:
                return out + rest
            else:
                out += rest[:o]
                c = rest.find("</think>", o)
                if c < 0:
                    return out
                rest = rest[c + 8:]

    r = random.Random(3)
    for _ in range(300):
        t = "".join(r.choice(["a", "b", "<think>", "</think>"]) for _ in range(r.randrange(12)))
        assert h.strip_reasoning_text(t) == model(t), t
    assert h.strip_reasoning_text("x</think>" * 200_000) == ""


@pytest.mark.parametrize("text,want", [
    ("hm <pet>hello</pet> bye", "hello"), ("<pet at=\"1\">a</pet><pet>b</pet>", "a"), ("<petty>x <pet>y</pet>", "y"), ("<pet>open", "<pet>open"), ("none", "none"),
])
def test_fence(text, want):
    assert h.extract_fence_text(text, "pet") == want


@pytest.mark.parametrize("line,want", [
    ("plain", "plain"), ("</pet>", None), (" <pet at=\"9\"> ", None), ("<pet>a</pet> b", "a b"), ("<pet><pet>a", "a"), ("a</pet></pet>", "a"), ("<pet><pet>a</pet></pet>", "a"), ("<petty>a", "<petty>a"),
    ("a <pet x='1'>", "a "),
])
def test_fence_lines(line, want):
    assert h.fence_line(line, "pet") == want


def test_line_regions():
    text = "hello\n<memory>\nold\n</memory>\n<msg from=\"x\">one line</msg>\n</summary> tail\n<messy>kept\nsay <msg >inline</msg>\n<pet>end</pet>"
    assert h.filter_lines_text(text, "pet") == "hello\n<messy>kept\nsay <msg >inline</msg>\nend"
    assert h.filter_lines_text("", "pet") == "" and h.filter_lines_text("<memory>\nnever closed\nx", "pet") == ""


def test_columns(spark):
    rows = [("a<think>b</think>c", "Tamo 9!", "Ann", "Lee", "x", "7", "c/1"), (None, "!", "Ann", " ", "al", "7", ""), ("", None, "Ann", None, None, "7", "-100")]
    df = spark.createDataFrame(rows, "t string, name string, f string, l string, u string, i string, c string")
    got = df.select(h.strip_reasoning(F.col("t")), h.speech_tag(F.col("name")), h.display_name(*map(F.col, "flui")), h.valid_chat_id(F.col("c")), h.extract_fence(F.col("t"), "x"), h.filter_lines(F.col("t"), "x")).collect()
    assert [tuple(r)[:4] for r in got] == [("ac", "tamo9", "Ann Lee", False), (None, "you", "@al", False), ("", "you", "7", True)]


@pytest.mark.parametrize("text,want", [
    ('a <b> <media type="photo">cat & dog</media> <i>', 'a &lt;b&gt; <media type="photo">cat & dog</media> &lt;i&gt;'), ('<media type="photo">open & x', '&lt;media type="photo"&gt;open &amp; x'),
    ('<media a><x></media><media type="p">y</media>', '&lt;media a&gt;&lt;x&gt;&lt;/media&gt;&lt;media type="p"&gt;y&lt;/media&gt;'), ("a&b", "a&amp;b"),
    ('<media a>x</media> & <media b>y</media>', '<media a>x</media> &amp; <media b>y</media>'),
])
def test_trusted_media(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(h.trusted_media(F.col("t"))).first()[0] == want


def test_time_rules(spark):
    one = spark.createDataFrame([("2025-03-01 12:00:00", "2025-02-22 12:00:00", 8, "2025-02-27", "bad")], "now string, active string, n int, stored string, bad string")
    one = one.select(F.to_timestamp("now").alias("now"), F.to_timestamp("active").alias("active"), "n", "stored", "bad")
    none = F.lit(None).cast("timestamp")
    r = one.select(
        sch.topic_weight(F.col("n"), F.col("active"), F.col("now")), sch.topic_weight(F.col("n"), F.col("now"), F.col("active")), sch.topic_weight(F.col("n"), none, F.col("now")),
        sch.effective_quota(F.lit(3), F.lit(9)), sch.interval_multiplier(F.lit(5)), sch.interval_multiplier(F.lit(70)), sch.local_date(F.col("now"), "Asia/Tokyo"),
        sch.in_active_hours(F.col("now"), 720, 721, "UTC"), sch.in_active_hours(F.col("now"), 0, 720, "UTC"), sch.cooldown_active(F.col("stored"), F.lit("2025-03-01"), 3),
        sch.cooldown_active(F.col("stored"), F.lit("2025-03-01"), 2), sch.cooldown_active(F.col("bad"), F.lit("2025-03-01"), 9), sch.retry_delay(F.lit(2.0), F.lit(3)), sch.retry_delay(F.lit(2.0), F.lit(40)),
        sch.timer_cadence(F.lit(80.0), F.lit(60.0)), sch.timer_cadence(F.lit(80_000.0), F.lit(60.0)), sch.timer_cadence(F.lit(1.0), F.lit(60.0)), sch.jittered(F.lit(100.0), F.lit(0.5)), sch.day_slots(F.lit(3), F.lit(100), F.lit("c"))).first()
    assert list(r)[:18] == [4.0, 8.0, pytest.approx(8 * 0.5 ** (30 / 7)), 1, 32, 2**63 - 1, "2025-03-01", True, False, True, False, False, 8.0, 60.0, 10.0, 60.0, 1.0, 100.0]
    assert [s // 100 for s in r[18]] == [0, 1, 2]
