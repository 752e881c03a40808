"""Conversations against a plain model."""
import datetime as dt
import random

import pytest

from convograph.llm.conversations import dialogue, fold_messages, rebuild_conversations

SCHEMA = ("id long, chat_id string, platform_msg_id string, direction string, event_type string, timestamp timestamp, sender_id string, text string, "
          "reply_to_platform_msg_id string, root string, t string, depth string, bad string, blank string")
T0 = dt.datetime(2025, 1, 1)


def row(i, p, t, reply=None, direction="inbound", text="hi", kind="message", sender="s", chat="c"):
    return (i, chat, p, direction, kind, None if t is None else T0 + dt.timedelta(seconds=t), sender, text, reply, *["x"] * 5)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def turns(df):
    return sorted(tuple(r) for r in df.select("chat_id", "root_msg_id", "turn_no", "platform_msg_id").collect())


def model(rows):
    by = {}
    for r in rows:
        if r[4] in ("message", "edit") and r[1] is not None and r[2] is not None:
            by.setdefault((r[1], r[2]), []).append(r)
    msgs = {}
    for k, rs in by.items():
        first = min(rs, key=lambda r: (r[5], r[0]))
        last = max(rs, key=lambda r: (r[5], r[4] == "edit", r[0]))
        msgs[k] = dict(t=first[5], i=min(r[0] for r in rs), blank=not (last[7] or "").strip(" \n​"), reply=first[8], d=first[3], bad=any(r[6] is None for r in rs))
    conv = {}
    for (c, p), m in msgs.items():
        way, at, bad = set(), p, False
        while at is not None and (c, at) in msgs and at not in way:
            way.add(at)
            up = msgs[c, at]["reply"]
            if up is None:
                conv.setdefault((c, at), []).append((p, len(way) - 1, bad))
                break
            bad |= (c, up) in msgs and msgs[c, at]["t"] < msgs[c, up]["t"]
            at = up
    out = []
    for (c, root), members in conv.items():
        ts = sorted((msgs[c, p]["t"], depth, msgs[c, p]["i"], p) for p, depth, _ in members if not msgs[c, p]["blank"])
        if any(b or msgs[c, p]["bad"] for p, _, b in members) or len(ts) < 2 or msgs[c, ts[0][3]]["d"] != "inbound" or msgs[c, ts[-1][3]]["d"] != "outbound":
            continue
        out += [(c, root, n, x[3]) for n, x in enumerate(ts, 1)]
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_equals_model(spark, seed):
    r = random.Random(seed)
    rows = []
    for i in range(260):
        p = r.randrange(90)
        rows.append(row(i, str(p), r.randrange(4) + p, None if p % 5 == 0 else str(r.randrange(95) if r.random() < 0.1 else r.randrange(p + 1)), r.choice(["inbound", "outbound"]),
                        r.choice(["hi", "hi", " ​", "", None, "ok"]), r.choice(["message", "message", "edit", "join"]), None if r.random() < 0.01 else "s", r.choice("cd")))
    # direction and link belong to the message
    fixed = {}
    rows = [(*x[:3], *fixed.setdefault((x[1], x[2]), (x[3], x[8]))[:1], *x[4:8], fixed[x[1], x[2]][1], *x[9:]) for x in rows]
    assert turns(rebuild_conversations(frame(spark, rows))) == model(rows)


def test_deep_thread_cycle_and_dangling(spark):
    deep = [row(n, f"m{n}", n, f"m{n - 1}" if n else None, "outbound" if n % 2 else "inbound") for n in range(300)]
    odd = [row(900, "a", 1, "b"), row(901, "b", 2, "a"), row(902, "d", 3, "nowhere", "outbound"), row(903, "e", 4, "d"), row(904, "self", 1, "self")]
    got = turns(rebuild_conversations(frame(spark, deep + odd)))
    assert len(got) == 300 and {g[1] for g in got} == {"m0"} and [g[3] for g in got] == [f"m{n}" for n in range(300)]


def test_one_wide_thread_is_numbered_in_slices(spark):
    wide = [row(0, "r", 0)] + [row(n, f"m{n}", n, "r", "outbound") for n in range(1, 200)]
    assert [g[3] for g in turns(rebuild_conversations(frame(spark, wide), hot_rows=20))] == ["r"] + [f"m{n}" for n in range(1, 200)]


def test_folding_versions(spark):
    rows = [row(1, "a", 5, text="first"), row(2, "a", 9, text="second", kind="edit"), row(3, "a", 9, text="message of that second"), row(4, "a", 1, text="late arrival")]
    m = fold_messages(frame(spark, rows)).first()
    assert m.t == int((T0 - dt.datetime(1970, 1, 1)).total_seconds() * 1e6) + 1_000_000 and m.first_id == 1 and not m.blank
    rows[1] = row(2, "a", 9, text=" ​ㅤ", kind="edit")
    assert fold_messages(frame(spark, rows)).first().blank


def test_roles(spark):
    rows = [row(1, "a", 1, text="q"), row(2, "b", 2, "a", "outbound", "old"), row(3, "b", 3, "a", "outbound", "new", "edit")]
    df = frame(spark, rows)
    assert [tuple(r)[2:] for r in dialogue(df, rebuild_conversations(df)).orderBy("turn_no").collect()] == [(1, "user", "q"), (2, "assistant", "new")]


def test_empty_and_nulls(spark):
    assert turns(rebuild_conversations(frame(spark, []))) == []
    rows = [row(1, None, 1), row(2, "a", None), row(3, "b", 2, "a", "outbound"), (4, *[None] * 13), row(5, "x" * 5000, 1, text="y" * 100_000)]
    assert turns(rebuild_conversations(frame(spark, rows * 2))) == []
