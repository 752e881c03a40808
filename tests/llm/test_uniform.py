import unicodedata

from convograph.llm.uniform import same_looking, uniform_text

SAME = [
    ("Hello world", "Ｈｅｌｌｏ ｗｏｒｌｄ"), ("Hello world", "He​llo　wor­ld﻿"), ("Café", "Café"), ("paella", "раеllа"), ("mill", "ⅿⅰⅼⅼ"),
    ("ガード", "ｶﾞｰﾄﾞ"), ("bold", "𝐛𝐨𝐥𝐝"), ("Été", "É‍té"), ("XII", "Ⅻ"), ("HAND", "ΗΑΝD"), ("office", "oﬃce"), ("a\nb", "a\r\nb"),
]
DIFFERENT = [("Hello", "hello"), ("Café", "Cafe"), ("O", "0"), ("l", "1"), ("a b", "a  b"), ("a b", "a\nb"), ("a.b", "a,b"), ("ß", "B"), ("I", "l"), ("ё", "е")]


def forms(spark, texts):
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "i long, text string, same string")
    return [r.out for r in uniform_text(df, "text", "out").orderBy("i").collect()]


def test_what_shows_alike_and_what_does_not(spark):
    flat = forms(spark, [x for p in SAME + DIFFERENT for x in p])
    pairs = list(zip(flat[::2], flat[1::2]))
    for (a, b), (x, y) in zip(pairs, SAME + DIFFERENT):
        assert (a == b) is ((x, y) in SAME), (x, y, a, b)


def test_stable_and_total(spark):
    texts = [None, "", "​", "x" * 200_000, "Ω≈ç√∫", "".join(map(chr, range(0x20, 0x3000)))]
    once = forms(spark, texts)
    assert once[0] is None and once[1] == "" and once[2] == "" and once[3] == texts[3]
    assert forms(spark, once) == once and all(unicodedata.is_normalized("NFC", t) for t in once if t)


def test_pairs(spark):
    rows = [("c", 1, "nice"), ("c", 2, "nice"), ("c", 10, "nісе"), ("c", 3, "ｎice"), ("d", 4, "nісе"), ("c", 5, " ​"), ("c", 6, " "), ("c", 7, None), (None, 8, "nice"), ("c", 9, "Nice")]
    df = spark.createDataFrame(rows * 2, "chat_id string, id long, text string").selectExpr("*", "'z' as form", "'z' as key", "1 as salt")
    want = {("1", "10"), ("1", "3"), ("10", "2"), ("10", "3"), ("2", "3")}
    for hot in (1, 10_000):
        got = [(r.a_key, r.b_key) for r in same_looking(df, "id", "text", "message", hot).collect()]
        assert set(got) == want and len(got) == len(want)
    assert same_looking(df.limit(0), "id", "text", "node").count() == 0


def test_rows_of_one_node_are_no_pair(spark):
    df = spark.createDataFrame([("c", "a", "Tom"), ("c", "a", "Ｔom"), ("c", "b", "Tοm"), ("c", "b", "Tοm")], "chat_id string, id string, name string")
    assert [(r.a_key, r.b_key) for r in same_looking(df, "id", "name", "node").collect()] == [("a", "b")]
