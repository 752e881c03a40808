import uuid

from pyspark.sql import functions as F

from convograph.functions import ids, text


def test_normalize_name():
    assert ids.normalize_name("  @Ａnna　Ｌ 3 ") == "anna l3"
    assert ids.normalize_name("ΟΔΟΣ") == "οδοσ"  # no rule for the end of a word
    assert ids.normalize_name("") == "" and ids.normalize_name(None) is None


def test_uuid_and_hash():
    assert ids.node_uuid("concept:tea") == str(uuid.uuid5(ids.NAMESPACE, "concept:tea"))
    assert ids.fnv1a("") == "cbf29ce484222325" and ids.fnv1a("a") == "af63dc4c8601ec8c"


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t"))).first()[0]


def test_insubstantial(spark):
    for t, want in [("👍", True), ("", True), (None, True), ("+1", True), ("OK!!", True), ("  Good Morning. ", True), ("1", False), ("hello world", False), ("谢谢", True)]:
        assert one(spark, text.insubstantial, t) is want, t


def test_search_folds_ascii_only(spark):
    df = spark.createDataFrame([("Straße 100%", "STRASSE"), ("Straße 100%", "00%"), ("ÄB", "äb"), ("AB", "ab"), ("ab", " "), (None, "a")], "a string, b string")
    assert [r[0] for r in df.select(text.contains_literal(F.col("a"), F.col("b"))).collect()] == [False, True, False, True, False, None]


def test_excerpt_and_escape(spark):
    assert one(spark, text.excerpt, "x" * 61) == "x" * 60 + "…"
    assert one(spark, text.escape_attribute, '<a & "b">') == "&lt;a &amp; &quot;b&quot;&gt;"
    assert one(spark, text.word_count, " a　b  c ") == 3
    assert one(spark, text.cjk_count, "日本かな한a") == 5
