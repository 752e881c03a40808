"""Names anywhere in a text."""
from convograph.plans import graph as plans

NAMES = ["weekly meetup of the old town walking club", "Bob", "Ann-Marie", "東京", "a", "%_", "late\nline", "Midnight Pottery", "nobody here", " ", "ÄRA"]
TEXTS = ["The WEEKLY meetup of the old town walking club, (bob).", "昨日東京で会った", "midnight pottery. ann-marie!", "late\nline\n%_", "", "x", "bobann-marie", "Ära ÄRA", None]


def test_pairs_of_names_in_one_message(spark, tmp_path):
    low = lambda x: x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    pairs = [("c", f"i{x}", f"i{y}", x, y) for x in NAMES for y in NAMES if x < y] + [("d", "p", "q", "Bob", "Ann-Marie")]
    spark.createDataFrame(pairs, "chat_id string, a_id string, b_id string, a_name string, b_name string").write.parquet(f"{tmp_path}/merge_candidates.parquet")
    spark.createDataFrame([("c", i, t) for i, t in enumerate(TEXTS)], "chat_id string, id long, text string").write.parquet(f"{tmp_path}/messages.parquet")
    want = {(c, low(x), low(y), n) for c, _, _, x, y in pairs if x.strip() and y.strip() and c == "c"
            and (n := sum(low(x) in low(t) and low(y) in low(t) for t in TEXTS if t is not None))}
    got = {(r.chat_id, r.a, r.b, r.messages) for r in plans.promotion(spark, str(tmp_path)).collect()}
    assert got == want and len(got) > 5
