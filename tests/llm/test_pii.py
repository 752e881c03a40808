import pytest

from convograph.llm.given_names import known_given
from convograph.llm.pii import find, find_pii, learned_given, plain_text, redact

GIVEN = known_given()


def spans(text):
    return sorted((kind, text[a:b]) for a, b, kind, _, _ in find(text, GIVEN) if b >= 0)


CASES = [
    ("write to jo.doe+x@mail.example.org today", [("email", "jo.doe+x@mail.example.org")]),
    ("write to jo (at) mail [dot] example [dot] org, ok", [("email", "jo (at) mail [dot] example [dot] org")]),
    ("write to jo at mail dot example please", [("email", "jo at mail dot example")]),
    ("ｊo@ｍail.example", [("email", "ｊo@ｍail.example")]),
    ("room @garden is open, ask @pebble_bot", []),
    ("call +44 7700 900123 or (617) 555-0153 or 030/23125139", [("phone", "(617) 555-0153"), ("phone", "+44 7700 900123"), ("phone", "030/23125139")]),
    ("六点以后请打 +４９ (０)３０ ２３１２５ ９３１ 找我", [("phone", "+４９ (０)３０ ２３１２５ ９３１")]),
    ("call six one seven five five five oh one five three now", [("phone", "six one seven five five five oh one five three")]),
    ("my id is 991-71-6767, hers QJ 31 09 06 B, his 804.452.110-20", [("id_number", "804.452.110-20"), ("id_number", "991-71-6767"), ("id_number", "QJ 31 09 06 B")]),
    ("ISBN 978-0-00-62130789-14, commit a40143474f46611, order 285-28767, tracking 36559854, log 192.0.2.9", []),
    ("meet at 5 Mistral Road, flat 2 around noon", [("address", "5 Mistral Road")]),
    ("we sold 12 Harrowgate Street posters to the Larkspur Avenue choir", []),
    ("das Paket kam in die Lindenweg 231b zurück", [("address", "Lindenweg 231b")]),
    ("das Paket kam in die Am Rehberg 21, 05537 zurück, am Montag 12 Leute", [("address", "Am Rehberg 21")]),
    ("fue a Calle Alborada n.º 121, 2º B por error", [("address", "Calle Alborada n.º 121")]),
    ("on se voit au 33 bis avenue du Moulin vers midi", [("address", "33 bis avenue du Moulin")]),
    ("tell Dr Renée de la Hatononer-Gozes that Robert talked", [("name", "Renée de la Hatononer-Gozes")]),
    ("ask for Kolkezeger, Johannes N. at the door", [("name", "Kolkezeger, Johannes N.")]),
    ("Bob K. Minnelap came, Victoria is here, Robert lives in Brandon", [("name", "Bob K. Minnelap")]),
    ("受付で Jürgen Temuneser さんを呼んで", [("name", "Jürgen Temuneser")]),
]


@pytest.mark.parametrize("text,want", CASES)
def test_cases(text, want):
    assert [(k, t) if k != "address" else (k, t) for k, t in spans(text)] == want


def test_offsets_survive_invisible_and_combining_characters():
    text = "tél: c​al­l +4​4 7700 9‍00123​!"
    (a, b, kind, _, _), = find(text, GIVEN)
    assert kind == "phone" and a == text.index("+") and text[a:b].startswith("+4​4")
    p, _ = plain_text(text)
    assert p.text == "tél: call +44 7700 900123!" and [text[p.source(i)] for i in (0, 5)] == ["t", "c"]


def test_case_is_decided_by_the_corpus(spark):
    rows = [("message", 1, "ROBERT TALKED ABOUT IT"), ("message", 2, "tell robert minnelap now"), ("message", 3, "Robert talked"), ("message", 4, "Anna-Robert talked"),
            ("message", 5, None), ("message", 6, ""), ("edge", 1, "tell Robert Minnelap")]
    df = spark.createDataFrame(rows, "src string, row_no long, text string").selectExpr("*", "'z' as word", "'z' as standing")
    found = find_pii(df, GIVEN)
    assert {(r.src, r.row_no, r.start_pos) for r in found.collect()} == {("message", 2, 5), ("edge", 1, 5)}
    texts = {(r.src, r.row_no): r.text for r in redact(df, found).collect()}
    assert texts["message", 2] == "tell [NAME] now" and texts["message", 5] is None and texts["message", 6] == "" and texts["message", 3] == "Robert talked"


def test_redaction_keeps_the_rest(spark):
    text = "a@b.example, +44 7700 900123 and 5 Mistral Road. " + "x" * 50_000
    df = spark.createDataFrame([("message", 1, text)] * 2, "src string, row_no long, text string")
    assert redact(df.limit(1), find_pii(df, GIVEN)).first().text == "[EMAIL], [PHONE] and [ADDRESS]. " + "x" * 50_000
    assert find_pii(df.limit(0), GIVEN).count() == 0


@pytest.mark.parametrize("text", [
    "wir treffen uns im Zimmer 12, dann im Kapitel 3. Am Gleis 4, im Level 5", "reach me via email 5, via Slack 3 or via Telegram 100", "on a pris 2 cours de danse, 3 place du marché", "im Boxring 3, auf Parkplatz 12",
    "release v20240131 and b20231105", "see ticket 2345678901, order no 2345678901", "IBAN DE89 3704 0044 0532 0130 00 bitte",
])
def test_nothing_personal(text):
    assert spans(text) == []


@pytest.mark.parametrize("text,want", [
    ("come to 100 Main Street Boston please", [("address", "100 Main Street")]), ("the 12 Oak Street Bakery opens", []), ("wir wohnen in Am Steg 4, 12345 Ort", [("address", "Am Steg 4")]),
    ("wir stehen vor An den Eichen 7.", [("address", "An den Eichen 7")]), ("abita in Via Roma 5, credo", [("address", "Via Roma 5")]), ("call me on 2345678901 now", [("phone", "2345678901")]),
    ("passport v20249931", [("id_number", "v20249931")]), ("ask Peter Meyer or Hannah Schmidt", [("name", "Hannah Schmidt"), ("name", "Peter Meyer")]),
    ("ask Mohammed Ali, Olga Petrova, Priya Sharma", [("name", "Mohammed Ali"), ("name", "Olga Petrova"), ("name", "Priya Sharma")]),
    ("ask for " + "Wolkenkratzer" * 9 + ", Robert at the door", [("name", "Wolkenkratzer" * 9 + ", Robert")]), ("ask for von der Leyenberg, Robert today", [("name", "von der Leyenberg, Robert")]),
])
def test_evidence_around(text, want):
    assert spans(text) == want


def test_given_names_are_learned(spark):
    people = [("Person", f"{g} {f}") for g in ("Zorbana", "Bo", "Anna-Lisa") for f in ("Kimmelu", "Rastaho", "Pelovi", "Drunkato")] + [("Person", "Quorra Flynnu"), ("Person", "ROBERT X"), ("Alias", "Noggin Bu"), ("Person", None)]
    nodes = spark.createDataFrame(people, "node_type string, name string")
    assert learned_given(nodes) - GIVEN == {"zorbana", "bo", "anna-lisa"} and learned_given(nodes.limit(0)) == GIVEN
    assert learned_given(nodes, share=0.5) == GIVEN
