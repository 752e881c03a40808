import pytest

from convograph.llm.languages import Automaton, Model, clean_labelled, label_language, label_segments

TEXT = {
    "en": "the weather was fine and we walked along the river until the evening. nobody told me that the meeting was cancelled. could you send me the list again before the weekend? "
          "i would rather stay at home this time because it is raining. they moved the party to another day and everybody was surprised. she keeps asking me about the old garden.",
    "es": "hacía buen tiempo y caminamos junto al río hasta la noche. nadie me dijo que la reunión estaba cancelada. ¿puedes mandarme otra vez la lista antes del domingo? "
          "esta vez prefiero quedarme en casa porque está lloviendo. cambiaron la fiesta para otro día y todos se sorprendieron. ella me pregunta siempre por el viejo jardín.",
    "ru": "погода была хорошая и мы гуляли вдоль реки до самого вечера. никто не сказал мне что встреча отменяется. можешь ещё раз прислать мне список до выходных? "
          "на этот раз я лучше останусь дома потому что идёт дождь. они перенесли праздник на другой день и все удивились. она всё время спрашивает про старый сад.",
    "ja": "天気がよかったので夕方まで川に沿って歩きました。会議が中止になったとは誰も言ってくれませんでした。週末までにもう一度リストを送ってくれますか。今回は雨が降っているので家にいたいです。",
}


@pytest.fixture(scope="module")
def model():
    return Model({x: "\n".join(s.strip() for s in t.replace("?", ".").replace("。", ".").split(".")) + "\n" for x, t in TEXT.items()})


def test_automaton_accepts_the_factors_of_its_text_and_no_others():
    text = "abracadabra\nbarbara\nabba\n"
    a = Automaton(text, rare=1)

    def accepts(s):
        state = 0
        for c in s:
            state = a.table[state * a.width + a.symbols[c]] if state >= 0 else -1
            if state < 0:
                return False
        return True

    factors = {text[i:j] for i in range(len(text)) for j in range(i + 1, len(text) + 1)}
    assert all(map(accepts, factors))
    letters = sorted(set(text))
    words = [""]
    for _ in range(4):
        words = [w + c for w in words for c in letters]
        assert all(accepts(w) == (w in factors) for w in words)


def test_phrases_are_longest_matches(model):
    k = model.languages.index("en")
    found, totals = model.segments(["the weather was fine"])
    assert found == [[("en", found[0][0][1])]] and totals[k, 0] <= 2.5


def test_one_and_several_languages(model):
    texts = ["we walked along the river", "caminamos junto al río", "мы гуляли вдоль реки", "夕方まで川に沿って歩きました",
             "nobody told me that the meeting was cancelled. nadie me dijo que la reunión estaba cancelada",
             "今回は雨が降っているので家にいたいです / she keeps asking me about the old garden", "мы гуляли вдоль реки Robert Smith до самого вечера"]
    found, _ = model.segments(texts)
    assert [[x for x, _ in f] for f in found] == [["en"], ["es"], ["ru"], ["ja"], ["en", "es"], ["ja", "en"], ["ru"]]


def test_held_out_accuracy(model):
    held = [("en", "everybody was asking about the list"), ("es", "todos preguntan por la lista de la fiesta"), ("ru", "все спрашивали про список"), ("ja", "リストを送ってくれましたか"),
            ("en", "she walked home because of the rain"), ("es", "ella se quedó en casa hasta el domingo"), ("ru", "она осталась дома из-за дождя"), ("ja", "雨が降ったので中止になりました")]
    found, _ = model.segments([t for _, t in held])
    assert sum(f[0][0] == x for f, (x, _) in zip(found, held)) >= 7


def test_labels():
    assert [label_language(x) for x in ("en", "EN", "en_US", "zh-Hans", " pt-BR ", "", "und", None)] == ["en", "en", "en", "zh", "pt", None, None, None]


def test_cleaning_drops_wrong_labels():
    rows = [(x, t) for x, t in TEXT.items()] * 3 + [("es", TEXT["en"])]
    out = clean_labelled(rows, dict.fromkeys(TEXT, 10_000))
    assert "weather" not in out["es"] and "weather" in out["en"]


def test_operator_and_edges(spark, model):
    long_ = TEXT["en"] * 200
    rows = [("m", 1, "we walked along the river", "en_GB"), ("m", 2, "we walked along the river", "es"), ("m", 3, "caminamos junto al río", None), ("m", 4, None, "en"), ("m", 5, "", "en"),
            ("m", 6, "short", "es"), ("m", 7, long_, "und"), ("m", 8, "12345 !!!", "en"), ("m", 9, "@handle_of_someone", "ru")]
    df = spark.createDataFrame(rows, "src string, row_no long, text string, lang string").selectExpr("*", "'z' as seg_no", "'z' as label")
    got = {(r.row_no, r.seg_no, r.seg_lang) for r in label_segments(df, model, only_wrong=True).collect()}
    assert got == {(2, 1, "en"), (3, 1, "es"), (7, 1, "en")}
    assert label_segments(df.limit(0), model).count() == 0
