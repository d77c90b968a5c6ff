import pytest

from filequarry.llm import language

SENTENCES = {
    "de": ["Die Straße vor dem Haus wurde gesperrt, weil der Verein dort sein Fest feiert.", "Niemand weiß, warum die Rechnung so spät gekommen ist.", "Im grünen Regal liegen noch viele alte Bilder aus dem Garten."],
    "en": ["The road in front of the house was closed because the club held its fair there.", "Nobody knows why the invoice arrived so late this year.", "There are still many old pictures of the garden on the green shelf."],
    "fr": ["La route devant la maison était fermée parce que le club y faisait sa fête.", "Personne ne sait pourquoi la facture est arrivée si tard cette année.", "Il y a encore beaucoup de vieilles photos du jardin sur l'étagère verte."],
    "ja": ["会議の記録は棚の上に置かれている。", "写真の束は昨年の春に整理されたが、まだ確認していない。", "古い書類は二つの箱に分けた。"],
}


@pytest.fixture(scope="module")
def model():
    return language.Centroids({k: [" ".join(v[i:] + v[:i]) * 3 for i in range(3)] for k, v in SENTENCES.items()})


def test_segments_of_mixed_texts(model):
    text = " ".join(SENTENCES["de"]) + "\n\n" + " ".join(SENTENCES["en"]) + "\n" + "".join(SENTENCES["ja"]) * 3
    found = language.segments(model, text)
    assert [s[2] for s in found] == ["de", "en", "ja"]
    assert all(0.5 < s[3] <= 1 and text[s[0] : s[1]].strip() for s in found)
    assert sum(s[4] for s in found) == sum(map(str.isalpha, text))


def test_what_has_no_language(model):
    for text in (None, "", "  \n ", "12 34 !!", "é" * 500, "6b2040/90fdd9/f58b2c/ae8c10/265a6c/eb10e5/" * 20):
        assert [s for s in language.segments(model, text) if s[4] >= 100] == []
    assert language.segments(language.Centroids({}), "Text") == []


def test_labels(spark):
    cases = [("de", "de"), ("DE", "de"), ("de-AT", "de"), ("de_AT", "de"), ("German", "de"), ("français", "fr"), (" eng ", "en"), ("??", None), ("x-default", None), ("", None), ("und", None)]
    rows = [(f'{{"dc:language": "{a}"}}', b) for a, b in cases] + [('{"dc:language": ["nl-NL", "de"]}', "nl"), ('{"dc:language": []}', None), ('{"dc:language": null}', None), ("{}", None), (None, None), ("broken", None)]
    got = spark.createDataFrame(rows, "meta_data string, want string").select("want", language.label_language().alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got)


def test_mislabelled(spark, model):
    de, en = " ".join(SENTENCES["de"]), " ".join(SENTENCES["en"])
    label = '{"dc:language": "%s"}'
    rows = [
        (1, de, label % "German"), (2, de, label % "fr"), (3, de, None), (4, de + "\n" + en, label % "de"), (5, de + "\n" + SENTENCES["en"][1], label % "de"),
        (6, "", label % "fr"), (7, None, None), (8, "kurz", None), (9, en * 300, label % "en"), (2, de, label % "fr"),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "id bigint, inhalt string, meta_data string, label string, letters int")
    got = sorted(tuple(r) for r in language.mislabelled(df, model).collect())
    assert got == [(2, "de"), (3, "de"), (4, "de"), (4, "en")]
    assert language.mislabelled(df.limit(0), model).count() == 0


def test_fit(spark):
    rows = [(k, " ".join(v) * 2) for k, v in SENTENCES.items()] * 2 + [(None, "x" * 300), ("xx", "y" * 300), ("de", None)]
    fitted = language.fit(spark.createDataFrame(rows, "lang string, text string"))
    assert set(fitted.languages) == {"de", "en", "fr"} | ({"ja"} if len(" ".join(SENTENCES["ja"]) * 2) >= 200 else set())
    assert fitted.similarities(" ".join(SENTENCES["fr"]), [(0, 70)])[0].argmax() == fitted.languages.index("fr")
    assert language.fit(spark.createDataFrame([], "lang string, text string")).languages == []


def test_copies_are_drawn_once_and_long_texts_all_over(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(language, "Centroids", lambda samples: seen.update(samples))
    rows = [("de", "kopie " * 50)] * 300 + [("de", f"text {i} " * 40) for i in range(50)] + [("en", "a" * 9_000 + "z" * 9_000)]
    language.fit(spark.createDataFrame(rows, "lang string, text string").repartition(4))
    assert len(seen["de"]) == 51 and len(set(seen["de"])) == 51
    assert seen["en"][0].count("a") == 1_250 - 250 + 250 and seen["en"][0].count("z") == 1_250 and len(seen["en"][0]) == 2_504


def test_confidence_of_held_out_stretches(model):
    """Texts that are near their own language alone have a confidence near 1, one between two languages near a half."""
    sure = language.segments(model, " ".join(SENTENCES["fr"]))
    assert sure[0][2] == "fr" and sure[0][3] > 0.9
