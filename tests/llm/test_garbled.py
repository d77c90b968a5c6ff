import random

import numpy as np
import pytest

from filequarry.llm import garbled

WORDS = "größer Straße für müssen Überprüfung früher wäre Mühe Höhe öffnen hätte längst gelöscht Aufnahmen später zunächst jährlich Gästebuch Rückseite Büro naïve café déjà été élève où à garçon preço ação não você más año señal él después mañana così più perché però è ключ дорога файл снимков после переезда запись лежала проверка 会議の記録は棚の上に置かれている。 € – ½ °C, „Wort“ “word” «mot» ├── │ └──".split()


@pytest.fixture(scope="module")
def model():
    return garbled.train({w: 200 for w in WORDS})


def test_chains_invert():
    for chain in garbled.chains():
        for word in ("größer", "дорога", "記録", "€"):
            spoilt = garbled.garble(word, chain)
            if spoilt is not None and spoilt != word:
                assert garbled.garble(garbled.restore(spoilt, chain) or "", chain) in (spoilt, "")
    assert garbled.restore("GrÃ¶ÃŸe", ("utf-8", "cp1252")) == "Größe" and garbled.restore("Größe", ("utf-8", "cp1252")) is None


def test_held_out_accuracy(model):
    """Words that training has not seen, garbled by usual chains."""
    rng = random.Random(1)
    unseen = ["Grüße", "Bücher", "Türen", "Gärten", "Vögel", "Fläche", "später.", "dûment", "opération", "coração", "mañanas", "città", "снимки", "записка"]
    chains = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp1251"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("utf-8", "cp1252", "utf-8", "cp1252")]
    tried = right = 0
    for word in unseen:
        assert model.verdict(word) is None
        for chain in rng.sample(chains, 4):
            spoilt = garbled.garble(word, chain)
            if spoilt is not None:
                tried += 1
                found = model.verdict(spoilt)
                right += found is not None and found[1] == word
    assert right / tried >= 0.95


def test_mending(model):
    text = "Die Straße ist größer. Das wÃ¤re für die HÃ¶he zu öffnen."
    fixed, chains, lost = garbled.mend(text, model.verdict)
    assert fixed == "Die Straße ist größer. Das wäre für die Höhe zu öffnen." and sum(chains.values()) == 2 and lost == 0
    assert garbled.mend("Hinweis: Wer „Ã¼“ statt „ü“ liest, hat die falsche Kodierung.", model.verdict) is None
    assert garbled.mend("Das Stra�enfest", model.verdict)[2] == 1
    assert garbled.mend("Das Zeichen “�” steht für Verlorenes", model.verdict) is None
    assert garbled.mend("plain", model.verdict) is None and garbled.mend("Größer – für € 5", model.verdict) is None


def test_table(spark):
    sound = [(i, " ".join(random.Random(i).sample(WORDS, 30)), "x") for i in range(80)]
    rows = [*sound, (100, "für die wÃ¤re größer", "x"), (101, None, "x"), (102, "", "x"), (103, " \n", "x"), (104, "für " * 50_000 + "mÃ¼ssen", "x"), (100, "für die wÃ¤re größer", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, words string")
    got = garbled.mended(df).collect()
    assert sorted(r["doc_id"] for r in got) == [100, 100, 104]
    assert {r["restored"] for r in got if r["doc_id"] == 100} == {"für die wäre größer"}
    assert garbled.mended(df.limit(0)).count() == 0 and garbled.mended(df.where("doc_id = 102")).count() == 0


def test_a_hot_group_of_garbled_copies(spark):
    """Copies count once: a text garbled by a one-byte chain stays garbled however often it is there."""
    rows = [(i, " ".join(random.Random(i).sample(WORDS, 30))) for i in range(80)]
    spoilt = garbled.garble("größer", ("cp850", "cp1252"))
    rows += [(1000 + i, f"das ist {spoilt}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    parts = garbled.sampled_words(df)
    assert parts[garbled.fragments(spoilt)[0]] == 1 and garbled.seen_words(df, parts) == parts
    got = {r["doc_id"]: r["restored"] for r in garbled.mended(df).collect()}
    assert {got.get(1000 + i) for i in range(300)} == {"das ist größer"}


def test_every_chain_likely_enough_is_tried(model, monkeypatch):
    """More than 12 chains that can't be inverted come first."""
    spoilt = garbled.garble("größer", ("cp850", "cp1252"))
    right = model.chains.index(("cp850", "cp1252"))
    barred = [i for i, c in enumerate(model.chains) if c is not None and garbled.restore(spoilt, c) is None]
    assert len(barred) > 12
    likely = np.full(len(model.chains), -100.0)
    likely[[0, right, *barred]] = [-50, -20, *[-10] * len(barred)]
    monkeypatch.setattr(model, "likelihoods", lambda word: likely if word == spoilt else np.zeros(len(model.chains)))
    assert model.verdict(spoilt)[1] == "größer"


def test_parts_of_texts_without_blanks(model):
    spoilt = garbled.garble("棚の上", ("utf-8", "cp1252"))
    for text, want in (
        ("früher—wÃ¤re", "früher—wäre"), ("für/wÃ¤re/größer", "für/wäre/größer"), (f"会議の記録は{spoilt}に置かれている。", "会議の記録は棚の上に置かれている。"),
        ("„für“,„wÃ¤re“", "„für“,„wäre“"),
    ):
        found = garbled.mend(text, model.verdict)
        assert found is not None and found[0] == want
    assert garbled.mend("会議の記録は棚の上に置かれている。für/größer—später", model.verdict) is None
    assert garbled.mend("Wer („Ã¼“) statt („ü“) liest", model.verdict) is None


def test_replacement_characters_are_told_apart(spark):
    sound = [(i, " ".join(random.Random(i).sample(WORDS, 30))) for i in range(80)]
    df = spark.createDataFrame([*sound, (100, "das Stra�enfest"), (101, "die wÃ¤re"), (102, "die wÃ¤re Stra�e")], "doc_id bigint, text string")
    assert {r["doc_id"]: r["found_by"] for r in garbled.mended(df).collect()} == {100: "replacement", 101: "classifier", 102: "both"}


def test_words_are_garbled_alike_alone_and_together():
    words = [*WORDS, "€", "ключ", "a\u0301", "棚"]
    for chain in garbled.chains():
        assert garbled.garble_all(words, chain) == [garbled.garble(w, chain) for w in words]
