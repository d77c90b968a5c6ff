from filequarry.functions import text
from filequarry.functions.stemming import stem
from filequarry.operators import search
from pyspark.sql import functions as F


def test_german_stems():
    # Pairs of the published vocabulary of the algorithm.
    pairs = {
        "aufeinander": "aufeinand", "aufeinanderbiss": "aufeinanderbiss", "auffallend": "auffall", "aufenthalt": "aufenthalt", "kategorische": "kategor", "kater": "kat", "katers": "kat", "häuser": "haus",
        "jugendlicher": "jugend", "kauft": "kauft", "kaufte": "kauft", "käufer": "kauf", "straßen": "strass", "bücher": "buch", "aufgaben": "aufgab", "möglichkeit": "moglich", "freiheit": "freiheit", "quelle": "quell",
    }
    assert {w: stem(w) for w in pairs} == pairs
    assert stem("") == "" and stem("ab") == "ab"


DOCS = [(1, "a.txt", "Die Häuser am Fluss"), (2, "b.txt", "Ein Haus ohne Fluss"), (3, "c.txt", "und der die das"), (4, "Haus.txt", None)]


def test_full_text(spark):
    docs = text.with_lexemes(spark.createDataFrame(DOCS, "id bigint, fname string, inhalt string"))

    def hits(query, language="german"):
        return sorted(r["id"] for r in text.tsquery(docs, query, language).collect())

    assert hits("Häuser Flüsse") == [1, 2] or hits("Häuser Fluss") == [1, 2]
    assert hits("haus ohne") == [1, 2, 4] or hits("haus fluss") == [1, 2]
    assert hits("haus berg") == [] and hits("der die und") == [] and hits("") == []
    index = text.inverted_index(docs)
    assert sorted(r["id"] for r in text.search_index(index, text.query_lexemes(spark, "Haus Fluss")).collect()) == [1, 2]
    assert text.search_index(index, []).count() == 0
    assert text.with_lexemes(spark.createDataFrame([], "id bigint, fname string, inhalt string")).count() == 0


def test_ranked_search(spark):
    docs = spark.createDataFrame(DOCS, "id bigint, fname string, inhalt string")
    assert [tuple(r) for r in search.ranked_search(docs, "Haus").collect()] == [(4, 15), (1, 5), (2, 5)]
    assert [tuple(r) for r in search.ranked_search(docs, "flus").collect()] == [(1, 2), (2, 2)]
    assert search.ranked_search(docs, "und 12").count() == 0
    assert search.split_query("Wo-ist_es, bitte? 3") == ["Wo", "ist_es", "bitte", "3"]
    hits = spark.createDataFrame([(1, 5), (1, 9), (2, 9)], "id bigint, score int")
    assert [tuple(r) for r in search.best_hits(hits).collect()] == [(1, 9), (2, 9)]


def test_titles_objects_and_snippets(spark):
    df = spark.createDataFrame([("Anlagen",), ("eine Anlage im langen Titel",), (None,)], "t string")
    assert [r[0] for r in df.select(search.title_score(F.col("t"), "anlage")).collect()] == [14, None, None]
    assert [r[0] for r in df.select(search.title_score(F.col("t"), "anlage", False)).collect()] == [86, None, None]
    names = spark.createDataFrame([("a.read", 0), ("a.reader", 1), ("b", 2)], "n string, p int")
    assert [r[0] for r in names.select(search.object_score(F.col("n"), F.col("p"), "read")).collect()] == [26, 11, None]
    long = "x " * 300 + "Wort " + "y " * 300
    cut = spark.createDataFrame([(long,), ("kurz",), (None,)], "t string").select(search.snippet(F.col("t"), ["wort"])).collect()
    assert cut[0][0].startswith("…") and cut[0][0].endswith("…") and "Wort" in cut[0][0] and len(cut[0][0]) <= 242
    assert cut[1][0] == "kurz" and cut[2][0] is None


def test_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [-1.0, 0.0]), (4, [0.0, 1.0]), (5, [0.0, 0.0]), (6, None), (7, [1.0])]
    df = spark.createDataFrame(rows, "id bigint, v array<float>")
    got = [(r["id"], r["sim"]) for r in search.similar_to(df, "id", "v", 1).collect()]
    assert got == [(1, 1.0), (2, 1.0), (4, 0.0), (5, 0.0), (3, -1.0), (7, None)]
    assert [r["id"] for r in search.similar_to(df, "id", "v", 1, 1, include_self=False).collect()] == [2]
    assert search.similar_to(df, "id", "v", 99).count() == 0
    bits = spark.createDataFrame([(1, b"\x00" * 8), (2, b"\xff" * 8), (3, b"\x00" * 7 + b"\x03"), (4, None), (5, b"short")], "id bigint, h binary")
    from filequarry.functions.vectors import hash_bits

    assert [tuple(r) for r in search.hamming_topk(bits, "id", hash_bits(F.col("h")), 0).collect()] == [(1, 0), (3, 2), (2, 64)]


def test_long_vectors(spark):
    rows = [(1, [1.0, 0.0] * 100), (2, [2.0, 0.0] * 100), (3, [-1.0, 0.0] * 100), (5, [0.0] * 200), (6, None), (7, [1.0]), (8, [None] * 200)]
    df = spark.createDataFrame(rows, "id bigint, v array<float>")
    scores = {r["id"]: r["sim"] for r in search.cosine_scores(df, "id", "v", rows[0][1]).collect()}
    assert {k: None if v is None else round(v, 9) for k, v in scores.items()} == {1: 1.0, 2: 1.0, 3: -1.0, 5: 0.0, 6: None, 7: None, 8: None}
