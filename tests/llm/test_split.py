from hypothesis import given, settings
from hypothesis import strategies as st

from filequarry.llm import split

TEXT = ("Der erste Satz steht hier. Ein zweiter folgt ihm!\n\nEin neuer Absatz beginnt, und er ist „länger“. " * 40).strip()


def test_pieces_end_at_boundaries():
    pieces = split.cut(TEXT, 500, 60)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(TEXT) and len(pieces) > 5
    for (a, b), (c, d) in zip(pieces, pieces[1:], strict=False):
        assert b - a <= 500 and a < c < b < d and 30 <= b - c <= 90
        assert TEXT[b - 1].isspace() and (c == 0 or TEXT[c - 1].isspace())
        assert TEXT[:b].rstrip()[-1] in ".!“"


def test_texts_without_boundaries_and_limits():
    assert split.cut("x" * 2500, 1000, 100) == [(0, 1000), (900, 1900), (1800, 2500)]
    assert split.cut("あ" * 30 + "。" + "い" * 30, 40, 0)[0] == (0, 31)
    assert split.cut("", 10, 2) == [] and split.cut("abc", 10, 2) == [(0, 3)] and split.cut("abc", 3, 2) == [(0, 3)]
    assert split.cut("abcd", 0, 5) == [(0, 1), (1, 2), (2, 3), (3, 4)]
    marks = "é" * 30
    assert all(marks[a] == "e" for a, _ in split.cut(marks, 11, 3))


@settings(max_examples=200, deadline=None)
@given(st.text("ab .\n。é́👍‍", max_size=300), st.integers(1, 60), st.integers(0, 80))
def test_pieces_cover_every_text(text, limit, overlap):
    pieces = split.cut(text, limit, overlap)
    assert all(0 < b - a <= limit for a, b in pieces)
    assert (pieces == []) == (text == "")
    if pieces:
        assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
        assert all(a < c <= b < d for (a, b), (c, d) in zip(pieces, pieces[1:], strict=False))
        assert "".join(text[max(a, e) : b] for (a, b), e in zip(pieces, [0, *[b for _, b in pieces]], strict=False)) == text


@settings(max_examples=2000, deadline=None)
@given(st.text("ab .\n。é\u0301👍\u200d", max_size=300), st.integers(1, 60), st.integers(0, 80))
def test_pieces_share_what_was_asked_and_none_is_redundant(text, limit, overlap):
    used = split.usable_overlap(limit, overlap)
    pieces = split.cut(text, limit, overlap)
    assert used <= overlap and (3 * overlap >= limit or used == overlap)
    assert all(b < d and 0 <= b - c <= used + used // 2 for (_, b), (c, d) in zip(pieces, pieces[1:], strict=False))
    assert all(e > b for (_, b), (e, _) in zip(pieces, pieces[2:], strict=False))  # none is covered by its neighbours
    assert "".join(text[max(a, e) : b] for (a, b), e in zip(pieces, [0, *[b for _, b in pieces]], strict=False)) == text


def test_clusters_longer_than_a_piece():
    marks = ("a" + "\u0301" * 90) * 40
    pieces = split.cut(marks, 100, 10)
    assert len(pieces) <= 45 and all(0 <= b - c <= 15 for (_, b), (c, _) in zip(pieces, pieces[1:], strict=False))
    joined = "👍\u200d" * 400
    assert len(split.cut(joined, 100, 10)) <= 10
    assert split.cut("aa\u200daa\u0301", 4, 1)[-1][1] == 6


def test_reduced_overlaps_are_reported(spark):
    pools = spark.createDataFrame([("a", 1000, 50), ("b", 100, 40), ("c", 100, 33), ("d", None, 5)], "pool string, max_chars int, overlap_chars int")
    assert [(r["pool"], r["used_overlap"]) for r in split.reduced_overlaps(pools, "max_chars", "overlap_chars").collect()] == [("b", 33)]


def test_greedy_cuts_equal_a_walk():
    """The squared tables give the cuts that walking from piece to piece gives."""
    for limit, overlap in ((100, 10), (333, 50), (64, 0)):
        pieces = split.cut(TEXT, limit, overlap)
        for a, b in pieces[1:]:
            assert split.cut(TEXT[a:], limit, overlap)[0][1] == b - a or a == 0


def test_archive(spark):
    dbdoc = spark.createDataFrame([(1, "p", "wort " * 300, "x"), (2, "p", None, "x"), (3, "p", "", "x"), (4, "q", "wort " * 300, "x"), (5, None, "wort " * 300, "x"), (6, "r", "y" * 200_001, "x"), (1, "p", "wort " * 300, "x")], "id bigint, pool string, inhalt string, item string")
    chunks = spark.createDataFrame([(10, 1, "wort " * 250), (11, 4, "wort " * 250), (12, 99, "wort " * 250), (13, None, None), (14, 1, None)], "chunk_id bigint, doc_id bigint, content string")
    pools = spark.createDataFrame([("p", 1000, 50, "z"), ("r", 1000, None, "z"), (None, 1, 1, "z"), ("p", 1000, 50, "z"), ("q", None, 10, "z")], "pool string, max_chars int, overlap_chars int, item string")
    rows = split.archive_pieces(dbdoc, chunks, pools).collect()
    assert sorted({(r["item"], r["item_id"]) for r in rows}) == [("dbdoc", 1), ("dbdoc", 6), ("doc_vectors", 10)]
    assert sum(r["item_id"] == 1 for r in rows) == 4  # the repeated row has pieces of its own
    assert max(len(r["content"]) for r in rows) <= 1000 and sum(len(r["content"]) for r in rows if r["item_id"] == 6) == 200_001
    empty = split.archive_pieces(dbdoc.limit(0), chunks.limit(0), pools.limit(0))
    assert empty.count() == 0 and empty.columns == ["item", "item_id", "piece_no", "start", "content"]
