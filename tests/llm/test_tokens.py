import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from filequarry.llm import tokens


@pytest.fixture(scope="module")
def encoder():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return tokens.PrefixEncoder(f.read(), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def public():
    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    made.encode_special_tokens = True
    return made


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=200))
def test_equals_the_public_tokenizer(encoder, public, text):
    ids = encoder.encode(text)
    assert ids == public.encode(text, add_special_tokens=False).ids
    assert encoder.decode(ids).decode() == text


def test_hard_texts(encoder, public):
    for text in ("<|endoftext|>", "a" * 3000, " " * 3000 + "x", "=-" * 1500, "日本語" * 500, "\n" * 999, "don't WE'LL  \t 12,345.67 naïve 👩‍🔧", "﻿x　y z"):
        assert encoder.encode(text) == public.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(a=st.binary(max_size=40), b=st.binary(max_size=40), new=st.binary(max_size=10), data=st.data())
def test_appends_and_edits_are_exact(encoder, a, b, new, data):
    prefixes = tokens.Prefixes(encoder, a)
    prefixes.append(b)
    assert prefixes.ids() == encoder.merged(a + b)
    start = data.draw(st.integers(0, len(a + b)))
    end = data.draw(st.integers(start, len(a + b)))
    prefixes.edit(start, end, new)
    want = (a + b)[:start] + new + (a + b)[end:]
    assert prefixes.data == want and prefixes.ids() == encoder.merged(want)
    assert prefixes.ids(len(want) // 2) == encoder.merged(want[: len(want) // 2])


def test_edits_work_near_their_place(encoder):
    prefixes = tokens.Prefixes(encoder, b"the quick brown fox " * 200)
    assert prefixes.edit(100, 101, b"Z") < 2 * encoder.longest + 10


def test_columns(spark, public):
    rows = [(1, "Grüße, <|endoftext|>!", "x"), (2, None, "x"), (3, "", "x"), (4, "wort " * 40_000, "x"), (None, "a", "x"), (1, "Grüße, <|endoftext|>!", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = tokens.encode_column(df, ["doc_id"], "text").collect()
    assert sorted((r["doc_id"] or 0, list(r["ids"])) for r in got) == sorted((i or 0, public.encode(t or "", add_special_tokens=False).ids) for i, t, _ in rows)
    counts = tokens.count_column(df, ["doc_id"], "text").collect()
    assert sorted((r["doc_id"] or 0, r["tokens"]) for r in counts) == sorted((r["doc_id"] or 0, len(r["ids"])) for r in got)
    assert tokens.encode_column(df.limit(0), ["doc_id"], "text").count() == 0
