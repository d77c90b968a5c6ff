import os
from datetime import datetime

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from filequarry.config import Config, suffix_list
from filequarry.functions import records


def one(spark, value, **columns):
    df = spark.createDataFrame([tuple(columns.values())], ", ".join(f"`{k}` string" for k in columns))
    return df.select(value.alias("v")).first()["v"]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("ab./ ü\n", max_size=12), min_size=30, max_size=60))
def test_names_as_the_os_has_them(spark, paths):
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = df.select("p", records.basename(F.col("p")).alias("b"), records.suffix(F.col("p")).alias("s")).collect()
    assert all(r["b"] == os.path.basename(r["p"]) and r["s"] == os.path.splitext(r["p"])[1] for r in got)


def test_suffixes_and_types(spark):
    for path, want, kind in ((".bashrc", "", None), ("a.tar.gz", ".gz", None), ("a.JPG", ".JPG", "pic"), ("x/y.Heic", ".Heic", "pic"), ("m.vob", ".vob", "vid"), ("a.b/c", "", None)):
        assert one(spark, records.suffix(F.col("p")), p=path) == want
        assert one(spark, records.ftype(records.suffix(F.col("p"))), p=path) == kind == Config().get_ftype(want)
    assert one(spark, records.ftype(F.col("p")), p=None) is None


def test_paths_below_a_root(spark):
    file = F.col("p")
    assert one(spark, records.relative_path(file, "/r/"), p="/r/a/r/b") == "a/r/b"
    assert one(spark, records.relative_path(file, "/r/", everywhere=True), p="/r/a/r/b") == "ab"
    assert one(spark, records.relative_path(file, "/r"), p="/other/b") == "/other/b"


def test_metadata_rules(spark):
    meta, fdate = F.col("m"), F.lit(datetime(2024, 5, 1, 10)).cast("timestamp_ntz")
    cases = [
        ('{"fdate": "x"}', datetime(2024, 5, 1, 10), datetime(1990, 1, 1)),
        ('{"dcterms:created": ["2020-01-01T00:00:00Z", "2021-01-01T00:00:00Z"]}', datetime(2020, 1, 1), datetime(2020, 1, 1)),
        ('{"dcterms:created": "2020-01-01T05:00:00+02:00"}', datetime(2020, 1, 1, 5), datetime(2020, 1, 1, 5)),
        ('{"dcterms:created": []}', datetime(2024, 5, 1, 10), datetime(1990, 1, 1)),
        ('{"dcterms:created": null}', datetime(2024, 5, 1, 10), datetime(1990, 1, 1)),
        ('{"dcterms:created": "x"}', datetime(2024, 5, 1, 10), datetime(1990, 1, 1)),
        (None, datetime(2024, 5, 1, 10), datetime(1990, 1, 1)),
    ]
    for text, of_file, of_document in cases:
        assert one(spark, records.sort_date_of_file(meta, fdate), m=text) == of_file
        assert one(spark, records.sort_date_of_document(meta), m=text) == of_document
    assert one(spark, records.content_length(meta), m='{"Content-Length": ["12", "13"]}') == 12
    assert one(spark, records.content_length(meta), m='{"Content-Length": "many"}') == 0
    assert one(spark, records.content_type(meta), m="{}") == "unk/unk"
    assert one(spark, records.meta_keys(meta), m='{"b": 1, "a": {"c": 2}}') == ["b", "a"]
    assert one(spark, records.meta_keys(meta), m=None) == []
    assert one(spark, records.nul_scrubbed(meta), m="a\x00b") == "anullb"
    assert one(spark, records.search_text(F.col("f"), meta), f="a.txt", m="b") == "a.txt b"
    assert one(spark, records.search_text(F.col("f"), meta, fused=True), f="a.txt", m="b") == "a.txtb"
    assert len(one(spark, records.search_text(F.col("f"), meta), f="a", m="x" * 900_000)) == 800_000


def test_config(tmp_path, monkeypatch):
    for name in ("IND_DOCROOT", "IND_PICSUF"):
        monkeypatch.delenv(name, raising=False)
    env = tmp_path / "config.env"
    env.write_text("# settings\nIND_DOCROOT=/one/   # root\nIND_PICSUF=.jpg, .png,\n", encoding="utf-8")
    found = Config.from_env_file(str(env))
    assert (found.docroot, found.picsuf, found.get_ftype(".PNG"), found.get_ftype(".bmp")) == ("/one/", (".jpg", ".png"), "pic", None)
    monkeypatch.setenv("IND_DOCROOT", "/two/")
    assert Config.from_env_file(str(env)).docroot == "/two/"
    assert Config.from_env_file(str(env), override=True).docroot == "/one/"
    assert Config.from_env_file(str(env), docroot="/three/").docroot == "/three/"
    assert Config.from_env_file(str(tmp_path / "none")).docroot == "/two/"
    assert suffix_list(" .a,.b , ") == (".a", ".b")
