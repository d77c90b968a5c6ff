"""From a file tree to searchable records, as the command line runs it."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from filequarry.functions import images, text
from filequarry.functions.records import relative_path
from filequarry.operators import pictures
from filequarry.operators.pipeline import index_pictures, ingest_tree
from filequarry.operators.store import Store

PACKET = b"""<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description
 xmlns:xmp="http://ns.adobe.com/xap/1.0/" xmp:Rating="4"/></rdf:RDF></x:xmpmeta>"""


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "files"
    (root / "sub").mkdir(parents=True)
    picture = images.to_png(np.full((30, 60, 3), 90, np.uint8))
    files = {"a.txt": "Die Häuser am Fluss".encode(), "sub/b.md": b"Ein Haus", "bad.docx": b"no zip", "c.pdf": b"%PDF", "p.png": picture, "q.PNG": picture + PACKET, "broken.jpg": b"no image"}
    for name, data in files.items():
        (root / name).write_bytes(data)
    (root / "gone.txt").symlink_to(root / "nowhere")
    return root


def test_ingest(spark, tree, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert ingest_tree(store, str(tree), "pool") == {"filemeta": 7, "dbdoc": 2, "errors": 5, "gone": 1}
    files = {r["path"]: r for r in store.read("filemeta").collect()}
    assert [files[p]["id"] for p in sorted(files)] == list(range(1, 8))  # what can't be parsed stays
    assert {"file", "fdate", "fsize"} <= set(files["a.txt"]["md_keys"]) and files["bad.docx"]["fsize"] == 6 and len(files["c.pdf"]["sha256"]) == 32
    documents = store.read("dbdoc")
    assert all(r["lexemes"] for r in documents.collect())  # worked out by the writer
    assert [r["path"] for r in text.tsquery(documents, "Haus").orderBy("path").collect()] == ["a.txt", "sub/b.md"]
    assert ingest_tree(store, str(tree), "pool")["filemeta"] == 0
    (tree / "new.txt").write_text("neu")
    assert ingest_tree(store, str(tree), "pool")["filemeta"] == 1 and store.read("filemeta").agg(F.max("id")).first()[0] == 8


def test_pictures(spark, tree, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    ingest_tree(store, str(tree), "pool")
    model = pictures.grid_model(16, channels=4)
    assert index_pictures(store, str(tree), make_predict=model) == {"pictures": 3, "thumbnails": 2, "failed": 1, "vectors": 2}
    rows = {r["path"]: r for r in store.read("pictures").collect()}
    assert rows["q.PNG"]["xmp"] == {"xmp:Rating": "4"} and rows["p.png"]["xmp"] == {}
    assert len(rows["p.png"]["phash"]) == 8 and images.from_npy(bytes(rows["p.png"]["thumbarray"])).shape == (224, 224, 3) and rows["p.png"]["truncated"] is False
    assert rows["broken.jpg"]["thumbarray"] is None
    vectors = store.read("dino_v2_vectors").collect()
    assert {r["pic_id"] for r in vectors} == {rows["p.png"]["id"], rows["q.PNG"]["id"]} and all(len(r["vector"]) == 1024 for r in vectors)
    assert index_pictures(store, str(tree), make_predict=model) == {"pictures": 0, "thumbnails": 0, "failed": 1, "vectors": 0}


def test_null_lexemes_never_mean_no_hit(spark):
    rows = [(1, "a", "Haus", None), (2, "b", "Haus", ["haus", "b"]), (3, "c", "Haus", ["anderes"]), (4, "d", None, None)]
    docs = spark.createDataFrame(rows, "id bigint, fname string, inhalt string, lexemes array<string>")
    assert sorted(r["id"] for r in text.tsquery(docs, "Häuser").collect()) == [1, 2]
    assert text.tsquery(docs, "Haus").columns == ["id", "fname"]


def test_paths_outside_the_root(spark):
    files = ["/r/a/b.txt", "/r/c/d", "/x/y", "/r/a", "/r/ab/c", "rel/x", "/r//c/./d"]
    got = [r[0] for r in spark.createDataFrame([(f,) for f in files], "f string").select(relative_path(F.col("f"), "/r/a/", above=True)).collect()]
    assert got == ["b.txt", *[os.path.relpath(f, "/r/a") for f in files[1:3]], "", os.path.relpath("/r/ab/c", "/r/a"), "rel/x", "../c/d"]
    assert spark.createDataFrame([("/x",), (None,)], "f string").select(relative_path(F.col("f"), "/", above=True)).collect()[0][0] == "x"
