import io
import zipfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from filequarry.functions import images
from filequarry.operators import ingest, pictures
from filequarry.sources import crawl, extract, xmp
from filequarry.streaming import crawl as streams

PACKET = b"""junk<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description
 xmlns:xmp="http://ns.adobe.com/xap/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/" xmp:Rating="4"><dc:subject><rdf:Bag><rdf:li>sea</rdf:li><rdf:li>sun</rdf:li></rdf:Bag></dc:subject>
 <xmp:Rating>5</xmp:Rating></rdf:Description></rdf:RDF></x:xmpmeta>junk"""


def gradient(h, w):
    return np.stack([np.tile(np.linspace(0, 255, w), (h, 1)), np.tile(np.linspace(0, 255, h)[:, None], (1, w)), np.full((h, w), 9.0)], axis=2).astype(np.uint8)


def docx():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>Eins</w:t></w:r></w:p><w:p><w:r><w:t>Zwei</w:t></w:r></w:p></w:body></w:document>')
        z.writestr("docProps/core.xml", '<c:coreProperties xmlns:c="c" xmlns:dc="dc" xmlns:t="t"><dc:title>Titel</dc:title><t:created>2020-02-03T04:05:06Z</t:created></c:coreProperties>')
    return out.getvalue()


def epub():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("o/p.opf", '<package xmlns="p"><metadata><dc:language xmlns:dc="d">de</dc:language></metadata><manifest><item id="a" href="a.html"/></manifest><spine><itemref idref="a"/></spine></package>')
        z.writestr("o/a.html", "<p>Seite</p>")
    return out.getvalue()


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "root"
    (root / "sub" / ".deep").mkdir(parents=True)
    files = {
        "a.txt": "Grüße".encode(), "b.HTML": b"<html lang='de'><title>T</title><script>no</script><p>Ein &amp; zwei<br>drei</p></html>", "sub/c.docx": docx(), "sub/.hidden.md": b"hid", "sub/.deep/_u.txt": b"under",
        "empty": b"", "sub/d.epub": epub(), "sub/e.pdf": b"%PDF", "bad.docx": b"no zip", "p.png": images.to_png(gradient(50, 100)), "bad.jpg": b"no image", "x.jpg": PACKET,
    }
    for name, data in files.items():
        (root / name).write_bytes(data)
    return root


def test_crawl_and_records(spark, tree):
    assert crawl.crawl(spark, str(tree)).count() == 12
    assert crawl.crawl(spark, str(tree), hidden=False).count() < 12
    assert {r["path"].rsplit("/", 1)[1] for r in crawl.crawl(spark, str(tree), "*.txt", content=False).collect()} == {"a.txt", "_u.txt"}
    got = {r["path"]: r for r in ingest.filemeta_records(spark, str(tree), "pool").collect()}
    assert len(got) == 12 and got["a.txt"]["ctype"] == "text/plain" and got["a.txt"]["fsize"] == 7 and len(got["a.txt"]["sha256"]) == 32
    assert got["sub/c.docx"]["sort_date"].year == 2020 and got["a.txt"]["sort_date"] == got["a.txt"]["fdate"]
    assert got["empty"]["suffix"] == "" and got["empty"]["ctype"] == "unk/unk" and got["sub/e.pdf"]["error"] == "unsupported" and "BadZipFile" in got["bad.docx"]["error"]
    documents = {r["path"]: r for r in ingest.dbdoc_records(spark, str(tree), "pool").collect()}
    assert documents["sub/c.docx"]["inhalt"] == "Eins\nZwei" and documents["a.txt"]["inhalt"] == "Grüße" and documents["sub/d.epub"]["inhalt"] == "Seite"
    assert documents["b.HTML"]["inhalt"] == "Ein & zwei\ndrei" and documents["bad.docx"]["inhalt"] == "" and documents["a.txt"]["sort_date"].year == 1990
    assert '"dc:language": ["de"]' in documents["b.HTML"]["meta_data"] and documents["b.HTML"]["md_keys"][0] == "Content-Type"
    assert ingest.filemeta_records(spark, str(tree), "pool", "*.none").count() == 0


def test_a_wide_and_deep_tree_is_listed_by_tasks(spark, tmp_path, monkeypatch):
    import os

    monkeypatch.setattr(crawl, "SUBTREES", 4)
    for a in range(6):
        for b in range(3):
            folder = tmp_path / f"d{a}" / f"e{b}" / ".deep"
            folder.mkdir(parents=True)
            (folder / f"{a}{b}.txt").write_text(f"{a}{b}")
    (tmp_path / "top.txt").write_text("top")
    (tmp_path / "loop").symlink_to(tmp_path)
    got = crawl.crawl(spark, str(tmp_path), each=5)
    assert got.rdd.getNumPartitions() >= 4 and got.count() == 19
    rows = {os.path.basename(r["path"]): bytes(r["content"]).decode() for r in got.collect()}
    assert rows["top.txt"] == "top" and rows["52.txt"] == "52"
    assert crawl.crawl(spark, str(tmp_path / "none")).where("error is null").count() == 0


def test_large_files(spark, tmp_path):
    (tmp_path / "large.txt").write_bytes(b"x" * ((1 << 26) + 1))
    (tmp_path / "b.bin").write_bytes(b"12345")
    got = ingest.dbdoc_records(spark, str(tmp_path), "pool", "*.txt").select(F.length("inhalt").alias("n"), "clength", "error").first()
    assert tuple(got) == ((1 << 26) + 1, (1 << 26) + 1, None)
    small = {r["path"].rsplit("/", 1)[1]: r for r in crawl.crawl(spark, str(tmp_path), maxbytes=4).select("path", "content", "error").collect()}
    assert small["b.bin"]["content"] is None and {r["error"] for r in small.values()} == {"too large"}
    assert {r["path"]: r["error"] for r in ingest.filemeta_records(spark, str(tmp_path), "pool", maxbytes=4).select("path", "error").collect()} == {"large.txt": None, "b.bin": "too large"}


def test_pictures(spark, tree):
    files = ingest.filemeta_records(spark, str(tree), "pool").withColumn("id", F.xxhash64("path"))
    pics = ingest.pictures_of(files)
    assert {r["path"] for r in pics.collect()} == {"p.png", "bad.jpg", "x.jpg"}
    tagged = ingest.with_xmp(pics, crawl.crawl(spark, str(tree)), str(tree))
    assert {r["path"]: r["xmp"] for r in tagged.collect()}["x.jpg"] == {"xmp:Rating": "5", "dc:subject[1]": "sea", "dc:subject[2]": "sun"}
    assert ingest.missing_pictures(files, pics.where("path = 'p.png'")).count() == 2
    assert ingest.without_thumbnail(pics, "/d/").where("file = '/d/p.png'").count() == 1
    contents = crawl.crawl(spark, str(tree), "*.[jp][pn]g").select(F.col("path").alias("id"), "content")
    got = {r["id"].rsplit("/", 1)[1]: r for r in pictures.thumbnails(contents).collect()}
    small = images.from_npy(bytes(got["p.png"]["thumbarray"]))
    assert small.shape == (224, 224, 3) and small[111].any() and not small[112:].any() and got["p.png"]["error"] is None
    assert got["bad.jpg"]["error"] and got["bad.jpg"]["thumbarray"] is None
    done = pictures.thumbnails(contents).where("error is null")
    vectors = pictures.embeddings(done, pictures.grid_model(), batch_size=2).collect()
    assert len(vectors) == 1 and len(vectors[0]["vector"]) == 192
    hashes = done.select("phash", pictures.phash_column(F.col("thumbarray")).alias("again"), pictures.png_column(F.col("thumbarray")).alias("png")).first()
    assert bytes(hashes["phash"]) == bytes(hashes["again"]) and (images.from_png(bytes(hashes["png"])) == small).all()
    failed = pictures.thumbnails(contents).where("error is not null")
    assert pictures.delivered(failed, done).count() == 2
    decoded = {r["path"].rsplit("/", 1)[1]: r for r in pictures.spark_images(spark, str(tree)).collect()}
    assert (images.from_png(bytes(decoded["p.png"]["content"])) == gradient(50, 100)).all()


@settings(max_examples=20, deadline=None)
@given(st.integers(1, 40), st.integers(1, 40), st.integers(0, 5))
def test_codecs(h, w, seed):
    image = np.random.default_rng(seed).integers(0, 256, (h, w, 3), dtype=np.uint8)
    assert (images.from_npy(images.to_npy(image)) == image).all() and (images.from_png(images.to_png(image)) == image).all()
    small = images.thumbnail(image)
    assert small.shape == (224, 224, 3)
    longer = max(h, w)
    assert not small[max(1, round(h * 224 / longer)) :].any() and not small[:, max(1, round(w * 224 / longer)) :].any()


def test_thumbnails_and_hashes():
    exact = gradient(224, 224)
    assert (images.thumbnail(exact) == exact).all()
    assert (images.thumbnail(np.full((100, 400, 3), 7, np.uint8))[:56] == 7).all()
    base = gradient(300, 200) // 2
    noisy = np.clip(base.astype(int) + 20, 0, 255).astype(np.uint8)
    distance = np.unpackbits(np.frombuffer(images.phash(base), np.uint8) ^ np.frombuffer(images.phash(noisy), np.uint8)).sum()
    assert len(images.phash(base)) == 8 and distance <= 6
    assert images.to_npy(None) is None and images.from_npy(None) is None
    with pytest.raises(ValueError, match="PNG"):
        images.from_png(b"x")


def test_extractors():
    assert extract.decoded(b"\xef\xbb\xbfx") == "x" and extract.decoded("ä".encode("cp1252")) == "ä" and extract.decoded("ä".encode("utf-16")) == "ä"
    page = "<div>out</div><div role=main><h1>A<a class='headerlink'>#</a></h1><style>s</style>in</div>"
    assert extract.html_text(page)[0] == "A\nin" and extract.html_text("")[0] == ""
    assert xmp.flat(None) is None and xmp.flat(b"none") == {} and xmp.flat(b"<x:xmpmeta><broken></x:xmpmeta>") is None


def test_streams(spark, tree, tmp_path):
    target, check = str(tmp_path / "out"), str(tmp_path / "check")
    assert streams.ingest_available(spark, str(tree), "pool", target, check).awaitTermination(120)
    first = spark.read.parquet(target).count()
    (tree / "new.txt").write_bytes(b"new")
    assert streams.ingest_available(spark, str(tree), "pool", target, check).awaitTermination(120)
    rows = spark.read.parquet(target)
    assert rows.count() == first + 1 and rows.where("path = 'new.txt' and pool = 'pool' and fsize = 3").count() == 1
    seen = []
    query = streams.work_queue(streams.file_stream(spark, str(tree)), lambda b: b.where("path like '%/a.txt'"), lambda b, n: seen.extend(r["path"] for r in b.collect()), str(tmp_path / "queue"))
    assert query.awaitTermination(120) and len(seen) == 1
