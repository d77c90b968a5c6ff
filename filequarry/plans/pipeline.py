"""Queries that run the steps of the pipeline over the archive's tables: extraction, XMP, stores, stored words, streams; and SQL with the same results."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filequarry.functions import images, records, text, vectors
from filequarry.operators import ingest, search
from filequarry.operators.store import Store
from filequarry.session import shared_folder, table
from filequarry.sources import extract, tables, xmp
from filequarry.streaming import crawl as streams

WANTED = "und der"
_PACKET = '<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description xmlns:{p}="{uri}" {k}="'


def _store(spark: SparkSession) -> Store:
    made = Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    made._files.deleteOnExit(made._path(made.root))
    made.create_all()
    return made


def extracted_text(spark: SparkSession, d: str) -> DataFrame:
    """Documents as text files, of which every seventh has a type that can't be read: text, length and error as extraction gives them."""
    suffix = F.when(F.pmod("doc_id", F.lit(7)) == 0, ".docx").otherwise(".txt")
    files = table(spark, d, "documents").where("text is not null").select("doc_id", "path", suffix.alias("suffix"), F.encode("text", "utf-8").alias("content"), F.lit(None).cast("string").alias("error"))
    meta = F.col("meta_data")
    return extract.extracted(files).select("doc_id", F.md5("page_content").alias("text_md5"), records.content_length(meta).alias("clength"), records.content_type(meta).alias("ctype"), F.col("error").isNotNull().alias("failed"))


def xmp_packets(spark: SparkSession, d: str) -> DataFrame:
    """The ratings of pictures written as XMP packets and read again."""
    start = _PACKET.format(p="xmp", uri="http://ns.adobe.com/xap/1.0/", k="xmp:Rating")
    rated = table(spark, d, "pictures").where(F.try_element_at("xmp", F.lit("xmp:Rating")).isNotNull())
    packet = F.concat(F.lit("file " + start), F.element_at("xmp", F.lit("xmp:Rating")), F.lit('"/></rdf:RDF></x:xmpmeta> end')).cast("binary")
    return rated.select("id", F.element_at(xmp.xmp(packet), F.lit("xmp:Rating")).alias("rating"))


def store_insert(spark: SparkSession, d: str) -> DataFrame:
    """File records put into a new store in two parts, each path once; keys count on in the order of paths."""
    made, rows = _store(spark), table(spark, d, "filemeta").drop("id")
    made.insert_new("filemeta", rows.where("path < 'm'"))
    made.insert_new("filemeta", rows)
    return made.read("filemeta").select("id", "path", "pool")


def store_update(spark: SparkSession, d: str) -> DataFrame:
    """Pictures in a new store, whose hash an update gives to their thumbnail."""
    made, rows = _store(spark), table(spark, d, "pictures").dropDuplicates(["path"]).select("*")
    rows = rows.join(table(spark, d, "pictures").groupBy("path").agg(F.min("id").alias("_id")), "path").withColumn("id", F.col("_id")).drop("_id")
    made.append("pictures", rows.select("id", "pool", "path", "fname", "suffix", "sort_date", "fdate", "fsize", "clength", "ctype"))
    changes = table(spark, d, "pictures").where("phash is not null").select("id", F.col("phash").alias("thumbarray"))
    made.update("pictures", changes, ["thumbarray"])
    return made.read("pictures").select("id", "path", F.lower(F.hex("thumbarray")).alias("thumb_hex"))


def store_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors put into a new store after the pictures that they refer to, read back with their length."""
    made = _store(spark)
    known = table(spark, d, "dino_v2_vectors").join(table(spark, d, "pictures").select(F.col("id").alias("pic_id")), "pic_id", "left_semi")
    pictures = known.select(F.col("pic_id").alias("id"), F.lit("p").alias("pool"), F.col("pic_id").cast("string").alias("path"), F.lit("f").alias("fname"), F.lit("").alias("suffix"), F.lit(0).cast("bigint").alias("fsize"))
    day = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    made.append("pictures", pictures.select("*", day.alias("sort_date"), day.alias("fdate"), F.lit(0).cast("bigint").alias("clength"), F.lit("t").alias("ctype")))
    made.append("dino_v2_vectors", known)
    return made.read("dino_v2_vectors").select("pic_id", F.size("vector").cast("bigint").alias("dims"), F.round(vectors.norm(F.col("vector")), 4).alias("norm"))


def staged_rows(spark: SparkSession, d: str) -> DataFrame:
    """A table staged in the shared folder and read back."""
    return tables.staged(table(spark, d, "filemeta").select("id", "fname", "fsize"), f"{shared_folder(spark)}/staged")


def stored_lexemes(spark: SparkSession, d: str) -> DataFrame:
    """The words that a writer stores for search, without stems, as one sorted text's hash."""
    rows = text.with_lexemes(table(spark, d, "dbdoc").select("id", "fname", "inhalt"), None)
    return rows.select("id", F.md5(F.array_join(F.array_sort("lexemes"), " ")).alias("words_md5"))


def tsquery_words(spark: SparkSession, d: str) -> DataFrame:
    """Full-text search where half of the documents have stored words and the others null ones."""
    docs = table(spark, d, "dbdoc").select("id", "path", "fname", "inhalt")
    half = text.with_lexemes(docs, None).withColumn("lexemes", F.when(F.pmod("id", F.lit(2)) == 0, F.col("lexemes")))
    return text.tsquery(half, WANTED, None).select("id", "path")


def best_hits(spark: SparkSession, d: str) -> DataFrame:
    """Hits of a title search and an object search brought together, the best of each record; place is their order by score, then name, then key."""
    rows = table(spark, d, "filemeta").select("id", "fname")
    titles = rows.select("id", "fname", search.title_score(F.col("fname"), "anlage").alias("score"))
    objects = rows.select("id", "fname", search.object_score(F.col("fname"), F.pmod("id", F.lit(3)), "html").alias("score"))
    hits = titles.unionByName(objects).where("score is not null")
    from filequarry.operators.store import dense_ids

    best = search.best_hits(hits, title="fname").select("id", "score", (-F.col("score")).alias("_s"), F.lower("fname").alias("_n"))
    return dense_ids(best, ["_s", "_n", "id"], "place").select("place", "id", "score")


def cosine_top3(spark: SparkSession, d: str) -> DataFrame:
    """The three most similar other rows."""
    return search.similar_to(table(spark, d, "embeddings"), "vec_id", "embedding", 5, k=3, include_self=False).select("vec_id", F.round("sim", 4).alias("sim"))


def arrivals(spark: SparkSession, d: str) -> DataFrame:
    """What the stream of sightings counts a day and pool, over all that has arrived."""
    return streams.arrivals_by_window(table(spark, d, "crawl_records"))


def record_stream_columns(spark: SparkSession, d: str) -> DataFrame:
    """The columns that the stream of files derives, over documents as files."""
    docs = table(spark, d, "documents").where("text is not null")
    files = docs.select(F.concat(F.lit("file:/ablage/"), "path").alias("path"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("modificationTime"), F.octet_length("text").cast("bigint").alias("length"), F.encode("text", "utf-8").alias("content"))
    rows = streams.record_stream(files, "/ablage", "pool")
    return rows.select("pool", "path", "fname", "suffix", "fsize", F.lower(F.hex("sha256")).alias("sha256_hex"))


def pictures_with_xmp(spark: SparkSession, d: str) -> DataFrame:
    """Picture records made from file records, with XMP read from their files, which hold the file's name as title."""
    files = table(spark, d, "filemeta").select("id", "path", "fname", "suffix", "fsize")
    start = _PACKET.format(p="dc", uri="http://purl.org/dc/elements/1.1/", k="dc:title")
    name = F.replace(F.replace(F.replace("fname", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    contents = files.groupBy("path").agg(F.min("fname").alias("fname")).select(F.concat(F.lit("/ablage/"), "path").alias("path"), F.concat(F.lit(start), name, F.lit('"/></rdf:RDF></x:xmpmeta>')).cast("binary").alias("content"))
    tagged = ingest.with_xmp(ingest.pictures_of(files), contents, "/ablage/")
    return tagged.select("id", "path", F.element_at("xmp", F.lit("dc:title")).alias("title"))


def thumbnail_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Each picture's hash as an 8 x 8 image, through the PNG and npy codecs and back."""

    def run(hashes):
        import numpy as np

        def there_and_back(h):
            bits = np.unpackbits(np.frombuffer(bytes(h), np.uint8)).reshape(8, 8, 1).repeat(3, 2) * 255
            again = images.from_npy(images.to_npy(images.from_png(images.to_png(bits))))
            return np.packbits(again[:, :, 0].ravel() > 0).tobytes()

        return hashes.map(there_and_back)

    rows = table(spark, d, "pictures").where("octet_length(phash) = 8")
    return rows.select("id", F.lower(F.hex(F.pandas_udf(run, "binary")("phash"))).alias("phash_hex"))


_ALL = (
    extracted_text, xmp_packets, store_insert, store_update, store_vectors, staged_rows, stored_lexemes, tsquery_words, best_hits, cosine_top3, arrivals, record_stream_columns, pictures_with_xmp, thumbnail_round_trip,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

_LIST = r"regexp_extract_all(lower(left(fname || ' ' || coalesce(inhalt, ''), 800000)), '[\p{L}\p{N}]+')"
_BASE = r"regexp_extract(path, '([^/]*)\z', 1, 's')"
_PICTURE = "lower(suffix) IN ('.jpg', '.jpeg', '.bmp', '.png', '.heic', '.tiff', '.tif')"

SQL = {
    "extracted_text": """
        SELECT doc_id, md5(CASE WHEN doc_id % 7 = 0 THEN '' ELSE replace(CASE WHEN starts_with(text, chr(65279)) THEN substring(text, 2) ELSE text END, chr(0), 'null') END) AS text_md5,
            strlen(text) AS clength, CASE WHEN doc_id % 7 = 0 THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' ELSE 'text/plain' END AS ctype, doc_id % 7 = 0 AS failed
        FROM documents WHERE text IS NOT NULL
    """,
    "xmp_packets": "SELECT id, xmp['xmp:Rating'] AS rating FROM pictures WHERE xmp['xmp:Rating'] IS NOT NULL",
    "store_insert": """
        WITH first AS (
            SELECT DISTINCT path FROM filemeta WHERE path < 'm'
        ), numbered AS (
            SELECT path, row_number() OVER (ORDER BY path) AS id FROM first
            UNION ALL SELECT path, (SELECT count(*) FROM first) + row_number() OVER (ORDER BY path) FROM (SELECT DISTINCT path FROM filemeta WHERE NOT path < 'm')
        )
        SELECT n.id, n.path, min(f.pool) AS pool FROM numbered n JOIN filemeta f USING (path) GROUP BY n.id, n.path
    """,
    "store_update": "SELECT k.id, k.path, lower(hex(p.phash)) AS thumb_hex FROM (SELECT path, min(id) AS id FROM pictures GROUP BY path) k JOIN pictures p USING (id)",
    "store_vectors": "SELECT pic_id, len(vector) AS dims, round(sqrt(list_sum(list_transform(vector, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 4) AS norm FROM dino_v2_vectors v WHERE EXISTS (SELECT 1 FROM pictures p WHERE p.id = v.pic_id)",
    "staged_rows": "SELECT id, fname, fsize FROM filemeta",
    "stored_lexemes": f"SELECT id, md5(array_to_string(list_sort(list_distinct({_LIST})), ' ')) AS words_md5 FROM dbdoc",
    "tsquery_words": f"SELECT id, path FROM dbdoc WHERE list_has_all({_LIST}, ['und', 'der'])",
    "best_hits": """
        WITH hits AS (
            SELECT id, fname, CAST(floor(6.0 / length(lower(trim(fname))) * 15 + 0.5) AS INT) + 1 AS score FROM filemeta WHERE instr(lower(trim(fname)), 'anlage') > 0 AND length(lower(trim(fname))) <= 12
            UNION ALL
            SELECT id, fname, CASE WHEN lower(fname) = 'html' OR split_part(lower(fname), '.', -1) = 'html' THEN 11 ELSE 6 END + CASE id % 3 WHEN 0 THEN 15 WHEN 1 THEN 5 ELSE -5 END
            FROM filemeta WHERE lower(fname) = 'html' OR instr(split_part(lower(fname), '.', -1), 'html') > 0
        ), best AS (
            SELECT id, lower(fname) AS n, max(score) AS score FROM hits GROUP BY ALL
        )
        SELECT row_number() OVER (ORDER BY score DESC, n, id) AS place, id, score FROM best
    """,
    "cosine_top3": "WITH q AS (SELECT list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS q FROM embeddings WHERE vec_id = 5), s AS (SELECT vec_id, list_cosine_similarity(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), q) AS sim FROM embeddings, q WHERE vec_id <> 5) SELECT vec_id, round(sim, 4) AS sim FROM s ORDER BY s.sim DESC, vec_id LIMIT 3",
    "arrivals": 'SELECT CAST(date_trunc(\'day\', arrived_at) AS TIMESTAMP) AS start, pool, count(*) AS "rows" FROM crawl_records WHERE arrived_at IS NOT NULL GROUP BY 1, 2',
    "record_stream_columns": rf"SELECT 'pool' AS pool, path, {_BASE} AS fname, regexp_extract({_BASE}, '\A\.*[^.].*(\.[^.]*)\z', 1, 's') AS suffix, strlen(text) AS fsize, sha256(text) AS sha256_hex FROM documents WHERE text IS NOT NULL",
    "pictures_with_xmp": f"SELECT id, path, (SELECT min(o.fname) FROM filemeta o WHERE o.path = f.path) AS title FROM filemeta f WHERE {_PICTURE}",
    "thumbnail_round_trip": "SELECT id, lower(hex(phash)) AS phash_hex FROM pictures WHERE octet_length(phash) = 8",
}
