"""Queries of the engine's own operators over the archive's tables, and SQL with the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filequarry.config import DOCUMENTS, PICTURES, VIDEOS
from filequarry.functions import records, text, vectors
from filequarry.functions.stemming import stem
from filequarry.operators import ingest, pictures, search, store
from filequarry.session import table
from filequarry.sources import extract

POOL = "mobil_eingang"
WANTED = "der und"
SEARCHED = "Aufnahmen Vereinsbrief"
SEARCHED_WORDS = "der pdf"
DOCROOT = "/ablage/"


def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    return search.similar_to(rows, "vec_id", "embedding", 0).select("vec_id", F.round("sim", 4).alias("sim"))


def cosine_topk_pictures(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "dino_v2_vectors")
    first = rows.agg(F.min("pic_id")).first()[0]
    return search.similar_to(rows, "pic_id", "vector", first).select("pic_id", F.round("sim", 4).alias("sim"))


def cosine_all(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    query = rows.where("vec_id = 1").select("embedding").first()[0]
    return search.cosine_scores(rows, "vec_id", "embedding", list(query)).select("vec_id", F.round("sim", 4).alias("sim"))


def hamming_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", vectors.sign_bits(F.col("embedding")).alias("bits"))
    query = rows.where("vec_id = 0").first()["bits"]
    return search.hamming_topk(rows, "vec_id", F.col("bits"), query)


def phash_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pictures").where("phash is not null")
    query = rows.orderBy("id").select(vectors.hash_bits(F.col("phash")).alias("b")).first()[0]
    return search.hamming_topk(rows, "id", vectors.hash_bits(F.col("phash")), query)


def filemeta_project(spark: SparkSession, d: str) -> DataFrame:
    meta, path = F.col("meta_data"), F.col("path")
    return table(spark, d, "filemeta").select(
        "id", "pool", "path", records.basename(path).alias("fname"), records.suffix(path).alias("suffix"), records.ftype(records.suffix(path)).alias("ftype"),
        records.sort_date_of_file(meta, F.col("fdate")).alias("sort_date"), "fdate", "fsize", records.content_length(meta).alias("clength"), records.content_type(meta).alias("ctype"),
        F.array_join(records.meta_keys(meta), ",").alias("md_keys"), F.lower(F.hex("sha256")).alias("sha256_hex"),
    )


def doc_record(spark: SparkSession, d: str) -> DataFrame:
    meta = F.col("meta_data")
    return table(spark, d, "dbdoc").select("id", "path", records.sort_date_of_document(meta).alias("sort_date"), records.content_type(meta).alias("ctype"), F.length(F.coalesce("inhalt", F.lit(""))).cast("bigint").alias("n_chars"))


def ftype_classify(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "filemeta").groupBy("pool", records.ftype(F.col("suffix")).alias("ftype")).agg(F.count("*").alias("files"), F.sum("fsize").alias("bytes"))


def path_basename_suffix(spark: SparkSession, d: str) -> DataFrame:
    path = F.col("path")
    return table(spark, d, "documents").select("doc_id", records.basename(path).alias("fname"), records.suffix(path).alias("suffix"))


def relative_paths(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "filemeta").select("id", F.concat(F.lit(DOCROOT), "pool", F.lit("/"), "path").alias("file"))
    return rows.select("id", records.relative_path(F.col("file"), DOCROOT).alias("below"), records.relative_path(F.col("file"), DOCROOT, everywhere=True).alias("replaced"))


def sha256_hex(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.lower(F.hex(records.sha256(F.col("text")))).alias("sha256_hex"))


def meta_default_first(spark: SparkSession, d: str) -> DataFrame:
    meta = F.col("meta_data")
    return table(spark, d, "filemeta").select("id", records.content_type(meta).alias("ctype"), records.content_length(meta).alias("clength"), records.meta_value(meta, "dcterms:created").alias("created"))


def md_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.array_join(records.meta_keys(F.col("props")), ",").alias("md_keys"))


def nul_scrub(spark: SparkSession, d: str) -> DataFrame:
    joined = F.concat("fname", F.lit("\x00"), "suffix")
    return table(spark, d, "filemeta").select("id", records.nul_scrubbed(joined).alias("scrubbed"))


def json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    value = F.to_json(F.try_parse_json("props"))
    return table(spark, d, "events").select("event_id", F.get_json_object(value, "$.k").alias("k"))


def iso_dates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "filemeta").select("id", F.date_format("fdate", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), F.left(F.concat("fname", "path"), F.lit(20)).alias("head"))


def pool_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "filemeta").where(F.col("pool") == POOL).select("id", "path", "fsize")


def todo_no_thumb(spark: SparkSession, d: str) -> DataFrame:
    return ingest.without_thumbnail(table(spark, d, "pictures"), DOCROOT)


def todo_no_heic(spark: SparkSession, d: str) -> DataFrame:
    return ingest.without_thumbnail(table(spark, d, "pictures"), DOCROOT, heic=False)


def has_thumb(spark: SparkSession, d: str) -> DataFrame:
    """Pictures that have a thumbnail after an update which gives one (their hash stands for it) to those with a vector."""
    rows, vectors_ = table(spark, d, "pictures"), table(spark, d, "dino_v2_vectors").select(F.col("pic_id").alias("id"))
    changes = rows.join(vectors_, "id", "left_semi").select("id", F.col("phash").alias("thumbarray"))
    updated = store.update_keyed(rows.select("id", "thumbarray"), changes, "id", ["thumbarray"])
    return updated.where("thumbarray is not null").select("id", F.octet_length("thumbarray").cast("bigint").alias("bytes"))


def has_phash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pictures").where("phash is not null").select("id", F.lower(F.hex("phash")).alias("phash_hex"))


def pics_from_meta(spark: SparkSession, d: str) -> DataFrame:
    return ingest.pictures_of(table(spark, d, "filemeta").where(F.col("pool") == POOL)).select("id", "path", "suffix", "fsize")


def missing_pics_anti(spark: SparkSession, d: str) -> DataFrame:
    return ingest.missing_pictures(table(spark, d, "filemeta"), table(spark, d, "pictures")).select("id", "path")


def error_minus_done(spark: SparkSession, d: str) -> DataFrame:
    failed = table(spark, d, "pictures").where("phash is null").select("id")
    done = table(spark, d, "dino_v2_vectors").select(F.col("pic_id").alias("id"))
    return pictures.delivered(failed, done)


def hash_lookup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "filemeta")
    wanted = rows.where("sha256 is not null").orderBy("id").select("sha256").first()
    return rows.where(F.col("sha256") == F.lit(bytes(wanted[0]) if wanted else b"")).select("id", "path")


def insert_unique(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "filemeta").select("path", "id", "pool")
    old, new = rows.where(F.col("pool") != POOL), rows.where(F.col("pool") == POOL)
    return old.unionByName(store.only_new(old, new, ["path"]))


def update_keyed(spark: SparkSession, d: str) -> DataFrame:
    changes = table(spark, d, "dino_v2_vectors").select(F.col("pic_id").alias("id"), F.lit(False).alias("truncated"))
    return store.update_keyed(table(spark, d, "pictures").select("id", "truncated"), changes, "id", ["truncated"])


def vector_join_pic(spark: SparkSession, d: str) -> DataFrame:
    v, p = table(spark, d, "dino_v2_vectors"), table(spark, d, "pictures")
    return v.join(p, v.pic_id == p.id).select("pic_id", "path", F.size("vector").cast("bigint").alias("dims"))


def chunk_join_doc(spark: SparkSession, d: str) -> DataFrame:
    c, o = table(spark, d, "doc_vectors"), table(spark, d, "dbdoc")
    return c.join(o, c.doc_id == o.id).select("chunk_id", "doc_id", "fname", F.length("content").cast("bigint").alias("n_chars"))


def dangling_references(spark: SparkSession, d: str) -> DataFrame:
    """Chunks whose document would be missing if a pool's documents were dropped."""
    c, o = table(spark, d, "doc_vectors"), table(spark, d, "dbdoc").where(F.col("pool") != POOL)
    return c.join(o, c.doc_id == o.id, "left_anti").select("chunk_id", "doc_id")


def assigned_ids(spark: SparkSession, d: str) -> DataFrame:
    """Keys without gaps in the order of paths, as the store gives them to new rows; the old key stands in for the further columns."""
    rows = table(spark, d, "filemeta").select(F.col("id").alias("old_id"), "path")
    return store.dense_ids(rows, ["path", "old_id"])


def sort_by_date(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "filemeta").orderBy(F.desc("sort_date"), "id").select("id", "sort_date").limit(100)


def sort_by_date_all(spark: SparkSession, d: str) -> DataFrame:
    """Every row; sort_by_date is its first 100."""
    return table(spark, d, "filemeta").orderBy(F.desc("sort_date"), "id").select("id", "sort_date")


def tsvector_tokens(spark: SparkSession, d: str) -> DataFrame:
    words = text.tokens(records.search_text(F.col("fname"), F.col("inhalt")))
    return table(spark, d, "dbdoc").select("id", words.alias("w")).select("id", F.size("w").cast("bigint").alias("words"), F.size(F.array_distinct("w")).cast("bigint").alias("lexemes"))


def fulltext_all_terms(spark: SparkSession, d: str) -> DataFrame:
    rows = text.with_lexemes(table(spark, d, "dbdoc").select("id", "fname", "inhalt"), None)
    return rows.where(text.matches(F.col("lexemes"), text.query_lexemes(spark, WANTED, None))).select("id")


def fulltext_index(spark: SparkSession, d: str) -> DataFrame:
    rows = text.with_lexemes(table(spark, d, "dbdoc").select("id", "fname", "inhalt"), None)
    return text.search_index(text.inverted_index(rows), text.query_lexemes(spark, WANTED, None))


def fulltext_german(spark: SparkSession, d: str) -> DataFrame:
    return text.tsquery(table(spark, d, "dbdoc").drop("lexemes"), SEARCHED).select("id", "path")


def german_stem(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("lang = 'de'").select(F.explode(text.tokens(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return rows.select("word", "n", F.pandas_udf(lambda ws: ws.map(stem), "string")("word").alias("stem"))


def html_text(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "documents").where(F.startswith("ctype", F.lit("text/html")))
    page = F.concat(F.lit("<html><head><title>"), "path", F.lit("</title><style>x{}</style></head><body><p>"), F.regexp_replace(F.regexp_replace("text", "&", "&amp;"), "<", "&lt;"), F.lit("</p></body></html>"))
    return pages.select("doc_id", extract.html_column(page).alias("text"))


def title_search(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "filemeta").select("id", search.title_score(F.col("fname"), "anlage").alias("score"))
    return rows.where("score is not null")


def object_search(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "filemeta").select("id", search.object_score(F.col("fname"), F.pmod("id", F.lit(3)), "html").alias("score"))
    return rows.where("score is not null")


def ranked_search(spark: SparkSession, d: str) -> DataFrame:
    return search.ranked_search(table(spark, d, "dbdoc"), SEARCHED)


def ranked_words(spark: SparkSession, d: str) -> DataFrame:
    """Ranked search by words as they are, without stems."""
    return search.ranked_search(table(spark, d, "dbdoc"), SEARCHED_WORDS, stemmed=False)


def snippets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", search.snippet(F.col("text"), ["straße"]).alias("snippet"))


def xmp_ratings(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pictures").where("xmp is not null").select(F.try_element_at("xmp", F.lit("xmp:Rating")).alias("rating"))
    return rows.groupBy("rating").agg(F.count("*").alias("pictures"))


_ALL = (
    cosine_topk, cosine_topk_pictures, cosine_all, hamming_topk, phash_topk, filemeta_project, doc_record, ftype_classify, path_basename_suffix, relative_paths, sha256_hex, meta_default_first, md_keys, nul_scrub,
    json_round_trip, iso_dates, pool_filter, todo_no_thumb, todo_no_heic, has_thumb, has_phash, pics_from_meta, missing_pics_anti, error_minus_done, hash_lookup, insert_unique, update_keyed, vector_join_pic,
    chunk_join_doc, dangling_references, sort_by_date, sort_by_date_all, tsvector_tokens, fulltext_all_terms, fulltext_index, fulltext_german, german_stem, html_text, title_search, object_search, ranked_search, ranked_words, snippets, xmp_ratings, assigned_ids,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}


def _cosine(vector: str, query: str) -> str:
    a, b = f"list_transform({vector}, lambda x: CAST(x AS DOUBLE))", f"list_transform({query}, lambda x: CAST(x AS DOUBLE))"
    return f"CASE WHEN list_sum(list_transform({a}, lambda x: x * x)) = 0 OR list_sum(list_transform({b}, lambda x: x * x)) = 0 THEN 0.0 ELSE list_cosine_similarity({a}, {b}) END"


def _in(suffixes: tuple[str, ...]) -> str:
    return ", ".join(f"'{s}'" for s in suffixes)


_FTYPE = f"CASE WHEN lower({{0}}) IN ({_in(DOCUMENTS)}) THEN 'doc' WHEN lower({{0}}) IN ({_in(PICTURES)}) THEN 'pic' WHEN lower({{0}}) IN ({_in(VIDEOS)}) THEN 'vid' END"
_BASE = r"regexp_extract({0}, '([^/]*)\z', 1, 's')"
_SUFFIX = r"regexp_extract(regexp_extract({0}, '([^/]*)\z', 1, 's'), '\A\.*[^.].*(\.[^.]*)\z', 1, 's')"
_META = "CASE json_type(meta_data, '$.\"{0}\"') WHEN 'ARRAY' THEN meta_data ->> '$.\"{0}\"[0]' ELSE meta_data ->> '$.\"{0}\"' END"
_CREATED = r"TRY_CAST(regexp_replace(trim(" + _META.format("dcterms:created") + r"), '\s*([Zz]|[+-]\d{2}:?\d{2})$', '') AS TIMESTAMP)"
_LENGTH = f"coalesce(TRY_CAST({_META.format('Content-Length')} AS BIGINT), 0)"
_TYPE = f"coalesce({_META.format('Content-Type')}, 'unk/unk')"
_WORDS = r"regexp_extract_all(lower(left(fname || ' ' || coalesce(inhalt, ''), 800000)), '[\p{L}\p{N}]+')"
_BITS = "list_transform(embedding[1:64], lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END)"
_DISTANCE = "CAST(list_sum(list_transform(list_zip({0}, {1}), lambda p: abs(p[1] - p[2]))) AS INT)"
_SPACE = r"[\s\p{Z}\x{85}\x{0B}\x{1C}-\x{1F}]"
_POINTS = "CASE WHEN list_contains(n, '{0}') THEN 15 WHEN list_contains(t, '{0}') THEN 5 WHEN len(list_filter(n, lambda x: contains(x, '{0}'))) > 0 THEN 7 WHEN len(list_filter(t, lambda x: contains(x, '{0}'))) > 0 THEN 2 END"

SQL = {
    "cosine_topk": f"SELECT vec_id, round({_cosine('embedding', '(SELECT embedding FROM embeddings WHERE vec_id = 0)')}, 4) AS sim FROM embeddings ORDER BY {_cosine('embedding', '(SELECT embedding FROM embeddings WHERE vec_id = 0)')} DESC, vec_id LIMIT 10",
    "cosine_topk_pictures": f"WITH q AS (SELECT vector AS q FROM dino_v2_vectors ORDER BY pic_id LIMIT 1), s AS (SELECT pic_id, {_cosine('vector', 'q')} AS sim FROM dino_v2_vectors, q) SELECT pic_id, round(sim, 4) AS sim FROM s ORDER BY s.sim DESC, pic_id LIMIT 10",
    "cosine_all": f"SELECT e.vec_id, round({_cosine('e.embedding', 'q.embedding')}, 4) AS sim FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 1) q",
    "hamming_topk": f"WITH b AS (SELECT vec_id, {_BITS} AS bits FROM embeddings), q AS (SELECT bits AS q FROM b WHERE vec_id = 0) SELECT vec_id, {_DISTANCE.format('bits', 'q')} AS distance FROM b, q ORDER BY distance, vec_id LIMIT 10",
    "filemeta_project": f"SELECT id, pool, path, {_BASE.format('path')} AS fname, {_SUFFIX.format('path')} AS suffix, {_FTYPE.format(_SUFFIX.format('path'))} AS ftype, coalesce({_CREATED}, fdate) AS sort_date, fdate, fsize, {_LENGTH} AS clength, {_TYPE} AS ctype, coalesce(array_to_string(json_keys(meta_data), ','), '') AS md_keys, lower(hex(sha256)) AS sha256_hex FROM filemeta",
    "doc_record": f"SELECT id, path, coalesce({_CREATED}, TIMESTAMP '1990-01-01') AS sort_date, {_TYPE} AS ctype, length(coalesce(inhalt, '')) AS n_chars FROM dbdoc",
    "ftype_classify": f"SELECT pool, {_FTYPE.format('suffix')} AS ftype, count(*) AS files, CAST(sum(fsize) AS BIGINT) AS bytes FROM filemeta GROUP BY 1, 2",
    "path_basename_suffix": f"SELECT doc_id, {_BASE.format('path')} AS fname, {_SUFFIX.format('path')} AS suffix FROM documents",
    "relative_paths": f"SELECT id, pool || '/' || path AS below, replace('{DOCROOT}' || pool || '/' || path, '{DOCROOT}', '') AS replaced FROM filemeta",
    "sha256_hex": "SELECT doc_id, sha256(text) AS sha256_hex FROM documents",
    "meta_default_first": f"SELECT id, {_TYPE} AS ctype, {_LENGTH} AS clength, {_META.format('dcterms:created')} AS created FROM filemeta",
    "md_keys": "SELECT event_id, coalesce(array_to_string(json_keys(props), ','), '') AS md_keys FROM events",
    "nul_scrub": "SELECT id, fname || 'null' || suffix AS scrubbed FROM filemeta",
    "json_round_trip": "SELECT event_id, props ->> '$.k' AS k FROM events",
    "iso_dates": "SELECT id, strftime(fdate, '%Y-%m-%dT%H:%M:%S') AS iso, left(fname || path, 20) AS head FROM filemeta",
    "pool_filter": f"SELECT id, path, fsize FROM filemeta WHERE pool = '{POOL}'",
    "todo_no_thumb": f"SELECT '{DOCROOT}' || path AS file, id FROM pictures WHERE thumbarray IS NULL",
    "todo_no_heic": f"SELECT '{DOCROOT}' || path AS file, id FROM pictures WHERE thumbarray IS NULL AND suffix NOT IN ('.HEIC', '.heic')",
    "has_thumb": "SELECT id, octet_length(phash) AS bytes FROM pictures p WHERE phash IS NOT NULL AND EXISTS (SELECT 1 FROM dino_v2_vectors v WHERE v.pic_id = p.id)",
    "has_phash": "SELECT id, lower(hex(phash)) AS phash_hex FROM pictures WHERE phash IS NOT NULL",
    "pics_from_meta": f"SELECT id, path, suffix, fsize FROM filemeta WHERE pool = '{POOL}' AND lower(suffix) IN ({_in(PICTURES)})",
    "missing_pics_anti": f"SELECT id, path FROM filemeta f WHERE lower(suffix) IN ({_in(PICTURES)}) AND NOT EXISTS (SELECT 1 FROM pictures p WHERE p.id = f.id)",
    "error_minus_done": "SELECT id FROM pictures p WHERE phash IS NULL AND NOT EXISTS (SELECT 1 FROM dino_v2_vectors v WHERE v.pic_id = p.id)",
    "hash_lookup": "SELECT id, path FROM filemeta WHERE sha256 = (SELECT sha256 FROM filemeta WHERE sha256 IS NOT NULL ORDER BY id LIMIT 1)",
    "insert_unique": f"SELECT path, id, pool FROM filemeta WHERE pool <> '{POOL}' UNION ALL SELECT path, min(id), '{POOL}' FROM filemeta f WHERE pool = '{POOL}' AND NOT EXISTS (SELECT 1 FROM filemeta o WHERE o.pool <> '{POOL}' AND o.path = f.path) GROUP BY path",
    "update_keyed": "SELECT p.id, coalesce(CASE WHEN v.pic_id IS NOT NULL THEN false END, p.truncated) AS truncated FROM pictures p LEFT JOIN dino_v2_vectors v ON v.pic_id = p.id",
    "vector_join_pic": "SELECT pic_id, path, len(vector) AS dims FROM dino_v2_vectors v JOIN pictures p ON v.pic_id = p.id",
    "chunk_join_doc": "SELECT chunk_id, doc_id, fname, length(content) AS n_chars FROM doc_vectors c JOIN dbdoc d ON c.doc_id = d.id",
    "dangling_references": f"SELECT chunk_id, doc_id FROM doc_vectors c WHERE NOT EXISTS (SELECT 1 FROM dbdoc d WHERE d.id = c.doc_id AND d.pool <> '{POOL}')",
    "assigned_ids": "SELECT id AS old_id, path, row_number() OVER (ORDER BY path, id) AS id FROM filemeta",
    "html_text": f"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[ \\t]*\\n[ \\t]*', chr(10), 'g'), '\\n{_SPACE}*\\n+', chr(10), 'g'), '^{_SPACE}+|{_SPACE}+$', '', 'g') AS text FROM documents WHERE ctype LIKE 'text/html%'",
    "ranked_words": f"WITH w AS (SELECT id, regexp_extract_all(lower(fname), '[\\p{{L}}\\p{{N}}]+') AS n, regexp_extract_all(lower(coalesce(inhalt, '')), '[\\p{{L}}\\p{{N}}]+') AS t FROM dbdoc), p AS (SELECT id, {_POINTS.format('der')} AS a, {_POINTS.format('pdf')} AS b FROM w) SELECT id, greatest(a, b) AS score FROM p WHERE a IS NOT NULL AND b IS NOT NULL",
    "sort_by_date": "SELECT id, sort_date FROM filemeta ORDER BY sort_date DESC, id LIMIT 100",
    "sort_by_date_all": "SELECT id, sort_date FROM filemeta ORDER BY sort_date DESC, id",
    "tsvector_tokens": f"SELECT id, len({_WORDS}) AS words, len(list_distinct({_WORDS})) AS lexemes FROM dbdoc",
    "fulltext_all_terms": f"SELECT id FROM dbdoc WHERE list_has_all({_WORDS}, ['der', 'und'])",
    "fulltext_index": f"SELECT id FROM dbdoc WHERE list_has_all({_WORDS}, ['der', 'und'])",
    "title_search": "SELECT id, CAST(floor(6.0 / length(lower(trim(fname))) * 15 + 0.5) AS INT) + 1 AS score FROM filemeta WHERE instr(lower(trim(fname)), 'anlage') > 0 AND length(lower(trim(fname))) <= 12",
    "object_search": "SELECT id, CASE WHEN lower(fname) = 'html' OR split_part(lower(fname), '.', -1) = 'html' THEN 11 ELSE 6 END + CASE id % 3 WHEN 0 THEN 15 WHEN 1 THEN 5 ELSE -5 END AS score FROM filemeta WHERE lower(fname) = 'html' OR instr(split_part(lower(fname), '.', -1), 'html') > 0",
    "snippets": "WITH p AS (SELECT doc_id, text, greatest(instr(lower(text), 'straße') - 121, 0) AS start FROM documents WHERE text IS NOT NULL) SELECT doc_id, CASE WHEN start > 0 THEN '…' ELSE '' END || trim(substring(text, CAST(start AS INT) + 1, 240), ' ') || CASE WHEN length(text) > start + 240 THEN '…' ELSE '' END AS snippet FROM p",
    "xmp_ratings": "SELECT xmp['xmp:Rating'] AS rating, count(*) AS pictures FROM pictures WHERE xmp IS NOT NULL GROUP BY 1",
    "phash_topk": "WITH b AS (SELECT id, list_transform(range(0, 64), lambda i: CASE WHEN (('x' || hex(phash))[2 + i // 4] IN ('8','9','A','B','C','D','E','F') AND i % 4 = 0) OR (('x' || hex(phash))[2 + i // 4] IN ('4','5','6','7','C','D','E','F') AND i % 4 = 1) OR (('x' || hex(phash))[2 + i // 4] IN ('2','3','6','7','A','B','E','F') AND i % 4 = 2) OR (('x' || hex(phash))[2 + i // 4] IN ('1','3','5','7','9','B','D','F') AND i % 4 = 3) THEN 1 ELSE 0 END) AS bits FROM pictures WHERE phash IS NOT NULL), q AS (SELECT bits AS q FROM b ORDER BY id LIMIT 1) SELECT id, " + _DISTANCE.format("bits", "q") + " AS distance FROM b, q ORDER BY distance, id LIMIT 10",
}
