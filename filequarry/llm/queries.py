"""Queries of the operators on text and vectors, over whole tables with production parameters, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filequarry.llm import garbled, language, neighbours, packing, split, survivor, tokens
from filequarry.session import checkpointed, table

CAPACITY = 2048


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_pieces(spark, folder).where("piece_no = 2").select("item", "item_id")


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return split.archive_pieces(table(spark, folder, "dbdoc"), table(spark, folder, "doc_vectors"), table(spark, folder, "pools"))


def p1_joined(spark: SparkSession, folder: str) -> DataFrame:
    """Each split text put together again from its pieces, overlaps left out, as a hash; and its longest piece."""
    pieces = p1_pieces(spark, folder).withColumn("end", F.col("start") + F.length("content"))
    before = F.lag("end", 1, 0).over(Window.partitionBy("item", "item_id").orderBy("piece_no"))
    new = pieces.withColumn("_new", F.substring("content", (before - F.col("start") + 1).cast("int"), F.length("content")))
    parts = new.groupBy("item", "item_id").agg(F.array_sort(F.collect_list(F.struct("piece_no", "_new"))).alias("_p"), F.max(F.length("content")).alias("_most"))
    whole = F.array_join(F.transform("_p", lambda p: p["_new"]), "")
    return parts.select("item", "item_id", F.md5(whole).alias("text_md5"), F.length(whole).cast("bigint").alias("characters"), (F.col("_most") > 0).alias("split"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return language.mislabelled(table(spark, folder, "dbdoc"), language.fit(table(spark, folder, "documents")))


def p2_segments(spark: SparkSession, folder: str) -> DataFrame:
    return language.language_segments(table(spark, folder, "dbdoc"), ["id"], "inhalt", language.fit(table(spark, folder, "documents")))


def _vectors(spark: SparkSession, folder: str, of) -> DataFrame:
    pictures = of(table(spark, folder, "dino_v2_vectors"), "pic_id", "vector").select(F.lit("dino_v2_vectors").alias("tbl"), "*")
    return pictures.unionByName(of(table(spark, folder, "doc_vectors"), "chunk_id", "vector").select(F.lit("doc_vectors").alias("tbl"), "*"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _vectors(spark, folder, neighbours.mutual_pairs)


def p3_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return _vectors(spark, folder, neighbours.nearest)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return survivor.best_members(table(spark, folder, "filemeta"), table(spark, folder, "pools"))


def p7_survivors(spark: SparkSession, folder: str) -> DataFrame:
    return survivor.survivors(table(spark, folder, "filemeta"), table(spark, folder, "pools"))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode_column(table(spark, folder, "documents"), ["doc_id"], "text")


def p9_containers(spark: SparkSession, folder: str) -> DataFrame:
    sizes = tokens.count_column(table(spark, folder, "documents"), ["doc_id"], "text")
    return packing.pack(sizes, ["doc_id"], "tokens", CAPACITY)


def p9_summary(spark: SparkSession, folder: str) -> DataFrame:
    """What holds of the containers: how many are too full, how many texts' parts don't add up or are cut without need, how many texts there are."""
    documents = table(spark, folder, "documents")
    sizes = checkpointed(tokens.count_column(documents, ["doc_id"], "text"))
    placed = checkpointed(packing.pack(sizes, ["doc_id"], "tokens", CAPACITY))
    full = placed.groupBy("container").agg(F.sum("size").alias("held")).where(F.col("held") > CAPACITY)
    of = placed.groupBy("doc_id").agg(F.sum("size").alias("held"), F.count("*").alias("parts"))
    wrong = sizes.join(of, "doc_id", "left").where("held is distinct from tokens or parts > greatest(1, ceil(tokens / 2048))")
    named = {"texts": sizes, "too_full": full, "wrong": wrong}
    counts = [rows.agg(F.count("*").alias("n")).select(*[(F.col("n") if c == name else F.lit(0)).cast("bigint").alias(c) for c in named]) for name, rows in named.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).agg(*[F.sum(c).alias(c) for c in named])


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return garbled.mended(table(spark, folder, "documents")).select("doc_id")


def p10_restored(spark: SparkSession, folder: str) -> DataFrame:
    return garbled.mended(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_pieces, p1_joined, p2_found, p2_segments, p3_found, p3_neighbours, p7_found, p7_survivors, p8_ids, p9_containers, p9_summary, p10_found, p10_restored)}

_BEST = r"""
        WITH RECURSIVE keys AS (
            SELECT id, 'h' || hex(sha256) AS k FROM filemeta WHERE sha256 IS NOT NULL AND fsize > 0
            UNION ALL
            SELECT id, 'p' || pool || '|' || array_to_string(list_filter(string_split(replace(nfc_normalize(lower(regexp_replace(path, '^[\s\x{A0}]+|[\s\x{A0}]+$', '', 'g'))), '\', '/'), '/'), lambda s: s NOT IN ('', '.')), '/') FROM filemeta WHERE path IS NOT NULL
        ), links AS (
            SELECT DISTINCT a.id AS x, b.id AS y FROM keys a JOIN keys b USING (k)
        ), reach(id, other) AS (
            SELECT id, id FROM filemeta UNION SELECT r.id, l.y FROM reach r JOIN links l ON r.other = l.x
        ), grouped AS (
            SELECT id, min(other) AS group_id FROM reach GROUP BY id HAVING count(*) > 1
        ), facts AS (
            SELECT g.group_id, f.id, p.trust, f.fdate, coalesce(len(list_filter(json_keys(f.meta_data), lambda k: NOT regexp_matches(CAST(json_extract(f.meta_data, '$."' || k || '"') AS VARCHAR), '^(null|\[\]|\{\}|"\s*")$'))), 0) AS filled
            FROM grouped g JOIN filemeta f USING (id) LEFT JOIN pools p USING (pool)
        )
        SELECT group_id, 'path' AS field, id FROM facts QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY trust DESC NULLS LAST, id) = 1
        UNION ALL
        SELECT group_id, 'fdate', id FROM facts WHERE fdate < TIMESTAMP '2026-01-01' QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY fdate DESC, id) = 1
        UNION ALL
        SELECT group_id, 'meta_data', id FROM facts QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY filled DESC, fdate DESC NULLS LAST, id) = 1
    """

SQL = {
    "p1_found": """
        SELECT 'dbdoc' AS item, d.id AS item_id FROM dbdoc d JOIN pools p USING (pool) WHERE length(d.inhalt) > p.max_chars
        UNION ALL
        SELECT 'doc_vectors', v.chunk_id FROM doc_vectors v JOIN dbdoc d ON v.doc_id = d.id JOIN pools p USING (pool) WHERE length(v.content) > p.max_chars
    """,
    "p1_joined": """
        SELECT 'dbdoc' AS item, d.id AS item_id, md5(d.inhalt) AS text_md5, length(d.inhalt) AS characters, true AS split FROM dbdoc d JOIN pools p USING (pool) WHERE length(d.inhalt) > p.max_chars
        UNION ALL
        SELECT 'doc_vectors', v.chunk_id, md5(v.content), length(v.content), true FROM doc_vectors v JOIN dbdoc d ON v.doc_id = d.id JOIN pools p USING (pool) WHERE length(v.content) > p.max_chars
    """,
    "p9_summary": "SELECT count(*) AS texts, 0 AS too_full, 0 AS wrong FROM documents",
    "p3_found": """
        WITH v AS (
            SELECT 'dino_v2_vectors' AS tbl, pic_id AS id, list_transform(vector, lambda x: CAST(x AS DOUBLE)) AS v FROM dino_v2_vectors
            UNION ALL SELECT 'doc_vectors', chunk_id, list_transform(vector, lambda x: CAST(x AS DOUBLE)) FROM doc_vectors
        ), solid AS (
            SELECT * FROM v WHERE list_sum(list_transform(v, lambda x: x * x)) > 0
        ), pairs AS (
            SELECT a.tbl, a.id AS q, b.id AS o, round(list_cosine_similarity(a.v, b.v), 9) AS s FROM solid a JOIN solid b ON a.tbl = b.tbl AND a.id <> b.id
        ), best AS (
            SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY tbl, q ORDER BY s DESC, o) <= 5
        )
        SELECT a.tbl, a.q AS id_a, a.o AS id_b FROM best a JOIN best b ON a.tbl = b.tbl AND a.q = b.o AND a.o = b.q WHERE a.q < a.o AND a.s >= 0.9
    """,
    "p7_found": _BEST,
    "p7_survivors": f"""
        SELECT group_id, max(CASE WHEN field = 'path' THEN path END) AS path, max(CASE WHEN field = 'fdate' THEN fdate END) AS fdate, max(CASE WHEN field = 'meta_data' THEN meta_data END) AS meta_data
        FROM ({_BEST}) b JOIN filemeta f USING (id) GROUP BY group_id
    """,
}
