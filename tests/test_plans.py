import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from filequarry.plans import archive, problems
from filequarry.sources.tables import staged


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Small tables with the declared columns."""
    from datetime import datetime

    from filequarry import schema

    root, day = tmp_path_factory.mktemp("tables"), datetime(2024, 1, 1)
    row = (1, "mobil_eingang", "a/b.JPG", "b.JPG", ".JPG", day, day, 1, 1, "image/jpeg", ["k"], '{"k": 1}', b"h" * 32)
    rows = {"filemeta": [row], "pictures": [(*row, {"xmp:Rating": "3"}, None, None, b"\x01" * 8)], "dbdoc": [(*row, "Der Text und das Haus", None)], "dino_v2_vectors": [(1, [1.0, 0.0])], "doc_vectors": [(1, 1, "c", [1.0])]}
    for name, some in rows.items():
        spark.createDataFrame(some, schema.TABLES[name]).write.parquet(f"{root}/{name}.parquet")
    return str(root)


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_filters_and_columns_reach_the_scan(spark, folder):
    text = plan(archive.pool_filter(spark, folder))
    assert re.search(r"PushedFilters: \[.*EqualTo\(pool,mobil_eingang\)", text) and "ReadSchema: struct<id:bigint,pool:string,path:string,fsize:bigint>" in text
    text = plan(archive.todo_no_heic(spark, folder))
    assert "IsNull(thumbarray)" in text and "meta_data" not in text
    assert "TakeOrderedAndProject" in plan(archive.cosine_topk_pictures(spark, folder)) and "TakeOrderedAndProject" in plan(archive.sort_by_date(spark, folder))


def test_what_is_built_in_stays_in_the_jvm(spark, folder):
    for query in (archive.filemeta_project, archive.fulltext_all_terms, archive.vector_join_pic, archive.insert_unique, archive.update_keyed):
        assert not re.search(r"Python|Pandas|Arrow", plan(query(spark, folder)))


def test_bounded_ranks_are_limited_before_the_shuffle(spark):
    from filequarry.operators.store import only_new

    new = spark.range(100).select((F.col("id") % 3).cast("string").alias("path"), "id")
    assert "WindowGroupLimit" in plan(only_new(new.limit(0), new, ["path"]))


def test_small_tables_run_through_every_query(spark, folder):
    for name in ("filemeta_project", "doc_record", "ftype_classify", "phash_topk", "fulltext_german", "pics_from_meta", "hash_lookup", "xmp_ratings", "ranked_search"):
        assert archive.QUERIES[name](spark, folder).count() >= 0


def test_every_query_has_a_name_and_sql_only_for_queries():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and {"p4_found", "p5_found", "p6_found"} <= set(queries)
    assert set(archive.QUERIES).isdisjoint(problems.QUERIES)


def test_the_whole_table_is_sorted(spark, tmp_path):
    days = spark.range(250).select("id", F.timestamp_seconds(F.pmod(F.col("id") * 7919, F.lit(83)) * 86400).alias("sort_date"))
    days.write.parquet(f"{tmp_path}/filemeta.parquet")
    got = [(r["sort_date"], r["id"]) for r in archive.sort_by_date_all(spark, str(tmp_path)).collect()]
    assert len(got) == 250 and got == sorted(got, key=lambda r: (-r[0].timestamp(), r[1]))


def test_staging(spark, tmp_path):
    df = spark.range(5)
    assert staged(df, str(tmp_path)).count() == 5 and staged(df).count() == 5


def test_pixel_values():
    import numpy as np

    from filequarry.functions import images

    values = images.pixel_values(np.full((2, 224, 224, 3), 255, np.uint8))
    assert values.shape == (2, 3, 224, 224) and values.dtype == np.float32 and abs(values[0, 0, 5, 5] - (1 - 0.485) / 0.229) < 1e-5
