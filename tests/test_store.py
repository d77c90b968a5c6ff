from datetime import datetime

import pytest
from pyspark.sql import functions as F

from filequarry import schema
from filequarry.operators.store import ConstraintError, Store, dense_ids, only_new, update_keyed

DAY = datetime(2024, 1, 1)


def record(path, pool="a", **more):
    return {"pool": pool, "path": path, "fname": path, "suffix": "", "sort_date": DAY, "fdate": DAY, "fsize": 1, "clength": 1, "ctype": "t"} | more


@pytest.fixture
def store(spark, tmp_path):
    made = Store(spark, str(tmp_path / "store"))
    made.create_all()
    return made


def test_tables(store):
    assert all(store.exists(t) and store.read(t).count() == 0 for t in schema.TABLES)
    store.drop_table("photos")
    assert not store.exists("photos")
    store.create_table("photos")
    assert store.exists("photos")
    with pytest.raises(ValueError, match="confirm"):
        store.recreate_tables()
    with pytest.raises(KeyError):
        store.read("none")


def test_insert_and_constraints(store):
    assert store.bulk_insert("filemeta", [record("b"), record("a", "z")])
    assert {(r["id"], r["path"]) for r in store.read("filemeta").collect()} == {(1, "a"), (2, "b")}
    assert not store.bulk_insert("filemeta", [record("c"), record("a")])  # path taken: nothing is written
    assert not store.bulk_insert("filemeta", [record("d"), record("d")])
    assert not store.bulk_insert("filemeta", [record("e", pool=None)])
    assert store.read("filemeta").count() == 2
    assert store.bulk_insert("filemeta", [record("c")]) and store.read("filemeta").agg({"id": "max"}).first()[0] == 3
    with pytest.raises(ConstraintError, match="pictures"):
        store.append("dino_v2_vectors", store.spark.createDataFrame([(1, [0.0] * 1024)], schema.TABLES["dino_v2_vectors"]))
    store.insert_new("filemeta", store.spark.createDataFrame([(9, *record(p).values()) for p in ("c",)] + [(8, *record("x").values()), (7, *record("x").values())], "id bigint, pool string, path string, fname string, suffix string, sort_date timestamp_ntz, fdate timestamp_ntz, fsize bigint, clength bigint, ctype string"))
    assert {r["id"] for r in store.read("filemeta").where("path in ('c', 'x')").collect()} == {3, 7}
    store.recreate_tables(confirm=True)
    assert store.read("filemeta").count() == 0


def test_update(store):
    assert store.bulk_insert("pictures", [record("a", "one"), record("b", "two"), record("c", "two")])
    changes = store.spark.createDataFrame([(1, b"x"), (99, b"y"), (2, None)], "id bigint, thumbarray binary")
    store.update("pictures", changes, ["thumbarray"])
    assert {r["path"]: r["thumbarray"] and bytes(r["thumbarray"]) for r in store.read("pictures").collect()} == {"a": b"x", "b": None, "c": None}
    store.append("dino_v2_vectors", store.spark.createDataFrame([(1, [1.0] * 1024)], schema.TABLES["dino_v2_vectors"]))
    store.update("dino_v2_vectors", store.spark.createDataFrame([(1, [2.0] * 1024)], schema.TABLES["dino_v2_vectors"]), ["vector"])
    assert store.read("dino_v2_vectors").first()["vector"][0] == 2.0


def test_column_functions(spark):
    old = spark.createDataFrame([("a", 1)], "path string, n int")
    new = spark.createDataFrame([("a", 2), ("b", 5), ("b", 4), (None, 1)], "path string, n int")
    assert {tuple(r) for r in only_new(old, new, ["path"]).collect()} == {("b", 4), (None, 1)}
    changes = spark.createDataFrame([("a", 7), ("a", 9), ("q", 1)], "path string, n int")
    assert [tuple(r) for r in update_keyed(old, changes, "path", ["n"]).collect()] == [("a", 9)]
    assert update_keyed(old.limit(0), changes, "path", ["n"]).count() == 0


def test_ids_are_dense_whatever_the_partitions(spark):
    """Wide and narrow rows, adaptive execution on, as many partitions as Spark's default."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
        for width in (128, 3072):
            calls = spark.sparkContext.accumulator(0)

            def read(batches, width=width, calls=calls):
                for batch in batches:
                    calls.add(batch.num_rows)
                    yield batch

            paths = spark.range(60_000).select(F.sha2(F.col("id").cast("string"), 256).alias("path"), F.repeat(F.lit("x"), width).alias("wide"))
            rows = dense_ids(paths.mapInArrow(read, "path string, wide string"), ["path"], "id", 5)
            ranked = rows.select("id", "path").orderBy("path").collect()
            assert [r["id"] for r in ranked] == list(range(6, 60_006)) and calls.value == 60_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_ids_of_ties_nulls_and_nothing(spark):
    rows = spark.createDataFrame([("b", 1), (None, 2), ("a", 3), ("a", 4), ("a", 3)], "path string, n int")
    got = sorted((r["id"], r["path"], r["n"]) for r in dense_ids(rows, ["path", "n"]).collect())
    assert got == [(1, None, 2), (2, "a", 3), (3, "a", 3), (4, "a", 4), (5, "b", 1)]
    assert dense_ids(rows.limit(0), ["path"]).count() == 0


def test_an_update_that_was_cut_off_is_finished(store, monkeypatch):
    assert store.bulk_insert("pictures", [record("a", "one"), record("b", "two")])
    changes = store.spark.createDataFrame([(1, b"x"), (2, b"y")], "id bigint, thumbarray binary")
    with monkeypatch.context() as m:
        m.setattr(store, "_note", lambda *a: (_ for _ in ()).throw(RuntimeError))
        with pytest.raises(RuntimeError):  # before the journal stands nothing has changed
            store.update("pictures", changes, ["thumbarray"])
    store.recover()
    assert store.read("pictures").where("thumbarray is not null").count() == 0
    note = store._note

    def noted(draft, moves):
        note(draft, moves)
        source, target = moves[0]
        store._files.delete(store._path(target), True)  # cut off after a folder was put aside
        raise RuntimeError

    with monkeypatch.context() as m:
        m.setattr(store, "_note", noted)
        with pytest.raises(RuntimeError):
            store.update("pictures", changes, ["thumbarray"])
    again = Store(store.spark, store.root)
    again.recover()
    assert {r["path"]: bytes(r["thumbarray"]) for r in again.read("pictures").collect()} == {"a": b"x", "b": b"y"}


def test_lexemes_are_generated_on_insert_and_update(store):
    assert store.bulk_insert("dbdoc", [record("a") | {"inhalt": "Die Häuser"}])
    assert "haus" in store.read("dbdoc").first()["lexemes"]
    store.update("dbdoc", store.spark.createDataFrame([(1, "Ein Fluss")], "id bigint, inhalt string"), ["inhalt"])
    assert "fluss" in store.read("dbdoc").first()["lexemes"] and "haus" not in store.read("dbdoc").first()["lexemes"]
