import random
from datetime import datetime, timedelta

from filequarry.llm import survivor
from pyspark.sql import functions as F

SCHEMA = "id bigint, pool string, path string, fsize bigint, sha256 binary, fdate timestamp_ntz, meta_data string, trust int, _pool string"
DAY = datetime(2020, 1, 1)


def rows(*given):
    return [(i, pool, path, size, sha, DAY + timedelta(days=day) if day is not None else None, meta, 1, "x") for i, pool, path, size, sha, day, meta in given]


def pools(spark):
    return spark.createDataFrame([("a", 1), ("b", 9), (None, 99), ("b", 9)], "pool string, trust int")


def test_paths():
    same = ["Gärten/a.JPG", "gärten//a.jpg", "./GÄRTEN/./A.jpg ", "\tGärten\\x\\..\\a.jpg ", "/gärten/a.jpg"]
    assert len({survivor.plain_path(p) for p in same}) == 1
    assert survivor.plain_path(None) is None and survivor.plain_path(" ./ ") is None and survivor.plain_path("a (1).jpg") != survivor.plain_path("a.jpg")


def test_components_against_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(i, i + 1) for i in range(200, 260)] + [(300, i) for i in range(301, 380)] + [(5, 5), (None, 1)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r["node"]: r["component"] for r in survivor.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: root(x) for x in parent}
    assert survivor.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_best_members(spark):
    records = rows(
        (1, "a", "x/one.jpg", 5, b"h", 1, '{"k": 1}'), (2, "b", "y.jpg", 5, b"h", 2, '{"k": 1, "l": " ", "m": [], "n": null}'), (3, "a", "X\\ONE.JPG", 0, b"other", 9000, '{"k": 1, "l": 2}'),
        (4, "a", "empty", 0, b"e", 0, None), (5, "b", "empty too", 0, b"e", 0, None),  # empty files share a hash and nothing else
        (6, "a", "tie", 5, b"t", 3, "{}"), (7, "a", "tie2", 5, b"t", 3, None), (7, "a", "tie2", 5, b"t", 3, None),
        (8, "z", None, 5, b"late", 9000, None), (9, None, None, 5, b"late", None, None),
        (10, "a", "alone", 5, None, 1, "broken {"), (None, "a", "alone", 5, b"h", 1, None),
    )
    got = {(r["group_id"], r["field"]): r["id"] for r in survivor.best_members(spark.createDataFrame(records, SCHEMA), pools(spark)).collect()}
    assert got == {
        (1, "path"): 2, (1, "fdate"): 2, (1, "meta_data"): 3,
        (6, "path"): 6, (6, "fdate"): 6, (6, "meta_data"): 6,
        (8, "path"): 8, (8, "meta_data"): 8,
    }
    built = {r["group_id"]: r for r in survivor.survivors(spark.createDataFrame(records, SCHEMA), pools(spark)).collect()}
    assert built[1]["path"] == "y.jpg" and built[1]["fdate"] == DAY + timedelta(days=2) and built[1]["meta_data"] == '{"k": 1, "l": 2}' and built[8]["fdate"] is None
    empty = spark.createDataFrame([], SCHEMA)
    assert survivor.best_members(empty, pools(spark)).count() == 0


def test_a_hot_group(spark):
    records = rows(*[(i, "a", f"p{i}", 5, b"hot", i % 50, "{}") for i in range(1, 400)], (500, "a", "p7", 5, b"x", 60, None), (501, "b", "q", 5, b"x", 1, None))
    got = {r["field"]: r["id"] for r in survivor.best_members(spark.createDataFrame(records, SCHEMA).repartition(5), pools(spark)).collect()}
    assert got == {"path": 501, "fdate": 500, "meta_data": 500}


def test_an_id_given_twice_has_one_survivor(spark):
    given = rows((1, "a", "x", 5, b"h", 1, '{"k": 1}'), (1, "a", "X", 5, b"h", 3, '{"k": 1, "l": 2}'), (1, "a", "./x", 5, b"h", 2, None), (2, "a", "y", 5, b"h", 2, "{}"))
    seen = set()
    for seed in range(3):
        shuffled = random.Random(seed).sample(given, len(given))
        seen |= {tuple(r) for r in survivor.survivors(spark.createDataFrame(shuffled, SCHEMA).repartition(4), pools(spark)).collect()}
    assert len(seen) == 1
    group, path, fdate, meta = seen.pop()
    assert group == 1 and path in ("x", "X", "./x") and fdate == DAY + timedelta(days=3) and meta == '{"k": 1, "l": 2}'


def test_hot_keys_are_not_shuffled_together(spark):
    """One hash on half of all rows, and a path on a third: their rows stay where they are."""
    n = 200_000
    hot = F.when(F.col("id") % 2 == 0, F.lit(0)).otherwise(F.col("id")).cast("string")
    keyed = spark.range(n).repartition(8).select(F.md5(hot).alias("by_hash"), F.col("id").alias("path_least"))
    edges = survivor.hash_edges(keyed, n)
    assert edges.count() == n and edges.where("b = 0").count() == n // 2
    places = [r["count"] for r in edges.where("b = 0").groupBy(F.spark_partition_id()).count().collect()]
    assert len(places) >= 2 and max(places) < 0.6 * (n // 2)  # as distinct left them, which adaptive execution may coalesce
    star = {r["component"] for r in survivor.components(edges).collect()}
    assert star == {0}
    rows_ = spark.range(90_000).select(F.when(F.col("id") < 60_000, F.lit("p")).otherwise(F.col("id").cast("string")).alias("k"), "id")
    other = spark.createDataFrame([("p", 1), ("70000", 2)], "k string, m int")
    got = survivor.joined_to_one(rows_, "k", other, 90_000).groupBy("m").count().collect()
    assert {(r["m"], r["count"]) for r in got} == {(1, 60_000), (2, 1), (None, 29_999)}
