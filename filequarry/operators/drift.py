"""Schemas that drift between runs: the changes of the metadata's keys and types, and one table with consistent columns.

Rows are loaded as path-value maps with raw types (VARIANT), path-type statistics are aggregated by run, and the statistics of
neighbouring runs are compared. Only values under keys that vanished or appeared are looked at again, to tell renamings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filequarry.session import checkpointed, materialised


def json_type(schema: Column) -> Column:
    """string, integer, decimal, boolean, array, object, or null for JSON null, from the name schema_of_variant gives.

    A number written with a point or an exponent is a decimal even if it is whole; Spark keeps such a one as DECIMAL(p,0) and gives
    that name to integers only beyond 64 bits, which have 19 digits or more.
    """
    digits = F.regexp_extract(schema, r"^DECIMAL\((\d+),0\)$", 1)
    return (
        F.when(schema == "STRING", "string")
        .when(schema.isin("BIGINT", "INT", "SMALLINT", "TINYINT") | (digits.try_cast("int") >= 19), "integer")
        .when(schema.startswith("DECIMAL") | schema.isin("DOUBLE", "FLOAT"), "decimal")
        .when(schema == "BOOLEAN", "boolean")
        .when(schema.startswith("ARRAY"), "array")
        .when(schema.startswith("OBJECT"), "object")
    )


def path_values(records: DataFrame, keep: list[str], values: bool = True) -> DataFrame:
    """One row for each top-level key of each record's meta_data: the columns of keep, key, type (null for JSON null), value (JSON text).

    Null metadata, text that isn't JSON and JSON that isn't an object have no keys. Of a key given twice in one object, one value
    is kept, or none if the parser refuses the text.
    """
    spark = records.sparkSession
    parsed = records.select(*keep, F.try_parse_json("meta_data").alias("_doc")).where("_doc is not null")
    entries = parsed.lateralJoin(spark.tvf.variant_explode(F.col("_doc").outer()))
    entries = entries.where("key is not null")
    kind = json_type(F.schema_of_variant("value"))
    return entries.select(*keep, "key", kind.alias("type"), *([F.to_json("value").alias("value")] if values else []))


def run_statistics(records: DataFrame, runs: DataFrame) -> DataFrame:
    """For each run and key: device_id, run_no, key, types (sorted, without null), cells (how many records have the key)."""
    entries = path_values(records, ["run_id"], values=False)
    # Combined by type first: a key of a run that holds a third of all rows is still one row per map task.
    counted = entries.groupBy("run_id", "key", "type").agg(F.count("*").alias("cells"))
    stats = counted.groupBy("run_id", "key").agg(F.array_sort(F.collect_set("type")).alias("types"), F.sum("cells").alias("cells"))
    return stats.join(_runs(runs), "run_id").select("run_id", "device_id", "run_no", "key", "types", "cells")


def _runs(runs: DataFrame) -> DataFrame:
    return runs.select("run_id", "device_id", "run_no").where("run_id is not null and device_id is not null and run_no is not null").dropDuplicates(["run_id"])


def changes(records: DataFrame, runs: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """Changes of the top-level keys between a device's neighbouring runs: device_id, run_no, change, old_key, new_key.

    change is renamed, removed (new_key ''), added (old_key '') or retyped (one key twice). Runs without any record are compared
    like all others, as runs without keys; a device's first run, and one whose predecessor is unknown, gives no change. Where a run
    delivers a path more than once, the values of all its records count. Records of unknown runs and null paths take no part.
    stats: run_statistics of the records, where they are at hand.
    """
    numbers = _runs(runs)
    stats = run_statistics(records, runs) if stats is None else stats
    pairs = numbers.select("device_id", "run_no").distinct()
    pairs = pairs.join(pairs.select("device_id", (F.col("run_no") + 1).alias("run_no")), ["device_id", "run_no"])
    later = stats.select("device_id", "run_no", "key", F.col("types").alias("new_types"))
    earlier = stats.select("device_id", (F.col("run_no") + 1).alias("run_no"), "key", F.col("types").alias("old_types"))
    # A row for each key of a run, a small part of the records' size; written once, as five branches read it.
    compared = checkpointed(earlier.join(later, ["device_id", "run_no", "key"], "full").join(pairs, ["device_id", "run_no"], "left_semi"))
    both = F.col("old_types").isNotNull() & F.col("new_types").isNotNull()
    retyped = compared.where(both & (F.size("old_types") > 0) & (F.size("new_types") > 0) & (F.col("old_types") != F.col("new_types")))
    retyped = retyped.select("device_id", "run_no", F.lit("retyped").alias("change"), F.col("key").alias("old_key"), F.col("key").alias("new_key"))
    single = compared.where(~both).select("device_id", "run_no", "key", F.when(F.col("new_types").isNull(), "old").otherwise("new").alias("side"))
    renamed = checkpointed(_renamings(records, numbers, single))
    taken = renamed.select("device_id", "run_no", F.explode(F.array(F.struct(F.lit("old").alias("side"), F.col("old_key").alias("key")), F.struct(F.lit("new").alias("side"), F.col("new_key").alias("key")))).alias("_t")).select("device_id", "run_no", "_t.*")
    alone = single.join(taken, ["device_id", "run_no", "key", "side"], "left_anti")
    old = F.col("side") == "old"
    alone = alone.select("device_id", "run_no", F.when(old, "removed").otherwise("added").alias("change"), F.when(old, F.col("key")).otherwise("").alias("old_key"), F.when(old, "").otherwise(F.col("key")).alias("new_key"))
    return retyped.unionByName(renamed).unionByName(alone)


def _renamings(records: DataFrame, numbers: DataFrame, single: DataFrame) -> DataFrame:
    """Pairs of a vanished and a new key with the same value under every path that has metadata in both runs, at least one not null.

    A path's cells under such keys meet in one small row, where keys with a common value are paired. A pair is a renaming if the
    values that meet are all the values that either key has.
    """
    sides = F.explode(F.array(F.struct(F.lit("old").alias("side"), (F.col("run_no") + 1).alias("run_no")), F.struct(F.lit("new").alias("side"), F.col("run_no").alias("run_no"))))
    placed = numbers.select("run_id", "device_id", sides.alias("_s")).select("run_id", "device_id", "_s.*")
    # Which keys of which run are looked at: one small row for each run, whatever the number of its records.
    wanted = placed.join(single, ["device_id", "run_no", "side"]).groupBy("run_id", "device_id", "run_no", "side").agg(F.collect_set("key").alias("keys"))
    wanted = placed.join(wanted, ["run_id", "device_id", "run_no", "side"], "left").groupBy("run_id", "device_id").agg(F.collect_list(F.struct("side", "run_no", F.coalesce("keys", F.array().cast("array<string>")).alias("keys"))).alias("_wanted"))
    known = records.select("run_id", "path", "meta_data").where("path is not null and meta_data is not null").join(wanted, "run_id")
    parsed = known.select("device_id", "path", "_wanted", F.expr("try_cast(try_parse_json(meta_data) as map<string, variant>)").alias("_doc")).where("_doc is not null")

    def cell(key: Column) -> Column:
        value = F.try_element_at(F.col("_doc"), key)
        return F.struct(key.alias("key"), F.concat_ws(":", json_type(F.schema_of_variant(value)), F.to_json(value)).alias("value"), json_type(F.schema_of_variant(value)).alias("type"))

    turned = parsed.select("device_id", "path", "_doc", F.explode("_wanted").alias("_w"))
    turned = turned.select("device_id", "path", "_w.run_no", "_w.side", F.filter(F.transform("_w.keys", cell), lambda c: c["type"].isNotNull()).alias("cells"))
    turned = turned.select("device_id", "path", "run_no", "side", F.transform("cells", lambda c: F.struct(c["key"].alias("key"), c["value"].alias("value"))).alias("cells"))
    met = turned.groupBy("device_id", "run_no", "path").agg(*[F.collect_set(F.when(F.col("side") == k, F.col("cells"))).alias(k) for k in ("old", "new")]).where("size(old) > 0 and size(new) > 0")
    met = met.select("device_id", "run_no", *[F.array_distinct(F.flatten(k)).alias(k) for k in ("old", "new")])
    none = F.lit(None).cast("string")
    seen = F.concat(
        F.transform("old", lambda o: F.struct(o["key"].alias("o"), none.alias("n"))),
        F.transform("new", lambda n: F.struct(none.alias("o"), n["key"].alias("n"))),
        F.flatten(F.transform("old", lambda o: F.transform(F.filter("new", lambda n: n["value"] == o["value"]), lambda n: F.struct(o["key"].alias("o"), n["key"].alias("n"))))),
    )
    counts = met.select("device_id", "run_no", F.explode(seen).alias("_c")).groupBy("device_id", "run_no", "_c.o", "_c.n").agg(F.count("*").alias("cells"))
    key = ["device_id", "run_no"]
    matches = counts.where("o is not null and n is not null")
    matches = matches.join(counts.where("n is null").select(*key, "o", F.col("cells").alias("of_old")), [*key, "o"]).join(counts.where("o is null").select(*key, "n", F.col("cells").alias("of_new")), [*key, "n"])
    matches = matches.where("cells = of_old and cells = of_new")
    return matches.select(*key, F.lit("renamed").alias("change"), F.col("o").alias("old_key"), F.col("n").alias("new_key"))


#: Spark's type for each JSON type; a column whose cells have several types takes the first of these that holds most of them.
SQL_TYPES = {"integer": "bigint", "decimal": "double", "boolean": "boolean", "string": "string", "array": "string", "object": "string"}


MOST_KEYS = 2_000  # keys that get columns; what rarer ones hold goes to one map


def renamings(changed: DataFrame) -> DataFrame:
    """old_key, new_key and on how many devices one was renamed to the other, from `changes`."""
    return changed.where("change = 'renamed'").groupBy("old_key", "new_key").agg(F.countDistinct("device_id").alias("devices"))


def columns_of(records: DataFrame, runs: DataFrame, support: int = 2, most: int = MOST_KEYS) -> tuple[list[tuple[str, str, list[str]]], bool]:
    """The consistent columns, (name, Spark type, keys), one for each concept, and whether there are keys beyond the `most` most frequent.

    Keys are one concept if `support` devices or more renamed one to the other; `renamings` lists those of fewer, whose keys stay
    apart. A concept's name is the key with the most cells, its type the most frequent one, where integers beside decimals count as
    decimals. Only statistics of `most` keys reach the driver, whatever the number of records and keys.
    """
    stats = materialised(run_statistics(records, runs))  # a row for each key of a run
    cells_of = stats.groupBy("key").agg(F.sum("cells").alias("cells"))
    frequent = [r["key"] for r in cells_of.orderBy(F.desc("cells"), "key").limit(most + 1).collect()]
    further, frequent = len(frequent) > most, frequent[:most]
    wanted = records.sparkSession.createDataFrame([(k,) for k in frequent], "key string")
    kinds = stats.join(F.broadcast(wanted), "key", "left_semi").select("key", F.explode_outer("types").alias("type"), "cells").groupBy("key", "type").agg(F.sum("cells").alias("cells")).collect()
    links = renamings(changes(records, runs, stats)).where(F.col("devices") >= support)
    for side in ("old_key", "new_key"):
        links = links.join(F.broadcast(wanted.withColumnRenamed("key", side)), side, "left_semi")
    links = links.collect()
    parent: dict[str, str] = {}

    def root(k: str) -> str:
        while parent.setdefault(k, k) != k:
            k = parent[k]
        return k

    cells: dict[str, dict[str, int]] = {}
    for r in sorted(kinds, key=lambda r: (r["key"], r["type"] or "")):
        if r["type"] is not None:
            cells.setdefault(r["key"], {})[r["type"]] = r["cells"]
            root(r["key"])
    for r in sorted(links, key=lambda r: (r["old_key"], r["new_key"])):
        a, b = sorted((root(r["old_key"]), root(r["new_key"])))
        parent[b] = a
    groups: dict[str, list[str]] = {}
    for k in sorted(cells):
        groups.setdefault(root(k), []).append(k)
    columns = []
    for keys in groups.values():
        name = max(keys, key=lambda k: (sum(cells[k].values()), k))
        of = {t: sum(cells[k].get(t, 0) for k in keys) for t in SQL_TYPES}
        if of["decimal"]:
            of = of | {"decimal": of["decimal"] + of["integer"], "integer": 0}
        columns.append((name, SQL_TYPES[max(of, key=lambda t: of[t])], keys))
    return sorted(columns), further


def consistent_table(records: DataFrame, runs: DataFrame, support: int = 2, most: int = MOST_KEYS) -> DataFrame:
    """Every record's metadata in the same typed columns: rec_id, run_id, device_id, path, the columns, failed_casts.

    Column names have characters other than letters, digits and _ replaced by _, and md_ before them, so that none clashes with
    another column. failed_casts maps a key to the JSON text of a value that its column's type can't hold; the cell is null then.
    Records with null or unreadable metadata stay, with null cells. Where a record has several keys of one concept, the first not
    null in the order of their names is taken. If there are more than `most` keys, the JSON text of the rarer ones' values is in one
    map more, other_keys.
    """
    columns, further = columns_of(records, runs, support, most)
    parsed = records.select("rec_id", "run_id", "device_id", "path", F.expr("try_cast(try_parse_json(meta_data) as map<string, variant>)").alias("_doc"))
    names: dict[str, int] = {}
    cells, failed = [], []
    for name, kind, keys in columns:
        plain = "md_" + "".join(c if c.isalnum() or c == "_" else "_" for c in name)
        names[plain.lower()] = names.get(plain.lower(), 0) + 1
        if names[plain.lower()] > 1:
            plain += f"_{names[plain.lower()]}"
        values = [F.try_element_at("_doc", F.lit(k)) for k in keys]
        if kind == "string":  # a string as it is, anything else as JSON text
            cast = [F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).when(F.schema_of_variant(v) != "VOID", F.to_json(v)) for v in values]
        else:
            cast = [F.try_variant_get(v, "$", kind) for v in values]
            failed += [F.when((F.schema_of_variant(v) != "VOID") & c.isNull(), F.struct(F.lit(k).alias("key"), F.to_json(v).alias("value"))) for k, v, c in zip(keys, values, cast, strict=True)]
        cells.append(F.coalesce(*cast).alias(plain))
    bad = F.map_from_entries(F.array_compact(F.array(*failed))) if failed else F.lit(None).cast("map<string,string>")
    more = []
    if further:
        placed = F.array(*[F.lit(k) for _, _, keys in columns for k in keys]).cast("array<string>")
        rest = F.map_filter("_doc", lambda k, v: ~F.array_contains(placed, k))
        more = [F.transform_values(rest, lambda k, v: F.to_json(v)).alias("other_keys")]
    return parsed.select("rec_id", "run_id", "device_id", "path", *cells, bad.alias("failed_casts"), *more)
