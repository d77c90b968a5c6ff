"""One surviving record for each group of records of the same file, each field from the member that is best for it.

Groups are the components that equal hashes and equal paths link. Members are ranked by completeness, trust and recency in windows;
the rank's bound lets Spark keep one row a group in each task before it shuffles, so a group of any size costs little.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filequarry.session import checkpointed

HOT = 50_000  # rows of one key from which on they are not shuffled to meet what belongs to the key
MOST_HOT = 10_000  # such keys at most; in larger tables a key has to have more rows to be one

BLANK = r"\A[\s\u0000- \u007f\u0085   -​    　﻿]*\z"


def plain_path(path: str | None) -> str | None:
    """One way of writing a path: letter case, Unicode form, separators, dot segments and surrounding blanks say nothing. Null if nothing is left."""
    if path is None:
        return None
    path = unicodedata.normalize("NFC", unicodedata.normalize("NFC", path).casefold())
    kept: list[str] = []
    for segment in path.strip(" \t\r\n\f\v\u0085    ​ 　﻿").replace("\\", "/").split("/"):
        if segment == "..":
            kept[-1:] = []
        elif segment not in ("", "."):
            kept.append(segment)
    return "/".join(kept).strip() or None


def _plain_paths(paths: pd.Series) -> pd.Series:
    return paths.map(plain_path, na_action="ignore")


def joined_to_one(rows: DataFrame, key: str, other: DataFrame, total: int) -> DataFrame:
    """rows left join other, which has one row a key at most. total: how many rows there are.

    Keys with more than HOT rows, and more than a share of 1 / MOST_HOT of all, meet their row of other by a broadcast of those few,
    MOST_HOT rows at most; the rest is joined as Spark sees fit. (Adaptive execution can't split a join with an aggregation.)
    """
    if total <= HOT:
        return rows.join(other, key, "left")
    hot = rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > max(HOT, total // MOST_HOT)).select(key)
    known = F.broadcast(hot.join(other, key, "left").withColumn("_hot", F.lit(True)))
    marked = rows.join(known, key, "left")
    cold = marked.where("_hot is null").select(*rows.columns).join(other, key, "left")
    return marked.where("_hot").drop("_hot").unionByName(cold)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a, b): node, component (the smallest node in it). Nulls and loops are left out.

    Large and small stars in turn: every node hands its neighbours to the smallest of them, until each edge joins a node to its
    component's smallest. Minima are combined before they are shuffled; each round is written to the shared folder.
    """
    current = checkpointed(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        seen = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state or seen[0] == 0:
            return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(current.select("v", "v").distinct())
        state = seen
        both = current.union(current.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = joined_to_one(both.where("v > u"), "u", least, seen[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        star = F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = joined_to_one(large, "u", below, seen[0]).select(F.explode(star).alias("e")).select("e.*")
        current = checkpointed(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())


def hash_edges(keyed: DataFrame, total: int) -> DataFrame:
    """a and b: for each hash (by_hash) an edge from each of its path_least to the smallest of them. total: how many rows there are."""
    hashed = keyed.where("by_hash is not null").select("by_hash", "path_least").distinct()
    least = hashed.groupBy("by_hash").agg(F.min("path_least").alias("hash_least"))
    return joined_to_one(hashed, "by_hash", least, total).select(F.col("path_least").alias("a"), F.col("hash_least").alias("b"))


def same_file_groups(records: DataFrame) -> DataFrame:
    """group_id (the smallest id) of each record: id, group_id. A record linked to none is its own group.

    Linked are records with equal sha256 that is not null and fsize > 0, and records with the same pool and the same path however
    it is written. Null pools, paths and hashes link nothing; records with a null id take no part.
    """
    keyed = records.where("id is not null").select(
        "id",
        F.when(F.col("sha256").isNotNull() & (F.col("fsize") > 0), F.md5("sha256")).alias("by_hash"),
        F.md5(F.concat(F.col("pool"), F.lit("\u0000"), F.pandas_udf(_plain_paths, "string")("path"))).alias("by_path"),
    )
    # Paths are made plain once; the smallest id of each and the join back read what was written.
    keyed = checkpointed(keyed.withColumn("by_path", F.coalesce("by_path", F.concat(F.lit("id "), F.col("id")))))
    total = keyed.count()
    # Records of one path come down to their smallest id first, and the paths of one hash to a star around the smallest of those.
    by_path = keyed.groupBy("by_path").agg(F.min("id").alias("path_least"))
    keyed = checkpointed(joined_to_one(keyed, "by_path", by_path, total).select("id", "by_hash", "path_least"))
    found = components(hash_edges(keyed, total)).withColumnRenamed("node", "path_least")
    return joined_to_one(keyed, "path_least", found, total).select("id", F.coalesce("component", "path_least").alias("group_id"))


def filled_entries(meta: str = "meta_data") -> Column:
    """How many top-level entries of a JSON object are not null, blank or empty; 0 for null and for what isn't an object."""
    entries = F.map_values(F.expr(f"try_cast(try_parse_json({meta}) as map<string, variant>)"))

    def filled(v: Column) -> Column:
        text = F.to_json(v)
        return F.when(F.schema_of_variant(v) == "STRING", ~F.try_variant_get(v, "$", "string").rlike(BLANK)).otherwise(~text.isin("null", "[]", "{}"))

    return F.coalesce(F.size(F.filter(entries, filled)), F.lit(0))


def best_members(records: DataFrame, pools: DataFrame, latest: str = "2026-01-01") -> DataFrame:
    """The member that gives each field of each group of two or more records: group_id, field, id.

    path: of the pool most trusted (unknown pools last); fdate: the latest before `latest`, no row if there is none; meta_data: the
    most filled entries, then the latest fdate. Ties go to the smallest id. An id given twice is one record, its fullest row.
    """
    return _best(records, pools, latest).select("group_id", "field", "id")


def _row() -> Column:
    """Tells rows of one id apart by what a survivor takes from them; equal rows are interchangeable."""
    return F.xxhash64("path", "fdate", "meta_data")


def _best(records: DataFrame, pools: DataFrame, latest: str = "2026-01-01", rows: bool = False) -> DataFrame:
    """best_members, with rows the winning row of an id given twice as `row`: the best by the field's own order, then by the row's hash."""
    trust = pools.select(F.col("pool").alias("_pool"), "trust").where("_pool is not null").dropDuplicates(["_pool"])
    plain = records.where("id is not null").select("id", "pool", "fdate", "meta_data", *([_row().alias("row")] if rows else []))
    more = ["row"] if rows else []
    facts = plain.join(trust, F.col("pool") == F.col("_pool"), "left").select("id", "trust", "fdate", filled_entries().alias("filled"), *more)
    ranked = checkpointed(facts.join(same_file_groups(records).distinct(), "id"))
    groups = ranked.groupBy("group_id").agg(F.min("id").alias("_a"), F.max("id").alias("_b")).where("_a < _b").select("group_id")
    orders = {
        "path": ([F.desc_nulls_last("trust"), "id"], None),
        "fdate": ([F.desc("fdate"), "id"], F.col("fdate") < F.lit(latest).cast("timestamp_ntz")),
        "meta_data": ([F.desc("filled"), F.desc_nulls_last("fdate"), "id"], None),
    }
    best = None
    for field, (order, allowed) in orders.items():
        of = ranked if allowed is None else ranked.where(allowed)
        rank = F.row_number().over(Window.partitionBy("group_id").orderBy(*order, *more))
        top = of.withColumn("_n", rank).where("_n = 1").select("group_id", F.lit(field).alias("field"), "id", *more)
        best = top if best is None else best.unionByName(top)
    return best.join(groups, "group_id", "left_semi")


def survivors(records: DataFrame, pools: DataFrame) -> DataFrame:
    """One record for each group of two or more: group_id, path, fdate, meta_data, each from its best member (fdate null if none is plausible).

    Of an id given twice with other values, the row that wins a field gives its value, so the result does not depend on the rows' order.
    """
    best = checkpointed(_best(records, pools, rows=True))
    values = records.select("id", "path", "fdate", "meta_data", _row().alias("row"))
    of = {f: F.max(F.when(F.col("field") == f, F.col(f))).alias(f) for f in ("path", "fdate", "meta_data")}
    return best.join(values, ["id", "row"]).groupBy("group_id").agg(*of.values())
