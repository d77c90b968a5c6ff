"""Tables as Parquet folders under one root: created, appended to, updated by key, with the constraints that Parquet doesn't have."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filequarry import schema
from filequarry.functions.text import with_lexemes
from filequarry.session import checkpointed, ship_package


class ConstraintError(ValueError):
    """Rows that a table may not hold."""


class Store:
    """The tables of schema.TABLES in folders below root, which one writer at a time changes.

    An update writes the table's next folders, then notes in a journal where they go, then renames them. A writer that finds a
    journal finishes its renames first, so an update that was cut off is made whole, never lost.
    """

    def __init__(self, spark: SparkSession, root: str):
        ship_package(spark)
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def folder(self, table: str) -> str:
        if table not in schema.TABLES:
            raise KeyError(f"no such table: {table}")
        return f"{self.root}/{table}"

    def exists(self, table: str) -> bool:
        return self._files.exists(self._path(self.folder(table)))

    def create_table(self, table: str) -> None:
        """An empty table, unless it is there."""
        if not self.exists(table):
            self._write(self.spark.createDataFrame([], schema.TABLES[table]), table, self.folder(table))

    def drop_table(self, table: str) -> None:
        self._files.delete(self._path(self.folder(table)), True)

    def create_all(self) -> None:
        for table in schema.TABLES:
            self.create_table(table)

    def recreate_tables(self, confirm: bool = False) -> None:
        """Drop and create all tables; all rows are lost, so it has to be confirmed."""
        if not confirm:
            raise ValueError("recreate_tables destroys all rows: pass confirm=True")
        for table in schema.TABLES:
            self.drop_table(table)
            self.create_table(table)

    def read(self, table: str) -> DataFrame:
        return self.spark.read.schema(schema.TABLES[table]).parquet(self.folder(table))

    def _write(self, rows: DataFrame, table: str, folder: str, mode: str = "overwrite") -> None:
        writer = rows.write.mode(mode)
        parts = schema.PARTITIONED.get(table)
        (writer.partitionBy(*parts) if parts else writer).parquet(folder)

    def assigned(self, table: str, rows: DataFrame) -> DataFrame:
        """rows with the table's key filled in above its largest key, without gaps, in the order of their paths, else of all columns.

        Rows with equal paths are ordered by their other columns.
        """
        key = schema.KEYS[table]
        highest = self.read(table).agg(F.max(key)).first()[0] or 0
        columns = [f.name for f in rows.schema if f.name != key and f.dataType.typeName() not in ("map", "variant")]
        order = sorted(columns, key=lambda c: c != "path")
        return dense_ids(rows.drop(key), order, key, highest)

    def violations(self, table: str, rows: DataFrame) -> list[str]:
        """What keeps rows from being appended: nulls, keys or unique columns given twice or taken, dangling references, vector lengths."""
        kind, found = schema.TABLES[table], []
        checks = [F.max(F.col(f.name).isNull().cast("int")).alias(f.name) for f in kind if not f.nullable and f.name in rows.columns]
        nulls = rows.agg(*checks).first() if checks else {}
        found += [f"{name} is null" for name in (nulls.asDict() if checks else {}) if nulls[name]]
        for columns in [[schema.KEYS[table]], *[[c] for c in schema.UNIQUE.get(table, [])]]:
            present = rows.select(*columns)
            if present.groupBy(*columns).count().where("count > 1").limit(1).count():
                found.append(f"{columns[0]} is given twice")
            if present.join(self.read(table).select(*columns), columns, "left_semi").limit(1).count():
                found.append(f"{columns[0]} is taken")
        if table in schema.REFERENCES:
            column, other, key = schema.REFERENCES[table]
            if rows.select(column).join(self.read(other).select(F.col(key).alias(column)), column, "left_anti").limit(1).count():
                found.append(f"{column} has no row in {other}")
        if table in schema.VECTOR_SIZE and rows.where(F.size("vector") != schema.VECTOR_SIZE[table]).limit(1).count():
            found.append(f"vector has not {schema.VECTOR_SIZE[table]} entries")
        return found

    def append(self, table: str, rows: DataFrame) -> None:
        """Append rows, all or none; ConstraintError if they violate a constraint. rows are worked out once."""
        self._append(table, checkpointed(self._shaped(table, rows)))

    def _append(self, table: str, shaped: DataFrame) -> None:
        self.recover()
        bad = self.violations(table, shaped)
        if bad:
            raise ConstraintError("; ".join(bad))
        self._write(shaped, table, self.folder(table), "append")

    def bulk_insert(self, table: str, data: list[dict] | DataFrame) -> bool:
        """Append dicts or rows; False, with nothing written, if that fails."""
        try:
            rows = data if isinstance(data, DataFrame) else self.spark.createDataFrame(data, self._partial(table, data))
            self.append(table, rows if schema.KEYS[table] in rows.columns else self.assigned(table, rows))
            return True
        except Exception:  # noqa: BLE001  the contract: any failure is told by the result
            return False

    def _partial(self, table: str, data: list[dict]):
        given = {k for d in data for k in d}
        return type(schema.TABLES[table])([f for f in schema.TABLES[table] if f.name in given])

    def _shaped(self, table: str, rows: DataFrame) -> DataFrame:
        """rows with the table's columns and types; lexemes are always worked out from what they are generated of."""
        shaped = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.TABLES[table]])
        return with_lexemes(shaped) if table in schema.GENERATED else shaped

    def insert_new(self, table: str, rows: DataFrame) -> int:
        """Append those rows whose unique columns the table doesn't have yet, the first by key of those that share them; how many.

        Rows without the table's key get theirs as `assigned` gives it. rows are worked out once, so files are read and hashed once.
        """
        self.recover()
        unique = schema.UNIQUE.get(table, [schema.KEYS[table]])
        new = only_new(self.read(table), rows, unique)
        if schema.KEYS[table] not in rows.columns:
            new = self.assigned(table, new)
        shaped = checkpointed(self._shaped(table, new))
        self._append(table, shaped)
        return shaped.count()

    def update(self, table: str, changes: DataFrame, columns: list[str]) -> None:
        """Set columns to the non-null values that changes (key, columns) has for a key; other keys in it say nothing.

        Where the table is partitioned, only partitions with a changed row are written again. changes are worked out once. A
        changed name or text has its lexemes worked out again.
        """
        self.recover()
        key, now, changes = schema.KEYS[table], self.read(table), checkpointed(changes)
        parts = schema.PARTITIONED.get(table)
        if parts:
            touched = now.join(changes.select(key), key, "left_semi").select(*parts).distinct()
            now = now.join(touched, parts, "left_semi")
        changed = update_keyed(now, changes, key, columns)
        if set(columns) & set(schema.GENERATED.get(table, ())):
            changed = with_lexemes(changed)
        draft = f"{self.root}/_{table}-{uuid.uuid4().hex[:8]}"
        self._write(changed, table, draft)
        folder = self.folder(table)
        moves = [(draft, folder)]
        if parts:
            found = [s.getPath() for s in self._files.listStatus(self._path(draft)) if s.isDirectory()]
            moves = [(p.toString(), f"{folder}/{p.getName()}") for p in found]
        self._note(draft, moves)
        self.recover()

    def _note(self, draft: str, moves: list[tuple[str, str]]) -> None:
        half = self._path(f"{self.root}/_journal-{uuid.uuid4().hex[:8]}.tmp")
        stream = self._files.create(half, False)
        stream.write(bytearray(json.dumps({"draft": draft, "moves": moves}).encode()))
        stream.close()
        self._files.rename(half, self._path(half.toString().removesuffix(".tmp")))

    def recover(self) -> None:
        """Finish the renames of updates that were cut off. What is replaced is put aside first and deleted last."""
        for status in self._files.globStatus(self._path(f"{self.root}/_journal-*")) or []:
            journal = status.getPath()
            if journal.getName().endswith(".tmp"):  # never came into force: the table is as it was
                self._files.delete(journal, False)
                continue
            stream = self._files.open(journal)
            try:
                noted = json.loads(bytes(stream.readAllBytes()).decode())
            finally:
                stream.close()
            aside = self._path(f"{noted['draft']}.old")
            self._files.mkdirs(aside)
            for source, target in noted["moves"]:
                if self._files.exists(self._path(source)):
                    if self._files.exists(self._path(target)):
                        self._files.rename(self._path(target), self._path(aside, uuid.uuid4().hex))
                    self._files.rename(self._path(source), self._path(target))
            self._files.delete(journal, False)
            self._files.delete(aside, True)
            self._files.delete(self._path(noted["draft"]), True)


def dense_ids(rows: DataFrame, order: list[str], key: str = "id", after: int = 0) -> DataFrame:
    """rows with `key` counted from after + 1 on without gaps in this order; nulls come first.

    Rows are parted into ranges of the order, sorted in their range and written once to the shared folder, so that the range and the
    place of a row stand fixed; a range's rows are then counted and numbered where they lie. Only the ranges' sizes, one a partition,
    reach the driver. Equal rows get neighbouring numbers.
    """
    spark = rows.sparkSession
    # Ranges are drawn from a sample, so without the first checkpoint rows would be worked out twice.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = checkpointed(checkpointed(rows).repartitionByRange(parts, *order).sortWithinPartitions(*order))
    placed = laid.withColumn("_at", F.monotonically_increasing_id())  # the partition's number in the bits above 33, the place in it below
    part = F.shiftright("_at", 33)
    sizes = {r["_part"]: r["n"] for r in placed.groupBy(part.alias("_part")).agg(F.count("*").alias("n")).collect()}
    starts, total = [], after
    for n in range(max(sizes, default=-1) + 1):
        starts.append((n, total))
        total += sizes.get(n, 0)
    offsets = F.broadcast(spark.createDataFrame(starts, "_part bigint, _offset bigint"))  # a row a partition
    numbered = placed.withColumn("_part", part.cast("bigint")).join(offsets, "_part")
    return numbered.withColumn(key, F.col("_offset") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_part", "_at", "_offset")


def only_new(old: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of new whose `columns` no row of old has; of those alike in them the first in the order of all that can be ordered."""
    order = [f.name for f in new.schema if f.name not in columns and f.dataType.typeName() not in ("map", "variant")]
    missing = new.join(old.select(*columns).distinct(), columns, "left_anti")
    ranked = missing.withColumn("_n", F.row_number().over(Window.partitionBy(*columns).orderBy(*(order or columns))))
    return ranked.where("_n = 1").drop("_n").select(*new.columns)


def update_keyed(rows: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """rows with columns taken from changes where it has a value for the row's key. A key given twice: its largest values."""
    new = changes.groupBy(F.col(key).alias("_key")).agg(*[F.max(c).alias(f"_new_{c}") for c in columns])
    joined = rows.join(new, F.col(key) == F.col("_key"), "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns])
