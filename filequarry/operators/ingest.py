"""Records from files: filemeta, dbdoc and pictures."""

from __future__ import annotations

from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filequarry.config import Config
from filequarry.functions import records
from filequarry.session import ship_package
from filequarry.sources import extract
from filequarry.sources.crawl import MOST, crawl
from filequarry.sources.xmp import xmp


def read_files(spark: SparkSession, root: str, pattern: str = "*", hidden: bool = True, maxbytes: int = MOST) -> DataFrame:
    """Every file below root with its text, metadata and hash, from which filemeta_of and dbdoc_of make records.

    Files that have an extractor are read whole; maxbytes holds for others. Stage it where both are made, so files are read once.
    """
    ship_package(spark)
    files = crawl(spark, root, pattern, hidden=hidden, maxbytes=maxbytes, whole=extract.EXTRACTORS)
    return extract.extracted(files.withColumn("suffix", records.suffix(F.col("path"))))


def _common(files: DataFrame, root: str, pool: str, above: bool = False) -> list:
    path = records.relative_path(F.col("path"), root, above=above)
    meta = F.col("meta_data")
    return [
        F.lit(pool).alias("pool"), path.alias("path"), records.basename(path).alias("fname"), records.suffix(path).alias("suffix"), F.col("modificationTime").alias("fdate"),
        F.coalesce("length", F.lit(0)).cast("bigint").alias("fsize"), records.content_length(meta).alias("clength"), records.content_type(meta).alias("ctype"), records.meta_keys(meta).alias("md_keys"), "meta_data",
    ]


def filemeta_of(files: DataFrame, root: str, pool: str) -> DataFrame:
    """A metadata record for each file: the columns of filemeta without id, and error. A file that can't be read or parsed stays, with error set."""
    return files.select(*_common(files, root, pool), records.sort_date_of_file(F.col("meta_data"), F.col("modificationTime")).alias("sort_date"), "sha256", "error")


def dbdoc_of(files: DataFrame, root: str, pool: str, config: Config | None = None) -> DataFrame:
    """A document record for each document file: the columns of dbdoc without id and lexemes, and error. inhalt is never null."""
    files = files.where(records.ftype(F.col("suffix"), config) == "doc")
    return files.select(*_common(files, root, pool, above=True), records.sort_date_of_document(F.col("meta_data")).alias("sort_date"), F.lit(None).cast("binary").alias("sha256"), F.coalesce("page_content", F.lit("")).alias("inhalt"), "error")


def filemeta_records(spark: SparkSession, root: str, pool: str, pattern: str = "*", hidden: bool = True, maxbytes: int = MOST) -> DataFrame:
    """filemeta_of the files below root."""
    return filemeta_of(read_files(spark, root, pattern, hidden, maxbytes), root, pool)


def dbdoc_records(spark: SparkSession, root: str, pool: str, pattern: str = "*", hidden: bool = True, config: Config | None = None, maxbytes: int = MOST) -> DataFrame:
    """dbdoc_of the files below root."""
    return dbdoc_of(read_files(spark, root, pattern, hidden, maxbytes), root, pool, config)


def file_contents(rows: DataFrame, file: str = "file", key: str = "id") -> DataFrame:
    """key, content and error for each row that names a file which every executor sees; a file that can't be read has error set."""

    def run(batches):
        for batch in batches:
            # One file at a time: a batch of paths is small, a batch of contents need not be.
            for k, path in zip(batch.column(key), batch.column(file).to_pylist(), strict=True):
                content = error = None
                try:
                    content = Path(path or "").read_bytes()
                except OSError as e:
                    error = f"{type(e).__name__}: {e.strerror}"
                yield pa.RecordBatch.from_arrays([pa.array([k.as_py()], k.type), pa.array([content], pa.binary()), pa.array([error], pa.string())], names=[key, "content", "error"])

    return rows.select(key, file).mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, content binary, error string")


def pictures_of(filemeta: DataFrame, config: Config | None = None) -> DataFrame:
    """Picture records, with the ids of the file records that they copy, for files of a picture type; what is read from files is null."""
    empty = {"xmp": "map<string,string>", "truncated": "boolean", "thumbarray": "binary", "phash": "binary"}
    return filemeta.where(records.ftype(F.col("suffix"), config) == "pic").select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in empty.items()])


def with_xmp(pictures: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """Pictures with xmp read from crawled files (path, content)."""
    read = files.select(records.relative_path(F.col("path"), root).alias("path"), xmp(F.col("content")).alias("_xmp"))
    joined = pictures.join(read, "path", "left")
    return joined.select(*[F.coalesce("_xmp", "xmp").alias("xmp") if c == "xmp" else F.col(c) for c in pictures.columns])


def missing_pictures(filemeta: DataFrame, pictures: DataFrame, config: Config | None = None) -> DataFrame:
    """File records of a picture type that have no picture record yet."""
    return filemeta.where(records.ftype(F.col("suffix"), config) == "pic").join(pictures.select("id"), "id", "left_anti")


def without_thumbnail(pictures: DataFrame, docroot: str, heic: bool = True, any_case: bool = False) -> DataFrame:
    """The work queue of thumbnails: file (docroot and path) and id of pictures without one. heic=False leaves out .HEIC and .heic, with any_case also .Heic."""
    todo = pictures.where(F.col("thumbarray").isNull())
    if not heic:
        todo = todo.where(F.lower("suffix") != ".heic") if any_case else todo.where(~F.col("suffix").isin(".HEIC", ".heic"))
    return todo.select(F.concat(F.lit(docroot), "path").alias("file"), "id")
