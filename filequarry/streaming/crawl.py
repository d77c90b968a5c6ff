"""Crawling and derived work as streams that process what is new and stop, or go on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from filequarry.functions import records

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def file_stream(spark: SparkSession, root: str, pattern: str = "*", at_once: int = 1000) -> DataFrame:
    """New files below root as a stream, at_once of them in a batch. Names that begin with . or _ are left out."""
    return spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", at_once).load(root)


def record_stream(files: DataFrame, root: str, pool: str) -> DataFrame:
    """Basic file records of a stream of files, all by built-in functions."""
    plain = F.regexp_replace("path", r"^file:/+", "/")
    path = records.relative_path(plain, root)
    return files.select(F.lit(pool).alias("pool"), path.alias("path"), records.basename(path).alias("fname"), records.suffix(path).alias("suffix"), F.col("modificationTime").cast("timestamp_ntz").alias("fdate"), F.col("length").alias("fsize"), records.sha256(F.col("content")).alias("sha256"))


def ingest_available(spark: SparkSession, root: str, pool: str, target: str, checkpoint: str, pattern: str = "*") -> StreamingQuery:
    """Append records of the files that are new since the last run to target, then stop. checkpoint keeps what has been read."""
    stream = record_stream(file_stream(spark, root, pattern), root, pool)
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def work_queue(source: DataFrame, todo: Callable[[DataFrame], DataFrame], work: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Do work on what todo keeps of each batch of a stream; a batch that fails is done again under its number, so work must be idempotent by it."""
    return source.writeStream.foreachBatch(lambda batch, number: work(todo(batch), number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals_by_window(sightings: DataFrame, time: str = "arrived_at", late: str = "1 hour", width: str = "1 day", by: str = "pool") -> DataFrame:
    """Counts of a stream's rows for each window and value of `by`; rows later than the watermark are left out."""
    return sightings.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("rows")).select(F.col("w.start").alias("start"), by, "rows")
