"""Tables from other stores: relational databases over JDBC, and staged intermediate results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from filequarry.session import checkpointed


def jdbc_table(spark: SparkSession, url: str, name: str, key: str | None = None, low: int = 0, high: int = 0, parts: int = 8, **options: str) -> DataFrame:
    """A table of a relational database; with a numeric key and its bounds, read in `parts` ranges at once. Filters and columns are pushed down.

    The database's driver has to be on the class path.
    """
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if key is not None:
        reader = reader.options(partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts)
    return reader.load()


def write_jdbc(df: DataFrame, url: str, name: str, mode: str = "append", batch: int = 10_000, **options: str) -> None:
    """Write df to a table of a relational database, batch rows in a statement."""
    df.write.format("jdbc").options(url=url, dbtable=name, batchsize=batch, **options).mode(mode).save()


def staged(df: DataFrame, folder: str | None = None) -> DataFrame:
    """df written once and read back, so that what follows does not work it out again: as Parquet below folder, else in the session's
    checkpoint folder. Rows that an interrupted run staged stay in their own subfolder and are never read by another.
    """
    if folder is None:
        return checkpointed(df)
    place = f"{folder.rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(place)
    return df.sparkSession.read.parquet(place)
