"""Session helpers: opening a session, reading tables, cutting lineage in the shared folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("filequarry")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("FILEQUARRY_DRIVER_MEMORY", "8g"))
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Send this package's code to the session's Python workers, once; they need not have it installed. Spark's driver serves the file."""
    context = spark.sparkContext
    if getattr(context, "_filequarry_shipped", False):
        return
    source = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="filequarry-code-"), "filequarry.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(source.rglob("*.py")):
            z.write(file, Path(source.name, file.relative_to(source)))
    context.addPyFile(str(archive))
    context._filequarry_shipped = True


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data folder. Queries begin here, so the workers get the package's code."""
    ship_package(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's folder for intermediate data: the one in spark.checkpoint.dir, which all machines share.

    Only a local session without the setting gets a temporary folder, which goes with the process; on a cluster, where each machine
    would have one of its own, a missing setting is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
            folder = tempfile.mkdtemp(prefix="filequarry-checkpoint-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder with its rows' order and partitions, its lineage cut. Spark removes it when it is no longer
    referred to, if spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def materialised(df: DataFrame) -> DataFrame:
    """df written to the shared folder as Parquet, which is smaller and read by columns; it is deleted when the driver ends."""
    spark = df.sparkSession
    place = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    df.write.option("compression", "zstd").parquet(place)
    return spark.read.schema(df.schema).parquet(place)
