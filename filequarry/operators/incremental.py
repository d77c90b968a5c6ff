"""Incremental runs: the target is the state. Its rows carry the key and version of the source they came from.

A run anti-joins the source against the target and publishes the target's next version atomically, so a run that dies leaves the
version before it in force and the next run takes up exactly what is missing.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["device_id", "path"]


def numbered(records: DataFrame, runs: DataFrame) -> DataFrame:
    """Records with run_no and processed: whether the run ended well and had the record by its cut-off.

    A record whose run is unknown has no run_no and is not processed. Runs given twice count once.
    """
    facts = runs.select(F.col("run_id").alias("_run"), F.col("run_no").alias("run_no"), F.col("status").alias("_status"), F.col("cutoff_at").alias("_cutoff"))
    facts = facts.where("_run is not null").dropDuplicates(["_run"])
    done = (F.col("_status") == "ok") & (F.col("arrived_at") <= F.col("_cutoff"))
    sightings = records.select("rec_id", "run_id", *KEY, "sha256", "arrived_at").join(facts, F.col("run_id") == F.col("_run"), "left")
    return sightings.select("rec_id", *KEY, "sha256", "run_no", F.coalesce(done, F.lit(False)).alias("processed"))


def target_of(sightings: DataFrame) -> DataFrame:
    """The target's state from the sightings: for each file the key and version (run_no, rec_id, sha256) last processed."""
    version = F.max(F.struct(F.coalesce("run_no", F.lit(-1)).alias("run_no"), "rec_id", F.col("sha256").alias("sha256")))
    return sightings.where("processed").groupBy(*KEY).agg(version.alias("version")).select(*KEY, "version.*")


def latest_of(sightings: DataFrame) -> DataFrame:
    """The newest sighting of each file, by run_no, then rec_id."""
    newest = F.max(F.struct(F.coalesce("run_no", F.lit(-1)).alias("run_no"), "rec_id", F.col("sha256").alias("sha256"), "processed"))
    return sightings.groupBy(*KEY).agg(newest.alias("newest")).select(*KEY, "newest.*")


def pending(source: DataFrame, target: DataFrame) -> DataFrame:
    """The newest source rows whose content the target does not hold: source left anti target on key and content.

    source: KEY, rec_id, sha256, processed; target: KEY, sha256. Content without a hash is never held. Null keys are keys like any other.
    """
    held = target.select(*[F.col(k).alias(f"_{k}") for k in KEY], F.col("sha256").alias("_sha256"))
    same = F.col("sha256") == F.col("_sha256")
    for k in KEY:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return source.where(~F.col("processed")).join(held, same, "left_anti")


def next_batch(records: DataFrame, runs: DataFrame) -> DataFrame:
    """rec_id of each record that the next run must take up."""
    sightings = numbered(records, runs)
    # One aggregation yields both states, so that the sightings are shuffled once, already combined.
    order = F.struct(F.coalesce("run_no", F.lit(-1)).alias("run_no"), "rec_id", F.col("sha256").alias("sha256"), "processed")
    states = sightings.groupBy(*KEY).agg(F.max(order).alias("newest"), F.max(F.when(F.col("processed"), order)).alias("held"))
    source = states.select(*KEY, "newest.*")
    target = states.where("held is not null").select(*KEY, "held.sha256")
    return pending(source, target).select("rec_id")


class VersionedTarget:
    """A target folder of parts, and versions that each list the parts in force.

    A version's parts are written first; then the file versions/N is created, which only one writer can do, and that creation is the
    commit. Its content is complete before it has that name. A reader sees the old version or the new one, never part of one; of two
    writers that start from one version one wins and the other gets RuntimeError. A part holds only new rows: a row counts if no later
    part has its key, so a run writes what changed and not the table. compact() brings the parts into one.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _number(self) -> int:
        """The highest version; they are counted without gaps."""
        place = self._path(f"{self.folder}/versions")
        if not self._files.exists(place):
            return 0
        return max((int(s.getPath().getName()) for s in self._files.listStatus(place) if s.getPath().getName().isdigit()), default=0)

    def current(self) -> dict | None:
        """number and parts (folders, the oldest first) of the version in force; None before the first."""
        number = self._number()
        if number == 0:
            return None
        stream = self._files.open(self._path(f"{self.folder}/versions/{number}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self) -> DataFrame | None:
        """The rows in force: of each key those of the latest part that has it. Null keys are keys like any other."""
        return self._rows(self.current())

    def _rows(self, now: dict | None) -> DataFrame | None:
        if now is None:
            return None
        parts = None
        for n, part in enumerate(now["parts"]):
            rows = self.spark.read.parquet(f"{self.folder}/{part}").withColumn("_part", F.lit(n))
            parts = rows if parts is None else parts.unionByName(rows, allowMissingColumns=True)
        if len(now["parts"]) == 1:
            return parts.drop("_part")
        # Maxima are combined before they are shuffled; only keys and part numbers are.
        latest = parts.groupBy(*[F.col(k).alias(f"_{k}") for k in KEY]).agg(F.max("_part").alias("_latest"))
        same = F.col("_part") == F.col("_latest")
        for k in KEY:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        return parts.join(latest, same, "left_semi").drop("_part")

    def publish(self, rows: DataFrame, after: int, parts: list[str] | None = None) -> int:
        """Add rows as a part to the version `after` (0: none), or put it in the place of these parts; returns the new version's number."""
        number = after + 1
        name = f"part={number}-{uuid.uuid4().hex[:8]}"
        rows.write.parquet(f"{self.folder}/{name}")
        now = self.current()
        if (now["number"] if now else 0) != after:
            raise RuntimeError(f"version {after} is no longer the one in force")
        kept = [p for p in (now["parts"] if now else []) if parts is None or p not in parts]
        self._commit(number, {"number": number, "parts": [name, *kept] if parts is not None else [*kept, name]})
        return number

    def _commit(self, number: int, content: dict) -> None:
        """Create versions/number with this content unless it is there. The content is written under another name and then renamed
        without overwriting, which exactly one of several writers can do.
        """
        place = f"{self.folder}/versions"
        self._files.mkdirs(self._path(place))
        draft = self._path(f"{place}/draft-{uuid.uuid4().hex}")
        stream = self._files.create(draft, False)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        jvm = self.spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs
        try:
            if self._files.getUri().getScheme() == "file":
                # The local file system checks and renames in two steps; a hard link is one, and fails if the name is taken.
                link = jvm.java.nio.file.Files.createLink
                link(*[jvm.java.nio.file.Path.of(self._path(p).toUri().getPath(), self.spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0)) for p in (f"{place}/{number}", draft.toString())])
            else:
                options = self.spark.sparkContext._gateway.new_array(context.Options.Rename, 1)
                options[0] = context.Options.Rename.NONE
                context.FileContext.getFileContext(self._files.getUri()).rename(draft, self._path(f"{place}/{number}"), options)
        except Py4JJavaError as e:
            raise RuntimeError(f"version {number} was published by another writer") from e
        finally:
            self._files.delete(draft, False)

    def advance(self, records: DataFrame, runs: DataFrame, process=None, most_parts: int = 64) -> int:
        """Process what is pending against the version in force and publish its results as the next version; returns its number.

        process: DataFrame of pending sightings (KEY, rec_id, run_no, sha256) -> target rows with those columns and its own results.
        It is evaluated once. Only its rows are written, but for a target of more than most_parts parts, which is compacted first.
        """
        if len((self.current() or {"parts": ()})["parts"]) >= most_parts:
            self.compact()
        now = self.current()
        held = self._rows(now)
        newest = latest_of(numbered(records, runs)).withColumn("processed", F.lit(False))
        todo = newest if held is None else pending(newest, held)
        rows = todo.drop("processed") if process is None else process(todo.drop("processed"))
        return self.publish(rows, now["number"] if now else 0)

    def compact(self) -> int | None:
        """Write the rows in force as one part and publish it; returns the version's number, None before the first."""
        now = self.current()
        if now is None:
            return None
        return self.publish(self._rows(now), now["number"], now["parts"])
