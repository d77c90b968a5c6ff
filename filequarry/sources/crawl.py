"""Files of a tree as rows: path, modificationTime, length, content."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from datetime import datetime
from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from filequarry.session import checkpointed, ship_package

SCHEMA = "path string, modificationTime timestamp_ntz, length bigint, sha256 binary, content binary, error string"


MOST = 1 << 26  # bytes of a file that are kept, where nothing else is said
LARGEST = 2_000_000_000  # bytes that a binary value of Spark can hold
TOO_LARGE = "too large"


LISTED = "path string, modificationTime timestamp_ntz, length bigint, error string"
SUBTREES = 256  # subtrees that the driver looks for before tasks list them


class _Subtrees(InputPartition):
    def __init__(self, flat: list[str], deep: list[str]):
        self.flat, self.deep = flat, deep


class TreeSource(DataSource):
    """Paths, dates and sizes of all files below a folder that every executor sees, hidden ones and those that begin with _ among them.

    Options: path; pattern (a glob for names). The driver lists the first levels only, until it has SUBTREES folders; each of these is
    walked by a task. A file or folder that can't be looked at is a row with error set. Links to folders are not followed.
    """

    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return LISTED

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(dict(self.options))


class _TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.pattern = options["path"], options.get("pattern", "*")

    def partitions(self) -> list[InputPartition]:
        flat, deep = [], [self.root]
        while deep and len(deep) < SUBTREES:
            below = []
            for folder in deep:
                try:
                    with os.scandir(folder) as entries:
                        below += sorted(e.path for e in entries if e.is_dir(follow_symlinks=False))
                except OSError:
                    pass  # the task that lists its files tells of it
            flat, deep = [*flat, *deep], below
        # What one level has in plenty goes to a bounded number of tasks; folders next to each other are often alike, so they are dealt.
        return [_Subtrees(flat[n::64], []) for n in range(min(64, len(flat)))] + [_Subtrees([], deep[n :: 4 * SUBTREES]) for n in range(min(4 * SUBTREES, len(deep)))]

    def read(self, partition: _Subtrees) -> Iterator[tuple]:
        from fnmatch import fnmatch

        refused: list[OSError] = []
        flat = ((f, next(os.walk(f, onerror=refused.append), (f, [], []))[2]) for f in partition.flat)
        deep = ((f, names) for top in partition.deep for f, _, names in os.walk(top, onerror=refused.append))
        for folder, names in chain(flat, deep):
            for name in names:
                if fnmatch(name, self.pattern):
                    file = os.path.join(folder, name)
                    try:
                        stat = os.stat(file)
                        yield file, datetime.fromtimestamp(stat.st_mtime), stat.st_size, None
                    except OSError as e:
                        yield file, None, None, f"{type(e).__name__}: {e.strerror}"
        for e in refused:
            yield e.filename, None, None, f"{type(e).__name__}: {e.strerror}"


def _read(listed: DataFrame, content: bool, maxbytes: int, whole: tuple[str, ...]) -> DataFrame:
    """listed with the files' hashes and, where they are kept, their bytes. Hashes are taken in blocks, one file at a time."""

    def run(batches):
        import hashlib

        import pyarrow as pa

        for batch in batches:
            for row in range(batch.num_rows):
                file, size, error = (batch.column(c)[row].as_py() for c in ("path", "length", "error"))
                digest = data = None
                if error is None:
                    most = LARGEST if whole and file.lower().endswith(whole) else min(maxbytes, LARGEST)
                    keep = content and size <= most
                    try:
                        hashed, blocks = hashlib.sha256(), []
                        with open(file, "rb") as f:
                            while block := f.read(1 << 20):
                                hashed.update(block)
                                if keep:
                                    blocks.append(block)
                        digest, data = hashed.digest(), b"".join(blocks) if keep else None
                        error = TOO_LARGE if content and not keep else None
                    except OSError as e:  # what is known of the file without reading it stays
                        error = f"{type(e).__name__}: {e.strerror}"
                told = [batch.column(c).slice(row, 1) for c in ("path", "modificationTime", "length")]
                yield pa.RecordBatch.from_arrays([*told, pa.array([digest], pa.binary()), pa.array([data], pa.binary()), pa.array([error], pa.string())], names=SCHEMA_NAMES)

    return listed.mapInArrow(run, SCHEMA)


SCHEMA_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def crawl(spark: SparkSession, root: str, pattern: str = "*", content: bool = True, hidden: bool = True, maxbytes: int = MOST, whole: Iterable[str] = (), each: int = 256) -> DataFrame:
    """The files below root whose names fit a glob, with hash and (content) bytes. Of a file over maxbytes (64 MB) there are none and error is
    'too large'; files with a suffix in `whole` are kept up to LARGEST. A file that can't be read stays, with error set.

    Tasks list the tree; the list, without contents, is written to the shared folder, and its files are then dealt to tasks of about
    `each` files or MOST bytes, wherever in the tree they are. hidden=False uses Spark's own reader, which reads any file system but
    leaves out names that begin with . or _, and prunes content and filters on length in the scan; it has no use for maxbytes and whole.
    """
    if hidden:
        ship_package(spark)
        spark.dataSource.register(TreeSource)
        suffixes = tuple(s.lower() for s in whole)
        listed = checkpointed(spark.read.format("filetree").option("path", root).option("pattern", pattern).load())
        files, size = listed.agg(F.count("*"), F.sum(F.least("length", F.lit(MOST)))).first()
        parts = max(1, -(-files // each), -(-(size or 0) // MOST))
        return _read(listed.repartition(parts, F.xxhash64("path")), content, maxbytes, suffixes)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    modified = F.col("modificationTime").cast("timestamp_ntz").alias("modificationTime")
    plain = files.select(F.regexp_replace("path", r"^file:/+", "/").alias("path"), modified, "length", F.unhex(F.sha2("content", 256)).alias("sha256"), "content", F.lit(None).cast("string").alias("error"))
    return plain if content else plain.drop("sha256", "content")
