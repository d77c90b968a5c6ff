"""A file tree's way into a store: files, documents, pictures, thumbnails and embeddings, each step from what the last left in the store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from filequarry.config import Config
from filequarry.operators import ingest, pictures
from filequarry.operators.store import Store
from filequarry.session import checkpointed


def ingest_tree(store: Store, root: str, pool: str, pattern: str = "*", config: Config | None = None) -> dict[str, int]:
    """Crawl root once and append what the store doesn't have: files, and the documents among them that could be parsed.

    A file that can't be parsed stays in filemeta with what the file system tells of it. Returns how many rows each table gained,
    how many files had an error, and how many vanished before they could be looked at, which are in no table.
    """
    store.create_all()
    read = checkpointed(ingest.read_files(store.spark, root, pattern))
    gone = F.col("modificationTime").isNull()
    told = read.agg(F.count_if(F.col("error").isNotNull() & ~gone).alias("errors"), F.count_if(gone).alias("gone")).first().asDict()
    there = read.where(~gone)
    files = ingest.filemeta_of(there, root, pool).drop("error")
    documents = ingest.dbdoc_of(there, root, pool, config).where("error is null").drop("error")
    return {"filemeta": store.insert_new("filemeta", files), "dbdoc": store.insert_new("dbdoc", documents), **told}


def index_pictures(store: Store, docroot: str, config: Config | None = None, make_predict: Callable | None = None) -> dict[str, int]:
    """Picture records with XMP for file records that have none, then thumbnails and hashes where they are missing, then vectors.

    docroot and a record's path name its file. A picture that can't be decoded keeps its place in the queue and is tried again by the
    next run. Without make_predict (see pictures.embeddings) no vectors are made. Returns how many rows each step wrote or failed at.
    """
    docroot = docroot.rstrip("/") + "/"
    files = ingest.missing_pictures(store.read("filemeta"), store.read("pictures"), config)
    found = ingest.file_contents(files.select("id", F.concat(F.lit(docroot), "path").alias("file")))
    tagged = found.select(F.col("id").alias("_id"), ingest.xmp(F.col("content")).alias("_xmp"))
    new = ingest.pictures_of(files, config).drop("xmp").join(tagged, F.col("id") == F.col("_id"), "left").withColumnRenamed("_xmp", "xmp").drop("_id")
    counts = {"pictures": store.insert_new("pictures", new)}

    queue = ingest.without_thumbnail(store.read("pictures"), docroot)
    made = checkpointed(pictures.thumbnails(ingest.file_contents(queue)))
    done = made.where("error is null")
    counts |= {"thumbnails": done.count(), "failed": made.where("error is not null").count()}
    if counts["thumbnails"]:
        store.update("pictures", done, ["thumbarray", "phash", "truncated"])

    if make_predict is not None:
        missing = store.read("pictures").join(store.read("dino_v2_vectors").select(F.col("pic_id").alias("id")), "id", "left_anti")
        vectors = checkpointed(pictures.embeddings(missing, make_predict).withColumnRenamed("id", "pic_id"))
        store.append("dino_v2_vectors", vectors)
        counts["vectors"] = vectors.count()
    return counts
