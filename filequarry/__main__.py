"""Command line: python -m filequarry ingest ROOT POOL STORE | pictures ROOT STORE | search STORE QUERY."""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import SparkSession

from filequarry.config import Config


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="filequarry")
    commands = parser.add_subparsers(dest="command", required=True)
    ingest = commands.add_parser("ingest", help="crawl a file tree and append its records to a store")
    ingest.add_argument("root")
    ingest.add_argument("pool")
    ingest.add_argument("store")
    ingest.add_argument("--pattern", default="*")
    pictures = commands.add_parser("pictures", help="make picture records, thumbnails, hashes and vectors for a store's files")
    pictures.add_argument("root")
    pictures.add_argument("store")
    pictures.add_argument("--model", help="module:function that returns make_predict; without it no vectors are made")
    search = commands.add_parser("search", help="documents of a store with all words of a query")
    search.add_argument("store")
    search.add_argument("query")
    given = parser.parse_args(argv)

    from filequarry.functions.text import tsquery
    from filequarry.operators.pipeline import index_pictures, ingest_tree
    from filequarry.operators.store import Store

    spark = SparkSession.builder.appName("filequarry").getOrCreate()
    store, config = Store(spark, given.store), Config.from_env_file()
    if given.command == "ingest":
        print(ingest_tree(store, given.root, given.pool, given.pattern, config))
    elif given.command == "pictures":
        module, _, function = (given.model or "").partition(":")
        store.create_all()
        print(index_pictures(store, given.root, config, getattr(importlib.import_module(module), function)() if module else None))
    else:
        tsquery(store.read("dbdoc"), given.query).select("id", "pool", "path").show(50, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
