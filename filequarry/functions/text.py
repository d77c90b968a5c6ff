"""Full-text search: words, stop words, stems, and the match of a query against a text's lexemes."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filequarry.functions.records import search_text
from filequarry.functions.stemming import stem

WORD = r"[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """The words of a text in lower case: runs of letters and digits. Hosts, addresses and numbers are no kinds of their own."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


@lru_cache
def stop_words(language: str = "german") -> tuple[str, ...]:
    """The stop list that Spark ships for a language."""
    from pyspark.ml.feature import StopWordsRemover

    return tuple(StopWordsRemover.loadDefaultStopWords(language))


_stem = lru_cache(1 << 17)(stem)  # a worker keeps this many


def _stems(words: pd.Series) -> pd.Series:
    return words.map(lambda ws: None if ws is None else [_stem(w) for w in ws])


def lexemes(words: Column, language: str | None = "german") -> Column:
    """The distinct lexemes of a list of words: without stop words, stemmed if the language is German. None: the distinct words as they are.

    Stems are found in Arrow batches, once for each distinct word of a batch.
    """
    if language is None:
        return F.array_distinct(words)
    kept = F.array_distinct(F.array_except(words, F.array(*map(F.lit, stop_words(language)))))
    return F.array_sort(F.array_distinct(F.pandas_udf(_stems, "array<string>")(kept))) if language == "german" else F.array_sort(kept)


def with_lexemes(documents: DataFrame, language: str | None = "german", fused: bool = False) -> DataFrame:
    """Documents with the column lexemes computed from fname and inhalt, as a writer stores it."""
    return documents.withColumn("lexemes", lexemes(tokens(search_text(F.col("fname"), F.col("inhalt"), fused)), language))


def query_lexemes(spark: SparkSession, query: str, language: str | None = "german") -> list[str]:
    """A query's lexemes by the same rules."""
    import re

    words = list(dict.fromkeys(re.findall(r"[^\W_]+", query.lower())))
    if language is None:
        return words
    words = [w for w in words if w not in set(stop_words(language))]
    return sorted({stem(w) for w in words}) if language == "german" else sorted(words)


def matches(lexeme_column: Column, wanted: list[str]) -> Column:
    """Whether all wanted lexemes are among a row's; with none wanted nothing matches."""
    if not wanted:
        return F.lit(False)
    return F.forall(F.array(*map(F.lit, wanted)), lambda w: F.array_contains(lexeme_column, w))


def with_stored_lexemes(documents: DataFrame, language: str | None = "german") -> DataFrame:
    """documents with lexemes: those stored, and worked out where they are null or there is no such column.

    Rows with stored lexemes form a branch of their own, which reads no text and stays in the JVM.
    """
    if "lexemes" not in documents.columns:
        return with_lexemes(documents, language)
    missing = with_lexemes(documents.where(F.col("lexemes").isNull()), language)
    return documents.where(F.col("lexemes").isNotNull()).unionByName(missing)


def tsquery(documents: DataFrame, query: str, language: str | None = "german") -> DataFrame:
    """The documents that contain all words of a query, unranked, without the wide columns.

    Stored lexemes are taken to be of this language; where they are null they are worked out, so a null never means no hit.
    """
    rows = with_stored_lexemes(documents, language)
    found = rows.where(matches(F.col("lexemes"), query_lexemes(documents.sparkSession, query, language)))
    return found.drop("inhalt", "lexemes")


def inverted_index(documents: DataFrame, key: str = "id") -> DataFrame:
    """lexeme and document for each lexeme of each document with stored lexemes, for writing partitioned or bucketed by lexeme."""
    return documents.select(F.explode("lexemes").alias("lexeme"), F.col(key).alias(key))


def search_index(index: DataFrame, wanted: list[str], key: str = "id") -> DataFrame:
    """Keys of the documents that have all wanted lexemes, from an inverted index: a pruned scan and one combined count."""
    if not wanted:
        return index.select(key).limit(0)
    hits = index.where(F.col("lexeme").isin(*wanted)).distinct().groupBy(key).agg(F.count("*").alias("_n"))
    return hits.where(F.col("_n") == len(set(wanted))).select(key)
