"""Searches: most similar vectors and hashes of one query, and ranked search over titles and texts."""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filequarry.functions import text as words
from filequarry.functions import vectors
from filequarry.functions.stemming import stem
from filequarry.session import ship_package

# What a hit of each kind scores.
TITLE, PARTIAL_TITLE, TERM, PARTIAL_TERM = 15, 7, 5, 2
OBJECT, PARTIAL_OBJECT = 11, 6
PRIORITY = {0: 15, 1: 5, 2: -5}
SHORT = 128  # entries of a vector


def cosine_scores(rows: DataFrame, key: str, vector: str, query: list[float]) -> DataFrame:
    """key and sim of every row with one query vector, as `vectors.cosine` has it: 0 for zero vectors, null for null ones and other lengths.

    Spark has no built-in product of arrays that is compiled, so vectors longer than SHORT go through numpy in Arrow batches, a product
    a batch; for short ones the way there costs more than it saves. The query, of one vector's size, goes with the code or the plan.
    """
    if len(query) <= SHORT:
        constant = F.array(*[F.lit(float(x)) for x in query])
        return rows.select(key, vectors.cosine(F.col(vector), constant, F.lit(float(np.linalg.norm(query)))).alias("sim"))
    ship_package(rows.sparkSession)
    wanted = np.asarray([float(x) for x in query])
    length = max(float(np.linalg.norm(wanted)), vectors.LEAST_NORM)

    def scored(batches):
        for batch in batches:
            column = batch.column("_vector")
            right = np.flatnonzero(np.asarray(pc.fill_null(pc.list_value_length(column), -1)) == len(wanted))
            flat = pc.list_flatten(column.take(pa.array(right)))
            whole = np.asarray(pc.is_valid(flat).to_numpy(zero_copy_only=False)).reshape(len(right), len(wanted)).all(1)
            matrix = np.asarray(pc.fill_null(flat, 0.0)).astype(np.float64).reshape(len(right), len(wanted))
            sims = np.full(batch.num_rows, np.nan)
            sims[right] = matrix @ wanted / (np.maximum(np.linalg.norm(matrix, axis=1), vectors.LEAST_NORM) * length)
            missing = np.ones(batch.num_rows, bool)
            missing[right[whole]] = False
            yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.array(sims, pa.float64(), mask=missing)], names=[key, "sim"])

    chosen = rows.select(F.col(key).alias("_key"), F.col(vector).alias("_vector"))
    return chosen.mapInArrow(scored, f"`{key}` {chosen.schema['_key'].dataType.simpleString()}, sim double")


def cosine_topk(rows: DataFrame, key: str, vector: str, query: list[float], k: int = 10, without: int | None = None) -> DataFrame:
    """The k rows most similar to a query vector, the lower key first on ties; a scan and one bounded heap a task. without: a key to leave out."""
    kept = rows if without is None else rows.where(F.col(key) != without)
    return cosine_scores(kept.where(F.col(vector).isNotNull()), key, vector, query).orderBy(F.desc_nulls_last("sim"), key).limit(k)


def similar_to(rows: DataFrame, key: str, vector: str, which: int, k: int = 10, include_self: bool = True) -> DataFrame:
    """The k rows most similar to the row of a key, which itself is first unless left out; no rows if there is none."""
    found = rows.where(F.col(key) == which).select(vector).limit(1).collect()
    if not found or found[0][0] is None:
        return rows.select(key, F.lit(0.0).alias("sim")).limit(0)
    return cosine_topk(rows, key, vector, list(found[0][0]), k, None if include_self else which)


def hamming_topk(rows: DataFrame, key: str, bits: Column, query: int, k: int = 10) -> DataFrame:
    """The k rows whose 64-bit hashes differ least from a query's: key, distance, the lower key first on ties."""
    return rows.select(key, vectors.hamming(bits, F.lit(query).cast("bigint")).alias("distance")).where(F.col("distance").isNotNull()).orderBy("distance", key).limit(k)


def split_query(query: str) -> list[str]:
    """A query's words: what stands between characters that are no letter, digit or underscore."""
    return [w for w in re.split(r"[^\w]+", query) if w]


def search_terms(query: str, language: str = "german") -> list[str]:
    """Words to search for: without stop words and plain numbers, stemmed, each once."""
    stops = set(words.stop_words(language))
    kept = [w.lower() for w in split_query(query)]
    kept = [w for w in kept if w not in stops and not w.isdigit()]
    return list(dict.fromkeys(stem(w) if language == "german" else w for w in kept))


def title_score(title: Column, query: str, document_title: bool = True) -> Column:
    """The score of a title, or of an index entry, that contains the query, of which it is at most twice the length; else null."""
    low, asked = F.lower(F.trim(title)), query.lower().strip()
    share = F.lit(float(len(asked))) / F.length(low)
    points = F.floor(share * (TITLE if document_title else 100) + 0.5).cast("int") + (1 if document_title else 0)
    return F.when((F.instr(low, asked) > 0) & (F.length(low) <= 2 * len(asked)) & (F.length(low) > 0), points)


def object_score(name: Column, priority: Column, query: str) -> Column:
    """The score of a named object: its last part or whole name equal to the query, or containing it, by priority 0, 1 or 2; else null."""
    low, asked = F.lower(name), query.lower()
    last = F.element_at(F.split(low, r"\."), -1)
    hit = F.when((low == asked) | (last == asked), OBJECT).when(F.instr(last, asked) > 0, PARTIAL_OBJECT)
    extra = reduce(lambda c, p: c.when(priority == p[0], p[1]), PRIORITY.items(), F.when(F.lit(False), 0)).otherwise(0)
    return hit + extra


def ranked_search(documents: DataFrame, query: str, key: str = "id", title: str = "fname", text: str = "inhalt", language: str = "german", stemmed: bool = True) -> DataFrame:
    """key and score of the documents that have every term of a query, in the title or the text: best first, then by title, then by key.

    A term equal to a stem of the title counts 15, of the text 5; a term of three letters or more that is only part of one counts 7
    or 2. A document's score is that of its best term. Terms of one or two letters needn't be found if longer ones are. The text's
    stems are the stored lexemes where there are any (these hold the title's too, which changes no score); else they are worked out.
    stemmed=False compares words as they are and reads no stored lexemes.
    """
    terms = search_terms(query, language) if stemmed else list(dict.fromkeys(w.lower() for w in split_query(query)))
    if not terms:
        return documents.select(key, F.lit(0).alias("score")).limit(0)
    how = language if stemmed else None
    names, wanted = words.lexemes(words.tokens(F.col(title)), how), words.lexemes(words.tokens(F.col(text)), how)
    rows = documents.select(key, F.col(title).alias("_name"), names.alias("_title"), wanted.alias("_text"))
    if stemmed and "lexemes" in documents.columns:
        stored, without = documents.where(F.col("lexemes").isNotNull()), documents.where(F.col("lexemes").isNull())
        rows = stored.select(key, F.col(title).alias("_name"), names.alias("_title"), F.col("lexemes").alias("_text"))
        rows = rows.unionByName(without.select(key, F.col(title).alias("_name"), names.alias("_title"), wanted.alias("_text")))

    def points(term: str) -> Column:
        whole = F.when(F.array_contains("_title", term), TITLE).when(F.array_contains("_text", term), TERM)
        if len(term) > 2:
            whole = whole.when(F.exists("_title", lambda w: F.instr(w, term) > 0), PARTIAL_TITLE).when(F.exists("_text", lambda w: F.instr(w, term) > 0), PARTIAL_TERM)
        return whole

    scored = rows.select(key, "_name", *[points(t).alias(f"_p{n}") for n, t in enumerate(terms)])
    needed = [n for n, t in enumerate(terms) if len(t) > 2] or list(range(len(terms)))
    found = scored.where(reduce(lambda a, b: a & b, [F.col(f"_p{n}").isNotNull() for n in needed]))
    best = F.col("_p0") if len(terms) == 1 else F.greatest(*[f"_p{n}" for n in range(len(terms))])
    return found.select(key, best.alias("score"), "_name").orderBy(F.desc("score"), F.lower("_name"), key).select(key, "score")


def best_hits(hits: DataFrame, key: str = "id", title: str | None = None) -> DataFrame:
    """Hits (key, score …) of several searches, the best of each key, ordered by score, then by title where one is named, then by key."""
    order = [F.desc("score"), *([F.lower(title)] if title else [])]
    top = hits.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")
    return top.orderBy(*order, key)


def snippet(text: Column, keywords: list[str], width: int = 240) -> Column:
    """width characters of a text from half as many before the last of the keywords' first hits on, with … where it is cut; from the start without a hit."""
    low = F.lower(text)
    hits = [F.instr(low, w.lower()) for w in keywords if w]
    place = F.greatest(F.lit(0), *hits) if hits else F.lit(0)
    start = F.greatest(place - 1 - width // 2, F.lit(0))
    body = F.trim(F.substring(text, start + 1, F.lit(width)))
    return F.concat(F.when(start > 0, "…").otherwise(""), body, F.when(F.length(text) > start + width, "…").otherwise(""))
