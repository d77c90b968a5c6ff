"""Oversized texts cut into overlapping pieces at natural boundaries, by pointer doubling.

Every position at which a piece may start is joined to its farthest legal successor, overlap included. Squaring that successor table
doubles the length of the jumps, so all cuts of a text come out after as many rounds as the logarithm of their number. A text is
one row and its table stays with it: nothing is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Characters that end a sentence, with the closing marks that may follow, and those that end one without a space.
_STOPS = ".!?…:;"
_CLOSERS = "\"'”’»«)]“"
_WIDE_STOPS = "。！？"


def _among(codes: np.ndarray, characters: str) -> np.ndarray:
    return np.isin(codes, np.array([ord(c) for c in characters], dtype=np.uint32))


def _blank(codes: np.ndarray) -> np.ndarray:
    narrow = ((codes >= 9) & (codes <= 13)) | ((codes >= 28) & (codes <= 32)) | ((codes >= 0x2000) & (codes <= 0x200A))
    return narrow | np.isin(codes, (0x85, 0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))


def boundaries(codes: np.ndarray) -> list[np.ndarray]:
    """Where code points may be parted, strongest first: after paragraphs, sentences or lines, words, and between characters.

    Each is an array of len + 1 flags: flag p stands for a cut before code point p. A weaker kind holds all stronger ones.
    The last kind leaves combining marks, joiners and variation selectors with what they belong to.
    """
    n = len(codes)
    blank, newline = _blank(codes), codes == 10
    word, line, wide = np.zeros(n + 1, bool), np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    word[1:n] = blank[:-1] & ~blank[1:]
    wide[1:n] = _among(codes[:-1], _WIDE_STOPS) & ~_among(codes[1:], _WIDE_STOPS + "」』）")
    # What a run of white space holds, and what stands before it, decide how strong the cut at its end is.
    at = np.arange(n)
    solid = np.maximum.accumulate(np.where(~blank, at, -1)) if n else at
    lines = np.concatenate(([0], np.cumsum(newline)))
    cuts = np.flatnonzero(word)
    before = solid[cuts - 1]
    broken = lines[cuts] - lines[np.maximum(before, 0)]
    closing = _among(codes, _CLOSERS)
    inner = np.maximum.accumulate(np.where(~blank & ~closing, at, -1)) if n else at
    stops = _among(codes, _STOPS)
    ends = np.where(inner[np.maximum(before, 0)] >= 0, stops[np.maximum(inner[np.maximum(before, 0)], 0)], False)
    paragraph = np.zeros(n + 1, bool)
    paragraph[cuts[broken >= 2]] = True
    line[cuts[(broken >= 1) | ends]] = True
    line |= wide
    word |= line
    loose = np.ones(n + 1, bool)
    mark = ((codes >= 0x300) & (codes <= 0x36F)) | ((codes >= 0xFE00) & (codes <= 0xFE0F)) | (codes == 0x200D) | ((codes >= 0x1F3FB) & (codes <= 0x1F3FF)) | ((codes >= 0x20D0) & (codes <= 0x20FF)) | ((codes >= 0x3099) & (codes <= 0x309A))
    loose[:n] = ~mark
    loose[1:n] &= codes[:-1] != 0x200D
    loose[1:n] &= ~((codes[:-1] == 13) & (codes[1:] == 10))
    loose[0] = loose[n] = True
    return [paragraph, line, word, loose]


def usable_overlap(limit: int, overlap: int) -> int:
    """The overlap that is aimed at: what is asked for, but less than a third of the limit, so that no piece lies within its neighbours."""
    return min(max(0, overlap), (max(1, limit) - 1) // 3)


def cut(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Start and end of consecutive pieces of at most `limit` characters that share about `overlap` with the piece before.

    A piece ends at the strongest boundary in the second half of its room, else at any natural one, else between characters. The
    next piece starts at the word boundary nearest to the overlap asked for, else at one between characters, if these leave at most
    half as much again to share; else it starts where the piece before ends. Every piece ends later than the one before, and no
    piece is covered by its neighbours. A text within the limit is one piece, an empty one none. An overlap of a third of the limit
    or more is taken as just under a third (`reduced_overlaps` reports such), a limit under 1 as 1.
    """
    n, limit = len(text), max(1, limit)
    if n <= limit:
        return [(0, n)] if n else []
    overlap = usable_overlap(limit, overlap)
    most = overlap + overlap // 2
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kinds = boundaries(codes)
    at = np.arange(n + 1)
    last = [np.maximum.accumulate(np.where(k, at, -1)) for k in kinds]
    reach = np.minimum(at + limit, n)
    least = at + limit // 2
    end = reach.copy()
    chosen = np.zeros(n + 1, bool)
    # What both neighbours share with a piece is shorter than the piece.
    progress = at + 2 * most + 1
    for found, floor in ((last[0], least), (last[1], least), (last[2], progress), (last[3], progress)):
        e = found[reach]
        take = ~chosen & (e >= np.maximum(floor, progress))
        end[take] = e[take]
        chosen |= take
    end[at + limit >= n] = n
    want, first = np.maximum(end - overlap, 0), np.maximum(end - most, 0)

    def following(kind: np.ndarray) -> np.ndarray:
        return np.minimum.accumulate(np.where(kind, at, n + 1)[::-1])[::-1][want]

    words, characters = (last[2][want], following(kinds[2])), (last[3][want], following(kinds[3]))
    start = end.copy()
    for below, above in (characters, words):  # words last, as they win
        fits = (below >= first) & (below <= end)
        near = (above <= end) & ((above - want < want - below) | ~fits)
        start = np.where(near & (above - want <= overlap // 2), above, np.where(fits, below, start))
    start = np.where(start <= at, end, start)
    follower = np.where(end >= n, n, start)
    # Pointer doubling: `reached` holds the first 2^k starts; jumping all of them 2^k pieces ahead gives the next 2^k.
    reached, jump = np.zeros(1, dtype=np.int64), follower
    while reached[-1] != n:
        reached = np.unique(np.concatenate((reached, jump[reached])))
        jump = jump[jump]
    starts = reached[:-1]
    return list(zip(starts.tolist(), end[starts].tolist(), strict=True))


def reduced_overlaps(limits: DataFrame, limit: str, overlap: str) -> DataFrame:
    """The rows of limits (one a pool, say) whose overlap is a third of the limit or more, with the overlap that is used instead: used_overlap."""
    used = F.greatest(F.lit(0), F.least(F.col(overlap), F.floor((F.greatest(F.lit(1), F.col(limit)) - 1) / 3).cast("int")))
    return limits.where(F.col(limit).isNotNull()).withColumn("used_overlap", used.cast("int")).where(F.col("used_overlap") < F.col(overlap))


def split_texts(df: DataFrame, keys: list[str], text: str, limit: str, overlap: str) -> DataFrame:
    """The pieces of each text longer than its limit: keys, piece_no (from 1), start (in characters), content.

    Texts within the limit, null texts and rows with a null limit give no row; a null overlap is none. Other columns are left out.
    """
    oversized = df.where(F.length(text) > F.col(limit)).select(*keys, F.col(text).alias("_text"), F.col(limit).cast("int").alias("_limit"), F.coalesce(F.col(overlap), F.lit(0)).cast("int").alias("_overlap"))

    def pieces(batches):
        for batch in batches:
            rows, numbers, starts, contents = [], [], [], []
            for row, (value, most, shared) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("_text", "_limit", "_overlap")], strict=True)):
                for number, (a, b) in enumerate(cut(value, most, shared), 1):
                    rows.append(row)
                    numbers.append(number)
                    starts.append(a)
                    contents.append(value[a:b])
            taken = batch.select(keys).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()), pa.array(contents, pa.string())], names=[*keys, "piece_no", "start", "content"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in oversized.select(*keys).schema)
    return oversized.mapInArrow(pieces, f"{schema}, piece_no int, start bigint, content string")


def archive_pieces(dbdoc: DataFrame, doc_vectors: DataFrame, pools: DataFrame) -> DataFrame:
    """The pieces of dbdoc.inhalt (item dbdoc) and doc_vectors.content (item doc_vectors): item, item_id, piece_no, start, content.

    A text has the limits of its pool, a chunk those of its record's pool; without a known pool there is no limit.
    """
    limits = pools.select(F.col("pool").alias("_pool"), "max_chars", "overlap_chars").where("_pool is not null").dropDuplicates(["_pool"])
    documents = dbdoc.select(F.lit("dbdoc").alias("item"), F.col("id").alias("item_id"), "pool", F.col("inhalt").alias("text"))
    owners = dbdoc.select(F.col("id").alias("_id"), "pool").where("_id is not null").dropDuplicates(["_id"])
    chunks = doc_vectors.where("content is not null").join(owners, F.col("doc_id") == F.col("_id")).select(F.lit("doc_vectors").alias("item"), F.col("chunk_id").alias("item_id"), "pool", F.col("content").alias("text"))
    texts = documents.unionByName(chunks).join(limits, F.col("pool") == F.col("_pool"))
    return split_texts(texts, ["item", "item_id"], "text", "max_chars", "overlap_chars")
