"""The most similar vectors of every vector, by a permutation index.

A vector is represented by the order of the pivots nearest to it and posted in the inverted files of the first of them. Within a
file, vectors are ranked by the footrule distance of their permutations and only the best are compared exactly. Pivots are rows drawn
from the table, so that dense regions have many of them.

A vector is sent to each of its files once, FILES of them where neighbours of NEAR or more are asked for, whatever the size of the
table. Beyond ROWS_A_PIVOT * MOST_PIVOTS rows the files grow longer; farther neighbours then take a file more for each doubling of the
rows a pivot stands for. Where files would hold more than 2 * BLOCK vectors, they are named by more pivots, in the order in which the
vector's permutation has them, which parts each into some BRANCHES.
"""

from __future__ import annotations

import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_A_PIVOT = 12
MOST_PIVOTS = 4096  # bounds what is fitted and sent to the executors, at 1,024 dimensions to 16 MB
SAMPLED = 5000  # rows from which the centre and the pivots are taken; every row is indexed
PREFIX = 16  # pivots in a permutation
FILES = 4  # inverted files in which a vector is posted
FAR_FILES = 12  # at most so many where neighbours below NEAR are asked for, and as many where files are named by several pivots
NEAR = 0.8  # nearer neighbours are sought among the first by footrule distance, however long the file: those of 0.9 were 12th at worst when measured
CANDIDATES = 64  # the best by footrule distance, besides ties, that are compared exactly with each vector of a file
FAR_SHARE = 0.8  # where neighbours below NEAR are asked for, at least this share of a file's vectors is
BLOCK = 4096  # vectors that a file should hold
BRANCHES = 32
SLICE = 500  # vectors whose distances to all pivots are held at once
QUERIES = 256  # vectors of a file whose candidates are compared at once
DIGITS = 9  # decimals to which similarities are told apart


def _deflated(data: bytes, strategy: int) -> bytes:
    packer = zlib.compressobj(6 if strategy == zlib.Z_DEFAULT_STRATEGY else 1, zlib.DEFLATED, -15, 8, strategy)
    return packer.compress(data) + packer.flush()


def _power(rows: np.ndarray) -> int | None:
    """The least power of two, below 16, that makes whole numbers of nearly as many of these vectors as any does; None if that is not half of them."""
    shares = [(np.mod(rows * 2.0**k, 1) == 0).all(1).mean() if len(rows) else 0.0 for k in range(16)]
    return next(k for k, share in enumerate(shares) if share >= max(shares) - 0.01) if max(shares) >= 0.5 else None


def _packed(rows: np.ndarray, power: int | None = -1) -> list[bytes]:
    """float32 vectors without loss in few bytes: as integers near 0 where 2^power makes whole numbers of them, others by the bytes' significance.

    The first byte tells which: the power, plus 64 if every integer fits in one byte, or 255. What follows is entropy coded. Equal
    vectors give equal bytes under one power, which is found in the rows themselves where none is given.
    """
    power = _power(rows) if power == -1 else power
    if power is not None:
        scaled = rows.astype(np.float64) * 2.0**power
        whole = ((np.mod(scaled, 1) == 0) & (np.abs(scaled) < 1 << 15)).all(1)
        signed = np.where(whole[:, None], scaled, 0).astype(np.int32)
        folded = ((signed << 1) ^ (signed >> 31)).astype(np.uint16)
        narrow = folded.max(1) < 256
    packed = []
    for i, row in enumerate(rows):
        if power is None or not whole[i]:
            packed.append(b"\xff" + _deflated(row.view(np.uint8).reshape(-1, 4).T.tobytes(), zlib.Z_DEFAULT_STRATEGY))
        elif narrow[i]:
            packed.append(bytes([power + 64]) + _deflated(folded[i].astype(np.uint8).tobytes(), zlib.Z_HUFFMAN_ONLY))
        else:
            packed.append(bytes([power]) + _deflated(folded[i].view(np.uint8).reshape(-1, 2).T.tobytes(), zlib.Z_DEFAULT_STRATEGY))
    return packed


def _unpacked(data: bytes) -> np.ndarray:
    kind, plain = data[0], np.frombuffer(zlib.decompress(data[1:], -15), np.uint8)
    if kind == 255:
        return np.ascontiguousarray(plain.reshape(4, -1).T).view(np.float32).ravel()
    folded = plain.astype(np.int32) if kind >= 64 else np.ascontiguousarray(plain.reshape(2, -1).T).view(np.uint16).ravel().astype(np.int32)
    return (((folded >> 1) ^ -(folded & 1)) / 2.0 ** (kind % 64)).astype(np.float32)


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of one length as rows, -0.0 as 0.0, and which rows of the column they are; those with null entries are left out."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0), np.float32), np.zeros(0, np.int64)
    flat = pc.list_flatten(column)
    good = np.arange(len(column))
    if flat.null_count:
        good = np.flatnonzero(~np.asarray(flat.is_null().to_numpy(zero_copy_only=False)).reshape(len(column), -1).any(1))
        flat = pc.list_flatten(column.take(pa.array(good)))
    return np.asarray(flat.cast(pa.float32())).reshape(len(good), -1) + np.float32(0), good


def _units(rows: np.ndarray, centre: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    units = rows / np.where(norms > 0, norms, 1) - centre
    return units / np.maximum(np.linalg.norm(units, axis=1, keepdims=True), 1e-12)


def _finite(vector: str, width: int) -> Column:
    """Whether a vector has this length and no NaN or infinite entry. NaN is above all in Spark's order; null entries are passed over."""
    return (F.size(vector) == width) & (F.array_max(vector) < float("inf")) & (F.array_min(vector) > float("-inf"))


def _complete(vector: str) -> Column:
    return F.forall(vector, lambda x: x.isNotNull())


def _most_frequent_length(df: DataFrame, vector: str) -> tuple[int, int]:
    """The length above 0 that most vectors have, of equally frequent ones the longest, and how many have it; 0, 0 without any."""
    lengths = df.where(F.size(vector) > 0).groupBy(F.size(vector).alias("width")).count().orderBy(F.desc("count"), F.desc("width"))
    found = lengths.first()
    return (found["width"], found["count"]) if found else (0, 0)


def rejected(df: DataFrame, key: str, vector: str) -> DataFrame:
    """The rows that take no part: key and reason, 'no key', 'no vector', 'length' (another than most vectors have) or 'value' (NaN, infinite or null)."""
    width, _ = _most_frequent_length(df, vector)
    reason = F.when(F.col(key).isNull(), "no key").when(F.col(vector).isNull(), "no vector").when(F.size(vector) != width, "length").when(~(_finite(vector, width) & _complete(vector)), "value")
    return df.select(key, reason.alias("reason")).where("reason is not null")


def fit(df: DataFrame, vector: str, rows: int) -> tuple[np.ndarray, np.ndarray, int | None] | None:
    """Centre, pivots and the packing's power, from at most SAMPLED rows drawn by hash; None without a vector that isn't zero."""
    share = min(1.0, 1.5 * SAMPLED / max(1, rows))
    drawn = df.where(F.pmod(F.xxhash64(vector), F.lit(1_000_000)) < int(share * 1_000_000)) if share < 1 else df
    matrix, _ = _matrix(drawn.orderBy(F.xxhash64(vector)).select(vector).limit(SAMPLED).toArrow().column(0))
    matrix = np.unique(matrix[np.abs(matrix).sum(1) > 0], axis=0) if matrix.size else matrix
    if not len(matrix):
        return None
    units = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    centre = (units.mean(0) if len(units) > 1 else np.zeros(units.shape[1])).astype(np.float32)
    pivots = min(MOST_PIVOTS, max(16, rows // ROWS_A_PIVOT), len(units))
    chosen = np.random.default_rng(7).permutation(len(units))[:pivots]
    return centre, _units(units[chosen].astype(np.float32), centre), _power(matrix)


def _permutations(units: np.ndarray, points: np.ndarray, width: int) -> np.ndarray:
    """The `width` pivots nearest to each row, the nearest first."""
    found = np.empty((len(units), width), np.int16)
    for start in range(0, len(units), SLICE):
        near = units[start : start + SLICE] @ points.T
        order = np.argpartition(-near, width - 1, axis=1)[:, :width]
        ranked = np.argsort(-np.take_along_axis(near, order, axis=1), axis=1, kind="stable")
        found[start : start + SLICE] = np.take_along_axis(order, ranked, axis=1)
    return found


def _depth(rows: int, pivots: int, width: int, own) -> int:
    """How many pivots name a file: so many that one should hold no more than 2 * BLOCK vectors. own: files of a vector by depth."""
    depth = 1
    while depth < min(5, width) and rows * own(depth) / (pivots * BRANCHES ** (depth - 1)) > 2 * BLOCK:
        depth += 1
    return depth


def _files(order: np.ndarray, own: int, depth: int, pivots: int) -> np.ndarray:
    """The numbers of the files of each permutation: those of the `own` sets of `depth` of its pivots that stand farthest in front."""
    sets = sorted(combinations(range(min(order.shape[1], own + depth - 1)), depth), key=lambda c: (sum(c), c))[:own]
    named = np.sort(order.astype(np.int64)[:, np.array(sets)], axis=2)
    return (named * pivots ** np.arange(depth, dtype=np.int64)).sum(2)


def _footrule(order: np.ndarray, mine: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Footrule distances between the permutations of rows `mine` and all rows; a pivot beyond the prefix stands just behind it.

    place: where each pivot stands in each row. With w pivots a row the distance is w (w + 1) less twice the sum, over the pivots that
    both have, of how far the later of its two places is from the end.
    """
    width = order.shape[1]
    shared = np.zeros((len(mine), place.shape[1]), np.int16)
    for j in range(width):
        shared += width - np.maximum(place[order[mine, j]], np.int8(j))
    return width * (width + 1) - 2 * shared


def _places(order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """order with its pivots numbered anew without gaps, and the place of each in each row, the width where a row has it not."""
    pivots, numbered = np.unique(order, return_inverse=True)
    numbered = numbered.reshape(order.shape)
    n, width = order.shape
    place = np.full((len(pivots), n), width, np.int8)
    place[numbered, np.arange(n)[:, None]] = np.arange(width, dtype=np.int8)[None, :]
    return numbered, place


def _best(rows: np.ndarray, order: np.ndarray, keep: int, floor: float, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, other row, similarity): of each distinct vector the `keep` most similar others with all ties, of those of at least floor.

    The CANDIDATES best by footrule distance, or this share of all rows if that is more, with all ties, are compared with each. Where
    that leaves rows out, rows are taken in the order of their permutations, so that those compared at once share candidates.
    """
    n = len(rows)
    wanted = max(CANDIDATES, int(np.ceil(share * n)))
    norms = np.linalg.norm(rows.astype(np.float64), axis=1) if n <= 2 * BLOCK else np.array([np.linalg.norm(r.astype(np.float64)) for r in rows])
    pruned = n - 1 > wanted
    walk = np.lexsort(order.T[::-1]) if pruned else np.arange(n)
    order, place = _places(order) if pruned else (order, None)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for start in range(0, n, QUERIES):
        mine = walk[start : start + QUERIES]
        line = np.arange(len(mine))
        columns, candidate = np.arange(n), None
        if pruned:
            distance = _footrule(order, mine, place)
            distance[line, mine] = np.iinfo(np.int16).max
            candidate = distance <= np.partition(distance, wanted - 1, axis=1)[:, wanted - 1 : wanted]
            columns = np.flatnonzero(candidate.any(0))
        similar = np.empty((len(mine), len(columns)))
        own = rows[mine].astype(np.float64) / norms[mine, None]
        for c in range(0, len(columns), BLOCK):  # bounds the memory of a long file
            some = columns[c : c + BLOCK]
            similar[:, c : c + BLOCK] = own @ (rows[some].astype(np.float64) / norms[some, None]).T
        similar = np.round(similar, DIGITS)
        if pruned:
            similar[~candidate[:, columns]] = -9
        else:
            similar[line, mine] = -9
        good = (similar >= floor) & (similar > -9)
        if len(columns) > keep:
            good &= similar >= -np.partition(-similar, keep - 1, axis=1)[:, keep - 1 : keep]
        q, c = np.nonzero(good)
        found.append((mine[q], columns[c], similar[q, c]))
    return tuple(np.concatenate(f) for f in zip(*found, strict=True))


def _spread(which: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For entries that each stand for a run of a flat list: which entry and which place of the list each of their elements is."""
    many = sizes[which]
    entry = np.repeat(np.arange(len(which)), many)
    return entry, starts[which][entry] + np.arange(len(entry)) - np.repeat(np.cumsum(many) - many, many)


def _nearest_ids(members: list[list[int]], q: np.ndarray, o: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, other id, similarity): the k best of each id, where rows of distinct vectors stand for the ids of their copies."""
    sizes = np.array([len(m) for m in members])
    flat, starts = np.array([i for m in members for i in m], np.int64), np.cumsum(sizes) - sizes
    several = np.flatnonzero(sizes > 1)  # copies are neighbours of each other
    q, o, s = np.concatenate((q, several)), np.concatenate((o, several)), np.concatenate((s, np.ones(len(several))))
    entry, at = _spread(o, starts, sizes)
    q, other, s = q[entry], flat[at], s[entry]
    entry, at = _spread(q, starts, sizes)
    me, other, s = flat[at], other[entry], s[entry]
    apart = me != other
    me, other, s = me[apart], other[apart], s[apart]
    by = np.lexsort((other, -s, me))
    me, other, s = me[by], other[by], s[by]
    first = np.flatnonzero(np.concatenate(([True], me[1:] != me[:-1]))) if len(me) else np.zeros(0, np.int64)
    rank = np.arange(len(me)) - np.repeat(first, np.diff(np.append(first, len(me))))
    return me[rank < k], other[rank < k], s[rank < k]


def _source(df: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """id and vector of the rows that take part, and how many vectors of their length there are."""
    rows = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<float>").alias("vector"))
    width, count = _most_frequent_length(rows, "vector")
    return rows.where(_finite("vector", width)), count


def nearest(df: DataFrame, key: str, vector: str, k: int = 5, floor: float = -1.0, files: int | None = None) -> DataFrame:
    """The k most similar other rows of each row, by cosine: id, other, similarity, of which those of at least `floor` are given.

    On equal similarity (to 9 decimals) the lower id comes first. Equal vectors are compared once: a row's first neighbours are then
    the lowest ids of its copies, and only the k + 1 lowest ids of copies can be anyone's neighbours among them. A zero vector has
    similarity 0 to all and is indexed nowhere: with floor <= 0 its neighbours are the lowest other ids. Rows without a key or vector,
    with a vector of another length than most, or with values that are no numbers take no part; `rejected` lists them. floor is at
    most 1. files: in how many files a vector is posted, if not in as many as FILES and FAR_FILES say.
    """
    source, count = _source(df, key, vector)
    found = _indexed(source, count, k, floor, files).unionByName(_further_copies(source, k))
    if floor > 0:
        return found
    # Zero vectors: similarity 0 to all, so their neighbours are the lowest ids. k + 1 ids reach the driver.
    source = source.where(_complete("vector"))
    lowest = [r["id"] for r in source.select("id").distinct().orderBy("id").limit(k + 1).collect()]
    zero = source.where(F.forall("vector", lambda x: x == 0)).select("id").distinct()
    others = F.slice(F.filter(F.array(*map(F.lit, lowest)).cast("array<bigint>"), lambda x: x != F.col("id")), 1, k)
    return found.unionByName(zero.select("id", F.explode(others).alias("other"), F.lit(0.0).alias("similarity")))


def _further_copies(source: DataFrame, k: int) -> DataFrame:
    """For copies of one vector beyond the k + 1 lowest ids: the k lowest ids. They are in no one else's neighbours, so the index leaves them out."""
    solid = F.exists("vector", lambda x: x != 0)
    hashed = source.where(solid).select("id", F.xxhash64("vector").alias("h"), F.hash("vector").alias("g"))
    # A rank with a bound keeps k + 1 rows of a group in each task before anything is shuffled, however many copies there are.
    rank = F.dense_rank().over(Window.partitionBy("h", "g").orderBy("id"))
    lowest = hashed.withColumn("n", rank).where(F.col("n") <= k + 1).groupBy("h", "g").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    large = lowest.where(F.size("ids") == k + 1).select("h", "g", F.slice("ids", 1, k).alias("near"), F.element_at("ids", -1).alias("bound"))
    beyond = hashed.join(large, ["h", "g"]).where(F.col("id") > F.col("bound"))
    return beyond.select("id", F.explode("near").alias("other"), F.lit(1.0).alias("similarity")).distinct()


def _indexed(source: DataFrame, rows: int, k: int, floor: float, files: int | None) -> DataFrame:
    """nearest for the vectors that aren't zero. rows: about how many there are."""
    spark = source.sparkSession
    model = fit(source, "vector", rows)
    empty = "id bigint, other bigint, similarity double"
    if model is None:
        return spark.createDataFrame([], empty)
    pivots, keep = len(model[1]), k + 1
    width = min(PREFIX, pivots)
    share = 0.0 if floor >= NEAR else FAR_SHARE

    def own(depth: int) -> int:
        doublings = max(0, int(np.log2(max(1, rows) / (pivots * ROWS_A_PIVOT))))
        return files or (FILES if floor >= NEAR else min(FAR_FILES, FILES + doublings) if depth == 1 else FAR_FILES)

    depth = _depth(rows, pivots, width, own)
    each = own(depth)
    shared = spark.sparkContext.broadcast(model)

    def posted(batches):
        centre, points, power = shared.value
        for batch in batches:
            matrix, good = _matrix(batch.column("vector"))
            solid = np.abs(matrix).sum(1) > 0
            matrix, ids = matrix[solid], np.asarray(batch.column("id"))[good][solid]
            # Copies in a batch are posted once, with their lowest ids.
            index: dict[bytes, list[int]] = {}
            for start in range(0, len(matrix), SLICE):
                for row, data in enumerate(_packed(matrix[start : start + SLICE], power), start):
                    index.setdefault(data, []).append(row)
            if not index:
                continue
            heads = [at[0] for at in index.values()]
            order = _permutations(_units(matrix[heads], centre), points, width)
            to = _files(order, each, depth, pivots)
            at = np.repeat(np.arange(len(heads)), to.shape[1])
            members = pa.array([np.unique(ids[at])[:keep].tolist() for at in index.values()], pa.list_(pa.int64()))
            columns = [members, pa.array([o.tobytes() for o in order], pa.binary()), pa.array(list(index), pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(to.ravel()), *[c.take(pa.array(at)) for c in columns]], names=["file", "members", "permutation", "packed"])

    postings = source.mapInArrow(posted, "file bigint, members array<bigint>, permutation binary, packed binary")

    def compared(table: pa.Table) -> pa.Table:
        index: dict[bytes, int] = {}
        members: list[list[int]] = []
        first: list[int] = []
        for row, (data, ids) in enumerate(zip(table.column("packed").to_pylist(), table.column("members").to_pylist(), strict=True)):
            at = index.setdefault(data, len(members))
            if at == len(members):
                members.append(ids)
                first.append(row)
            else:
                members[at] = sorted({*members[at], *ids})[:keep]
        order = np.stack([np.frombuffer(p, np.int16) for p in table.column("permutation").take(pa.array(first)).to_pylist()])
        matrix = np.stack([_unpacked(p) for p in index])
        found = _nearest_ids(members, *_best(matrix, order, keep, floor, share), k)
        return pa.table([pa.array(f, t) for f, t in zip(found, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["id", "other", "similarity"])

    pairs = postings.groupBy("file").applyInArrow(compared, empty)
    # A row's finds in its files, at most k from each, are merged.
    merged = pairs.groupBy("id").agg(F.slice(F.array_sort(F.collect_set(F.struct((-F.col("similarity")).alias("far"), "other"))), 1, k).alias("best"))
    return merged.select("id", F.explode("best").alias("b")).select("id", F.col("b.other").alias("other"), (-F.col("b.far")).alias("similarity"))


def mutual_pairs(df: DataFrame, key: str, vector: str, k: int = 5, floor: float = 0.9, files: int | None = None) -> DataFrame:
    """Pairs id_a < id_b in which each is among the other's k most similar and the similarity is at least `floor`, which is above 0."""
    source, count = _source(df, key, vector)
    found = _indexed(source, count, k, floor, files)
    ordered = found.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b"), "id")
    return ordered.groupBy("id_a", "id_b").agg(F.countDistinct("id").alias("sides")).where("sides = 2").select("id_a", "id_b")
