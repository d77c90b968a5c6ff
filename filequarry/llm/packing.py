"""Items of varying length in containers of fixed capacity: large-item matching, then best fit into what room is left.

Whether items fit depends on their sizes alone, so the plan is made for the histogram of sizes, which has no more rows than the
capacity, and items are then dealt to the plan's places by their rank among items of equal size. No item reaches the driver and no
container's contents are gathered anywhere.
"""

from __future__ import annotations

import bisect
from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filequarry.session import checkpointed

ROWS_IN_A_BUCKET = 200_000


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Places for counts[size] items of each size from 1 to capacity: (size, from_rank, to_rank, first container, items a container).

    Items of a size with ranks from_rank <= r < to_rank go to container first + (r - from_rank) // items_a_container. Second: how
    many containers there are. Items above a third of the capacity, of which no three fit together, are matched first: the largest
    left with the largest that fits beside it. All others go, largest first, into the container with the least room that takes them.
    """
    places: list[tuple[int, int, int, int, int]] = []
    used: dict[int, int] = defaultdict(int)
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> runs of containers (first, how many)
    order: list[int] = []  # rooms that some container has, sorted
    total = 0

    def put(size: int, first: int, containers: int, each: int) -> None:
        places.append((size, used[size], used[size] + containers * each, first, each))
        used[size] += containers * each

    def leave(room: int, first: int, containers: int) -> None:
        if room and containers:
            if not gaps[room]:
                bisect.insort(order, room)
            gaps[room].append((first, containers))

    left = {s: n for s, n in counts.items() if n > 0 and 0 < s <= capacity}
    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        size = large[-1]
        at = bisect.bisect_right(large, capacity - size) - 1
        if at < 0:
            n, mate = left[size], None
        else:
            mate = large[at]
            n = left[size] // 2 if mate == size else min(left[size], left[mate])
            if n == 0:  # one item is left, which can't be its own mate
                at -= 1
                mate = large[at] if at >= 0 else None
                n = 1 if mate is None else min(left[size], left[mate])
        if mate == size:
            put(size, total, n, 2)
        else:
            put(size, total, n, 1)
            if mate is not None:
                put(mate, total, n, 1)
        leave(capacity - size - (mate or 0), total, n)
        total += n
        for s in {size, mate} - {None}:
            left[s] -= n * (2 if size == mate else 1)
            if not left[s]:
                del left[s]
                large.remove(s)
    for size in sorted(left, reverse=True):
        n = left[size]
        while n:
            at = bisect.bisect_left(order, size)
            if at < len(order):
                room = order[at]
                first, containers = gaps[room].pop()
                if not gaps[room]:
                    order.pop(at)
            else:
                room, first = capacity, total
                containers = -(-n // (capacity // size))
                total += containers
            each = room // size
            full = min(containers, n // each)
            rest = n - full * each if full < containers else 0
            if full:
                put(size, first, full, each)
                leave(room - each * size, first, full)
            if rest:
                put(size, first + full, 1, rest)
                leave(room - rest * size, first + full, 1)
            leave(room, first + full + bool(rest), containers - full - bool(rest))
            n -= full * each + rest
    return places, total


def pack(items: DataFrame, keys: list[str], size: str, capacity: int) -> DataFrame:
    """Each item, or each part of one larger than the capacity, with its container: keys, part, first, size, container.

    Only an item larger than the capacity is split, into parts of the whole capacity and a rest; first is where the part begins.
    Items of size 0 take no room and are in container 0; those of null or negative size count as 0. Containers are numbered from 0
    without gaps. Rows with equal keys are packed one by one; null keys are keys like any other. An empty input gives no rows.
    """
    spark = items.sparkSession
    amount = F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(0)), F.lit(0))
    parts = F.when(amount > 0, F.ceil(amount / capacity)).otherwise(1).cast("bigint")
    whole = items.select(*keys, amount.alias("_all"), F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("part"))
    sized = whole.select(*keys, F.col("part").cast("int").alias("part"), (F.col("part") * capacity).alias("first"), F.least(F.col("_all") - F.col("part") * capacity, F.lit(capacity)).alias("size"))
    sized = checkpointed(sized)  # the sizes are worked out once: for the histogram, and for dealing
    histogram = sized.groupBy("size").count().collect()  # no more rows than the capacity
    counts = {r["size"]: r["count"] for r in histogram}
    places, _ = plan({s: n for s, n in counts.items() if s}, capacity)
    schema = "_size bigint, low bigint, high bigint, base bigint, each bigint"
    places_df = spark.createDataFrame([*places, (0, 0, counts.get(0, 0), 0, max(1, counts.get(0, 0)))], schema)
    # A size may hold any share of the items: its ranks are counted bucket by bucket and the buckets' counts added up.
    buckets = max(8, -(-sum(counts.values()) // ROWS_IN_A_BUCKET))
    dealt = sized.withColumn("_bucket", F.pmod(F.xxhash64(*keys, "part"), F.lit(buckets)))
    within = Window.partitionBy("size", "_bucket").orderBy(*keys, "part")
    ranked = dealt.withColumn("_rank", F.row_number().over(within) - 1)
    before = dealt.groupBy("size", "_bucket").count()
    before = before.withColumn("_before", F.coalesce(F.sum("count").over(Window.partitionBy("size").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = ranked.join(before.select("size", "_bucket", "_before"), ["size", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    # The plan's length depends on the capacity only, some rows for each size: it is broadcast.
    placed = ranked.join(F.broadcast(places_df), (F.col("size") == F.col("_size")) & (F.col("_rank") >= F.col("low")) & (F.col("_rank") < F.col("high")))
    return placed.select(*keys, "part", "first", "size", (F.col("base") + F.floor((F.col("_rank") - F.col("low")) / F.col("each"))).cast("bigint").alias("container"))
