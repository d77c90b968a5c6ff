from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from filequarry.llm import packing


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 60), max_size=30), st.integers(60, 70))
def test_plans_hold_everything(counts, capacity):
    places, total = packing.plan(counts, capacity)
    fill, seen = Counter(), Counter()
    for size, low, high, base, each in places:
        assert seen[size] == low < high
        seen[size] = high
        for rank in range(low, high):
            fill[base + (rank - low) // each] += size
    assert seen == Counter(counts) and set(fill) == set(range(total))
    assert not fill or max(fill.values()) <= capacity
    # No two containers could be one, but for those of large items.
    halves = sum(2 * v <= capacity for v in fill.values())
    assert halves <= 1 + sum(3 * s > capacity for s in counts)


def test_large_items_are_matched():
    places, total = packing.plan({60: 5, 40: 5, 34: 6}, 100)
    assert total == 8 and len(places) == 3
    assert packing.plan({}, 100) == ([], 0) and packing.plan({50: 3}, 100)[1] == 2 and packing.plan({100: 2, 1: 1}, 100)[1] == 3


def test_many_small_items_fill_well():
    counts = {s: 1000 for s in range(1, 700, 7)}
    _, total = packing.plan(counts, 2048)
    assert sum(s * n for s, n in counts.items()) / total / 2048 > 0.998


def test_items(spark, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_IN_A_BUCKET", 3)
    rows = [(i, 7, "x", 1) for i in range(30)] + [(100, 25, "x", 1), (101, 0, "x", 1), (102, None, "x", 1), (103, -5, "x", 1), (None, 3, "x", 1), (None, 3, "x", 1), (104, 10, "x", 1)]
    items = spark.createDataFrame(rows, "id bigint, n bigint, size string, part int")
    got = packing.pack(items, ["id"], "n", 10).collect()
    fill = Counter()
    for r in got:
        fill[r["container"]] += r["size"]
    assert max(fill.values()) <= 10 and sum(fill.values()) == 30 * 7 + 25 + 6 + 10 and set(fill) == set(range(len(fill)))
    assert sorted((r["part"], r["first"], r["size"]) for r in got if r["id"] == 100) == [(0, 0, 10), (1, 10, 10), (2, 20, 5)]
    assert Counter(r["id"] for r in got) == Counter([i for i, *_ in rows] + [100, 100])
    assert {r["container"] for r in got if r["size"] == 0} == {0}
    assert len(fill) == 34  # 33 of full size, of which two take a 3 each, and the rest of 5
    assert packing.pack(items.limit(0), ["id"], "n", 10).count() == 0
