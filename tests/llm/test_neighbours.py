import numpy as np
import pytest

from filequarry.llm import neighbours


def brute(rows, k, floor=-1.0):
    ids = np.array(sorted(i for i, v in rows if i is not None and v is not None))
    matrix = np.array([dict(rows)[i] for i in ids], float)
    norms = np.linalg.norm(matrix, axis=1)
    similar = np.round(matrix @ matrix.T / np.maximum(norms[:, None] * norms, 1e-30), 9)
    np.fill_diagonal(similar, -9)
    top = np.argsort(-similar, axis=1, kind="stable")[:, :k]
    return {(int(ids[a]), int(ids[b])) for a in range(len(ids)) for b in top[a] if similar[a, b] >= floor}


def clusters(seed=3, n=40, size=8, width=48):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        centre = rng.normal(size=width)
        rows += [np.round((centre + rng.normal(size=width) * 0.12) * 32) / 32 for _ in range(size)]
    rows += [rng.normal(size=width) for _ in range(n * 4)]
    rows[5] = rows[4].copy()
    rows[6] = rows[4] * 2
    rows += [np.zeros(width)] * 3
    return [(i * 3 + 1, [float(np.float32(x)) for x in r]) for i, r in enumerate(rows)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], "id bigint, vector array<float>, file string")


def test_recall(spark):
    rows = clusters()
    got = {(r["id"], r["other"]) for r in neighbours.nearest(frame(spark, rows), "id", "vector", 5, 0.9).collect()}
    want = brute(rows, 5, 0.9)
    assert len(got & want) / len(want) >= 0.97 and len(got - want) <= 0.03 * len(want)
    every = {(r["id"], r["other"]) for r in neighbours.nearest(frame(spark, rows), "id", "vector").collect()}
    close = brute(rows, 5, 0.6)
    assert len(every & close) / len(close) >= 0.97
    mutual = {(a, b) for a, b in want if a < b and (b, a) in want}
    pairs = {tuple(r) for r in neighbours.mutual_pairs(frame(spark, rows), "id", "vector").collect()}
    assert len(pairs & mutual) / len(mutual) >= 0.97


def test_a_hot_group_of_copies(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(300)] + [(1000 + i, rng.normal(size=3).tolist()) for i in range(50)]
    got = {}
    for r in neighbours.nearest(frame(spark, rows).repartition(7), "id", "vector", 5, 0.999999).collect():
        got.setdefault(r["id"], []).append(r["other"])
    assert sorted(got[0]) == [1, 2, 3, 4, 5] and sorted(got[5]) == [0, 1, 2, 3, 4]
    assert sorted(got[299]) == [0, 1, 2, 3, 4] and len(got) >= 300


def test_long_files_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 8)
    monkeypatch.setattr(neighbours, "ROWS_A_PIVOT", 10_000)
    rows = clusters(seed=8, n=12, size=6)
    got = {(r["id"], r["other"]) for r in neighbours.nearest(frame(spark, rows), "id", "vector", 5, 0.9).collect()}
    want = brute(rows, 5, 0.9)
    assert len(got & want) / len(want) >= 0.95


def test_a_large_table_is_searched_by_the_same_rule(spark, monkeypatch):
    """Few pivots stand for many rows a pivot: far neighbours are found all the same."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=24)]) for i in range(1500)]
    want = brute(rows, 5)
    monkeypatch.setattr(neighbours, "MOST_PIVOTS", 24)
    monkeypatch.setattr(neighbours, "BLOCK", 300)
    got = {(r["id"], r["other"]) for r in neighbours.nearest(frame(spark, rows), "id", "vector").collect()}
    assert len(got & want) / len(want) >= 0.95


def test_odd_lengths_and_a_single_vector(spark):
    odd = [(i, [1.0, 2.0, 3.0] if i % 3 == 0 else []) for i in range(9)]
    got = {(r["id"], r["other"]) for r in neighbours.nearest(frame(spark, odd).coalesce(1), "id", "vector", 2, 0.9).collect()}
    assert got == {(0, 3), (0, 6), (3, 0), (3, 6), (6, 0), (6, 3)}
    single = frame(spark, [(i, [1.0, 2.0, 3.0]) for i in range(900)])
    assert neighbours.nearest(single, "id", "vector", 2, 0.9).count() == 1800


def test_edges(spark):
    assert neighbours.nearest(frame(spark, []), "id", "vector").count() == 0
    zeros = [(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 0.0]), (4, None), (None, [1.0, 1.0])]
    got = {(r["id"], r["other"], r["similarity"]) for r in neighbours.nearest(frame(spark, zeros), "id", "vector", 2).collect()}
    assert {g for g in got if g[0] in (1, 2)} == {(1, 2, 0.0), (1, 3, 0.0), (2, 1, 0.0), (2, 3, 0.0)}
    assert neighbours.mutual_pairs(frame(spark, zeros), "id", "vector").count() == 0
    twice = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0])]
    assert [tuple(r) for r in neighbours.mutual_pairs(frame(spark, twice), "id", "vector").collect()] == [(1, 2)]


@pytest.mark.parametrize("scale", [32, 1, 0.37, 3200])
def test_packing_is_exact(scale):
    rows = np.random.default_rng(2).normal(size=(70, 16))
    rows = (np.rint(rows * scale) / scale if scale != 0.37 else rows).astype(np.float32)
    rows[69] = 1e30
    assert all((neighbours._unpacked(p) == r).all() for p, r in zip(neighbours._packed(rows), rows, strict=True))


def test_a_vector_has_as_many_files_at_every_depth():
    order = np.stack([np.random.default_rng(i).permutation(40)[:16] for i in range(50)]).astype(np.int16)
    for own, depth in ((5, 1), (4, 2), (12, 2), (12, 3)):
        files = neighbours._files(order, own, depth, 40)
        assert files.shape == (50, own) and all(len(set(row)) == own for row in files.tolist())
    assert neighbours._depth(3_000_000, 4096, 16, lambda d: 5) == 1 and neighbours._depth(10**8, 4096, 16, lambda d: 5) == 2 and neighbours._depth(10**11, 4096, 16, lambda d: 5) == 4


def test_footrule_is_what_it_says():
    rng = np.random.default_rng(2)
    order = np.stack([rng.permutation(30)[:6] for _ in range(40)])
    numbered, place = neighbours._places(order)
    got = neighbours._footrule(numbered, np.arange(40), place)
    for a in range(40):
        for b in range(40):
            x, y = order[a].tolist(), order[b].tolist()
            want = sum(abs((x.index(p) if p in x else 6) - (y.index(p) if p in y else 6)) for p in set(x) | set(y))
            assert got[a, b] == want


def test_products_are_made_for_candidates_only(monkeypatch):
    """With candidates left out by footrule distance, near neighbours are still found."""
    monkeypatch.setattr(neighbours, "CANDIDATES", 20)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(100, 32))
    rows = np.repeat(centres, 6, axis=0) + rng.normal(size=(600, 32)) * 0.1
    rows = rows.astype(np.float32)
    units = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    order = neighbours._permutations(units, units[rng.permutation(600)[:64]], 16)
    q, o, s = neighbours._best(rows, order, 6, 0.9, 0.0)
    exact = units.astype(float) @ units.T.astype(float)
    np.fill_diagonal(exact, -1)
    want = {(a, b) for a in range(600) for b in np.argsort(-exact[a])[:5] if exact[a, b] >= 0.9}
    got = set(zip(q.tolist(), o.tolist(), strict=True))
    assert len(got & want) / len(want) > 0.97 and np.allclose(s, [exact[a, b] for a, b in zip(q, o, strict=True)], atol=1e-6)


def test_several_pivots_name_the_files_of_a_large_table(spark, monkeypatch):
    rows = clusters(seed=9, n=40, size=8)
    monkeypatch.setattr(neighbours, "MOST_PIVOTS", 24)
    monkeypatch.setattr(neighbours, "BLOCK", 30)
    assert neighbours._depth(len(rows), 24, 16, lambda d: 5) == 2
    want = brute(rows, 5, 0.9)
    got = {(r["id"], r["other"]) for r in neighbours.nearest(frame(spark, rows), "id", "vector", 5, 0.9).collect()}
    assert len(got & want) / len(want) >= 0.95


def test_what_takes_no_part_is_listed(spark):
    rows = [(1, [1.0, 2.0]), (2, [2.0, 1.0]), (3, [1.0]), (4, None), (None, [1.0, 1.0]), (5, [float("nan"), 1.0]), (6, [float("-inf"), 1.0]), (7, [None, 1.0]), (8, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "id bigint, vector array<float>")
    got = {(r["id"], r["reason"]) for r in neighbours.rejected(df, "id", "vector").collect()}
    assert got == {(3, "length"), (4, "no vector"), (None, "no key"), (5, "value"), (6, "value"), (7, "value")}
    near = {(r["id"], r["other"]) for r in neighbours.nearest(df, "id", "vector", 2).collect()}
    assert near == {(1, 2), (2, 1), (8, 1), (8, 2)}
