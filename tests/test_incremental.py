from datetime import datetime, timedelta

import pytest

from filequarry.operators import incremental as inc

RECORDS = "rec_id bigint, run_id bigint, device_id bigint, path string, sha256 binary, arrived_at timestamp_ntz, run_no string, _run string"
RUNS = "run_id bigint, device_id bigint, run_no bigint, status string, cutoff_at timestamp_ntz"
T0 = datetime(2024, 1, 1)


def runs(spark):
    return spark.createDataFrame([(1, 1, 1, "ok", T0), (2, 1, 2, "failed", T0), (3, 1, 3, "ok", T0), (3, 1, 3, "ok", T0), (4, 1, 4, None, T0)], RUNS)


def records(spark, rows):
    return spark.createDataFrame([(i, run, 1, path, sha, T0 + timedelta(days=late), "x", "y") for i, run, path, sha, late in rows], RECORDS)


def test_cases(spark):
    rows = [
        (1, 1, "same", b"a", 0), (2, 2, "same", b"a", 0),  # seen again unchanged, in a failed run
        (3, 1, "changed", b"a", 0), (4, 2, "changed", b"b", 0),
        (5, 2, "new", b"a", 0),
        (6, 3, "late", b"a", 1),  # came after the cut-off
        (7, 1, "null", b"a", 0), (8, 4, "null", None, 0),
        (9, 1, "done", b"a", 0), (10, 3, "done", b"b", 0),
        (11, 1, "restored", b"a", 0), (12, 3, "restored", b"b", 0), (13, 4, "restored", b"a", 0),
        (14, 1, "held null", None, 0), (15, 4, "held null", b"a", 0),
        (16, 99, "unknown run", b"a", 0),
        (17, 2, "twice", b"a", 0), (18, 2, "twice", b"a", 0), (18, 2, "twice", b"a", 0),
        (19, 1, None, b"a", 0), (20, 4, None, b"a", 0),
    ]
    got = sorted(r[0] for r in inc.next_batch(records(spark, rows), runs(spark)).collect())
    assert got == [4, 5, 6, 8, 13, 15, 16, 18]
    assert inc.next_batch(records(spark, []), runs(spark)).count() == 0


def test_versions_are_published_whole(spark, tmp_path):
    target = inc.VersionedTarget(spark, str(tmp_path / "target"))
    assert target.current() is None and target.read() is None
    first = records(spark, [(1, 1, "a", b"x", 0), (2, 1, "b", b"y", 0)])
    assert target.advance(first, runs(spark)) == 1
    assert {r["path"] for r in target.read().collect()} == {"a", "b"}
    second = records(spark, [(1, 1, "a", b"x", 0), (2, 1, "b", b"y", 0), (3, 2, "a", b"x", 0), (4, 2, "b", b"z", 0)])
    seen = []

    def process(todo):
        seen.extend(r["rec_id"] for r in todo.collect())
        return todo

    assert target.advance(second, runs(spark), process) == 2 and seen == [4]
    assert {(r["path"], r["rec_id"]) for r in target.read().collect()} == {("a", 1), ("b", 4)}

    def dies(todo):
        raise RuntimeError

    third = records(spark, [(5, 3, "c", b"q", 0)])
    with pytest.raises(RuntimeError):
        target.advance(third, runs(spark), dies)
    assert target.current()["number"] == 2
    with pytest.raises(RuntimeError):  # another writer was first
        target.publish(target.read(), 1)
    assert target.advance(third, runs(spark)) == 3 and target.read().count() == 3


def test_a_run_writes_what_changed(spark, tmp_path):
    folder = tmp_path / "target"
    target = inc.VersionedTarget(spark, str(folder))
    first = [(i, 1, f"p{i}", b"x", 0) for i in range(2000)]
    assert target.advance(records(spark, first), runs(spark)) == 1

    def size():
        return sum(f.stat().st_size for f in folder.rglob("*.parquet"))

    def rows_written(part):
        return spark.read.parquet(str(folder / part)).count()

    whole = size()
    calls = spark.sparkContext.accumulator(0)

    def process(todo):
        def result(batches):
            for batch in batches:
                calls.add(len(batch))
                yield batch.assign(result=[__import__("uuid").uuid4().hex for _ in range(len(batch))])

        return todo.mapInPandas(result, todo.schema.simpleString()[7:-1].replace(":", " ") + ", result string")

    changed = first + [(5000 + i, 2, f"p{i}", b"y", 0) for i in range(20)]
    assert target.advance(records(spark, changed), runs(spark), process) == 2
    assert rows_written(target.current()["parts"][-1]) == 20 and calls.value == 20 and size() < 1.5 * whole
    held = target.read()
    assert held.count() == 2000 and held.where("sha256 = X'79'").count() == 20
    assert held.select("path", "result").exceptAll(target.read().select("path", "result")).count() == 0  # results stand, though they are random
    assert target.compact() == 3 and len(target.current()["parts"]) == 1 and target.read().count() == 2000
    assert target.advance(records(spark, changed), runs(spark)) == 4 and target.read().count() == 2000


def test_of_two_writers_one_wins(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    target = inc.VersionedTarget(spark, str(tmp_path / "target"))
    rows = records(spark, [(1, 1, "a", b"x", 0)])
    assert target.advance(rows, runs(spark)) == 1

    def commit(n):
        try:
            target._commit(2, {"number": 2, "parts": [str(n)]})
            return n
        except RuntimeError:
            return None

    with ThreadPoolExecutor(8) as pool:
        won = [n for n in pool.map(commit, range(8)) if n is not None]
    assert len(won) == 1 and target.current()["parts"] == [str(won[0])]
