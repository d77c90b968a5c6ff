import json
import random
from itertools import product

from filequarry.operators import drift

RECORDS = "rec_id bigint, run_id bigint, device_id bigint, path string, meta_data string, key string, run_no string"
RUNS = "run_id bigint, device_id bigint, run_no bigint, key string"


def kind(v):
    return None if v is None else "boolean" if isinstance(v, bool) else "integer" if isinstance(v, int) else "decimal" if isinstance(v, float) else "string" if isinstance(v, str) else "array" if isinstance(v, list) else "object"


def expected(records, runs):
    numbers, by = {r[0]: (r[1], r[2]) for r in runs}, {}
    for number in numbers.values():
        by[number] = {}
    for _, run, _, path, meta, *_ in records:
        if meta is not None and run in numbers:
            by[numbers[run]].setdefault(path, []).append(json.loads(meta))
    out = set()
    for (device, no), new in by.items():
        if (device, no - 1) not in by:
            continue
        old = by[device, no - 1]
        ko, kn = ({k for ms in side.values() for m in ms for k in m} for side in (old, new))
        renamed = set()
        for o, n in product(ko - kn, kn - ko):
            values = [({json.dumps(m.get(o)) for m in old[p]} - {"null"}, {json.dumps(m.get(n)) for m in new[p]} - {"null"}) for p in set(old) & set(new) if p is not None]
            if any(a for a, _ in values) and all(a == b for a, b in values):
                renamed.add((o, n))
        out |= {(device, no, "renamed", o, n) for o, n in renamed}
        out |= {(device, no, "removed", o, "") for o in ko - kn - {o for o, _ in renamed}}
        out |= {(device, no, "added", "", n) for n in kn - ko - {n for _, n in renamed}}
        for k in ko & kn:
            a, b = ({kind(m[k]) for ms in side.values() for m in ms if k in m} - {None} for side in (old, new))
            if a and b and a != b:
                out.add((device, no, "retyped", k, k))
    return out


def test_changes_against_brute_force(spark):
    rng = random.Random(5)
    runs = [(10 * d + n, d, n, "clash") for d in range(1, 5) for n in range(1, 6)]
    values = [1, 2.5, 2.0, "1", True, None, [1], {"a": 1}, "x", 10**20]
    records, rec = [], 0
    for run, device, no, _ in runs:
        names = rng.sample(["a", "b", "c", "d:e", "f g", "ü"], 4)
        for path in "pqrs":
            meta = {k: values[(hash((device, path, i // 2)) + (no if rng.random() < 0.1 else 0)) % len(values)] for i, k in enumerate(names) if rng.random() < 0.9}
            records.append((rec := rec + 1, run, device, path, json.dumps(meta) if rng.random() < 0.9 else None, "clash", "clash"))
    # One concept under a name of its own in each run, its values kept.
    for run, device, no, _ in runs:
        for path in "pq":
            records.append((rec := rec + 1, run, device, path, json.dumps({f"name{no}": f"value of {path}"}), "clash", "clash"))
    records += [(rec + 1, 11, 1, None, '{"lost": 1}', None, None), (rec + 2, 999, 1, "p", '{"unknown run": 1}', None, None), *records[:3]]
    got = drift.changes(spark.createDataFrame(records, RECORDS), spark.createDataFrame(runs, RUNS)).collect()
    assert {tuple(r) for r in got} == expected(records, runs)
    assert len(got) == len(set(got))


def test_empty_and_broken(spark):
    runs = spark.createDataFrame([(1, 1, 1, ""), (2, 1, 2, ""), (2, 1, 2, "")], RUNS)
    broken = spark.createDataFrame([(1, 1, 1, "p", '{"a": 1}', "", ""), (2, 2, 1, "p", "{broken", "", ""), (3, 2, 1, "q", "[1]", "", "")], RECORDS)
    assert {tuple(r) for r in drift.changes(broken, runs).collect()} == {(1, 2, "removed", "a", "")}
    assert drift.changes(spark.createDataFrame([], RECORDS), spark.createDataFrame([], RUNS)).count() == 0


def test_consistent_table(spark):
    runs = spark.createDataFrame([(d * 10 + n, d, n, "") for d in (1, 2) for n in (1, 2)], RUNS)
    rows = [(d * 100 + n * 10 + i, d * 10 + n, d, p, json.dumps({("size" if n == 1 else "bytes"): i + 7, "t": "x" if i else None}), "", "") for d in (1, 2) for n in (1, 2) for i, p in enumerate("pq")]
    rows.append((900, 11, 1, "r", '{"size": "many"}', "", ""))
    rows.append((901, 11, 1, "s", None, "", ""))
    table = drift.consistent_table(spark.createDataFrame(rows, RECORDS), runs)
    got = {r["rec_id"]: r for r in table.collect()}
    column = next(c for c in table.columns if c in ("md_size", "md_bytes"))
    assert dict(table.dtypes)[column] == "bigint" and len(table.columns) == 7
    assert [got[i][column] for i in (110, 121, 900, 901)] == [7, 8, None, None]
    assert got[900]["failed_casts"] == {"size": '"many"'} and got[110]["failed_casts"] == {}


def test_rare_keys_share_one_column(spark):
    runs = spark.createDataFrame([(1, 1, 1, "")], RUNS)
    rows = [(i, 1, 1, f"p{i}", json.dumps({"common": i, f"rare{i}": [i], "often": "x"}), "", "") for i in range(30)] + [(99, 1, 1, "q", None, "", "")]
    table = drift.consistent_table(spark.createDataFrame(rows, RECORDS), runs, most=2)
    assert table.columns == ["rec_id", "run_id", "device_id", "path", "md_common", "md_often", "failed_casts", "other_keys"]
    got = {r["rec_id"]: r for r in table.collect()}
    assert got[7]["md_common"] == 7 and got[7]["other_keys"] == {"rare7": "[7]"} and got[99]["other_keys"] is None
    assert "other_keys" not in drift.consistent_table(spark.createDataFrame(rows, RECORDS), runs, most=40).columns


def test_renamings_are_counted_by_device(spark):
    runs = spark.createDataFrame([(d * 10 + n, d, n, "") for d in (1, 2) for n in (1, 2)], RUNS)
    rows = [(d * 100 + n, d * 10 + n, d, "p", json.dumps({("a" if n == 1 else "b" if d == 1 else "c"): 5}), "", "") for d in (1, 2) for n in (1, 2)]
    got = drift.renamings(drift.changes(spark.createDataFrame(rows, RECORDS), runs)).collect()
    assert {tuple(r) for r in got} == {("a", "b", 1), ("a", "c", 1)}
