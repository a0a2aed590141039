"""Sliced forms against plain Python on rows where one key dominates."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from gaugework.operators import ordered
from gaugework.operators.hot_keys import lookup
from gaugework.session import ROWS_PER_SLICE, materialize, slice_count


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    out = []
    for n in range(3000):
        key = "hot" if rng.random() < 0.9 else f"k{rng.randrange(40)}"
        out.append((key, n, float(rng.randrange(500)) if rng.random() < 0.95 else None, rng.random() < 0.01))
    out.append(("empty", 3000, None, False))
    return out


@pytest.fixture
def frame(sliced, rows):
    return sliced.createDataFrame(rows, "key string, n int, value double, flag boolean").repartition(5)


def by_key(rows):
    groups = {}
    for row in sorted(rows, key=lambda r: r[1]):
        groups.setdefault(row[0], []).append(row)
    return groups


def test_slices_follow_the_rows(frame, rows):
    kept = materialize(frame)
    assert slice_count(kept) == -(-len(rows) // 100)
    assert slice_count(kept.limit(5)) == 1
    sizes = ordered.ordered_slices(frame, ["key"], [F.col("n")]).groupBy("key", ordered.SLICE).count()
    assert sizes.agg(F.max("count")).first()[0] < 300 < sum(r[0] == "hot" for r in rows)


def test_number_rows(frame, rows):
    out = ordered.number_rows(frame, ["key"], [F.col("n")], "pos").collect()
    want = {(k, r[1]): i + 1 for k, g in by_key(rows).items() for i, r in enumerate(g)}
    assert {(r.key, r.n): r.pos for r in out} == want


def test_global_numbers(frame, rows):
    out = ordered.number_rows(frame, [], [F.desc("n")], "pos").collect()
    assert all(r.pos == len(rows) - r.n for r in out) and len(out) == len(rows)


def test_previous_and_running(frame, rows):
    prev = ordered.previous_values(frame, ["key"], [F.col("n")], {"p": "n", "pv": "value"}).collect()
    want = {}
    for k, g in by_key(rows).items():
        for a, b in zip([None] + g[:-1], g):
            want[(k, b[1])] = (a[1], a[2]) if a else (None, None)
    assert {(r.key, r.n): (r.p, r.pv) for r in prev} == want
    seen = ordered.running_any(frame, ["key"], [F.col("n")], "flag", "seen").collect()
    before = ordered.running_any(frame, ["key"], [F.col("n")], "flag", "seen", False).collect()
    incl, excl = {}, {}
    for k, g in by_key(rows).items():
        found = False
        for r in g:
            excl[(k, r[1])] = found
            found = found or r[3]
            incl[(k, r[1])] = found
    assert {(r.key, r.n): r.seen for r in seen} == incl
    assert {(r.key, r.n): r.seen for r in before} == excl


@pytest.mark.parametrize("whole", [True, False])
def test_percentiles(spark, frame, rows, whole):
    if whole:
        spark.conf.unset(ROWS_PER_SLICE)
    out = ordered.exact_percentiles(
        frame, ["key"], "value", {"p50": 0.5, "p95": 0.95, "p0": 0.0}, {"rows": (F.count("*"), F.sum)}
    ).collect()
    assert len(out) == len(by_key(rows))
    for r in out:
        values = sorted(x[2] for x in by_key(rows)[r.key] if x[2] is not None)
        assert r.rows == len(by_key(rows)[r.key])
        if not values:
            assert r.p50 is None and r.p95 is None
            continue
        assert r.p50 == statistics.median(values) and r.p0 == values[0]
        at = 0.95 * (len(values) - 1)
        low = int(at)
        high = min(low + 1, len(values) - 1)
        assert r.p95 == pytest.approx(values[low] + (values[high] - values[low]) * (at - low))


def test_salted_lookup(frame, rows, monkeypatch):
    import gaugework.operators.hot_keys as hot_keys

    monkeypatch.setattr(hot_keys, "ROWS_PER_SALT", 50)
    table = frame.sparkSession.createDataFrame(
        [(f"k{i}", i) for i in range(30)] + [("hot", 99)], "key string, mark int"
    )
    out = lookup(frame, table, ["key"], "left", ["n"]).collect()
    want = {f"k{i}": i for i in range(30)} | {"hot": 99}
    assert len(out) == len(rows)
    assert all(r.mark == want.get(r.key) for r in out)
    inner = lookup(frame, table, ["key"], "inner", ["n"]).count()
    assert inner == sum(r[0] in want for r in rows)
