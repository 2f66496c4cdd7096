"""Filling of calls and counts against a direct version."""

import random

import pytest

from locusloom.operators import fill as P

DDL = "marker_id long, call_batch string, chrom int, pos long, data_format string, raw_snps array<tinyint>, n_typed int, missing_counts int, call_method string, extra string"


def table(spark, rows):
    return spark.createDataFrame(rows, DDL)


def ok(v, fmt):
    return v in (0, 1) or (v == 2 and fmt == "diploid_int")


def direct_calls(rows, gap):
    out = {}
    for mid, b, c, pos, fmt, calls, *_ in rows:
        if calls is None:
            continue
        seen = [v for v in calls if ok(v, fmt)]
        filled = []
        for s, v in enumerate(calls):
            if ok(v, fmt) or not seen:
                filled.append((v if ok(v, fmt) else None, 0 if ok(v, fmt) else None))
                continue
            near = []
            for m2, b2, c2, p2, f2, k2, *_ in rows:
                if (b2, c2) == (b, c) and pos and p2 and k2 is not None and s < len(k2) and ok(k2[s], f2):
                    side = 0 if (p2, m2) < (pos, mid) else 1
                    near.append((side, p2, m2, k2[s]))
            before = max(((p, m, v2) for side, p, m, v2 in near if side == 0), default=None)
            after = min(((p, m, v2) for side, p, m, v2 in near if side == 1), default=None)
            best = [(abs(pos - x[0]), k, x[2]) for k, x in enumerate((before, after)) if x and abs(pos - x[0]) <= gap and ok(x[2], fmt)]
            if best:
                d, k, v2 = min(best)
                filled.append((v2, 2 if k == 0 else 1))
            else:
                filled.append((max((0, 1, 2), key=lambda g: (seen.count(g), -g)), 3))
        out[mid] = filled
    return out


@pytest.mark.parametrize("seed,gap,size", [(0, 150, 4096), (1, 400, 3), (2, 10**6, 5), (3, 10**6, 1), (4, 1, 2)])
def test_calls_equal_direct_version(spark, seed, gap, size):
    """Whatever the limit, and whether an entity is one segment or many."""
    rng = random.Random(seed)
    rows = []
    for i in range(120):
        fmt = rng.choice(["binary", "diploid_int", None])
        calls = None if rng.random() < 0.05 else [rng.choice([0, 1, 2, 0, 1, -1, 9, None]) for _ in range(rng.choice([0, 3, 6]))]
        rows.append((i, rng.choice(["a", "b", None]), rng.choice([1, 2, None]), rng.choice([None, 0, *(rng.randrange(3000) for _ in range(8))]), fmt, calls, 90, 3, None, "x"))
    got = {r.marker_id: list(zip(r.calls, r.call_method)) for r in P.fill_calls(table(spark, rows), gap, size, least_rows=rng.choice([1, 1000])).collect()}
    assert got == direct_calls(rows, gap)


@pytest.mark.parametrize("size", [4096, 2, 1])
def test_counts(spark, size):
    rows = [
        (1, "a", 1, 100, "binary", [0], 90, 10, None, ""), (2, "a", 1, 200, "binary", [0], 90, None, None, ""), (3, "a", 1, 400, "binary", [0], 90, 40, None, ""), (4, "a", 1, 9_000_000, "binary", [0], 90, -1, None, ""),
        (5, "a", 1, None, "binary", [0], 90, 99, None, ""), (6, "b", 1, 5, "binary", [0], 90, 91, None, ""), (7, None, None, 1, "binary", [0], 90, None, None, ""), (8, None, None, 3, "binary", [0], 90, 5, None, ""),
        (9, "a", 1, 300, "binary", [0], 15, None, None, ""), (10, "d", 1, 12, "binary", [0], 15, None, None, ""), (11, "d", 1, 0, "binary", [0], 15, 7, None, ""),
    ]
    got = {r.marker_id: (r.missing_counts, r.count_method, r.count_distance) for r in P.fill_counts(table(spark, rows), size).collect()}
    assert got[2] == (20.0, "interpolated", 100) and got[4] == (40.0, "previous_marker", 8_999_600)
    assert got[1] == (10.0, "observed", 0) and got[5] == (10.0, "first_observed", None) and got[10] == (7.0, "first_observed", None)
    assert got[6] == (None, None, None) and got[7] == (5.0, "next_marker", 2)
    assert got[9] == (15.0, "interpolated", 100)


def test_whole_table(spark):
    rows = [(1, "a", 1, 1, "binary", None, 9, None, "clash", "x"), (2, "a", 1, 1, "binary", [], 9, 2, "clash", "x"), (3, "a", 1, 1, "binary", [1, None], 9, 3, "clash", "x")]
    out = P.fill_genotypes(table(spark, rows))
    assert out.columns.count("call_method") == 1 and "extra" in out.columns and out.count() == 3
    assert P.fill_genotypes(table(spark, [])).count() == 0
    slots = {tuple(r) for r in P.filled_slots(P.fill_calls(table(spark, rows)), P.fill_counts(table(spark, rows))).collect()}
    assert slots == {(3, 1), (1, -1)}


def test_methods(spark):
    rows = [(1, "a", 1, 100, "binary", [0, 1, None], 9, 2, None, ""), (2, "a", 1, 150, "binary", [1, None, None], 9, None, None, ""), (3, "b", 1, 150, "binary", [None], 9, None, None, "")]
    got = {(r.what, r.method): (r.n_values, r.mean_distance) for r in P.methods(P.fill_calls(table(spark, rows)), P.fill_counts(table(spark, rows))).collect()}
    assert got == {
        ("calls", "observed"): (3, 0), ("calls", "previous_marker"): (1, 50), ("calls", "marker_mode"): (2, None), ("calls", "open"): (1, None),
        ("missing_counts", "observed"): (1, 0), ("missing_counts", "previous_marker"): (1, 50), ("missing_counts", "open"): (1, None),
    }
