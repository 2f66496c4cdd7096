"""Percentile summaries: stated error bound, merging, edge cases."""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from locusloom.llm import quantiles as Q

PROBS = [0.05, 0.25, 0.5, 0.75, 0.95]


def rank_error(sorted_x, value, p):
    n = len(sorted_x)
    want = int(np.clip(math.ceil(p * n), 1, n))
    lo, hi = np.searchsorted(sorted_x, value, "left") + 1, np.searchsorted(sorted_x, value, "right")
    return max(0, lo - want, want - hi)


@pytest.mark.parametrize("slices,eps", [(1, 0.01), (4, 0.002)])
def test_bound_holds_over_days_and_partitions(spark, slices, eps):
    rng = np.random.default_rng(7)
    n = 60_000
    t = pd.DataFrame({"k": rng.choice([1, 2, 3], n, p=[0.7, 0.299, 0.001]), "day": rng.integers(0, 9, n), "x": np.round(rng.exponential(size=n), 2)})
    t.loc[rng.random(n) < 0.05, "x"] = np.nan
    daily = Q.summarize(spark.createDataFrame(t).repartition(12), ["k", "day"], "x", eps, slices, block=3000)
    for s, keys in ((daily, ["k", "day"]), (Q.merge_summaries(daily, ["k"], slices), ["k"])):
        rows = Q.percentiles(s, keys, PROBS).collect()
        groups = {k if isinstance(k, tuple) else (k,): np.sort(g["x"].dropna()) for k, g in t.groupby(keys)}
        assert {tuple(r[k] for k in keys) for r in rows} == set(groups)
        for r in rows:
            x = groups[tuple(r[k] for k in keys)]
            assert r.n == len(x)
            assert r.rank_error <= eps * r.n
            for p in PROBS:
                assert rank_error(x, r[f"p{round(100 * p):02d}"], p) <= r.rank_error


def test_summaries_stay_small(spark):
    t = pd.DataFrame({"k": np.zeros(50_000, int), "x": np.random.default_rng(1).normal(size=50_000)})
    s = Q.summarize(spark.createDataFrame(t).repartition(8), ["k"], "x", 0.01).selectExpr("size(v) as m").first().m
    assert s < 2000


def test_edge_cases(spark):
    rows = [(None, 1.0), (None, 3.0), ("a", math.nan), ("a", None), ("b", math.inf), ("b", -math.inf), ("b", 0.0), ("c", 5.0), ("d", 2.0), ("d", 2.0)]
    df = spark.createDataFrame(rows, "k string, x double").selectExpr("k", "x", "'clash' as v", "1 as n")
    got = {r.k: r for r in Q.percentiles(Q.summarize(df, ["k"], "x"), ["k"], [0.5]).collect()}
    assert set(got) == {None, "b", "c", "d"}
    assert got["b"].p50 == 0.0 and got["c"].p50 == 5.0 and got["d"].n == 2 and got[None].p50 == 1.0
    assert all(r.rank_error == 0 for r in got.values())
    assert Q.summarize(df.filter("false"), ["k"], "x").count() == 0
    with pytest.raises(ValueError):
        Q.summarize(df, ["k"], "x", 0)


def summary(x, eps, level=0):
    x = np.sort(np.asarray(x, float))
    z = np.zeros(len(x), np.int64)
    _, v, g, d = Q.compress(z, x, z + 1, z, Q.permitted(np.array([len(x)]), np.array([eps]), np.array([level])))
    return pa.table({"k": [1], "n": [len(x)], "eps": [eps], "level": pa.array([level], pa.int32()), "v": [v], "g": [g], "d": [d]})


def answers(t, probs=PROBS):
    out = list(Q._answers(["k"], probs)(pa.table(t).select(["k", "n", "v", "g", "d"]).combine_chunks().to_batches()))
    return out[0].to_pylist()[0]


def check(t, every, eps):
    every, r = np.sort(every), answers(t)
    assert r["n"] == len(every)
    assert r["rank_error"] <= eps * len(every)
    for p in PROBS:
        assert rank_error(every, r[f"p{round(100 * p):02d}"], p) <= r["rank_error"]


@pytest.mark.parametrize("seed,eps", [(0, 0.005), (1, 0.02), (2, 0.1)])
@pytest.mark.parametrize("shape", ["pairs", "chain", "mixed"])
def test_bound_holds_over_many_merge_levels(seed, eps, shape):
    """256 parts of unequal size, merged in pairs (8 levels), one after the other (255) or at random."""
    rng = np.random.default_rng(seed)
    parts = []
    for i in range(256):
        x = np.round(rng.exponential(size=int(rng.integers(1, 4000))) * rng.choice([0.1, 1, 10]), 2)
        parts.append((summary(x, eps), x))
    while len(parts) > 1:
        if shape == "pairs":
            pairs = [(parts[i], parts[i + 1]) for i in range(0, len(parts), 2)]
            rest = []
        else:
            i, j = (0, 1) if shape == "chain" else sorted(rng.choice(len(parts), 2, replace=False))
            pairs, rest = [(parts[i], parts[j])], [p for k, p in enumerate(parts) if k not in (i, j)]
        merged = []
        for (a, x), (b, y) in pairs:
            t = pa.Table.from_batches([Q.merge_parts(pa.concat_tables([a, b]), ["k"])])
            merged.append((t, np.concatenate([x, y])))
            uncertain = np.asarray(t["g"][0].as_py()) + np.asarray(t["d"][0].as_py())
            assert uncertain[1:].max(initial=0) <= max(2 * eps * t["n"][0].as_py(), 1)
        parts = merged + rest
        check(*parts[0], eps)
    assert len(parts[0][0]["v"][0]) < (2000 if shape == "pairs" and eps < 0.01 else 20_000)


def test_parts_of_one_group_merge_in_a_stream():
    """A task that holds few parts merges them on the way, and never mixes groups."""
    rng = np.random.default_rng(3)
    rows, every = [], {}
    for k, parts in ((1, 40), (2, 1), (3, 7), (None, 12)):
        for _ in range(parts):
            x = rng.normal(size=int(rng.integers(1, 900)))
            every.setdefault(k, []).append(x)
            rows.append(summary(x, 0.01).set_column(0, "k", pa.array([k], pa.int64())))
    t = pa.concat_tables(rows).combine_chunks()
    for fan_in, hold, step in ((4, 10**9, 3), (10**9, 500, 1), (5, 10**9, 100), (10**9, 10**9, 2)):
        got = list(Q._merge(["k"], fan_in, hold)(iter([b for k in range(0, t.num_rows, step) for b in t.slice(k, step).combine_chunks().to_batches()])))
        out = pa.Table.from_batches(got)
        assert sorted(map(str, out["k"].to_pylist())) == sorted(map(str, every))
        for i, k in enumerate(out["k"].to_pylist()):
            check(out.slice(i, 1), np.concatenate(every[k]), 0.01)


def test_summaries_of_unequal_precision():
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=5000), rng.normal(size=800)
    t = pa.Table.from_batches([Q.merge_parts(pa.concat_tables([summary(x, 0.01), summary(y, 0.05)]), ["k"])])
    assert t["eps"][0].as_py() == 0.05
    check(t, np.concatenate([x, y]), 0.05)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 20), min_size=1, max_size=40), min_size=1, max_size=6), st.integers(2, 12))
def test_merging_keeps_every_rank_interval(parts, most):
    group, part, v, g, d = [], [], [], [], []
    for k, p in enumerate(parts):
        x = np.sort(np.array(p, float))
        z = np.zeros(len(x), np.int64)
        a = Q.compress(z, x, z + 1, z, np.array([most]))
        assert (a[2] + a[3]).max() <= max(most, 1)
        group.append(a[0]), part.append(np.full(len(a[1]), k)), v.append(a[1]), g.append(a[2]), d.append(a[3])
    sg, sv, sgap, sd = Q.merge_tuples(*map(np.concatenate, (group, part, v, g, d)))
    assert (sgap + sd).max() <= most * len(parts)
    low = np.cumsum(sgap)
    every = np.sort(np.concatenate([np.array(p, float) for p in parts]))
    for lo, hi, x in zip(low, low + sd, sv):
        first, last = np.searchsorted(every, x, "left") + 1, np.searchsorted(every, x, "right")
        assert lo <= last and hi >= first
    assert low[-1] + sd[-1] == len(every)
