"""Orphan references against a direct version."""

import datetime as dt
import random

import numpy as np
import pytest

from locusloom.operators import references as R

T0 = dt.datetime(2020, 1, 1)


def day(k):
    return None if k is None else T0 + dt.timedelta(days=k)


def key(x):
    import re

    if x is None:
        return None
    x = x.strip(" \t")
    if x == "" or x.lower() == "na":
        return None
    if re.fullmatch(r"[0-9]+(\.0+)?", x):
        return str(int(x.split(".")[0]))
    return x.lower()


def test_clean_key(spark):
    given = ["007", "7.0", " 7\t", "7.", "7.01", "NA", " na ", "", "  ", None, "aB", "0", "000.00", "1e3", "-7"]
    df = spark.createDataFrame([(x,) for x in given], "x string").select(R.clean_key("x"))
    assert [r[0] for r in df.collect()] == [key(x) for x in given]


@pytest.mark.parametrize("seed,per_range,per_part", [(0, 20_000, 200_000), (1, 5, 7), (2, 1, 1)])
def test_equals_direct_version(spark, seed, per_range, per_part):
    rng = random.Random(seed)
    names = ["a", "A ", "b", "007", "7.0", "c", None, "NA", "d"]
    parents = [(rng.choice(names), day(rng.randrange(40)), day(rng.choice([None, rng.randrange(40)])), "x") for _ in range(25)] + [(None, None, None, "x"), ("d", None, None, "x")]
    refs = [(i, rng.choice([*names, "hot", "hot"]), day(rng.choice([None, *range(-3, 45)]))) for i in range(300)]
    p = spark.createDataFrame(parents, "id string, s timestamp, e timestamp, ref_table string")
    r = R.references(spark.createDataFrame(refs, "n long, k string, t timestamp"), "refs", "k", "n", "t")
    got = {x.row_id: (x.ref_month, x.status) for x in R.find_orphans([r], p, "id", "s", "e", per_range, per_part).collect()}
    want = {}
    for i, k, t in refs:
        if key(k) is None:
            continue
        spans = [(s, e or dt.datetime.max) for n, s, e, _ in parents if key(n) == key(k) and s is not None and s < (e or dt.datetime.max)]
        if t is None:
            want[i] = (None, "no_time")
        elif not any(s <= t < e for s, e in spans):
            kind = "unknown" if not spans else "too_early" if all(s > t for s, _ in spans) else "between" if any(s > t for s, _ in spans) else "deleted"
            want[i] = (t.strftime("%Y-%m"), kind)
    assert got == want


def test_empty_tables(spark):
    p = spark.createDataFrame([], "id string, s timestamp, e timestamp")
    r = R.references(spark.createDataFrame([(1, "a", T0)], "n long, k string, t timestamp"), "refs", "k", "n", "t")
    assert [x.status for x in R.find_orphans([r], p, "id", "s", "e").collect()] == ["unknown"]
    none = R.references(spark.createDataFrame([], "n long, k string, t timestamp"), "refs", "k", "n", "t")
    assert R.find_orphans([none], p, "id", "s", "e").count() == 0


def test_hash_collision():
    """Two keys of one hash value stay apart."""
    h, k = np.array([5, 5, 5, 9]), np.array(["b", "a", "a", "z"], object)
    r = R._Range(h, k, np.array([10, 0, 20, 0]), np.array([30, 5, 25, 1]))
    out = r.probe(np.array([5, 5, 5, 5, 9, 7]), np.array(["a", "b", "b", "c", "z", "a"], object), np.array([3, 3, 15, 3, 0, 0]), np.ones(6, bool))
    assert [R.STATUS[c] for c in out] == ["live", "too_early", "live", "unknown", "live", "unknown"]
