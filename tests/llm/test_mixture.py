"""Mixtures: shares, caps, order, schedules."""

import random
from pathlib import Path

import pytest

from locusloom.llm.mixture import Mixture, plan_shares, source_key

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not Path(TOKENIZER).exists(), reason="no tokenizer files here")


def documents(spark, sizes, seed=0):
    rng = random.Random(seed)
    rows, k = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            s = rng.choice([source, source.upper(), source.replace("_", "-"), f" {source}", source.replace("_", "__")])
            rows.append((k, s, " ".join(rng.choice(["seed", "marker", "Zürich", "42"]) for _ in range(rng.randrange(1, 30))), "clash"))
            k += 1
    rows += [(k, None, "text", ""), (k + 1, "a_one", None, ""), (k + 2, "a_one", "", ""), (k + 3, "other", "text text", "")]
    return spark.createDataFrame(rows, "doc_id long, source string, text string, n_tokens string")


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def test_source_key(spark):
    df = spark.createDataFrame([("Assoc__Reports ",), ("assoc-reports",), (None,)], "s string")
    assert [r[0] for r in df.select(source_key("s")).collect()] == ["assocreports", "assocreports", None]


def test_shares_caps_and_order(spark):
    docs = documents(spark, {"a_one": 400, "b_two": 60, "c_three": 200})
    t = targets(spark, [("a_one", 0.5, 1), ("b_two", 0.3, 3), ("c_three", 0.15, 2), ("absent", 0.05, 4)])
    m = Mixture(docs, t, TOKENIZER, bucket_rows=50, schedules={"b_two": [(0, 0.0), (1, 1.0)]})
    rows = m.rows.collect()
    rep = {r.source: r for r in m.report().collect()}
    for s, w in (("a_one", 0.5), ("b_two", 0.3), ("c_three", 0.15)):
        assert rep[s].actual_share == pytest.approx(w / 0.95, abs=0.01)
    assert rep["absent"].used_tokens == 0 and rep["absent"].actual_share == 0
    uses = {}
    for r in rows:
        uses[r.doc_id, r.use_no] = uses.get((r.doc_id, r.use_no), 0) + 1
    assert set(uses.values()) == {1}
    assert max(r.use_no for r in rows if r.source == "b_two") <= 3 and {r.use_no for r in rows if r.source == "a_one"} == {1}
    assert [r.position for r in rows] == sorted(r.position for r in rows) and all(0 <= r.position <= 1 for r in rows)
    late = sum(r.n_tokens for r in rows if r.source == "b_two" and r.position > 0.5) / rep["b_two"].used_tokens
    assert late == pytest.approx(0.75, abs=0.03)  # a rising line holds three quarters of its area in the second half
    even = sum(r.n_tokens for r in rows if r.source == "a_one" and r.position > 0.5) / rep["a_one"].used_tokens
    assert even == pytest.approx(0.5, abs=0.03)


def test_buckets_do_not_change_the_mixture(spark):
    docs = documents(spark, {"a_one": 200, "b_two": 90})
    t = targets(spark, [("A One", 0.6, 1), ("b_two", 0.4, 2)])
    a, b = (sorted(map(tuple, Mixture(docs, t, TOKENIZER, bucket_rows=k).rows.collect())) for k in (3, 10**6))
    assert a == b


def test_plan():
    keys = {"a": "a", "b": "b", "c": "c"}
    free = {s.source: s for s in plan_shares([("a", 0.5, 1), ("b", 0.5, 2)], {"a": 100, "b": 30}, keys, None)}
    assert free["a"].demand == free["b"].demand == 60 and free["b"].passes == 2
    capped = {s.source: s.demand for s in plan_shares([("a", 0.5, 1), ("b", 0.5, 1)], {"a": 100, "b": 30}, keys, 120)}
    assert capped == {"a": 90, "b": 30}
    short = {s.source: s.demand for s in plan_shares([("a", 0.5, 1), ("b", 0.5, 1), ("c", 0, 9)], {"a": 10, "b": 30, "c": 5}, keys, 1000)}
    assert short == {"a": 10, "b": 30, "c": 0}
    assert all(s.demand == 0 for s in plan_shares([("a", 1.0, 1)], {}, keys, None))


def test_empty_tables(spark):
    docs, t = documents(spark, {"a_one": 5}), targets(spark, [("a_one", 1.0, 1)])
    assert Mixture(docs.filter("false"), t, TOKENIZER).rows.count() == 0
    m = Mixture(docs, t.filter("false"), TOKENIZER)
    assert m.rows.count() == 0 and m.report().count() == 0
    with pytest.raises(ValueError):
        Mixture(docs, t, TOKENIZER, schedules={"a_one": [(0.2, 1), (1, 1)]})
