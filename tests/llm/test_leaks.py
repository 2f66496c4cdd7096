"""Leak search against brute force over word windows."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from locusloom.llm.leaks import best_match, find_leaks, leaked_items
from locusloom.llm.words import words


def distance(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abc"), min_size=1, max_size=70), st.lists(st.sampled_from("abcd"), max_size=90))
def test_bit_parallel_distance(p, t):
    assert best_match(p, t)[0] == distance(p, t)


def test_words():
    assert words("Éta​ble a­nd fai-\nlure, ｏｎｅ x_1") == ["etable", "and", "failure", "one", "x", "1"]
    assert words("a-b c -\nd") == ["a", "b", "c", "d"]
    assert words(None) == words("") == words(" \n") == []


def brute(docs, items, window, edits):
    out = {}
    for d, t in docs:
        w = words(t)
        for i, x in items:
            v = words(x)
            size = min(window, len(v))
            if not size:
                continue
            k = min(edits, size - 1)
            best = min(distance(v[a : a + size], w) for a in range(len(v) - size + 1))
            if best <= k:
                out[d, i] = best
    return out


@pytest.mark.parametrize("edits,block,bits", [(0, 10**6, 27), (1, 10**6, 27), (2, 10**6, 27), (0, 3, 20), (1, 3, 12), (2, 3, 20)])
def test_equals_brute_force(spark, edits, block, bits):
    """Few items go through the automaton, many through hashes (also with a bit map that sifts badly)."""
    rng = random.Random(edits)
    vocab = "the line of mk2_1 peak at é and seed q".split()
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 3, 8, 14, 20])))) for i in range(12)] + [(20, None), (21, ""), (22, "..!")]
    docs = []
    for d in range(60):
        w = [rng.choice(vocab) for _ in range(rng.choice([0, 2, 15, 40]))]
        if rng.random() < 0.6:
            v = (rng.choice(items[:12])[1]).split()
            a = rng.randrange(len(v))
            part = v[a : a + rng.choice([6, 9, 14])]
            if len(part) > 4 and rng.random() < 0.5:
                part[2:3] = rng.choice([[], ["zzz"], ["zzz", "yyy"]])
            w[len(w) // 2 : len(w) // 2] = part
        docs.append((d, " ".join(w)))
    docs += [(100, None), (101, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as distance").repartition(3)
    rows = find_leaks(df, spark.createDataFrame(items, "item_id long, text string"), 8, edits, block_words=block, bits=bits).collect()
    assert {(r.doc_id, r.item_id): r.distance for r in rows} == brute(docs, items, 8, edits)
    assert len(rows) == len({(r.doc_id, r.item_id) for r in rows})


def test_recall_on_planted_edits(spark):
    """Passages with planted word edits are all found, up to the budget and not beyond it."""
    rng = random.Random(11)
    vocab = [f"w{k}" for k in range(400)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(30))) for i in range(40)]
    docs, want = [], {}
    for d in range(300):
        i, n = rng.randrange(40), rng.choice([0, 1, 2, 3])
        part = items[i][1].split()[9:21]
        for k in sorted(rng.sample(range(12), n), reverse=True):
            part[k : k + 1] = rng.choice([[], ["zz"], [part[k], "zz"]])
        docs.append((d, " ".join(f"q{d}{k}" for k in range(40)) + " " + " ".join(part) + " " + " ".join(f"r{d}{k}" for k in range(40))))
        want[d, i] = n
    df, tests = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    exact = brute(docs, items, 12, 2)
    for block in (10**6, 10):
        got = {(r.doc_id, r.item_id): r.distance for r in find_leaks(df, tests, 12, 2, block_words=block, bits=20).collect()}
        assert got == exact
        assert all(got[k] <= n for k, n in want.items() if n <= 2)


def test_piece_in_very_many_places(spark, monkeypatch):
    """A stock phrase with more than its share of the hits is split and still complete."""
    phrase = "see the notes of the panel"
    items = [(i, f"{phrase} item number {i} has its own long ending here") for i in range(30)]
    docs = [(d, f"{phrase} item number {d % 60} has its own long ending here and {d}") for d in range(11_000)]
    df, tests = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = find_leaks(df, tests, 12, 0, block_words=10, bits=20).filter("distance = 0").select("doc_id", "item_id").collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(d, d % 60) for d in range(11_000) if d % 60 < 30}


def test_report_and_long_text(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    long = " ".join(f"w{k}" for k in range(50_000))
    docs = spark.createDataFrame([(1, f"{long} {item.upper()} {long}"), (2, item[:40]), (3, item)], "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (8, item)], "item_id long, text string")
    rep = {r.item_id: (r.n_documents, r.distance) for r in leaked_items(find_leaks(docs, items)).collect()}
    assert rep == {7: (2, 0), 8: (2, 0)}
    assert find_leaks(docs, items.filter("false")).count() == 0 and find_leaks(docs.filter("false"), items).count() == 0
