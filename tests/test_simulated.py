"""The simulations: registered at the harness size, run here at the size for unit tests."""

import inspect

import pytest

from locusloom.plans import association, pipelines

SIZE = {"n_indivs": 200, "n_markers": 10_000, "n_pairs": 10, "n_causal": 10, "h2": 0.8}


@pytest.mark.parametrize("name", ["gxe_simulation", "simulated_gwas"])
def test_registered_at_harness_size(monkeypatch, name):
    made = []

    def dataset(spark, *args):
        made.append(dict(zip(SIZE, args)))
        raise InterruptedError

    monkeypatch.setattr(pipelines.simulate, "dataset", dataset)
    with pytest.raises(InterruptedError):
        association.QUERIES[name](None, "")
    assert made == [SIZE]


@pytest.mark.parametrize("name,ids", [("gxe_simulation", [1, 3]), ("simulated_gwas", [1, 2, 3, 4])])
def test_every_trait_is_scanned(spark, name, ids):
    f = getattr(pipelines, name)
    assert {k: p.default for k, p in inspect.signature(f).parameters.items() if k in SIZE} == SIZE
    out = f(spark, 60, 300, 2).groupBy("phen_id").count().collect()
    assert {r.phen_id: r["count"] for r in out} == dict.fromkeys(ids, 300)
