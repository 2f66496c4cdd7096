"""Kinships known by their root: against dense ones, and replicated traits of more individuals than a matrix holds."""

import duckdb
import numpy as np
import pytest
from conftest import same

from locusloom.functions import reml
from locusloom.operators import variance
from locusloom.plans import catalog, mixed


@pytest.mark.parametrize("rank", [1, 4, 38, 40])
@pytest.mark.parametrize("method", ["REML", "ML"])
def test_fits_as_dense(rank, method):
    rng = np.random.default_rng(rank)
    root = rng.normal(size=(40, rank))[rng.integers(0, 40, 40)] if rank < 20 else rng.normal(size=(40, rank))
    y, x = root @ rng.normal(size=rank) + rng.normal(size=40), np.column_stack([np.ones(40), rng.normal(size=40)])
    low = reml.LowRank(root).scaled()
    k = reml.scale_k(root @ root.T)
    np.testing.assert_allclose(low.root @ low.root.T, k, atol=1e-9)
    a, b = low.fit(y, x, method), reml.fit(y, k, x, method)
    np.testing.assert_allclose([a.heritability, a.vg, a.ve, a.ll, a.rss, *a.beta], [b.heritability, b.vg, b.ve, b.ll, b.rss, *b.beta], rtol=1e-5, atol=1e-7)
    np.testing.assert_allclose(low.likelihood_ratio(y), reml.likelihood_ratio(y, k), rtol=1e-6, atol=1e-7)
    np.testing.assert_allclose(low.blup(y, 0.4), reml.blup(y, k, 0.4), atol=1e-8)


NAMES = ["block_heritability", "block_blups"]


@pytest.mark.parametrize("name", NAMES)
def test_many_individuals(spark, tmp_path, name):
    """A matrix over these 20,000 individuals would take 3.2 GB."""
    rng = np.random.default_rng(2)
    kinds = ["click", "error", "purchase", "signup", "view"]
    rows = [(k, kinds[k % 5], float(v)) for k, v in zip(range(20_000), np.round(rng.exponential(50, 20_000), 2))]
    rows += [(k, kinds[k % 5], float(v)) for k, v in zip(range(0, 20_000, 3), np.round(rng.exponential(50, 7_000), 2))]
    spark.createDataFrame(rows, "user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    same(catalog.queries()[name](spark, str(tmp_path)).toPandas(), con.sql(catalog.oracles()[name]).df())


def test_individuals_without_a_sort(spark, data):
    """The individuals' list takes one pass over the events, without aggregates and a sort that samples first."""
    sc = spark.sparkContext
    sc.setJobGroup("individuals", "individuals of the replicated traits")
    try:
        ids = mixed._traits(spark, data)[2]
    finally:
        sc.setJobGroup("other", "other")
    assert ids == [str(k) for k in sorted(int(x) for x in set(ids))]
    assert len(sc.statusTracker().getJobIdsForGroup("individuals")) <= 3


def test_unknown_individuals_and_gaps(spark):
    """Observations of individuals outside the kinship and those without a value are left out, whatever the order of the rows."""
    rng = np.random.default_rng(4)
    ids, root = [f"i{k}" for k in range(30)], np.eye(3)[np.arange(30) % 3]
    rows = [(1, ids[k % 30], float(rng.normal(2 * (k % 3), 1))) for k in rng.permutation(60).tolist()] + [(1, "x", 1.0), (1, None, 2.0), (1, ids[0], None), (2, "x", 3.0)]
    phens = spark.createDataFrame(rows, "phen_id int, indiv_id string, value double")
    low, dense = (variance.trait_blups(phens, k, ids).toPandas().sort_values(["indiv_id", "value"], ignore_index=True) for k in (reml.LowRank(root), root @ root.T))
    known = sorted(r[1:] for r in rows if r[1] in ids and r[2] is not None)
    assert list(low[["indiv_id", "value"]].itertuples(index=False, name=None)) == known and set(low["phen_id"]) == {1}
    np.testing.assert_allclose(low[["blup", "residual"]], dense[["blup", "residual"]], atol=1e-5)
