"""Queries of the dosage panel without a cell per call, on tables with odd keys, and their operators against the dense ones."""

import duckdb
import numpy as np
import pytest
from conftest import same

from locusloom.operators import kinship, markers, scan, sparse
from locusloom.plans import catalog
from locusloom.plans.fixtures import sparse_b

QUERIES, ORACLES = catalog.queries(), catalog.oracles()
NAMES = [
    "anova_missing_class",
    "filter_mac",
    "filter_monomorphic",
    "impute_rounded_mean",
    "marker_stats",
    "anova_scan",
    "diploid_kinship",
    "filter_maf",
    "frequency_bins",
    "individual_missing",
    "only_biallelic",
    "filter_missing",
    "impute_mode",
    "individuals_typed",
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Keys with holes, parts without lines, a part with many, lines of unknown parts and suppliers."""
    path, rng = tmp_path_factory.mktemp("odd"), np.random.default_rng(5)
    people, parts = [int(k) for k in np.sort(rng.choice(200, 60, replace=False))], [3 * k + 1 for k in range(40)]
    spark.createDataFrame([(k, float(rng.normal(0, 5000))) for k in people], "s_suppkey long, s_acctbal double").write.parquet(f"{path}/supplier.parquet")
    spark.createDataFrame([(k, k % 50) for k in parts], "p_partkey long, p_size int").write.parquet(f"{path}/part.parquet")
    lines = [(int(rng.choice(parts[5:])), int(rng.choice(people))) for _ in range(1500)] + [(parts[5], k) for k in people for _ in range(2)]
    lines += [(parts[7], 100_000), (parts[8], -4), (parts[9], next(k for k in range(200) if k not in people)), (2, people[0]), (100_000, people[1])]
    spark.createDataFrame(lines, "l_partkey long, l_suppkey long").write.parquet(f"{path}/lineitem.parquet")
    con = duckdb.connect()
    for t in ("supplier", "part", "lineitem"):
        con.sql(f"create view {t} as select * from '{path}/{t}.parquet/*.parquet'")
    return str(path), con


@pytest.fixture
def short_batches(spark):
    """A part's lines lie in several batches."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, 7)
    yield
    spark.conf.set(name, before)


@pytest.mark.parametrize("name", NAMES)
def test_odd_keys(spark, odd, short_batches, name):
    d, con = odd
    df = QUERIES[name](spark, d)
    assert "calls" not in df._jdf.queryExecution().toString()
    same(df.toPandas(), con.sql(ORACLES[name]).df())


def _rows(df, digits=9):
    return sorted(tuple(round(x, digits) if isinstance(x, float) else x for x in r) for r in df.collect())


def test_operators_agree_with_dense_ones(spark, odd):
    p, y = sparse_b(spark, odd[0], gaps=True)
    d = p.dense()
    names = ["marker_id", "n_typed", "n_missing", "missing_rate", "n_alleles", "mean", "mac", "maf"]
    assert _rows(sparse.marker_stats(p).select(names)) == _rows(markers.marker_stats(d).select(names))
    for f, *args in (("filter_mac", 20), ("filter_maf", 0.2, 0.45), ("only_biallelic",), ("filter_monomorphic",), ("filter_missing", 0.034)):
        a, b = (getattr(m, f)(x, *args).markers.select("marker_id") for m, x in ((sparse, p), (markers, d)))
        assert _rows(a) == _rows(b), f
    assert _rows(sparse.individual_missing(p)) == _rows(markers.individual_missing(d))
    for f in ("impute_mode", "impute_rounded_mean"):
        a, b = getattr(sparse, f)(p), getattr(markers, f)(d)
        assert _rows(sparse.totals(a)) == _rows(b.markers.select("marker_id", markers.total()))
        assert _rows(a.dense().markers.select("marker_id", "calls")) == _rows(b.markers.select("marker_id", "calls"))
    some = [k for k in range(p.n) if k % 3]
    a, b = sparse.pick_individuals(p, some), markers.pick_individuals(d, some)
    assert a.ids == b.ids and _rows(a.dense().markers.select("marker_id", "calls")) == _rows(b.markers.select("marker_id", "calls"))


@pytest.mark.parametrize("kind", ["plain", "covariates", "no intercept", "replicates"])
@pytest.mark.parametrize("missing_class", [True, False])
def test_anova_agrees_with_dense_one(spark, odd, kind, missing_class):
    p, y = sparse_b(spark, odd[0], gaps=True)
    rng, rows = np.random.default_rng(1), None
    x = {"covariates": np.column_stack([np.ones(p.n), rng.normal(size=(p.n, 2))]), "no intercept": rng.normal(size=(p.n, 1))}.get(kind)
    if kind == "replicates":
        rows = [*range(p.n), *range(0, p.n, 2)]
        y = np.r_[y, y[::2] + 100]
    null = scan.Null(y, x, rows=rows)
    a, b = (np.array(_rows(x), float) for x in (sparse.anova_scan(p, null, missing_class), scan.anova_scan(p.dense(), null, missing_class)))
    np.testing.assert_allclose(a, b, rtol=1e-7, atol=1e-9)


@pytest.mark.parametrize("missing_class", [True, False])
def test_sets_without_individuals(spark, odd, missing_class):
    """Fewer individuals than sets."""
    p, y = sparse_b(spark, odd[0], gaps=True)
    few = [k for k in range(p.n) if p.sets[k] < 12]
    p = sparse.pick_individuals(p, few)
    null = scan.Null(y[few])
    a, b = (np.array(_rows(x), float) for x in (sparse.anova_scan(p, null, missing_class), scan.anova_scan(p.dense(), null, missing_class)))
    np.testing.assert_allclose(a, b, rtol=1e-7, atol=1e-9)


def _kin(spark, path, groups, each, parts):
    """Suppliers of several groups that share no part, some without lines, and a part without any."""
    rng = np.random.default_rng(3)
    spark.createDataFrame([(k, float(rng.normal(0, 5000))) for k in range(groups * each + 7)], "s_suppkey long, s_acctbal double").write.parquet(f"{path}/supplier.parquet")
    spark.createDataFrame([(k, k % 50) for k in range(groups * parts + 1)], "p_partkey long, p_size int").write.parquet(f"{path}/part.parquet")
    lines = [(int(k), int(k % groups + groups * rng.integers(each))) for k in rng.integers(0, groups * parts, 6 * groups * parts)]
    spark.createDataFrame(lines, "l_partkey long, l_suppkey long").write.parquet(f"{path}/lineitem.parquet")
    return str(path)


@pytest.mark.parametrize("most", [1, 16, 1024])
@pytest.mark.parametrize("table", ["one group", "groups"])
def test_emmax_anova_agrees_with_dense_one(spark, odd, tmp_path, short_batches, monkeypatch, table, most):
    monkeypatch.setattr(sparse, "_BLOCK", most)
    d = odd[0] if table == "one group" else _kin(spark, tmp_path, 5, 9, 12)
    df = QUERIES["emmax_anova"](spark, d)
    assert "calls" not in df._jdf.queryExecution().toString()
    p, y = sparse_b(spark, d)
    kin = sparse.kin_groups(p)
    assert len(set(kin[kin >= 0])) == (1 if table == "one group" else 5)
    dense = p.dense()
    a, b = (np.array(_rows(x), float) for x in (df, scan.emmax_anova(dense, y, kinship.ibs_kinship(dense))[0]))
    np.testing.assert_allclose(a, b, rtol=1e-6, atol=1e-8)


def test_emmax_anova_many_individuals(spark, tmp_path):
    """A matrix over these 30,007 individuals would take 7.2 GB."""
    t = QUERIES["emmax_anova"](spark, _kin(spark, tmp_path, 2000, 15, 2)).toPandas()
    assert len(t) == t["marker_id"].nunique() == 4001
    assert t["n_classes"].between(1, 3).all() and (t["f_stat"] >= 0).all() and t["p_value"].between(0, 1).all()
    np.testing.assert_allclose(t["rss"] / (1 - t["var_perc"]), (t["rss"] / (1 - t["var_perc"])).iloc[0])


def test_missing_calls_have_no_kinship(spark, odd):
    p, y = sparse_b(spark, odd[0], gaps=True)
    with pytest.raises(ValueError, match="missing"):
        sparse.emmax_anova(p, y)
