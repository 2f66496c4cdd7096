"""Every registered query outside llm against its SQL on the smallest tables, or against what must hold of its rows."""

import numpy as np
import pytest
from conftest import same

from locusloom.plans import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracles()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, data, duck, name):
    same(QUERIES[name](spark, data).toPandas(), duck.sql(ORACLES[name]).df())


def one_per(*keys, n):
    """So many rows, each key once."""
    return lambda t: len(t) == n and not t.duplicated(list(keys)).any()


def scan_of(n):
    """A scan of n markers: statistics and p-values within their ranges, and falling together."""

    def ok(t):
        f, p = (t["f_stat"], t["p_value"]) if "f_stat" in t else (t["f_joint"], t["p_joint"])
        order = np.argsort(f.to_numpy(), kind="stable")
        falling = "n_classes" in t or "n_tested" in t or (np.diff(p.to_numpy()[order]) <= 1e-12).all()
        return len(t) == n and t["marker_id"].is_unique and (f >= 0).all() and p.between(0, 1).all() and p.nunique() > n // 4 and falling

    return ok


def steps(t):
    """A forward search that fits better with each marker, then a backward one that fits worse."""
    t = t.sort_values("step")
    forward = t[t["action"] != "remove"]
    gone = t[t["action"] == "remove"]
    return len(forward) > 1 and (np.diff(forward["num_par"]) == 1).all() and (np.diff(gone["num_par"]) == -1).all() and (t["bic"] + 2 * t["ll"] > 0).all() and t["cofactors"].map(len).iloc[0] == 0


def shares(t):
    """Shares of the variance within 0..1, statistics not below 0."""
    return len(t) > 0 and (t["stat"].dropna() >= 0).all() and t["p_value"].dropna().between(0, 1).all() and (t["perc_var1"] + t["perc_var2"]).dropna().between(0, 1 + 1e-9).all()


def blups(t):
    """Prediction and residual make up the value less its mean, and predictions vary less than values."""
    return np.allclose(t["blup"] + t["residual"], t["value"] - t["value"].mean()) and t["blup"].std() <= t["value"].std()


HOLDS = {
    "emmax_scan": scan_of(64), "emma_scan": scan_of(64), "emmax_posteriors": lambda t: scan_of(64)(t) and t["ppa"].between(0, 1).all() and abs(t["prior"].sum() - 1) < 1e-6,
    "emmax_anova": lambda t: t["marker_id"].is_unique and t["n_classes"].between(1, 3).all() and (t["f_stat"] >= 0).all() and t["p_value"].between(0, 1).all(),
    "emmax_gxe": lambda t: len(t) == 64 and (t["rss_joint"] <= t["rss_g"] + 1e-9).all(), "emmax_interactions": lambda t: len(t) == 64 and t["n_tested"].between(0, 3).all() and t["p_value"].between(0, 1).all(),
    "emmax_permutations": lambda t: sorted(t["perm"]) == list(range(100)) and (t["max_f"] > 0).all() and t["min_p"].between(0, 1).all(),
    "stepwise_linear": steps, "multi_locus": steps, "trait_heritability": lambda t: t["heritability"].between(0, 1).all() and (t["vg"] >= 0).all() and (t["ve"] >= 0).all(), "trait_blups": blups,
    "chromosome_variance": lambda t: one_per("chrom", n=4)(t) and shares(t), "window_variance": shares, "gene_variance": lambda t: one_per("gene_id", n=2)(t) and shares(t),
    "cross_validated_blup": lambda t: len(t) > 0 and t.select_dtypes("number").notna().all().all(), "kinship_tree": lambda t: t["step"].is_unique and t["size"].max() == len(t) + 1 and (np.diff(t.sort_values("step")["height"]) >= -1e-9).all(),
    "most_normal_transform": one_per("phen_id", n=5), "box_cox_transform": one_per("phen_id", n=5), "normality": lambda t: one_per("phen_id", n=5)(t) and t.select_dtypes("float").iloc[:, 0].between(0, 1).all(),
    "stored_gwas": lambda t: len(t) > 30 and t["score"].between(0, 1).all(), "aligned_gwas": lambda t: len(t) == 64 and t["score"].between(0, 1).all(),
    "gxe_simulation": one_per("phen_id", "marker_id", n=100_000), "simulated_gwas": lambda t: len(t) == 200_000 and t["phen_id"].nunique() == 20, "simulated_genotypes": lambda t: one_per("marker_id", n=1000)(t) and {len(c) for c in t["calls"]} == {100},
}


def test_every_query_is_checked():
    assert set(HOLDS) == set(QUERIES) - set(ORACLES)


@pytest.mark.parametrize("name", sorted(HOLDS))
def test_holds(spark, data, name):
    t = QUERIES[name](spark, data).toPandas()
    assert HOLDS[name](t), t.head(20).to_string()


def test_entry_has_rows(spark, data):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
