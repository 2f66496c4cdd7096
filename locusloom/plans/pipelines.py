"""End-to-end analyses: from genotypes and phenotypes to results, steps and predictions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.reml import Fit
from ..operators import markers, simulate, sparse
from ..operators.kinship import ibs_kinship, kinship, prune_related, unrelated
from ..operators.markers import filter_maf, impute_mean, pick_individuals
from ..operators.panels import coordinate
from ..operators.scan import Null, emmax, emmax_gxe, emmax_permutations, f_scan, permutation_threshold
from ..operators.stepwise import Search, multi_locus_mixed_model
from ..operators.traits import environment_summary, transform
from ..operators.variance import cross_validated_blup, window_scan
from ..panel import Panel, SparsePanel
from ..session import cut


def as_results(scan: DataFrame) -> DataFrame:
    """A scan in the columns of a result table."""
    return scan.select(F.col("marker_id").alias("row_id"), "chrom", "pos", F.col("p_value").alias("score"), "maf", "mac", *[c for c in ("beta", "f_stat", "rss", "var_perc", "ppa") if c in scan.columns])


def _values(values: DataFrame) -> np.ndarray:
    return np.array([r.value for r in values.select("value").collect()], float)  # one trait's observations


def linear_gwas(panel: Panel, phens: DataFrame, phen_id: int) -> DataFrame:
    """Align, then one regression per marker."""
    cut, values, rows = coordinate(panel, phens, phen_id)
    return as_results(f_scan(cut, Null(_values(values), rows=rows)))


def mixed_model_gwas(panel: Panel, phens: DataFrame, phen_id: int, method: str = "ibs", exact: int = 0, priors: DataFrame | None = None) -> tuple[DataFrame, Fit]:
    """Align, kinship, one variance fit, then one whitened regression per marker."""
    cut, values, rows = coordinate(panel, phens, phen_id)
    k = kinship(cut, method, scaled=False)
    scan, fit = emmax(cut, _values(values), k, rows=rows, exact=exact, priors=priors)
    return as_results(scan), fit


def multi_locus_gwas(panel: Panel, phens: DataFrame, phen_id: int, max_steps: int = 10, priors: DataFrame | None = None) -> Search:
    """Align, kinship, stepwise search; replicates enter as averages."""
    cut, values, _ = coordinate(panel, phens, phen_id, keep_replicates=False)
    return multi_locus_mixed_model(cut, _values(values), ibs_kinship(cut), max_steps, priors=priors)


def stored_gwas(panel: Panel, y, min_maf: float = 0.1, n_perm: int = 0, seed: int = 0) -> tuple[DataFrame, Fit, tuple[float, float] | None]:
    """Whole-genome scan of a stored panel: frequency filter (strict), kinship, scan, permutation threshold over all chromosomes."""
    p = filter_maf(panel, min_maf, strict=True)
    k = kinship(p, "ibd")
    scan, fit = emmax(p, y, k)
    threshold = permutation_threshold(emmax_permutations(p, y, k, n_perm, seed)[0]) if n_perm else None
    return as_results(scan), fit, threshold


def quality_control(panel: Panel | SparsePanel, max_individual_missing: float = 0.5, max_marker_missing: float = 0.05, min_maf: float = 0.1, max_relatedness: float | None = 0.8, exclude: list[str] = []) -> Panel:
    """Individuals by missingness and list, markers by missingness, mean imputation, frequency, relatedness, frequency again.

    A sparse panel gets its cells once only frequent markers are left.
    """
    m = sparse if isinstance(panel, SparsePanel) else markers
    p = m.filter_individuals_by_missing(panel, max_individual_missing)
    gone = set(exclude)
    p = m.pick_individuals(p, [i for i, x in enumerate(p.ids) if x not in gone])
    p = m.filter_maf(m.filter_missing(p, max_marker_missing), min_maf)
    if isinstance(p, SparsePanel):
        p = p.with_markers(cut(p.markers)).dense()
    if max_relatedness is not None:
        p = filter_maf(pick_individuals(p, unrelated(p, "ibd", max_relatedness)), min_maf)
    return impute_mean(p)


def environments_gwas(panel: Panel, phens: DataFrame, statistic: str = "median", method: str = "ibd", exact: int = 1000) -> DataFrame:
    """phen_id, env and results of mixed-model scans of every trait in every environment of a table with column env."""
    s = environment_summary(phens)
    out = None
    for t in s.select("phen_id", "env").distinct().orderBy("phen_id", "env").collect():  # a few traits and environments
        one = s.filter((F.col("phen_id") == t.phen_id) & (F.col("env") == t.env)).select("phen_id", "indiv_id", F.col(statistic).alias("value"))
        r = mixed_model_gwas(panel, one, t.phen_id, method, exact)[0].select(F.lit(t.phen_id).alias("phen_id"), F.lit(t.env).alias("env"), "*")
        out = r if out is None else out.unionByName(r)
    return out


def prediction(panel: Panel, y, n_folds: int = 5, n_repeats: int = 20, max_relatedness: float = 0.5, seed: int = 0) -> DataFrame:
    """Repeated k-fold genomic prediction on individuals that aren't closely related."""
    k = kinship(panel, "ibd")
    at = prune_related(k, max_relatedness)
    return cross_validated_blup(panel.spark, np.asarray(y)[at], k[np.ix_(at, at)], n_folds, n_repeats, seed)


def gxe_simulation(spark: SparkSession, n_indivs: int = 200, n_markers: int = 10_000, n_pairs: int = 10, n_causal: int = 10, h2: float = 0.8, seed: int = 0) -> DataFrame:
    """Simulated trait pairs as two environments: phen_id of the pair's first trait and the three tests per marker."""
    panel, phens = simulate.dataset(spark, n_indivs, n_markers, n_pairs, n_causal, h2, seed)
    k = ibs_kinship(panel)
    out = None
    rows = list(range(panel.n)) * 2
    env = np.repeat([0.0, 1.0], panel.n)
    by = {p: {r.indiv_id: r.value for r in phens.filter(F.col("phen_id") == p).collect()} for p in range(1, 2 * n_pairs + 1)}  # simulated individuals
    for pair in range(n_pairs):
        y = np.array([by[2 * pair + t][x] for t in (1, 2) for x in panel.ids])
        r = emmax_gxe(panel, y, k, env, rows=rows)[0].withColumn("phen_id", F.lit(2 * pair + 1))
        out = r if out is None else out.unionByName(r)
    return out


def simulated_gwas(spark: SparkSession, n_indivs: int = 200, n_markers: int = 10_000, n_pairs: int = 10, n_causal: int = 10, h2: float = 0.8, seed: int = 0) -> DataFrame:
    """phen_id and results of a linear scan of every trait of the simulated pairs."""
    panel, phens = simulate.dataset(spark, n_indivs, n_markers, n_pairs, n_causal, h2, seed)
    out = None
    for phen_id in range(1, 2 * n_pairs + 1):
        r = linear_gwas(panel, phens, phen_id).select(F.lit(phen_id).alias("phen_id"), "*")
        out = r if out is None else out.unionByName(r)
    return out


def variance_demo(panel: Panel, phens: DataFrame, phen_id: int, half_width: int = 500_000, step: int = 250_000) -> DataFrame:
    """Box-Cox transformation, then a local-against-global variance scan."""
    t = transform(phens.filter(F.col("phen_id") == phen_id), "box_cox")
    cut, values, _ = coordinate(panel, t, phen_id, keep_replicates=False)
    return window_scan(cut, _values(values), half_width, step)
