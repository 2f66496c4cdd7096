"""Forward and backward search for several loci, with linear or mixed models.

The loop runs on the driver over one cached panel; each step is one distributed
scan that returns its best marker. Covariates are single marker rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dist import log_choose
from ..functions.reml import Eigen, Fit, fit, scale_k
from ..panel import Panel
from .orderstats import Ordered, greatest_gap
from .scan import Null, f_scan, log_likelihood, with_posteriors

Locus = tuple[int, int]


@dataclass
class Step:
    """One model of the search."""

    number: int
    action: str
    cofactors: list[Locus]
    rss: float
    ll: float
    bic: float
    ebic: float
    mbic: float
    heritability: float | None
    min_p: float | None
    min_locus: Locus | None
    cofactor_p: list[float] = field(default_factory=list)
    max_ppa: float | None = None
    scan: DataFrame | None = field(default=None, repr=False)
    mahalanobis_rss: float | None = None
    reml_mahalanobis_rss: float | None = None
    pval_median: float | None = None
    ks_stat: float | None = None

    @property
    def mbonf(self) -> float:
        """The largest p-value of a cofactor, 0 without any."""
        return max(self.cofactor_p, default=0.0)


def criteria(ll: float, n_markers: int, n_params: int, n: int) -> tuple[float, float, float]:
    """(BIC, extended BIC, modified BIC) of a model with n_params parameters."""
    bic = -2 * ll + n_params * math.log(n)
    ebic = bic + 2 * log_choose(n_markers, n_params - 2)
    mbic = bic + 2 * n_params * math.log(max(n_markers / 2.2 - 1, 1e-9))
    return bic, ebic, mbic


class Search:
    """Stepwise search; ``run`` fills ``steps``, ``choose`` picks one by a criterion.

    k: kinship for mixed models, None for linear ones. y: one value per panel
    individual. priors: (chrom, pos, prior); then choose_by may be ``ppa``.
    distribution: also the median and the Kolmogorov-Smirnov distance of each
    scan's p-values, which read the scan again.
    """

    def __init__(self, panel: Panel, y, k: np.ndarray | None = None, max_steps: int = 10, choose_by: str = "p", priors: DataFrame | None = None, keep_scans: bool = False, distribution: bool = False):
        self.panel = panel.with_markers(panel.markers.persist())
        self.y = np.asarray(y, float)
        self.n = len(self.y)
        self.k = None if k is None else scale_k(np.asarray(k, float))
        self.eig_k = None if k is None else Eigen.of(self.k)
        self.max_steps, self.choose_by, self.priors, self.keep_scans, self.distribution = max_steps, choose_by, priors, keep_scans, distribution
        self.n_markers = self.panel.markers.count()
        self.steps: list[Step] = []
        self._genotype: dict[Locus, np.ndarray] = {}

    def _row(self, locus: Locus) -> np.ndarray:
        if locus not in self._genotype:
            r = self.panel.markers.filter((F.col("chrom") == locus[0]) & (F.col("pos") == locus[1])).orderBy("marker_id").select("calls").first()
            if r is None:
                raise KeyError(f"no marker at {locus}")
            g = np.array([np.nan if v is None else v for v in r.calls], float)
            self._genotype[locus] = np.where(np.isnan(g), np.nanmean(g), g)
        return self._genotype[locus]

    def _design(self, loci: list[Locus]) -> np.ndarray:
        return np.column_stack([np.ones(self.n), *[self._row(x) for x in loci]])

    def _null(self, loci: list[Locus]) -> tuple[Null, Fit | None, float, float]:
        """Null model, its fit, and the likelihood and weighted residual sum of the ML fit."""
        x = self._design(loci)
        if self.k is None:
            null = Null(self.y, x)
            return null, None, log_likelihood(null.rss0, self.n), null.rss0
        f = fit(self.y, self.k, x, eig_k=self.eig_k)
        ml = fit(self.y, self.k, x, "ML", eig_k=self.eig_k, whiten=False)
        return Null(self.y, x, f.whitener), f, ml.ll, ml.rss

    def _cofactor_p(self, null: Null, loci: list[Locus]) -> list[tuple[float, float]]:
        """(p, F) of each cofactor given the others, under the model's whitening."""
        out = []
        for i in range(len(loci)):
            rest = Null(self.y, self._design(loci[:i] + loci[i + 1 :]), null.w)
            f = max(0.0, (rest.rss0 / null.rss0 - 1) * (self.n - null.p))
            from ..functions.dist import f_sf

            out.append((float(f_sf(f, 1, self.n - null.p)), f))
        return out

    def _scan(self, null: Null, loci: list[Locus]) -> DataFrame:
        s = f_scan(self.panel, null)
        if loci:
            s = s.filter(~F.struct("chrom", "pos").isin(*[F.struct(F.lit(c), F.lit(p).cast("long")) for c, p in loci]))
        return s if self.priors is None else with_posteriors(s, self.priors, self.n, null.rss0)

    def _step(self, action: str, loci: list[Locus], scan: bool = True) -> Step:
        null, f, ll, ml_rss = self._null(loci)
        params = len(loci) + 1 + (self.k is not None)
        bic, ebic, mbic = criteria(ll, self.n_markers, params, self.n)
        best, table = None, None
        if scan:
            table = self._scan(null, loci)
            order = [F.col("ppa").desc_nulls_last()] if self.choose_by == "ppa" else [F.col("p_value").asc()]
            best = table.orderBy(*order, "chrom", "pos").first()
        step = Step(
            len(self.steps), action, list(loci), null.rss0, ll, bic, ebic, mbic, f.heritability if f else None, best.p_value if best else None,
            (best.chrom, best.pos) if best else None, [p for p, _ in self._cofactor_p(null, loci)], best.ppa if best and self.priors is not None else None, table if self.keep_scans else None,
        )
        step.mahalanobis_rss, step.reml_mahalanobis_rss = ml_rss, null.rss0
        if table is not None and self.distribution:
            p = table.select(F.col("p_value").alias("score"))
            half = Ordered(p)
            step.pval_median, step.ks_stat = half.at([half.n // 2]).get(half.n // 2), greatest_gap(p, None)[0]
        self.steps.append(step)
        return step

    def run(self, backward: bool = True) -> list[Step]:
        """Adds markers up to max_steps or until heritability is below 0.001 for the second time, then removes them one by one."""
        loci: list[Locus] = []
        low = 0
        step = self._step("start", loci)
        for _ in range(self.max_steps):
            if step.min_locus is None:
                break
            loci = [*loci, step.min_locus]
            step = self._step("add", loci)
            low += step.heritability is not None and step.heritability < 0.001
            if low >= 2:
                break
        while backward and len(loci) > 1:
            null, *_ = self._null(loci)
            f = [x for _, x in self._cofactor_p(null, loci)]
            weakest = int(np.argmin(f))
            loci = loci[:weakest] + loci[weakest + 1 :]
            self._step("remove", loci, scan=False)
        return self.steps

    def done(self) -> None:
        self.panel.markers.unpersist()

    def choose(self, criterion: str, threshold: float | None = None) -> Step:
        """The best step: ebic, mbic or bic by their least value; bonf by the largest forward model whose added marker
        was significant; mbonf by the largest model with all cofactors significant, the smaller value on ties."""
        t = threshold or 0.05 / max(self.n_markers, 1)
        if criterion in ("bic", "ebic", "mbic"):
            return min(self.steps, key=lambda s: (getattr(s, criterion), s.number))
        if criterion == "bonf":
            best = self.steps[0]
            for before, step in zip(self.steps, self.steps[1:]):
                if step.action != "add" or before.min_p is None or before.min_p > t:
                    break
                best = step
            return best
        if criterion == "mbonf":
            ok = [s for s in self.steps if s.mbonf <= t]
            return max(ok, key=lambda s: (len(s.cofactors), -s.mbonf, -s.number)) if ok else self.steps[0]
        raise ValueError("criteria: bic, ebic, mbic, bonf, mbonf")

    def final_scan(self, step: Step) -> DataFrame:
        """The scan given a step's cofactors."""
        return self._scan(self._null(step.cofactors)[0], step.cofactors)

    def table(self) -> DataFrame:
        """The steps as a table."""
        rows = [
            (s.number, s.action, len(s.cofactors) + 1 + (self.k is not None), *[None if v is None else float(v) for v in (s.ll, s.rss, s.bic, s.ebic, s.mbic, s.mbonf, s.heritability, s.min_p, s.max_ppa, s.mahalanobis_rss, s.reml_mahalanobis_rss, s.pval_median, s.ks_stat)],
             [(c, p, float(-math.log10(max(v, 1e-323)))) for (c, p), v in zip(s.cofactors, s.cofactor_p)])
            for s in self.steps
        ]
        ddl = "step int, action string, num_par int, ll double, rss double, bic double, ebic double, mbic double, mbonf double, pseudo_heritability double, min_p double, max_ppa double, mahalanobis_rss double, reml_mahalanobis_rss double, pval_median double, ks_stat double, cofactors array<struct<chrom int, pos long, neglog_p double>>"
        return self.panel.spark.createDataFrame(rows, ddl)


def cofactor_text(col: str = "cofactors"):
    """Cofactors as chrom_pos_score joined by blanks."""
    return F.concat_ws(" ", F.transform(col, lambda c: F.concat_ws("_", c["chrom"].cast("string"), c["pos"].cast("string"), F.format_string("%.4f", c["neglog_p"]))))


def stepwise_linear(panel: Panel, y, max_steps: int = 10, backward: bool = True, **options) -> Search:
    s = Search(panel, y, None, max_steps, **options)
    s.run(backward)
    return s


def multi_locus_mixed_model(panel: Panel, y, k: np.ndarray, max_steps: int = 10, backward: bool = True, **options) -> Search:
    s = Search(panel, y, k, max_steps, **options)
    s.run(backward)
    return s


def single_step(panel: Panel, y, cofactors: list[Locus], k: np.ndarray | None = None, **options) -> tuple[Step, DataFrame]:
    """One step of an interactive search: statistics given the cofactors, and the scan."""
    s = Search(panel, y, k, keep_scans=True, **options)
    step = s._step("given", cofactors)
    return step, step.scan
