"""Association scans: one regression per marker, in batches of markers.

Covariates, and the whitening of the mixed model, are projected out once; then a
marker x changes the residual sum of squares by (x'r)^2 / x'x, with r the
projected trait and x the projected marker (Frisch-Waugh). A batch of markers is
one matrix product. What is broadcast is a basis of the covariates for plain
regression, and an n x n matrix for mixed models; scans have no shuffle.

Defined cases: missing calls count as the marker's mean; markers without
variation after projection get F = 0, p = 1 and the null model's residuals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dist import f_sf
from ..functions.reml import Eigen, Fit, fit, scale_k, thin_q
from ..panel import Panel
from .kinship import calls_matrix
from .markers import mac, maf

_LEAST = 1e-9


class Null:
    """The null model: trait and covariates, whitened where a fit is given.

    rows: place in the panel of each observation, for replicates.
    """

    def __init__(self, y, x=None, whitener: np.ndarray | None = None, rows: list[int] | None = None):
        self.y = np.asarray(y, float).ravel()
        self.n = len(self.y)
        self.x = np.ones((self.n, 1)) if x is None else np.asarray(x, float).reshape(self.n, -1)
        self.w = whitener
        self.rows = None if rows is None else np.asarray(rows, int)
        wy, wx = (self.y, self.x) if whitener is None else (whitener @ self.y, whitener @ self.x)
        self.q = thin_q(wx)
        self.p = self.q.shape[1]
        self.r = wy - self.q @ (self.q.T @ wy)
        self.rss0 = float(self.r @ self.r)

    def project(self, g: np.ndarray) -> np.ndarray:
        """Rows of observations, whitened and without covariates."""
        x = g if self.w is None else g @ self.w.T
        return x - (x @ self.q) @ self.q.T

    def observe(self, calls: pa.Array, n: int, complete: bool = True) -> np.ndarray:
        """Calls of a batch as rows of observations, gaps filled with the marker's mean where complete."""
        g = calls_matrix(calls, n)
        if not complete:
            return g if self.rows is None else g[:, self.rows]
        with np.errstate(invalid="ignore"):
            g = np.where(np.isnan(g), np.nan_to_num(np.nanmean(g, axis=1, keepdims=True)) if len(g) else g, g)
        return g if self.rows is None else g[:, self.rows]


def _drop(x: np.ndarray, r: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fall of the rss, x'x, usable) per row; whole: squared length before projection."""
    den = np.einsum("ij,ij->i", x, x)
    ok = den > _LEAST * np.maximum(whole, 1e-30)
    num = x @ r
    return np.where(ok, num * num / np.where(ok, den, 1), 0.0), np.where(ok, den, 1.0), ok


def _f(rss_small: np.ndarray, rss_big: np.ndarray, q, df: int) -> tuple[np.ndarray, np.ndarray]:
    """F of the fall from rss_small to rss_big by q columns, and its tail; 0 and 1 where nothing falls."""
    q = np.asarray(q, float)
    with np.errstate(divide="ignore", invalid="ignore"):
        f = np.where((q > 0) & (df > 0), (rss_small / np.maximum(rss_big, 1e-300) - 1) * df / np.maximum(q, 1), 0.0)
        f = np.maximum(f, 0.0)
    p = np.where(q > 0, f_sf(f, np.maximum(q, 1), max(df, 1)), 1.0)
    return f, p


def _source(panel: Panel) -> DataFrame:
    f = panel.data_format
    return panel.markers.select("marker_id", F.col("chrom").cast("int").alias("chrom"), F.col("pos").cast("long").alias("pos"), mac(f).cast("double").alias("mac"), maf(f).cast("double").alias("maf"), "calls")


_HEAD = "marker_id long, chrom int, pos long, mac double, maf double"


def _scan(panel: Panel, null: Null, columns: list[str], work, complete: bool = True) -> DataFrame:
    """Maps batches of markers; work(null, observations) returns one array per column."""
    n = panel.n
    shared = panel.spark.sparkContext.broadcast(null)  # n x n at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        step = max(1, min(4096, 32_000_000 // max(own.n, 1)))
        for b in batches:
            for k in range(0, b.num_rows, step):
                part = b.slice(k, step)
                out = work(own, own.observe(part.column("calls"), n, complete))
                yield pa.RecordBatch.from_arrays([*part.columns[:5], *[pa.array(np.asarray(v, float)) for v in out]], names=["marker_id", "chrom", "pos", "mac", "maf", *columns])

    return _source(panel).mapInArrow(run, _HEAD + "".join(f", {c} double" for c in columns))


def f_scan(panel: Panel, null: Null) -> DataFrame:
    """marker_id, chrom, pos, mac, maf, beta, f_stat, p_value, rss, var_perc."""
    def work(null: Null, g: np.ndarray):
        whole = np.einsum("ij,ij->i", g, g) if null.w is None else np.einsum("ij,ij->i", g @ null.w.T, g @ null.w.T)
        x = null.project(g)
        fall, den, ok = _drop(x, null.r, whole)
        rss = null.rss0 - fall
        f, p = _f(np.full(len(g), null.rss0), rss, ok.astype(int), null.n - null.p - 1)
        return np.where(ok, (x @ null.r) / den, 0.0), f, p, rss, fall / null.rss0

    return _scan(panel, null, ["beta", "f_stat", "p_value", "rss", "var_perc"], work)


def anova_scan(panel: Panel, null: Null, missing_class: bool = False) -> DataFrame:
    """One-way analysis over genotype classes: n_classes, f_stat, p_value, rss, var_perc.

    missing_class: missing calls form a class of their own; else they count to
    the class nearest to the marker's mean.
    """
    def work(null: Null, g: np.ndarray):
        g = np.where(np.isnan(g), -1.0, np.rint(g))
        values = np.unique(g)
        fall, used = np.zeros(len(g)), np.zeros(len(g))
        basis: list[np.ndarray] = []
        # indicators of one class after the other, each made orthogonal to those before; with an
        # intercept the last one is what the others leave
        whole = np.ones((1, g.shape[1]))
        intercept = np.square(null.project(whole)).sum() < 1e-9 * (whole.sum() if null.w is None else np.square(whole @ null.w.T).sum())
        for v in values[: len(values) - 1 if intercept else None]:
            raw = (g == v).astype(float)
            x = null.project(raw)
            for e in basis:
                x -= np.einsum("ij,ij->i", x, e)[:, None] * e
            d, den, ok = _drop(x, null.r, raw.sum(axis=1))
            fall, used = fall + d, used + ok
            if len(basis) + 1 < len(values) - intercept:
                basis.append(np.where(ok[:, None], x / np.sqrt(den)[:, None], 0.0))
        rss = null.rss0 - fall
        f = np.zeros(len(g))
        p = np.ones(len(g))
        for q in np.unique(used):
            at = used == q
            f[at], p[at] = _f(np.full(at.sum(), null.rss0), rss[at], q, null.n - null.p - int(q))
        return used + 1, f, p, rss, fall / null.rss0

    return _scan(panel, null, ["n_classes", "f_stat", "p_value", "rss", "var_perc"], work, complete=not missing_class)


def gxe_scan(panel: Panel, null: Null, env) -> DataFrame:
    """Marker and marker-by-environment tests; env should be among the covariates of the null model.

    g: marker against null; joint: marker and interaction against null with two
    degrees of freedom; gxe: interaction given the marker, with the residual
    degrees of freedom of the one-marker model.
    """
    e = np.asarray(env, float).ravel()

    def work(null: Null, g: np.ndarray):
        whole = np.einsum("ij,ij->i", g, g)
        x = null.project(g)
        fall, den, ok = _drop(x, null.r, whole)
        z = null.project(g * e)
        z = z - np.where(ok, np.einsum("ij,ij->i", z, x) / den, 0.0)[:, None] * x
        fall2, _, ok2 = _drop(z, null.r, whole)
        rss_g, rss_ge = null.rss0 - fall, null.rss0 - fall - fall2
        base = np.full(len(g), null.rss0)
        fg, pg = _f(base, rss_g, ok.astype(int), null.n - null.p - 1)
        fj, pj = _f(base, rss_ge, np.where(ok | ok2, 2, 0), null.n - null.p - 2)
        fi, pi = _f(rss_g, rss_ge, ok2.astype(int), null.n - null.p - 1)
        return fg, pg, rss_g, fj, pj, rss_ge, fi, pi

    return _scan(panel, null, ["f_g", "p_g", "rss_g", "f_joint", "p_joint", "rss_joint", "f_gxe", "p_gxe"], work)


def interaction_scan(panel: Panel, null: Null, cofactors, least_sum: float = 15) -> DataFrame:
    """Marker and its products with cofactors; a product is used if marker and product each sum to more than least_sum."""
    cof = np.atleast_2d(np.asarray(cofactors, float))

    def work(null: Null, g: np.ndarray):
        whole = np.einsum("ij,ij->i", g, g)
        x = null.project(g)
        fall, den, ok = _drop(x, null.r, whole)
        used = ok.astype(float)
        basis = [np.where(ok[:, None], x / np.sqrt(den)[:, None], 0.0)]
        for c in cof:
            raw = g * c
            may = (g.sum(axis=1) > least_sum) & (raw.sum(axis=1) > least_sum)
            z = null.project(np.where(may[:, None], raw, 0.0))
            for e in basis:
                z = z - np.einsum("ij,ij->i", z, e)[:, None] * e
            d, den, good = _drop(z, null.r, np.einsum("ij,ij->i", raw, raw))
            fall, used = fall + d, used + good
            basis.append(np.where(good[:, None], z / np.sqrt(den)[:, None], 0.0))
        rss = null.rss0 - fall
        f, p = np.zeros(len(g)), np.ones(len(g))
        for q in np.unique(used):
            at = used == q
            f[at], p[at] = _f(np.full(at.sum(), null.rss0), rss[at], q, null.n - null.p - int(q))
        return used, f, p, rss, fall / null.rss0

    return _scan(panel, null, ["n_tested", "f_stat", "p_value", "rss", "var_perc"], work)


def permutation_scan(panel: Panel, null: Null, n_perm: int = 100, seed: int = 0) -> DataFrame:
    """perm, min_rss, max_f, min_p over all markers, for permutations of the null residuals.

    A permutation depends on seed and number only. Partitions send one row per
    permutation.
    """
    n, df = panel.n, null.n - null.p - 1
    shared = panel.spark.sparkContext.broadcast(null)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        r = np.stack([own.r[np.random.default_rng([seed, k]).permutation(own.n)] for k in range(n_perm)], axis=1)
        r = r - own.q @ (own.q.T @ r)
        rss0 = (r * r).sum(axis=0)
        best = np.full(n_perm, np.inf)
        for b in batches:
            g = own.observe(b.column("calls"), n)
            x = own.project(g)
            den = np.einsum("ij,ij->i", x, x)
            ok = den > _LEAST * np.maximum(np.einsum("ij,ij->i", g, g), 1e-30)
            if ok.any():
                fall = (x[ok] @ r) ** 2 / den[ok, None]
                best = np.minimum(best, 1 - (fall / rss0).max(axis=0))
        yield pa.RecordBatch.from_pydict({"perm": np.arange(n_perm, dtype=np.int32), "share": best})

    part = panel.markers.select("calls").mapInArrow(run, "perm int, share double")
    least = part.groupBy("perm").agg(F.min("share").alias("share")).filter("share < 1e300")
    out = least.select("perm", (F.col("share") * null.rss0).alias("min_rss"), F.greatest((1 / F.col("share") - 1) * df, F.lit(0.0)).alias("max_f"))
    from ..functions.dist import f_tail

    return out.withColumn("min_p", f_tail(F.col("max_f"), F.lit(1.0), F.lit(float(df))))


def permutation_threshold(perms: DataFrame) -> tuple[float, float]:
    """(p, F) at place n_perm div 20 of the permutations in order of p."""
    rows = sorted((r.min_p, r.max_f) for r in perms.select("min_p", "max_f").collect())  # one row per permutation
    return rows[len(rows) // 20]


# ------------------------------------------------------------- mixed models


def whitened_null(y, k: np.ndarray, x=None, rows: list[int] | None = None, method: str = "REML", eig_k: Eigen | None = None) -> tuple[Null, Fit]:
    """Null model whitened by the fit of y on K; with replicates K is taken at each observation's individual."""
    k = scale_k(np.asarray(k, float))
    if rows is not None:
        k = k[np.ix_(rows, rows)]
    f = fit(np.asarray(y, float), k, x, method, eig_k=eig_k)
    return Null(y, x, f.whitener, rows), f


def emmax(panel: Panel, y, k: np.ndarray, x=None, rows: list[int] | None = None, exact: int = 0, priors: DataFrame | None = None) -> tuple[DataFrame, Fit]:
    """Mixed-model scan with one variance ratio for all markers.

    exact: so many markers of smallest p are refitted with their own ratio.
    priors: (chrom, pos, prior); adds bayes_factor and ppa.
    """
    null, f = whitened_null(y, k, x, rows)
    out = f_scan(panel, null)
    if exact:
        best = out.orderBy("p_value", "marker_id").limit(exact).select("marker_id")
        sub = panel.with_markers(panel.markers.join(F.broadcast(best), "marker_id", "left_semi"))  # exact rows
        e = emma(sub, y, k, x, rows).select("marker_id", *[F.col(c).alias(f"_{c}") for c in ("beta", "f_stat", "p_value", "rss", "var_perc")])
        out = out.join(F.broadcast(e), "marker_id", "left")
        out = out.select("marker_id", "chrom", "pos", "mac", "maf", *[F.coalesce(f"_{c}", c).alias(c) for c in ("beta", "f_stat", "p_value", "rss", "var_perc")])
    if priors is not None:
        out = with_posteriors(out, priors, null.n, null.rss0)
    return out, f


def with_posteriors(scan: DataFrame, priors: DataFrame, n: int, rss0: float) -> DataFrame:
    """Adds prior, bayes_factor = sqrt(exp(n log(rss0 / rss) - log n)) and the posterior probability ppa."""
    p = priors.groupBy("chrom", "pos").agg(F.max("prior").alias("prior"))
    out = scan.join(p, ["chrom", "pos"], "left")
    bf = F.exp(0.5 * (n * F.log(F.lit(rss0) / F.col("rss")) - float(np.log(n))))
    odds = F.col("bayes_factor") * F.col("prior") / (1 - F.col("prior"))
    return out.withColumn("bayes_factor", bf).withColumn("ppa", F.when(odds.isNull(), None).when(odds > 1e300, 1.0).otherwise(odds / (1 + odds)))


def emma(panel: Panel, y, k: np.ndarray, x=None, rows: list[int] | None = None, grids: int = 50, low: float = -4, high: float = 10) -> DataFrame:
    """Exact mixed model per marker: the variance ratio is fitted anew with the marker in the model."""
    y = np.asarray(y, float).ravel()
    k = scale_k(np.asarray(k, float))
    k = k if rows is None else k[np.ix_(rows, rows)]
    x0 = np.ones((len(y), 1)) if x is None else np.asarray(x, float).reshape(len(y), -1)
    base = Null(y, x0, None, rows)
    eig_k = Eigen.of(k)
    shared = panel.spark.sparkContext.broadcast((base, None, eig_k))
    n = panel.n
    columns = ["beta", "f_stat", "p_value", "rss", "var_perc", "delta"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, k, eig_k = shared.value
        uy, ux = eig_k.vectors.T @ base.y, eig_k.vectors.T @ base.x
        for b in batches:
            rows_out = []
            for g in base.observe(b.column("calls"), n):
                xg = np.column_stack([base.x, g])
                if thin_q(xg).shape[1] == base.p:
                    rows_out.append((0.0, 0.0, 1.0, base.rss0, 0.0, np.nan))
                    continue
                f = fit(base.y, k, xg, eig_k=eig_k, grids=grids, low=low, high=high, whiten=False)
                root = 1 / np.sqrt(np.maximum(eig_k.values + f.delta, 1e-12))
                null = Null(root * uy, root[:, None] * ux)
                stat, p = _f(np.array([null.rss0]), np.array([f.rss]), 1, base.n - base.p - 1)
                rows_out.append((f.beta[-1], stat[0], p[0], f.rss, 1 - f.rss / null.rss0, f.delta))
            out = [pa.array(np.array(c, float)) for c in zip(*rows_out)] if rows_out else [pa.array([], pa.float64())] * 6
            yield pa.RecordBatch.from_arrays([*b.columns[:5], *out], names=["marker_id", "chrom", "pos", "mac", "maf", *columns])

    return _source(panel).mapInArrow(run, _HEAD + "".join(f", {c} double" for c in columns))


def emmax_anova(panel: Panel, y, k: np.ndarray, x=None, rows: list[int] | None = None) -> tuple[DataFrame, Fit]:
    null, f = whitened_null(y, k, x, rows)
    return anova_scan(panel, null), f


def emmax_gxe(panel: Panel, y, k: np.ndarray, env, x=None, rows: list[int] | None = None) -> tuple[DataFrame, Fit]:
    """Gene-by-environment scan; the environment joins the covariates."""
    y, e = np.asarray(y, float), np.asarray(env, float)
    x0 = np.ones((len(y), 1)) if x is None else np.asarray(x, float).reshape(len(y), -1)
    null, f = whitened_null(y, k, np.column_stack([x0, e]), rows)
    return gxe_scan(panel, null, e), f


def emmax_interactions(panel: Panel, y, k: np.ndarray, cofactors, least_sum: float = 15) -> tuple[DataFrame, Fit]:
    c = np.atleast_2d(np.asarray(cofactors, float))
    null, f = whitened_null(y, k, np.column_stack([np.ones(c.shape[1]), c.T]))
    return interaction_scan(panel, null, c, least_sum), f


def emmax_permutations(panel: Panel, y, k: np.ndarray, n_perm: int = 100, seed: int = 0, rows: list[int] | None = None) -> tuple[DataFrame, Fit]:
    null, f = whitened_null(y, k, None, rows)
    return permutation_scan(panel, null, n_perm, seed), f


# ----------------------------------------------------------- single tests


class LinearModel:
    """Ordinary regression of one trait on covariates kept on the driver; starts with an intercept."""

    def __init__(self, y):
        self.y = np.asarray(y, float).ravel()
        self.x = np.ones((len(self.y), 1))

    def add_factor(self, x, tolerance: float = 1e-8) -> bool:
        """Appends a covariate unless it depends on those there."""
        x = np.asarray(x, float).ravel()
        q = thin_q(self.x)
        rest = x - q @ (q.T @ x)
        if rest @ rest < tolerance:
            return False
        self.x = np.column_stack([self.x, x])
        return True

    def set_factors(self, factors, intercept: bool = True) -> None:
        """Replaces all covariates."""
        columns = [np.ones(len(self.y))] if intercept else []
        self.x = np.column_stack([*columns, *[np.asarray(f, float).ravel() for f in factors]])

    @property
    def hat(self) -> np.ndarray:
        q = thin_q(self.x)
        return q @ q.T

    @property
    def betas(self) -> np.ndarray:
        return np.linalg.lstsq(self.x, self.y, rcond=None)[0]

    @property
    def residuals(self) -> np.ndarray:
        return self.y - self.x @ self.betas

    @property
    def rss(self) -> float:
        return float(self.residuals @ self.residuals)

    @property
    def ll(self) -> float:
        return log_likelihood(self.rss, len(self.y))

    def null(self, rows: list[int] | None = None) -> Null:
        """The null model for scans."""
        return Null(self.y, self.x, rows=rows)


def general_f_test(y, x, a, c) -> tuple[float, float]:
    """(F, p) of the hypothesis A beta = c."""
    y, x, a, c = (np.asarray(v, float) for v in (y, x, np.atleast_2d(a), np.ravel(c)))
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    r = y - x @ beta
    q, df = len(a), len(y) - x.shape[1]
    d = a @ beta - c
    f = float(d @ np.linalg.solve(a @ np.linalg.pinv(x.T @ x) @ a.T, d) / q / (r @ r / df))
    return f, float(f_sf(f, q, df))


def test_covariate(y, x, extra) -> tuple[float, float]:
    """(F, p) of adding one covariate, with n - p - 1 residual degrees of freedom."""
    null = Null(y, x)
    e = null.project(np.asarray(extra, float).reshape(1, -1))
    fall, _, ok = _drop(e, null.r, np.array([float(np.square(extra).sum())]))
    f, p = _f(np.array([null.rss0]), null.rss0 - fall, ok.astype(int), null.n - null.p - 1)
    return float(f[0]), float(p[0])


def log_likelihood(rss: float, n: int) -> float:
    """Gaussian log-likelihood at its maximum."""
    return -0.5 * n * (1 + np.log(2 * np.pi) + np.log(max(rss, 1e-300) / n))


# ------------------------------------------------------------- marker pairs


_PAIR_COLUMNS = ["rss_single", "rss_additive", "rss_interaction", "rss_full"] + [f"{k}_{m}" for m in ("single", "additive", "interaction", "full") for k in ("f", "p")] + ["var_perc"]


def pair_scan(panel: Panel, y, max_markers: int = 2000, block: int = 64, null: Null | None = None) -> DataFrame:
    """All pairs of binary markers: haplotype counts and F-tests of the nested models; each marker with itself gives its own test.

    The output has m (m + 1) / 2 rows by definition, so the shortlist of markers is
    limited, and a longer one is an error. Blocks of markers are paired, so a task
    holds two blocks. Missing calls count as the marker's mean, and not as
    haplotypes. null: the null model, by default the mean of y.
    single: better single marker against the null model. additive: both markers
    against the better one. interaction: the product with the better marker.
    full: both and their product against the null model. var_perc: share of the
    null model's rss that the full one takes. n00..n11: haplotypes of marker1, marker2.
    """
    m = panel.markers.select("marker_id", "calls").orderBy("chrom", "pos", "marker_id").limit(max_markers + 1).collect()
    if len(m) > max_markers:
        raise ValueError(f"more than {max_markers} markers; make a shortlist first")
    ids = np.array([r.marker_id for r in m])
    typed = np.array([[-1 if v is None else v for v in r.calls] for r in m], np.int8).reshape(len(m), -1)
    shared = panel.spark.sparkContext.broadcast((ids, typed, Null(y) if null is None else null))  # max_markers rows
    nb = -(-len(m) // block)
    tasks = panel.spark.range(nb * (nb + 1) // 2).repartition(max(1, nb * (nb + 1) // 2))
    counts = ["n00", "n01", "n10", "n11"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, typed, null = shared.value
        known = np.where(typed < 0, np.nan, typed.astype(float))
        with np.errstate(invalid="ignore"):
            mean = np.nan_to_num(np.nansum(known, axis=1) / np.maximum((typed >= 0).sum(axis=1), 1))
        g = np.where(typed < 0, mean[:, None], typed)
        if null.rows is not None:
            g, typed = g[:, null.rows], typed[:, null.rows]
        df = null.n - null.p
        for b in batches:
            for t in b.column(0).to_pylist():
                i = int((np.sqrt(8 * t + 1) - 1) // 2)
                j = t - i * (i + 1) // 2
                a, c = np.meshgrid(np.arange(i * block, min(len(ids), (i + 1) * block)), np.arange(j * block, min(len(ids), (j + 1) * block)), indexing="ij")
                a, c = a.ravel(), c.ravel()
                keep = c <= a
                a, c = a[keep], c[keep]
                if not len(a):
                    continue
                x, z = g[a], g[c]
                px, pz = null.project(x), null.project(z)
                fx, _, _ = _drop(px, null.r, x.sum(1))
                fz, _, _ = _drop(pz, null.r, z.sum(1))
                better = (fx >= fz)[:, None]
                first, other = np.where(better, px, pz), np.where(better, pz, px)
                whole = np.ones(len(a))
                fall1, den1, ok1 = _drop(first, null.r, whole)
                unit = np.where(ok1[:, None], first / np.sqrt(den1)[:, None], 0.0)

                def after(v, *basis):
                    for e in basis:
                        v = v - np.einsum("ij,ij->i", v, e)[:, None] * e
                    return v

                add = after(other, unit)
                fall2, den2, ok2 = _drop(add, null.r, whole)
                unit2 = np.where(ok2[:, None], add / np.sqrt(den2)[:, None], 0.0)
                both = null.project(x * z)
                falli, _, oki = _drop(after(both, unit), null.r, whole)
                fallf, _, okf = _drop(after(both, unit, unit2), null.r, whole)
                base = np.full(len(a), null.rss0)
                r1 = base - fall1
                r2, ri, rf = r1 - fall2, r1 - falli, r1 - fall2 - fallf
                tests = [_f(base, r1, ok1.astype(int), df - 1), _f(r1, r2, ok2.astype(int), df - 2), _f(r1, ri, oki.astype(int), df - 2)]
                q = ok1.astype(int) + ok2 + okf
                full = np.zeros(len(a)), np.ones(len(a))
                for d in np.unique(q):
                    full[0][q == d], full[1][q == d] = _f(base[q == d], rf[q == d], d, df - int(d))
                tests.append(full)
                own = a == c
                for f, p in tests[1:3]:
                    f[own], p[own] = tests[0][0][own], tests[0][1][own]
                haps = np.stack([((typed[c] == u) & (typed[a] == v)).sum(axis=1) for u in (0, 1) for v in (0, 1)])
                stats = [r1, r2, ri, rf, *[v for t in tests for v in t], 1 - rf / null.rss0 if null.rss0 > 0 else np.zeros(len(a))]
                columns = [ids[c], ids[a], (haps > 0).sum(axis=0).astype(np.int32), *haps.astype(np.int64), *stats]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in columns], names=["marker1", "marker2", "n_haplotypes", *counts, *_PAIR_COLUMNS])

    return tasks.mapInArrow(run, "marker1 long, marker2 long, n_haplotypes int, " + ", ".join(f"{c} long" for c in counts) + ", " + ", ".join(f"{c} double" for c in _PAIR_COLUMNS))
