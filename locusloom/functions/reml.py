"""Variance-component estimation of the model y = Xb + u + e, u ~ N(0, vg K), e ~ N(0, ve I).

Dense algebra over individuals in numpy, used on the driver and inside Python
workers. delta is ve / vg. Memory is a few n x n matrices: up to about 10,000
individuals.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

from .dist import chi2_sf


def nearest_positive(v: np.ndarray, floor: float = 1e-10) -> np.ndarray:
    """The matrix with eigenvalues below ``floor`` of the largest raised to it."""
    lam, u = np.linalg.eigh((v + v.T) / 2)
    return (u * np.maximum(lam, floor * lam[-1])) @ u.T


def cholesky_upper(v: np.ndarray) -> np.ndarray:
    """Upper triangular R with R'R = v; of the nearest positive matrix if v has no such factor."""
    try:
        return np.linalg.cholesky(v).T
    except np.linalg.LinAlgError:
        return np.linalg.cholesky(nearest_positive(v)).T


def thin_q(x: np.ndarray, tol: float = 1e-8) -> np.ndarray:
    """Orthonormal basis of the column space; dependent columns are dropped."""
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    return u[:, s > tol * max(s[0], 1e-300)] if s.size else u


def scale_k(k: np.ndarray) -> np.ndarray:
    """Scale so that the trace of the centred matrix is n - 1."""
    n = len(k)
    return k * ((n - 1) / (np.trace(k) - k.sum() / n))


@dataclass
class Eigen:
    """Decompositions that depend on K, and on K and X."""

    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def of(cls, k: np.ndarray) -> Eigen:
        return cls(*np.linalg.eigh((k + k.T) / 2))

    @classmethod
    def within(cls, k: np.ndarray, x: np.ndarray) -> Eigen:
        """Of S(K + I)S with S the projection off X, without its null space."""
        q = thin_q(x)
        h = k + np.eye(len(k))
        h = h - q @ (q.T @ h)
        h = h - (h @ q) @ q.T
        lam, u = np.linalg.eigh((h + h.T) / 2)
        return cls(lam[q.shape[1] :] - 1, u[:, q.shape[1] :])


@dataclass
class LowRank:
    """A kinship known by its root, n x r: K = root root'. K itself is never formed."""

    root: np.ndarray

    def at(self, rows) -> LowRank:
        """The kinship of these rows, which may repeat."""
        return LowRank(self.root[rows])

    def scaled(self) -> LowRank:
        """As scale_k."""
        n = len(self.root)
        return LowRank(self.root * math.sqrt((n - 1) / (np.square(self.root).sum() - np.square(self.root.sum(axis=0)).sum() / n)))

    def coordinates(self, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(eigenvalues, columns in the basis of the eigenvectors, further directions): further ones have eigenvalue 0 and no share in the columns.

        The null space of K is turned so that the columns' part in it needs as
        many directions as there are columns.
        """
        u, s, _ = np.linalg.svd(self.root, full_matrices=False)
        u, s = (u[:, s > 1e-10 * s[0]], s[s > 1e-10 * s[0]]) if s.size else (u, s)
        inner = u.T @ columns
        outer = columns - u @ inner
        _, size, v = np.linalg.svd(outer - u @ (u.T @ outer), full_matrices=False)
        outer = (size[:, None] * v)[: len(u) - len(s)]
        return np.r_[s * s, np.zeros(len(outer))], np.concatenate([inner, outer]), len(u) - len(s) - len(outer)

    def fit(self, y: np.ndarray, x: np.ndarray | None = None, method: str = "REML", grids: int = 100, low: float = -10, high: float = 10, tol: float = 1e-12) -> Fit:
        """As fit, without a whitener."""
        y = np.asarray(y, float).ravel()
        x = np.ones((len(y), 1)) if x is None else np.asarray(x, float).reshape(len(y), -1)
        basis = thin_q(x)
        lam, c, rest = self.coordinates(np.column_stack([basis, x, y]))
        q = basis.shape[1]
        profile = Profile.of(lam, c[:, -1], c[:, :q], method, rest)
        delta, ll, vg = profile.maximise(grids, low, high, tol)
        root = 1 / np.sqrt(np.maximum(lam + delta, 1e-12))
        wx, wy = root[:, None] * c[:, q:-1], root * c[:, -1]
        beta, *_ = np.linalg.lstsq(wx, wy, rcond=None)
        r = wy - wx @ beta
        return Fit(delta, vg, vg * delta, ll, 1 / (1 + delta), beta, float(r @ r), None, len(y), x.shape[1])

    def likelihood_ratio(self, y: np.ndarray) -> tuple[float, float]:
        """As likelihood_ratio; the kinship is scaled already."""
        return _against_none(y, self.fit(y, method="ML").ll)

    def blup(self, y: np.ndarray, heritability: float) -> np.ndarray:
        """As blup: root (root'root + delta I)^-1 root' (y - mean)."""
        y = np.asarray(y, float)
        if heritability <= 0:
            return np.zeros(len(y))
        inner = self.root.T @ self.root + (1 - heritability) / heritability * np.eye(self.root.shape[1])
        return self.root @ np.linalg.solve(inner, self.root.T @ (y - y.mean()))


def reml_ll(delta, lam: np.ndarray, eta2: np.ndarray):
    """Restricted log-likelihood at delta (array or number)."""
    d = np.atleast_1d(delta)[:, None]
    p = len(lam)
    s = lam + d
    out = 0.5 * (p * (np.log(p / (2 * np.pi)) - 1 - np.log((eta2 / s).sum(1))) - np.log(s).sum(1))
    return out if np.ndim(delta) else float(out[0])


def reml_slope(delta, lam, eta2):
    """Derivative of reml_ll by delta."""
    d = np.atleast_1d(delta)[:, None]
    s = lam + d
    out = 0.5 * (len(lam) * (eta2 / s**2).sum(1) / (eta2 / s).sum(1) - (1 / s).sum(1))
    return out if np.ndim(delta) else float(out[0])


def ml_ll(delta, lam, lam_full, eta2):
    """Log-likelihood at delta; lam_full are the eigenvalues of K."""
    d = np.atleast_1d(delta)[:, None]
    n = len(lam_full)
    out = 0.5 * (n * (np.log(n / (2 * np.pi)) - 1 - np.log((eta2 / (lam + d)).sum(1))) - np.log(lam_full + d).sum(1))
    return out if np.ndim(delta) else float(out[0])


def ml_slope(delta, lam, lam_full, eta2):
    """Derivative of ml_ll by delta."""
    d = np.atleast_1d(delta)[:, None]
    s = lam + d
    out = 0.5 * (len(lam_full) * (eta2 / s**2).sum(1) / (eta2 / s).sum(1) - (1 / (lam_full + d)).sum(1))
    return out if np.ndim(delta) else float(out[0])


class Profile:
    """Likelihood of a model as a function of delta, from the eigenvectors of K alone.

    In their basis the covariance is diagonal, so for any covariates a value of
    delta costs a small weighted regression and no further decomposition.
    """

    def __init__(self, y: np.ndarray, x: np.ndarray, eig: Eigen, method: str):
        self._set(eig.values, eig.vectors.T @ y, eig.vectors.T @ thin_q(x), method, 0)

    @classmethod
    def of(cls, lam: np.ndarray, uy: np.ndarray, ux: np.ndarray, method: str, rest: int) -> Profile:
        """From coordinates; rest: further directions of eigenvalue 0 in which neither y nor x has a share."""
        p = cls.__new__(cls)
        p._set(lam, uy, ux, method, rest)
        return p

    def _set(self, lam: np.ndarray, uy: np.ndarray, ux: np.ndarray, method: str, rest: int) -> None:
        if method not in ("REML", "ML"):
            raise ValueError("method is REML or ML")
        self.lam, self.uy, self.ux, self.rest = lam, uy, ux, rest
        self.n, self.q, self.reml = len(lam) + rest, ux.shape[1], method == "REML"
        self.p = self.n - self.q if self.reml else self.n

    def __call__(self, delta) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log-likelihood, slope by delta, weighted residual sum) for an array of deltas."""
        step = max(1, 2_000_000 // max(1, len(self.lam)))
        if np.size(delta) > step:
            parts = [self(delta[k : k + step]) for k in range(0, len(delta), step)]
            return tuple(np.concatenate(x) for x in zip(*parts))
        w = 1 / np.maximum(self.lam + np.atleast_1d(delta)[:, None], 1e-12)
        w0 = 1 / np.maximum(np.atleast_1d(delta), 1e-12)
        pairs = (self.ux[:, :, None] * self.ux[:, None, :]).reshape(len(self.lam), -1)
        a = (w @ pairs).reshape(-1, self.q, self.q)
        beta = np.linalg.solve(a, (w @ (self.ux * self.uy[:, None]))[:, :, None])[:, :, 0]
        r = self.uy - beta @ self.ux.T
        rss = (w * r * r).sum(1)
        ll = 0.5 * (self.p * (np.log(self.p / (2 * np.pi)) - 1 - np.log(rss)) + np.log(w).sum(1) + self.rest * np.log(w0))
        slope = 0.5 * (self.p * (w * w * r * r).sum(1) / rss - w.sum(1) - self.rest * w0)
        if self.reml:  # covariates are orthonormal, so their own determinant is one
            ll -= 0.5 * np.linalg.slogdet(a)[1]
            slope += 0.5 * np.trace(np.linalg.solve(a, (w * w @ pairs).reshape(-1, self.q, self.q)), axis1=1, axis2=2)
        return ll, slope, rss

    def maximise(self, grids: int, low: float, high: float, tol: float) -> tuple[float, float, float]:
        """(delta, log-likelihood, variance of K): log-spaced grid, then bisection of the slope in every bracket."""
        x = np.linspace(low, high, grids + 1)
        ll, slope, _ = self(np.exp(x))
        best = int(np.nanargmax(ll))
        found = [(float(ll[best]), float(np.exp(x[best])))]
        inside = np.flatnonzero((slope[:-1] > 0) & (slope[1:] < 0))
        if len(inside):
            a, b = x[inside], x[inside + 1]
            for _ in range(max(1, math.ceil(math.log2((high - low) / grids / tol)))):
                mid = (a + b) / 2
                up = self(np.exp(mid))[1] > 0
                a, b = np.where(up, mid, a), np.where(up, b, mid)
            d = np.exp((a + b) / 2)
            found += zip(self(d)[0].tolist(), d.tolist())
        top, delta = max(found)
        return delta, top, float(self(delta)[2][0] / self.p)


@dataclass
class Fit:
    """One fitted null model."""

    delta: float
    vg: float
    ve: float
    ll: float
    heritability: float
    beta: np.ndarray
    rss: float
    whitener: np.ndarray = field(repr=False)
    n: int = 0
    q: int = 0


def fit(
    y: np.ndarray, k: np.ndarray, x: np.ndarray | None = None, method: str = "REML", eig_k: Eigen | None = None,
    grids: int = 100, low: float = -10, high: float = 10, tol: float = 1e-12, whiten: bool = True,
) -> Fit:
    """Fit by REML or ML; x defaults to an intercept. eig_k saves the decomposition of K, whiten=False the n x n whitener."""
    y = np.asarray(y, float).ravel()
    n = len(y)
    x = np.ones((n, 1)) if x is None else np.asarray(x, float).reshape(n, -1)
    eig_k = eig_k or Eigen.of(k)
    delta, ll, vg = Profile(y, x, eig_k, method).maximise(grids, low, high, tol)
    return _complete(y, x, eig_k, delta, vg, ll, whiten)


def _complete(y, x, eig_k: Eigen, delta: float, vg: float, ll: float, whiten: bool) -> Fit:
    root = 1 / np.sqrt(np.maximum(eig_k.values + delta, 1e-12))
    wx, wy = root[:, None] * (eig_k.vectors.T @ x), root * (eig_k.vectors.T @ y)
    beta, *_ = np.linalg.lstsq(wx, wy, rcond=None)
    r = wy - wx @ beta
    w = (eig_k.vectors * root).T if whiten else None
    return Fit(delta, vg, vg * delta, ll, 1 / (1 + delta), beta, float(r @ r), w, len(y), x.shape[1])


def search_ratio(value, grids: int = 5, rounds: int = 5, low: float = -3, high: float = 3) -> tuple[float, float, float]:
    """(share a, value, delta) of the greatest value(a) = (value, delta): nested grids over the log of a / (1 - a)."""
    best: tuple[float, float, float] | None = None
    for _ in range(rounds):
        step = (high - low) / grids
        for lr in np.linspace(low, high, grids + 1):
            ll, delta = value(1 / (1 + math.exp(-lr)))
            if best is None or ll > best[0]:
                best = (ll, lr, delta)
        low, high = best[1] - step, best[1] + step
    return 1 / (1 + math.exp(-best[1])), best[0], best[2]


class LocalAndRest:
    """ML likelihood of y ~ a K_rest + (1 - a) K_local + delta I with an intercept, both matrices scaled.

    total: decomposition of the mean kinship of all ``m_total`` markers; root: n x
    r with root root' the mean kinship of the m local ones. The rest is the
    difference, so in the basis of the total the covariance is a diagonal plus r
    columns: a likelihood costs n r^2, and neither the local matrix nor that of the
    rest is formed or decomposed.
    """

    def __init__(self, y: np.ndarray, total: Eigen, total_mean: np.ndarray, m_total: int, root: np.ndarray, m: int):
        n = len(y)
        self.lam, self.n = total.values, n
        self.b = total.vectors.T @ root
        self.yx = total.vectors.T @ np.column_stack([y, np.ones(n)])
        local = np.array([np.square(root).sum(), np.square(root.sum(axis=0)).sum()])  # trace and sum
        rest = (np.array([np.trace(total_mean), total_mean.sum()]) * m_total - local * m) / (m_total - m)
        self.s_local, self.s_rest = ((n - 1) / (trace - whole / n) for trace, whole in (local, rest))
        self.grow, self.shrink = m_total / (m_total - m), m / (m_total - m)

    @staticmethod
    def root_of(local_mean: np.ndarray) -> np.ndarray:
        """The root of a local kinship of which only the matrix is known."""
        mu, q = np.linalg.eigh(local_mean)
        keep = mu > 1e-10 * max(mu[-1], 1e-300)
        return q[:, keep] * np.sqrt(mu[keep])

    @property
    def rank(self) -> int:
        return self.b.shape[1]

    def ll(self, a: float, delta) -> np.ndarray | float:
        """Log-likelihood at one ratio and one or many deltas; -inf where the covariance isn't positive."""
        deltas = np.atleast_1d(np.asarray(delta, float))
        d = 1 / np.maximum(a * self.s_rest * self.grow * self.lam + deltas[:, None], 1e-12)
        beta = (1 - a) * self.s_local - a * self.s_rest * self.shrink
        r, out = self.rank, np.full(len(deltas), -math.inf)
        step = max(1, 4_000_000 // max(1, self.n * r))
        for k in range(0, len(deltas), step):
            w = d[k : k + step]
            wb = w[:, :, None] * self.b
            inner = np.eye(r) + beta * (self.b.T @ wb)
            sign, logdet = np.linalg.slogdet(inner)
            z = np.swapaxes(wb, 1, 2) @ self.yx
            g = self.yx.T @ (w[:, :, None] * self.yx)
            ok = sign > 0
            if ok.any():
                g[ok] -= beta * np.swapaxes(z[ok], 1, 2) @ np.linalg.solve(inner[ok], z[ok])
            rss = g[:, 0, 0] - g[:, 0, 1] ** 2 / g[:, 1, 1]
            ok &= rss > 0
            out[k : k + step][ok] = 0.5 * (self.n * (math.log(self.n / (2 * math.pi)) - 1 - np.log(rss[ok])) + np.log(w[ok]).sum(axis=1) - logdet[ok])
        return out if np.ndim(delta) else float(out[0])

    def best_delta(self, a: float, grids: int = 25, low: float = -10, high: float = 10, rounds: int = 10, fine: int = 8) -> tuple[float, float]:
        """(log-likelihood, delta) of the best delta: a grid over its logarithm, then finer grids around the best point."""
        x = np.linspace(low, high, grids + 1)
        best, at, step = -math.inf, low, (high - low) / grids
        for _ in range(rounds + 1):
            v = self.ll(a, np.exp(x))
            i = int(np.argmax(v))
            if v[i] > best:
                best, at = float(v[i]), float(x[i])
            x = np.linspace(max(low, at - step), min(high, at + step), fine + 1)
            step = (x[-1] - x[0]) / fine
        return best, math.exp(at)

    def test(self) -> dict:
        """The likelihood-ratio test of the local matrix, and the shares of the variance."""
        ll0, _ = self.best_delta(1.0)
        a, ll, delta = search_ratio(self.best_delta)
        stat, h = max(0.0, 2 * (ll - ll0)), 1 / (1 + delta)
        return {"stat": stat, "p_value": float(chi2_sf(stat, 1)), "perc_var1": h * a, "perc_var2": h * (1 - a), "pseudo_heritability": h}


def fit_two(y: np.ndarray, k1: np.ndarray, k2: np.ndarray, x: np.ndarray | None = None, method: str = "REML", grids: int = 5, rounds: int = 5, low: float = -3, high: float = 3) -> dict:
    """Two covariance matrices: search of the ratio r in a K1 + (1 - a) K2, a = r / (1 + r).

    Returns the best fit, the share a, and the shares of the variance of K1, K2
    and the residual.
    """
    k1, k2 = scale_k(np.asarray(k1, float)), scale_k(np.asarray(k2, float))
    x = np.ones((len(y), 1)) if x is None else x

    def value(a: float) -> tuple[float, float]:
        f = fit(y, a * k1 + (1 - a) * k2, x, method, grids=50, whiten=False)
        return f.ll, f.delta

    a, ll, _ = search_ratio(value, grids, rounds, low, high)
    f = fit(y, a * k1 + (1 - a) * k2, x, method, grids=50)
    return {"fit": f, "ll": ll, "share": a, "perc_var1": f.heritability * a, "perc_var2": f.heritability * (1 - a), "perc_error": 1 - f.heritability}


def likelihood_ratio(y: np.ndarray, k: np.ndarray, eig_k: Eigen | None = None) -> tuple[float, float]:
    """(statistic, p) of the test that the variance of K is above zero, one degree of freedom. eig_k: of the scaled K."""
    return _against_none(y, fit(np.asarray(y, float), scale_k(k), method="ML", eig_k=eig_k, whiten=False).ll)


def _against_none(y: np.ndarray, full: float) -> tuple[float, float]:
    """The test of a log-likelihood against that without a kinship."""
    y = np.asarray(y, float)
    n = len(y)
    null = -0.5 * n * (math.log(2 * math.pi * float(np.var(y))) + 1)
    stat = max(0.0, 2 * (full - null))
    return stat, float(chi2_sf(stat, 1))


def blup(y: np.ndarray, k: np.ndarray, heritability: float, mean: float | None = None) -> np.ndarray:
    """K (K + delta I)^-1 (y - mean) with delta = (1 - h) / h; zeros for h = 0."""
    y = np.asarray(y, float)
    if heritability <= 0:
        return np.zeros(len(y))
    delta = (1 - heritability) / heritability
    return k @ np.linalg.solve(k + delta * np.eye(len(y)), y - (y.mean() if mean is None else mean))
