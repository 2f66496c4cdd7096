"""Queries of the mixed-model operators on a kinship whose likelihood SQL can state in closed form.

Individuals of one group (the last digit of their id) are taken as identical, those
of different groups as unrelated: K = ZZ'. Then (K + delta I)^-1 acts on group sums
only, so likelihoods, F-tests, variances and predictions are sums over groups, and
the SQL finds the variance ratio as the zero of the likelihood's slope. The
operators get the dense matrix and know nothing of its form, but for replicated
traits, whose many individuals have their kinship as its root Z.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import reml
from ..operators import scan, stepwise, variance
from ..panel import Panel
from .association import r, rounded, s
from .fixtures import A_SQL, C_SQL, panel_a, phenotypes_c, with_sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_GROUPS = 10
#: What a group adds to the trait, so that there is a variance to find.
_EFFECT = 0.7
COFACTOR = 3


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


# ------------------------------------------------------------------- SQL side


def _pairs(names: list[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(names) for b in names[i:]]


class BlockSql:
    """CTEs that fit and test models over groups. t: table with key columns, grp and the variables."""

    def __init__(self, t: str, keys: list[str], names: list[str]):
        self.keys, self.names = keys, names
        self.k = "".join(f"{k}, " for k in keys)
        sums = ", ".join([f"sum({a}::double) as s_{a}" for a in names] + [f"sum({a}::double * {b}) as p_{a}_{b}" for a, b in _pairs(names)])
        self.ctes = [
            f"q as (select {self.k}grp, count(*)::double as m, {sums} from {t} group by all)",
            f"c as (select {self.k}sum(m) as n, (sum(m) - 1) / (sum(m) - sum(m * m) / sum(m)) as c from q group by all)",
        ]
        self.on = " and ".join(f"g.{k} is not distinct from q.{k} and c.{k} is not distinct from q.{k}" for k in keys) or "true"

    def products(self, grid: str, names: list[str]) -> str:
        """Weighted products at every delta = exp(x) of a grid: S with V^-1, T with V^-2, U without."""
        gk = "".join(f"g.{k}, " for k in self.keys)
        cols = []
        for a, b in _pairs(names):
            mean = f"s_{a} * s_{b} / m"
            cols += [
                f"sum((p_{a}_{b} - {mean}) / exp(x) + {mean} / (exp(x) + c * m)) as S_{a}_{b}",
                f"sum((p_{a}_{b} - {mean}) / exp(x) ^ 2 + {mean} / (exp(x) + c * m) ^ 2) as T_{a}_{b}",
                f"sum(p_{a}_{b}) as U_{a}_{b}",
            ]
        return (
            f"select {gk}x, any_value(n) as n, sum((m - 1) * x + ln(exp(x) + c * m)) as logdet, sum((m - 1) / exp(x) + 1 / (exp(x) + c * m)) as tr, 0.0 as lp, 0.0 as lu, 0.0 as tt, 0 as q, {', '.join(cols)}"
            f" from {grid} as g, q, c where {self.on} group by {gk}x"
        )

    def sweep(self, inner: str, names: list[str], out: str) -> str:
        """Takes a covariate out of all other variables."""
        gk = "".join(f"{k}, " for k in self.keys)
        rest = [v for v in names if v != out]
        key = lambda a, b, m: f"{m}_{a}_{b}" if (a, b) in _pairs(names) else f"{m}_{b}_{a}"
        see, tee, uee = (f"nullif({m}_{out}_{out}, 0)" for m in "STU")
        cols = []
        for a, b in _pairs(rest):
            ka, kb = f"{key(a, out, 'S')} / {see}", f"{key(b, out, 'S')} / {see}"
            cols.append(f"S_{a}_{b} - {ka} * {key(b, out, 'S')} as S_{a}_{b}")
            cols.append(f"T_{a}_{b} - {ka} * {key(b, out, 'T')} - {kb} * {key(a, out, 'T')} + {ka} * {kb} * T_{out}_{out} as T_{a}_{b}")
            cols.append(f"U_{a}_{b} - {key(a, out, 'U')} * {key(b, out, 'U')} / {uee} as U_{a}_{b}")
        return f"select {gk}x, n, logdet, tr, lp + ln({see}) as lp, lu + ln({uee}) as lu, tt + {tee} / {see} as tt, q + 1 as q, {', '.join(cols)} from ({inner})"

    def profile(self, grid: str, covariates: list[str], method: str) -> str:
        """Log-likelihood and slope at every x of a grid, with the residual products of y."""
        names = [*covariates, "y"]
        inner = self.products(grid, names)
        for v in covariates:
            inner = self.sweep(inner, names, v)
            names = [w for w in names if w != v]
        p = "(n - q)" if method == "REML" else "n"
        ll = f"0.5 * ({p} * (ln({p} / (2 * pi())) - 1 - ln(S_y_y)) - logdet" + (" - lp + lu)" if method == "REML" else ")")
        slope = f"{p} * T_y_y / S_y_y - tr" + (" + tt" if method == "REML" else "")
        return f"select *, {ll} as ll, {slope} as slope from ({inner})"

    def fit(self, name: str, covariates: list[str], method: str = "REML", grids: int = 100, low: float = -10, high: float = 10) -> BlockSql:
        """Adds the CTE ``name`` (keys, x): the best log of delta."""
        k, step, fine = self.k, (high - low) / grids, 256
        by = f"partition by {', '.join(self.keys)} " if self.keys else ""
        on = " and ".join(f"b.{v} is not distinct from e.{v}" for v in self.keys) or "true"
        group = f"group by {', '.join(self.keys)}" if self.keys else ""
        self.ctes += [
            f"{name}_g0 as (select {k}{low} + {step} * i as x from (select distinct {k}0 as z from q), (select unnest(range({grids + 1})) as i))",
            f"{name}_e0 as materialized (select {k}x, ll, slope, lead(slope) over ({by}order by x) as after from ({self.profile(f'{name}_g0', covariates, method)}))",
            f"{name}_b0 as (select {k}arg_max(x, ll) filter (slope > 0 and after < 0) as lo, arg_max(x, ll) as best from {name}_e0 {group})",
        ]
        for i in range(1, 6):
            width = step / fine ** (i - 1)
            self.ctes += [
                f"{name}_g{i} as (select {k}coalesce(lo, best) + {width / fine} * i as x from {name}_b{i - 1}, (select unnest(range({fine})) as i))",
                f"{name}_e{i} as materialized (select {k}x, slope from ({self.profile(f'{name}_g{i}', covariates, method)}))",
                f"{name}_b{i} as (select {', '.join(f'b.{v}' for v in self.keys) + ', ' if self.keys else ''}case when any_value(b.lo) is not null then max(e.x) filter (e.slope > 0) end as lo, any_value(b.best) as best from {name}_b{i - 1} as b join {name}_e{i} as e on {on} {'group by ' + ', '.join(f'b.{v}' for v in self.keys) if self.keys else ''})",
            ]
        self.ctes.append(f"{name} as (select {k}coalesce(lo, best) as x from {name}_b5)")
        return self

    def at(self, name: str, grid: str, covariates: list[str], rest: list[str]) -> BlockSql:
        """Adds the CTE ``name``: products of the variables in ``rest`` without the covariates, at the x of ``grid``."""
        names = [*covariates, *rest]
        inner = self.products(grid, names)
        for v in covariates:
            inner = self.sweep(inner, names, v)
            names = [w for w in names if w != v]
        self.ctes.append(f"{name} as ({inner})")
        return self


def _sql(base: list[str], block: BlockSql, select: str) -> str:
    return with_sql(*base, *block.ctes) + select


#: One row per individual and marker, with the group, the trait and the environment.
_T = f"""t as (
  select marker_id, chrom, pos, vec_id % {_GROUPS} as grp, 1 as o, g, y + {_EFFECT} * (vec_id % {_GROUPS}) as y, (vec_id // {_GROUPS}) % 2 as e, g * ((vec_id // {_GROUPS}) % 2) as ge,
    max(case when marker_id = {COFACTOR} then g end) over (partition by vec_id) as h from a
), u as (select * replace (g * h as ge) from t), one as (select * from t where marker_id = 0)"""
_BASE = [A_SQL, _T]


def _everywhere(name: str, fitted: str) -> str:
    """A fitted ratio for every marker."""
    return f"{name} as (select marker_id, x from (select distinct marker_id from t), {fitted})"


def _panel(spark: SparkSession, d: str) -> tuple[Panel, np.ndarray, np.ndarray]:
    p, y = panel_a(spark, d)
    group = np.array([int(x) % _GROUPS for x in p.ids])
    return p, y + _EFFECT * group, (group[:, None] == group).astype(float)


# --------------------------------------------------------------------- queries

_FIT = BlockSql("one", [], ["o", "y"]).fit("f", ["o"]).fit("l", ["o"], "ML")
_FIT.ctes += [
    f"fr as ({_FIT.profile('f', ['o'], 'REML')})", f"fl as ({_FIT.profile('l', ['o'], 'ML')})", f"beta as (select 'REML' as method, S_o_y / S_o_o as mean from ({_FIT.products('f', ['o', 'y'])}) union all select 'ML', S_o_y / S_o_o from ({_FIT.products('l', ['o', 'y'])}))",
    "both_fits as (select 'REML' as method, x, n, ll, S_y_y as rss, S_y_y / (n - 1) as vg from fr union all select 'ML', x, n, ll, S_y_y, S_y_y / n from fl)",
]


@query(_sql(_BASE, _FIT, f"select method, {s('x', 5)} as log_delta, {s('1 / (1 + exp(x))')} as heritability, {s('vg', 5)} as vg, {s('vg * exp(x)', 5)} as ve, {s('ll', 5)} as ll, {s('mean', 5)} as mean, {s('rss', 2)} as rss from both_fits join beta using (method)"))
def block_fit(spark: SparkSession, d: str) -> DataFrame:
    """REML and ML fits of the trait: ratio, variances, likelihood, mean."""
    _, y, k = _panel(spark, d)
    rows = []
    for m in ("REML", "ML"):
        f = reml.fit(y, reml.scale_k(k), method=m)
        rows.append((m, float(np.log(f.delta)), f.heritability, f.vg, f.ve, f.ll, float(f.beta[0]), f.rss))
    out = spark.createDataFrame(rows, "method string, log_delta double, heritability double, vg double, ve double, ll double, mean double, rss double")
    return rounded(rounded(rounded(out, "rss", digits=2), "log_delta", "vg", "ve", "ll", "mean", digits=5), "heritability")


@query(_sql(_BASE, _FIT, f"select {s('2 * (ll + n / 2 * (ln(2 * pi() * v) + 1))', 4)} as stat from fl, (select var_pop(y) as v from one)"))
def block_likelihood_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Statistic of the test that the kinship explains no variance."""
    _, y, k = _panel(spark, d)
    return spark.createDataFrame([(reml.likelihood_ratio(y, k)[0],)], "stat double").select(r("stat", 4).alias("stat"))


def _scan_sql(names: list[str], covariates: list[str], table: str, tail: list[str], select: str) -> str:
    """A scan with the null model's ratio: products of the markers without the covariates."""
    null = BlockSql("one", [], [*covariates, "y"]).fit("f", covariates)
    each = BlockSql(table, ["marker_id"], names)
    each.ctes.append(_everywhere("ratio", "nf"))
    each.at("w", "ratio", covariates, [v for v in names if v not in covariates])
    return with_sql(*_BASE, f"nf as (with {', '.join(null.ctes)} select x from f)", *each.ctes, *tail) + select


_F1 = "(S_y_y / nullif(S_y_y - S_g_y ^ 2 / S_g_g, 0) - 1)"


@query(_scan_sql(["o", "g", "y"], ["o"], "t", [], f"select marker_id, {s('S_g_y / S_g_g')} as beta, {s(f'{_F1} * (n - 2)', 4)} as f_stat, {s('S_y_y - S_g_y ^ 2 / S_g_g', 2)} as rss, {s('S_g_y ^ 2 / S_g_g / S_y_y')} as var_perc from w"))
def block_emmax(spark: SparkSession, d: str) -> DataFrame:
    """Mixed-model scan with one ratio for all markers."""
    p, y, k = _panel(spark, d)
    out = scan.emmax(p, y, k)[0].select("marker_id", "beta", "f_stat", "rss", "var_perc")
    return rounded(rounded(rounded(out, "rss", digits=2), "f_stat", digits=4), "beta", "var_perc")


_EMMA = BlockSql("t", ["marker_id"], ["o", "g", "y"]).fit("f", ["o", "g"], grids=50, low=-4).at("w", "f", ["o"], ["g", "y"])


@query(_sql(_BASE, _EMMA, f"select marker_id, {s('x', 5)} as log_delta, {s('S_g_y / S_g_g', 5)} as beta, {s(f'{_F1} * (n - 2)', 4)} as f_stat, {s('S_y_y - S_g_y ^ 2 / S_g_g', 2)} as rss from w"))
def block_emma(spark: SparkSession, d: str) -> DataFrame:
    """Exact mixed model: the ratio is fitted for every marker."""
    p, y, k = _panel(spark, d)
    out = scan.emma(p, y, k).select("marker_id", F.log("delta").alias("log_delta"), "beta", "f_stat", "rss")
    return rounded(rounded(rounded(out, "rss", digits=2), "f_stat", digits=4), "beta", "log_delta", digits=5)


_TWO = ["w2 as (select *, S_y_y - S_g_y ^ 2 / nullif(S_g_g, 0) as r1, S_g_g > 1e-9 as ok, S_ge_ge - S_g_ge ^ 2 / nullif(S_g_g, 0) as ee, S_ge_y - S_g_ge * S_g_y / nullif(S_g_g, 0) as ey from w)", "w3 as (select *, r1 - ey ^ 2 / ee as r2 from w2)"]


@query(_scan_sql(["o", "e", "g", "ge", "y"], ["o", "e"], "t", _TWO, f"select marker_id, {s('(S_y_y / r1 - 1) * (n - 3)', 4)} as f_g, {s('(S_y_y / r2 - 1) * (n - 4) / 2', 4)} as f_joint, {s('(r1 / r2 - 1) * (n - 3)', 4)} as f_gxe, {s('r1', 2)} as rss_g, {s('r2', 2)} as rss_joint from w3"))
def block_gxe(spark: SparkSession, d: str) -> DataFrame:
    """Gene-by-environment scan in the mixed model."""
    p, y, k = _panel(spark, d)
    out = scan.emmax_gxe(p, y, k, [int(x) // _GROUPS % 2 for x in p.ids])[0].select("marker_id", "f_g", "f_joint", "f_gxe", "rss_g", "rss_joint")
    return rounded(rounded(out, "rss_g", "rss_joint", digits=2), "f_g", "f_joint", "f_gxe", digits=4)


_SUMS = "sums as (select marker_id, sum(g) > 15 and sum(ge) > 15 as may from u group by 1)"
_INTER = [_SUMS, "w2 as (select *, S_g_g > 1e-6 as ok from w join sums using (marker_id))",
          "w3 as (select *, case when ok then S_g_y ^ 2 / S_g_g else 0 end as fall1, case when may then S_ge_ge - case when ok then S_g_ge ^ 2 / S_g_g else 0 end end as ee, S_ge_y - case when ok then S_g_ge * S_g_y / S_g_g else 0 end as ey from w2)",
          "w4 as (select *, ok::int + coalesce(ee > 1e-6, false)::int as used, S_y_y - fall1 - case when coalesce(ee > 1e-6, false) then ey ^ 2 / ee else 0 end as rss from w3)"]


@query(_scan_sql(["o", "h", "g", "ge", "y"], ["o", "h"], "u", _INTER, f"select marker_id, used::double as n_tested, {s('case when used > 0 then (S_y_y / rss - 1) * (n - 2 - used) / used else 0 end', 4)} as f_stat, {s('rss', 2)} as rss from w4"))
def block_interactions(spark: SparkSession, d: str) -> DataFrame:
    """Each marker and its product with one cofactor in the mixed model."""
    p, y, k = _panel(spark, d)
    cofactor = p.markers.filter(F.col("marker_id") == COFACTOR).first().calls
    out = scan.emmax_interactions(p, y, k, [cofactor])[0].select("marker_id", "n_tested", "f_stat", "rss")
    return rounded(rounded(out, "rss", digits=2), "f_stat", digits=4)


@query(_scan_sql(["o", "g", "y"], ["o"], "t", ["pri as (select distinct marker_id, pos / 100000.0 as prior from t)"], f"""select marker_id, {s('prior')} as prior, {s('ln(bf)', 4)} as log_bayes_factor, {s('bf * prior / (1 - prior) / (1 + bf * prior / (1 - prior))')} as ppa
  from (select marker_id, prior, exp(0.5 * (n * ln(S_y_y / (S_y_y - S_g_y ^ 2 / S_g_g)) - ln(n))) as bf from w join pri using (marker_id))"""))
def block_posteriors(spark: SparkSession, d: str) -> DataFrame:
    """Bayes factors and posterior probabilities of a mixed-model scan; the prior grows with the position."""
    p, y, k = _panel(spark, d)
    priors = p.markers.select("chrom", "pos", (F.col("pos") / 100000.0).alias("prior"))
    out = scan.emmax(p, y, k, priors=priors)[0]
    return out.select("marker_id", r("prior").alias("prior"), r(F.log("bayes_factor"), 4).alias("log_bayes_factor"), r("ppa").alias("ppa"))


@query(_scan_sql(["o", "g", "y"], ["o"], "t", [], f"select marker_id, 2.0::double as n_classes, {s(f'{_F1} * (n - 2)', 4)} as f_stat, {s('S_g_y ^ 2 / S_g_g / S_y_y')} as var_perc from w"))
def block_anova(spark: SparkSession, d: str) -> DataFrame:
    """Analysis of variance over the marker's classes in the mixed model."""
    p, y, k = _panel(spark, d)
    out = scan.emmax_anova(p, y, k)[0].select("marker_id", "n_classes", "f_stat", "var_perc")
    return rounded(rounded(out, "f_stat", digits=4), "var_perc")


@query(_scan_sql(["o", "h", "g", "y"], ["o", "h"], "t", [], f"select marker_id, {s(f'{_F1} * (n - 3)', 4)} as f_stat, {s('S_y_y - S_g_y ^ 2 / S_g_g', 2)} as rss from w where marker_id <> {COFACTOR}"))
def block_step(spark: SparkSession, d: str) -> DataFrame:
    """Scan of one step of the multi-locus search, given one cofactor."""
    p, y, k = _panel(spark, d)
    at = p.markers.filter(F.col("marker_id") == COFACTOR).first()
    out = stepwise.single_step(p, y, [(at.chrom, at.pos)], k)[1].select("marker_id", "f_stat", "rss")
    return rounded(rounded(out, "rss", digits=2), "f_stat", digits=4)


_STEP = BlockSql("one", [], ["o", "h", "y"]).fit("f", ["o", "h"]).fit("l", ["o", "h"], "ML")
_STEP.ctes += [f"fr as ({_STEP.profile('f', ['o', 'h'], 'REML')})", f"fl as ({_STEP.profile('l', ['o', 'h'], 'ML')})", "m as (select count(distinct marker_id)::double as m from t)"]


@query(_sql(_BASE, _STEP, f"""select {s('fl.ll', 4)} as ll, {s('-2 * fl.ll + 3 * ln(fl.n)', 4)} as bic, {s('-2 * fl.ll + 3 * ln(fl.n) + 2 * ln(m)', 4)} as ebic, {s('-2 * fl.ll + 3 * ln(fl.n) + 6 * ln(m / 2.2 - 1)', 4)} as mbic,
  {s('fr.S_y_y', 2)} as rss, {s('1 / (1 + exp(fr.x))')} as pseudo_heritability from fl, fr, m"""))
def block_step_criteria(spark: SparkSession, d: str) -> DataFrame:
    """Likelihood, information criteria and heritability of the model with one cofactor."""
    p, y, k = _panel(spark, d)
    at = p.markers.filter(F.col("marker_id") == COFACTOR).first()
    t = stepwise.single_step(p, y, [(at.chrom, at.pos)], k)[0]
    out = spark.createDataFrame([(float(t.ll), float(t.bic), float(t.ebic), float(t.mbic), float(t.rss), float(t.heritability))], "ll double, bic double, ebic double, mbic double, rss double, pseudo_heritability double")
    return rounded(rounded(rounded(out, "ll", "bic", "ebic", "mbic", digits=4), "rss", digits=2), "pseudo_heritability")


# traits with replicates: the kinship of an observation is that of its individual
_TRAIT_T = f"""t as (
  select phen_id, indiv_id, indiv_id::bigint % {_GROUPS} as grp, 1 as o, unnest([min(value), max(value)]) + 4 * (indiv_id::bigint % {_GROUPS}) as y from c group by phen_id, indiv_id
)"""

def _trait_sql(select: str) -> str:
    b = BlockSql("t", ["phen_id"], ["o", "y"]).fit("f", ["o"])
    b.ctes.append(f"w as ({b.profile('f', ['o'], 'REML')})")
    return with_sql(C_SQL.replace("c as (", "events_c as (", 1), _TRAIT_T.replace("from c group", "from events_c group"), *b.ctes) + select


def _traits(spark: SparkSession, d: str) -> tuple[DataFrame, reml.LowRank, list[str]]:
    """Least and greatest value of every individual as two replicates."""
    every = phenotypes_c(spark, d)
    phens = every.groupBy("phen_id", "indiv_id").agg(F.min("value").alias("a"), F.max("value").alias("b"))
    shifted = phens.select("phen_id", "indiv_id", (F.explode(F.array("a", "b"))).alias("value")).withColumn("value", F.col("value") + 4 * (F.col("indiv_id").cast("long") % _GROUPS))
    ids = sorted(every.select("indiv_id").distinct().toArrow().column("indiv_id").to_pylist(), key=int)  # the individuals
    group = np.array([int(x) % _GROUPS for x in ids])
    return shifted, reml.LowRank(np.eye(_GROUPS)[group]), ids


@query(_trait_sql(f"select phen_id::int as phen_id, n::bigint as n, {s('1 / (1 + exp(x))', 5)} as heritability, {s('S_y_y / (n - 1)', 3)} as vg, {s('S_y_y / (n - 1) * exp(x)', 3)} as ve from w"))
def block_heritability(spark: SparkSession, d: str) -> DataFrame:
    """Heritability and variances of replicated traits."""
    phens, k, ids = _traits(spark, d)
    out = variance.trait_heritability(phens, k, ids).select("phen_id", "n", "heritability", "vg", "ve")
    return rounded(rounded(out, "vg", "ve", digits=3), "heritability", digits=5)


@query(_trait_sql(f""", h as (
  select t.phen_id, grp, c * (sum(y) - count(*) * any_value(mean)) / (exp(any_value(x)) + c * count(*)) as blup, any_value(mean) as mean
  from t join (select phen_id, avg(y) as mean from t group by 1) using (phen_id) join w using (phen_id) join c using (phen_id) group by t.phen_id, grp, c
) select phen_id::int as phen_id, indiv_id, {s('y', 4)} as value, {s('blup', 4)} as blup, {s('y - mean - blup', 4)} as residual from t join h using (phen_id, grp)"""))
def block_blups(spark: SparkSession, d: str) -> DataFrame:
    """Predicted genetic values and residuals of replicated traits."""
    return rounded(variance.trait_blups(*_traits(spark, d)), "value", "blup", "residual", digits=4)

