"""Phenotypes in long form: phen_id, phen_name, indiv_id, replicate_id, value, raw_value, transformation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dist import shapiro_wilk

TRANSFORMS = ("none", "sqrt", "log", "sqr", "exp", "arcsin_sqrt", "ascombe", "box_cox", "most_normal")


def phenotypes(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """From (phen_id, phen_name, indiv_id, value) on the driver."""
    df = spark.createDataFrame(rows, "phen_id int, phen_name string, indiv_id string, value double")
    return df.select("phen_id", "phen_name", "indiv_id", F.lit(None).cast("int").alias("replicate_id"), "value", F.col("value").alias("raw_value"), F.lit(None).cast("string").alias("transformation"))


def trait_list(phens: DataFrame) -> DataFrame:
    """phen_id, phen_name, n_values, n_individuals."""
    return phens.groupBy("phen_id").agg(F.min("phen_name").alias("phen_name"), F.count("value").alias("n_values"), F.countDistinct("indiv_id").alias("n_individuals"))


def number_replicates(phens: DataFrame) -> DataFrame:
    """replicate_id 1, 2, ... per trait and individual in order of value."""
    w = Window.partitionBy("phen_id", "indiv_id").orderBy("value", "raw_value")
    return phens.withColumn("replicate_id", F.row_number().over(w))


def averages(phens: DataFrame) -> DataFrame:
    """phen_id, indiv_id, value (mean), n_replicates."""
    return phens.groupBy("phen_id", "indiv_id").agg(F.avg("value").alias("value"), F.count("value").alias("n_replicates"))


def value_lists(phens: DataFrame) -> DataFrame:
    """phen_id, indiv_id, values in order, n_replicates; replicates of one individual are few."""
    return phens.groupBy("phen_id", "indiv_id").agg(F.sort_array(F.collect_list("value")).alias("values"), F.count("value").alias("n_replicates"))


def to_averages(phens: DataFrame) -> DataFrame:
    """Replicates replaced by their mean; the other columns of phenotypes stay."""
    return phens.groupBy("phen_id", "indiv_id").agg(
        F.min("phen_name").alias("phen_name"), F.lit(1).alias("replicate_id"), F.avg("value").alias("value"), F.avg("raw_value").alias("raw_value"), F.min("transformation").alias("transformation")
    )


def environment_summary(phens: DataFrame, positive_only: list[int] = []) -> DataFrame:
    """phen_id, env, indiv_id, mean, median, n from replicates with column env; NaN and, for listed traits, values <= 0 are left out."""
    ok = F.col("value").isNotNull() & ~F.isnan("value")
    if positive_only:
        ok = ok & (~F.col("phen_id").isin(*positive_only) | (F.col("value") > 0))
    return phens.filter(ok).groupBy("phen_id", "env", "indiv_id").agg(F.avg("value").alias("mean"), F.percentile("value", 0.5).alias("median"), F.count("*").alias("n"))


def environment_correlation(summary: DataFrame, env1: str, env2: str, column: str = "mean") -> DataFrame:
    """phen_id, correlation of two environments over common individuals."""
    a = summary.filter(F.col("env") == env1).select("phen_id", "indiv_id", F.col(column).alias("x"))
    b = summary.filter(F.col("env") == env2).select("phen_id", "indiv_id", F.col(column).alias("y"))
    return a.join(b, ["phen_id", "indiv_id"]).groupBy("phen_id").agg(F.corr("x", "y").alias("correlation"), F.count("*").alias("n"))


def correlations(phens: DataFrame, other: DataFrame | None = None) -> DataFrame:
    """phen1, phen2, correlation of individual means on common individuals; all pairs phen1 < phen2, or all with another table."""
    a = averages(phens).select(F.col("phen_id").alias("phen1"), "indiv_id", F.col("value").alias("x"))
    b = averages(phens if other is None else other).select(F.col("phen_id").alias("phen2"), "indiv_id", F.col("value").alias("y"))
    j = a.join(b, "indiv_id")
    if other is None:
        j = j.filter("phen1 < phen2")
    return j.groupBy("phen1", "phen2").agg(F.corr("x", "y").alias("correlation"), F.count("*").alias("n"))


def broad_sense_heritability(phens: DataFrame) -> DataFrame:
    """phen_id, h2 (share of the sum of squares between individuals), h2_mean (1 - (1 - h2) / (n / individuals)).

    From sums and squares per individual, so no window over a trait is needed.
    """
    per = phens.groupBy("phen_id", "indiv_id").agg(F.count("value").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    t = per.groupBy("phen_id").agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    ssb, sst = F.col("b") - F.col("s") * F.col("s") / F.col("n"), F.col("q") - F.col("s") * F.col("s") / F.col("n")
    t = t.withColumn("h2", F.try_divide(ssb, sst))
    return t.select("phen_id", F.col("n").alias("n_values"), F.col("k").alias("n_individuals"), "h2", (1 - (1 - F.col("h2")) / (F.col("n") / F.col("k"))).alias("h2_mean"))


# -------------------------------------------------------------------- filters


def _traits_where(phens: DataFrame, stats: DataFrame, condition: Column) -> DataFrame:
    return phens.join(stats.filter(condition).select("phen_id"), "phen_id", "left_semi")


def keep_traits(phens: DataFrame, ids: list[int]) -> DataFrame:
    return phens.filter(F.col("phen_id").isin(*ids))


def keep_traits_with_values(phens: DataFrame, least: int = 50) -> DataFrame:
    return _traits_where(phens, phens.groupBy("phen_id").agg(F.count("value").alias("n")), F.col("n") >= least)


def spread(phens: DataFrame, min_different: int = 10) -> DataFrame:
    """phen_id, n_distinct, is_binary, is_constant, is_near_constant.

    Near constant: with z = 50 (value - mean) / sd, shifted to a least value of
    0.1 and rounded half up, the fullest bin holds more than n - min_different.
    """
    stats = phens.groupBy("phen_id").agg(
        F.count("value").alias("n"), F.countDistinct("value").alias("n_distinct"), F.min("value").alias("lo"), F.avg("value").alias("m"), F.stddev_pop("value").alias("sd")
    )
    z = F.floor(F.try_divide(50 * (F.col("value") - F.col("lo")), F.col("sd")) + 0.1 + 0.5)
    bins = phens.join(stats, "phen_id").groupBy("phen_id", z.alias("bin")).agg(F.count("*").alias("k")).groupBy("phen_id").agg(F.max("k").alias("fullest"))
    return stats.join(bins, "phen_id").select(
        "phen_id", "n_distinct", (F.col("n_distinct") == 2).alias("is_binary"), (F.col("n_distinct") == 1).alias("is_constant"),
        ((F.col("fullest") > F.col("n") - min_different) | (F.col("n_distinct") == 1)).alias("is_near_constant"),
    )


def drop_near_constant(phens: DataFrame, min_different: int = 15) -> DataFrame:
    return _traits_where(phens, spread(phens, min_different), ~F.col("is_near_constant"))


def drop_outliers(phens: DataFrame, iqr: float) -> DataFrame:
    """Values further than iqr interquartile ranges from the quartiles of their trait are dropped."""
    q = phens.groupBy("phen_id").agg(F.percentile_approx("value", [0.25, 0.75], 10_000).alias("q"))
    d = (F.col("q")[1] - F.col("q")[0]) * iqr
    return phens.join(q, "phen_id").filter(F.col("value").between(F.col("q")[0] - d, F.col("q")[1] + d)).drop("q")


def keep_trait_individuals(phens: DataFrame, ids: DataFrame) -> DataFrame:
    """Values of the listed individuals; an ``ordinal`` column of the list comes along for ordering."""
    cols = ["indiv_id", *(["ordinal"] if "ordinal" in ids.columns else [])]
    return phens.join(ids.select(*cols).dropDuplicates(["indiv_id"]), "indiv_id")


def sample_individuals(phens: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    u = F.pmod(F.xxhash64("indiv_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return phens.filter(u < fraction)


def incidence(phens: DataFrame, phen_id: int) -> DataFrame:
    """(row, indiv_id, col): each value's individual, col its place among the trait's sorted individuals."""
    p = phens.filter(F.col("phen_id") == phen_id)
    cols = p.select("indiv_id").distinct().orderBy("indiv_id").collect()  # the individuals of one trait
    table = phens.sparkSession.createDataFrame([(r.indiv_id, i) for i, r in enumerate(cols)], "indiv_id string, col int")
    order = Window.orderBy("indiv_id", "value")  # within one trait
    return p.join(table, "indiv_id").select((F.row_number().over(order) - 1).alias("row"), "indiv_id", "col")


# -------------------------------------------------------------- transformations


def _with_stats(phens: DataFrame) -> DataFrame:
    """phens with _lo, _hi and _sd of each trait, which are aggregated and joined, since one trait may hold most rows."""
    s = phens.groupBy("phen_id").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"), F.stddev_pop("value").alias("_sd")).withColumnRenamed("phen_id", "_p")
    return phens.join(s, phens["phen_id"].eqNullSafe(s["_p"])).drop("_p")


def transform(phens: DataFrame, kind: str, method: str = "standard") -> DataFrame:
    """Transforms every trait of the table; ``standard`` first shifts values to 0.1 sd above zero.

    arcsin_sqrt leaves traits with values outside 0..1 as they are. box_cox and
    most_normal choose per trait by the Shapiro-Wilk test.
    """
    if kind not in TRANSFORMS:
        raise ValueError(f"transformations: {', '.join(TRANSFORMS)}")
    if kind == "none":
        return phens
    if kind in ("box_cox", "most_normal"):
        return phens.groupBy("phen_id").applyInPandas(_chosen(kind, method), phens.schema)
    x = F.col("value") - F.col("_lo") + 0.1 * F.col("_sd") if method == "standard" else F.col("value")
    value = {
        "log": lambda: F.log(x), "sqrt": lambda: F.sqrt(x), "sqr": lambda: x * x, "exp": lambda: F.exp(x),
        "ascombe": lambda: 2 * F.sqrt(F.col("value") + 0.375), "arcsin_sqrt": lambda: F.asin(F.sqrt(F.col("value"))),
    }[kind]()
    label = F.lit(kind)
    if kind == "arcsin_sqrt":
        fits = (F.col("_lo") >= 0) & (F.col("_hi") <= 1)
        value, label = F.when(fits, value).otherwise(F.col("value")), F.when(fits, label).otherwise(F.col("transformation"))
    return _with_stats(phens).select(*[value.alias(c) if c == "value" else label.alias(c) if c == "transformation" else F.col(c) for c in phens.columns])


def _candidates(v: np.ndarray, method: str, kinds: tuple[str, ...]) -> dict[str, np.ndarray]:
    x = v - v.min() + 0.1 * v.std() if method == "standard" else v
    out = {}
    with np.errstate(all="ignore"):
        for k in kinds:
            if k == "arcsin_sqrt" and (v.min() < 0 or v.max() > 1):
                continue
            y = {"none": lambda: v, "sqrt": lambda: np.sqrt(x), "log": lambda: np.log(x), "sqr": lambda: x * x, "exp": lambda: np.exp(x), "arcsin_sqrt": lambda: np.arcsin(np.sqrt(v))}[k]()
            if np.isfinite(y).all():
                out[k] = y
    return out


def _chosen(kind: str, method: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf["value"].to_numpy(float)
        pdf = pdf.copy()
        if len(v) < 3 or v.max() == v.min():
            return pdf
        if kind == "box_cox":
            x = v - v.min() + 0.1 * v.std() if method == "standard" else v
            if x.min() <= 0:
                return pdf
            grid = [round(a / 10, 1) for a in range(-20, 21)]
            tried = {f"box_cox({a})": np.log(x) if a == 0 else (x**a - 1) / a for a in grid}
            tried = {k: y for k, y in tried.items() if np.isfinite(y).all() and y.max() > y.min()}
        else:
            tried = _candidates(v, method, ("none", "sqrt", "log", "sqr", "exp", "arcsin_sqrt"))
        p = {k: shapiro_wilk(y)[1] for k, y in tried.items()}
        p = {k: x for k, x in p.items() if x == x}
        if not p:
            return pdf
        best = max(p, key=p.get)
        pdf["value"] = tried[best]
        if best != "none":
            pdf["transformation"] = best
        return pdf

    return run


def normality(phens: DataFrame) -> DataFrame:
    """phen_id, w, p of the Shapiro-Wilk test."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        w, p = shapiro_wilk(pdf["value"].dropna())
        return pd.DataFrame({"phen_id": pdf["phen_id"].iloc[:1], "w": [w], "p": [p]})

    return phens.select("phen_id", "value").groupBy("phen_id").applyInPandas(run, "phen_id int, w double, p double")


def revert(phens: DataFrame) -> DataFrame:
    """Raw values again."""
    return phens.withColumn("value", F.coalesce("raw_value", "value")).withColumn("transformation", F.lit(None).cast("string"))


def normalize(phens: DataFrame) -> DataFrame:
    """Values divided by the sample sd of the trait's individual means."""
    sd = averages(phens).groupBy("phen_id").agg(F.stddev_samp("value").alias("_sd"))
    return phens.join(sd, "phen_id").withColumn("value", F.try_divide("value", "_sd")).drop("_sd")


def histogram(phens: DataFrame) -> DataFrame:
    """phen_id, bin, low, high, n with round(8 + 2 ln n) bins per trait."""
    s = phens.groupBy("phen_id").agg(F.count("value").alias("_n"), F.min("value").alias("_a"), F.max("value").alias("_b"))
    s = s.withColumn("_k", F.round(8 + 2 * F.log("_n")))
    width = (F.col("_b") - F.col("_a")) / F.col("_k")
    j = phens.join(s, "phen_id").withColumn("_w", width)
    j = j.withColumn("bin", F.when(F.col("_w") > 0, F.least(F.floor((F.col("value") - F.col("_a")) / F.col("_w")), F.col("_k") - 1)).otherwise(0).cast("int"))
    return j.groupBy("phen_id", "bin").agg((F.min("_a") + F.col("bin") * F.min("_w")).alias("low"), (F.min("_a") + (F.col("bin") + 1) * F.min("_w")).alias("high"), F.count("*").alias("n"))
