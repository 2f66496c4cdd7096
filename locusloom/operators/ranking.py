"""Ranks, quantiles and cut-offs of association results (row_id, chrom, pos, score, ...).

Ranks of all rows are numbered by range partitioning; single order statistics,
medians, grids and distribution tests come from counted buckets (``orderstats``);
extreme values and top lists use aggregates and limits. Nothing sorts everything in
one task.
Ties are broken by row_id.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dist import kolmogorov_sf, neg_log10
from .ordering import row_numbers
from .orderstats import Ordered, greatest_gap


def ranks(results: DataFrame, score: str = "score", ascending: bool = True) -> DataFrame:
    """results with their 1-based rank; NULL scores come last."""
    first = F.col(score).asc_nulls_last() if ascending else F.col(score).desc_nulls_last()
    return row_numbers(results, [first, F.col("row_id")], "_r").withColumn("rank", F.col("_r") + 1).drop("_r")


def score_at(results: DataFrame, fraction: float, score: str = "score") -> float | None:
    """The score at 0-based place int(n * fraction) of the ascending order, the last one at most."""
    s = Ordered(results, score)
    return s.at([min(s.n - 1, int(s.n * fraction))])[min(s.n - 1, int(s.n * fraction))] if s.n else None


def filter_percentile(results: DataFrame, fraction: float, reverse: bool = False, score: str = "score") -> DataFrame:
    """Rows with a score of at least score_at(fraction), or at most where reversed."""
    edge = score_at(results, fraction, score)
    if edge is None:
        return results
    return results.filter(F.col(score) <= edge if reverse else F.col(score) >= edge)


def filter_attribute(results: DataFrame, name: str, threshold: float, reverse: bool = False) -> DataFrame:
    """Rows whose column is at least the threshold, or at most where reversed."""
    return results.filter(F.col(name) <= threshold if reverse else F.col(name) >= threshold)


def keep_rows(results: DataFrame, row_ids: DataFrame) -> DataFrame:
    return results.join(row_ids.select("row_id").distinct(), "row_id", "left_semi")


def top(results: DataFrame, n: int, largest: bool = False, score: str = "score") -> DataFrame:
    """The n smallest (or largest) scores."""
    order = F.col(score).desc_nulls_last() if largest else F.col(score).asc_nulls_last()
    return results.orderBy(order, "row_id").limit(n)


def extreme(results: DataFrame, name: str = "score", largest: bool = True) -> DataFrame:
    """The row with the largest (or smallest) value; of several the first."""
    return top(results.filter(F.col(name).isNotNull()), 1, largest, name)


def summary(results: DataFrame, score: str = "score") -> DataFrame:
    """n_scores, min_score, max_score."""
    return results.agg(F.count(score).alias("n_scores"), F.min(score).alias("min_score"), F.max(score).alias("max_score"))


def in_genome_order(results: DataFrame) -> DataFrame:
    return results.orderBy("chrom", "pos", "row_id")


def locus_rows(results: DataFrame, loci: DataFrame) -> DataFrame:
    """loci with the row_id of the result at each, -1 where there is none."""
    r = results.groupBy("chrom", "pos").agg(F.min("row_id").alias("_r"))
    return loci.join(r, ["chrom", "pos"], "left").withColumn("row_id", F.coalesce("_r", F.lit(-1)).cast("long")).drop("_r")


def common_top(a: DataFrame, b: DataFrame, fraction: float = 0.1, largest: bool = False) -> tuple[DataFrame, DataFrame]:
    """Both results cut to loci in either's top fraction that exist in the other."""
    def best(df: DataFrame) -> DataFrame:
        edge = score_at(df, 1 - fraction if largest else fraction)
        keep = F.col("score") >= edge if largest else F.col("score") < edge
        return df.filter(keep).select("chrom", "pos")

    both = a.select("chrom", "pos").intersect(b.select("chrom", "pos"))
    loci = best(a).unionByName(best(b)).distinct().join(both, ["chrom", "pos"], "left_semi")
    return tuple(d.join(loci, ["chrom", "pos"], "left_semi") for d in (a, b))


def chromosome_ends(df: DataFrame) -> DataFrame:
    """chrom, end_pos."""
    return df.groupBy("chrom").agg(F.max("pos").alias("end_pos"))


def genome_length(df: DataFrame) -> DataFrame:
    return chromosome_ends(df).agg(F.sum("end_pos").alias("genome_length"))


def chromosome_splits(results: DataFrame) -> DataFrame:
    """chrom and the 0-based place of its first row in genome order; empty chromosomes between get the next one's."""
    counts = results.groupBy("chrom").agg(F.count("*").alias("n")).collect()  # one row per chromosome
    n = {r.chrom: r.n for r in counts}
    rows, total = [], 0
    for c in range(min(n, default=0), max(n, default=-1) + 1):
        rows.append((c, total))
        total += n.get(c, 0)
    return results.sparkSession.createDataFrame(rows, "chrom int, first_row long")


def negative_log10(results: DataFrame, score: str = "score") -> DataFrame:
    """score becomes -log10(score), 323 where it is zero."""
    return results.withColumn(score, neg_log10(F.col(score)))


def significant(results: DataFrame, n_tests: int | None = None, alpha: float = 0.05) -> DataFrame:
    """Adds ``significant``: score below alpha over the number of tests."""
    m = n_tests or results.count()
    return results.withColumn("significant", F.col("score") < alpha / m if m else F.lit(False))


# ---------------------------------------------------------------- distributions


def quantile_grid(results: DataFrame, dots: int = 1000, score: str = "score") -> DataFrame:
    """i, observed: the score at place int(n * i / (dots + 2)), i = 1..dots."""
    s = Ordered(results, score)
    place = {i: s.n * i // (dots + 2) for i in range(1, dots + 1)}
    found = s.at(list(place.values()))
    return results.sparkSession.createDataFrame([(i, found[k]) for i, k in place.items() if k in found], "i int, observed double")


def log_quantile_grid(results: DataFrame, dots: int = 1000, max_value: float = 5, score: str = "score") -> DataFrame:
    """i, expected, observed in -log10: places int(10^-(i / (dots + 1) * max_value) * n), i = 1..dots."""
    s = Ordered(results, score)
    expected = {i: i / (dots + 1) * float(max_value) for i in range(1, dots + 1)}
    place = {i: math.floor(math.pow(10.0, -e) * s.n) for i, e in expected.items()}
    found = s.at(list(place.values()))
    grid = results.sparkSession.createDataFrame([(i, expected[i], found[k]) for i, k in place.items() if k in found], "i int, expected double, x double")
    return grid.select("i", "expected", neg_log10(F.col("x")).alias("observed"))


def expected_grid(spark, n: int) -> DataFrame:
    """i, expected: (i + 0.5) / (n + 1), i = 0..n-1."""
    return spark.range(n).select(F.col("id").cast("int").alias("i"), ((F.col("id") + 0.5) / (n + 1)).alias("expected"))


def area_between(quantiles: DataFrame) -> DataFrame:
    """One row: area between observed and expected by the trapezoid rule; expects i, observed, expected."""
    nxt = quantiles.select((F.col("i") - 1).alias("i"), F.col("observed").alias("o2"), F.col("expected").alias("e2"))
    d = quantiles.join(nxt, "i")
    part = (F.col("e2") - F.col("expected")) * F.abs((F.col("observed") - F.col("expected")) + (F.col("o2") - F.col("e2"))) / 2
    return d.agg(F.sum(part).alias("area"))


def median_offset(results: DataFrame, score: str = "score", expected: float = 0.5) -> DataFrame:
    """One row: expected median minus the score at place n div 2."""
    s = Ordered(results, score)
    found = s.at([s.n // 2])
    return results.sparkSession.createDataFrame([(float(expected) - x,) for x in found.values()], "median_offset double")


def ks_uniform(results: DataFrame, score: str = "score") -> DataFrame:
    """One row: D and p of the Kolmogorov-Smirnov test against the uniform distribution."""
    d, n, _ = greatest_gap(results, None, score)
    return results.sparkSession.createDataFrame([(d, kolmogorov_sf(d, n) if n else None)], "d double, p double")


def ks_two_samples(a: DataFrame, b: DataFrame, score: str = "score") -> DataFrame:
    """One row: D and p of the two-sample test."""
    d, na, nb = greatest_gap(a, b, score)
    p = kolmogorov_sf(d, na * nb / (na + nb)) if na and nb else None
    return a.sparkSession.createDataFrame([(d, p)], "d double, p double")


def relative_rank(col: Column, n: int) -> Column:
    return col / n
