"""Tidy tables from which plots are drawn: Manhattan, QQ, box and bar plots, maps and trees."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dist import neg_log10
from ..operators.kinship import upgma
from ..operators.ordering import Along
from ..operators.ranking import chromosome_ends, expected_grid, ks_uniform, log_quantile_grid, median_offset, quantile_grid, score_at
from ..panel import Panel


def offsets(results: DataFrame, gap: int = 0) -> DataFrame:
    """chrom, offset: summed ends of the chromosomes before; one row per chromosome."""
    rows, total = [], 0
    for r in chromosome_ends(results).orderBy("chrom").collect():  # one row per chromosome
        rows.append((r.chrom, total))
        total += r.end_pos + gap
    return results.sparkSession.createDataFrame(rows, "chrom int, offset long")


def manhattan(
    results: DataFrame, p_values: bool = True, fraction: float = 1.0, max_score: float | None = None, threshold: float | None = None,
    highlight: DataFrame | None = None, gap: int = 0, n_tests: int | None = None,
) -> DataFrame:
    """row_id, chrom, pos, x, y, clipped, significant, highlighted.

    y is -log10 of p-values or the score itself, clipped at max_score; fraction
    below 1 keeps only that share of smallest p-values (or largest scores). The
    threshold defaults to 0.05 over the number of tests.
    """
    m = n_tests or results.count()
    t = threshold if threshold is not None else (-math.log10(0.05 / max(m, 1)) if p_values else math.inf)
    shown = results
    if fraction < 1:
        edge = score_at(results, fraction if p_values else 1 - fraction)
        shown = results.filter(F.col("score") <= edge if p_values else F.col("score") >= edge)
    y = neg_log10(F.col("score")) if p_values else F.col("score")
    out = shown.join(F.broadcast(offsets(results, gap)), "chrom")  # one row per chromosome
    out = out.select("row_id", "chrom", "pos", (F.col("pos") + F.col("offset")).alias("x"), y.alias("y"))
    out = out.withColumn("significant", F.col("y") > t)
    out = out.withColumn("clipped", F.col("y") > max_score if max_score is not None else F.lit(False))
    if max_score is not None:
        out = out.withColumn("y", F.least("y", F.lit(float(max_score))))
    if highlight is None:
        return out.withColumn("highlighted", F.lit(False))
    h = highlight.select("chrom", "pos").distinct().withColumn("highlighted", F.lit(True))
    return out.join(h, ["chrom", "pos"], "left").withColumn("highlighted", F.coalesce("highlighted", F.lit(False)))


def star_labels(points: DataFrame, distance: int = 1_000_000) -> DataFrame:
    """The highest significant point of each run of significant points with gaps of at most distance."""
    a = Along(points.filter("significant"), "row_id").lag({"prev": "pos"})
    a = a._again(a.df.withColumn("new", F.when(F.col("prev").isNull() | (F.col("pos") - F.col("prev") > distance), 1).otherwise(0).cast("long"))).running_sum("new", "cluster")
    return a.df.groupBy("chrom", "cluster").agg(F.max_by(F.struct("row_id", "pos", "x", "y"), F.struct("y", -F.col("pos"))).alias("p")).select("chrom", "p.*")


def gene_lanes(genes: DataFrame, lanes: int = 5) -> DataFrame:
    """gene_id, chrom, start_pos, end_pos, lane: neighbouring genes on different lanes."""
    a = Along(genes.withColumn("pos", F.col("start_pos")).withColumn("_one", F.lit(1).cast("long")), "gene_id").running_sum("_one", "k")
    return a.done().select("gene_id", "chrom", "start_pos", "end_pos", ((F.col("k") - 1) % lanes).cast("int").alias("lane"))


def qq(results: DataFrame, label: str = "", dots: int = 1000, max_value: float = 5, log: bool = False) -> DataFrame:
    """label, i, expected, observed: linear quantiles, or -log10 ones at log-spaced ranks."""
    if log:
        out = log_quantile_grid(results, dots, max_value)
    else:
        out = quantile_grid(results, dots).join(expected_grid(results.sparkSession, dots + 1), "i").select("i", "expected", "observed")
    return out.withColumn("label", F.lit(label))


def qq_of(results: dict[str, DataFrame], **options) -> DataFrame:
    """qq of several results in one table."""
    out = None
    for label, r in results.items():
        q = qq(r, label, **options)
        out = q if out is None else out.unionByName(q)
    return out


def qq_statistics(results: DataFrame) -> DataFrame:
    """One row: KS D and p, and the median offset."""
    return ks_uniform(results).crossJoin(median_offset(results))  # one row each


def box_by_allele(pairs: DataFrame) -> DataFrame:
    """g, n, min, q1, median, q3, max of (indiv_id, g, value)."""
    q = F.percentile("value", F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75)]))
    b = pairs.groupBy("g").agg(F.count("*").alias("n"), F.min("value").alias("min"), q.alias("q"), F.max("value").alias("max"))
    return b.select("g", "n", "min", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "max")


def ordered_bars(pairs: DataFrame) -> DataFrame:
    """Individuals of one trait in descending order of value, with their allele."""
    return pairs.orderBy(F.col("value").desc(), "indiv_id")


def allele_map(panel: Panel, chrom: int, pos: int, metadata: DataFrame) -> DataFrame:
    """indiv_id, lat, lon, country, g of one locus."""
    g = panel.markers.filter((F.col("chrom") == chrom) & (F.col("pos") == pos)).select(F.posexplode("calls").alias("idx", "g"))
    return g.join(F.broadcast(panel.individuals()), "idx").join(metadata.select("indiv_id", "lat", "lon", "country"), "indiv_id", "left").drop("idx")


def tree(spark, k: np.ndarray, ids: list[str]) -> DataFrame:
    """a, b, height, size per merge of average linkage, with labels of leaves."""
    n = len(ids)
    name = lambda i: ids[i] if i < n else f"#{i - n}"
    return spark.createDataFrame([(s, name(a), name(b), h, size) for s, (a, b, h, size) in enumerate(upgma(k))], "step int, a string, b string, height double, size int")
