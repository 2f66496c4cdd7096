"""Seeded simulation of genotypes and traits; a cell depends on seed and place only."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..panel import Panel


def genotypes(spark: SparkSession, n_indivs: int = 1000, n_markers: int = 1000, n_chroms: int = 5, seed: int = 0) -> Panel:
    """Binary markers with allele probability one half on equal chromosomes; all-zero markers are dropped."""
    per = -(-n_markers // n_chroms)
    m = spark.range(n_markers).withColumnRenamed("id", "marker_id")
    bit = lambda i: F.shiftright(F.xxhash64(F.lit(seed), "marker_id", i), 17).bitwiseAND(1).cast("tinyint")
    m = m.select(
        "marker_id", (F.floor(F.col("marker_id") / per) + 1).cast("int").alias("chrom"), ((F.col("marker_id") % per + 1) * 1000).alias("pos"),
        F.transform(F.sequence(F.lit(0), F.lit(n_indivs - 1)), bit).alias("calls"),
    )
    return Panel(m.filter(F.exists("calls", lambda x: x > 0)), [str(i) for i in range(n_indivs)])


def traits(panel: Panel, n_pairs: int = 1, h2: float = 0.8, n_causal: int = 100, model: str = "exponential", shared: float = 0.5, seed: int = 0) -> DataFrame:
    """Pairs of correlated traits: phen_id, phen_name, indiv_id, value, and the causal loci as array column ``causal``.

    A share of the causal markers is common to the pair; effects are exponential
    or normal with random sign; noise is scaled to the wanted heritability and
    values are standardised. Trait ids are 2 i + 1 and 2 i + 2.
    """
    if model not in ("exponential", "normal"):
        raise ValueError("model is exponential or normal")
    total = panel.markers.count()
    k = min(n_causal, total)
    rows = []
    for pair in range(n_pairs):
        rng = np.random.default_rng([seed, pair])
        want = panel.markers.select("marker_id", "chrom", "pos", "calls").orderBy(F.xxhash64(F.lit(seed), F.lit(pair), "marker_id"), "marker_id").limit(min(total, 2 * k)).collect()  # n_causal rows
        common = int(k * shared)
        first, rest = want[:k], want[:common] + want[k : 2 * k - common]
        for t, chosen in enumerate((first, rest)):
            g = np.array([[0 if v is None else v for v in r.calls] for r in chosen], float)
            effect = rng.exponential(1, len(g)) if model == "exponential" else rng.normal(0, 1, len(g))
            effect *= rng.choice([-1, 1], len(g))
            value = effect @ g
            var = value.var()
            noise = rng.normal(0, np.sqrt(max(var, 1e-12) * (1 - h2) / h2), panel.n) if 0 < h2 < 1 else np.zeros(panel.n)
            value = value + noise
            value = (value - value.mean()) / (value.std() or 1)
            loci = [(int(r.chrom), int(r.pos)) for r in chosen]
            pid = 2 * pair + t + 1
            rows += [(pid, f"{pid}_simulated", x, None, float(v), float(v), None, loci) for x, v in zip(panel.ids, value)]
    ddl = "phen_id int, phen_name string, indiv_id string, replicate_id int, value double, raw_value double, transformation string, causal array<struct<chrom int, pos long>>"
    return panel.spark.createDataFrame(rows, ddl)


def dataset(spark: SparkSession, n_indivs: int = 1000, n_markers: int = 10_000, n_pairs: int = 10, n_causal: int = 100, h2: float = 0.8, seed: int = 0) -> tuple[Panel, DataFrame]:
    """Genotypes and traits."""
    p = genotypes(spark, n_indivs, n_markers, seed=seed)
    return p, traits(p, n_pairs, h2, n_causal, seed=seed)
