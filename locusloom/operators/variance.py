"""Heritability, BLUP, and variance scans by trait, chromosome, window and gene."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dist import chi2_sf
from ..functions.reml import Eigen, LocalAndRest, LowRank, blup, fit, fit_two, likelihood_ratio, scale_k
from ..panel import Panel
from .kinship import Gram, calls_matrix, features, gram_table, grams, reorder
from .regions import range_join


def trait_heritability(phens: DataFrame, k: np.ndarray | LowRank, ids: list[str]) -> DataFrame:
    """phen_id, n, heritability, p_value, vg, ve of every trait; replicates use the kinship of their individual.

    A kinship of low rank costs a decomposition of its root, any other one of the
    observations' matrix.
    """
    shared = phens.sparkSession.sparkContext.broadcast((k, {x: i for i, x in enumerate(ids)}))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        k, place = shared.value
        _, at, y = _observations(pdf, place)
        pid = pdf["phen_id"].iloc[0]
        if len(y) < 3 or np.ptp(y) == 0:
            return pd.DataFrame({"phen_id": [pid], "n": [len(y)], "heritability": [np.nan], "p_value": [np.nan], "vg": [np.nan], "ve": [np.nan]})
        if isinstance(k, LowRank):
            own = k.at(at).scaled()
            f, p = own.fit(y), own.likelihood_ratio(y)[1]
        else:
            zkz = scale_k(k[np.ix_(at, at)])
            eig = Eigen.of(zkz)
            f, p = fit(y, zkz, eig_k=eig, whiten=False), likelihood_ratio(y, zkz, eig)[1]
        return pd.DataFrame({"phen_id": [pid], "n": [len(y)], "heritability": [f.heritability], "p_value": [p], "vg": [f.vg], "ve": [f.ve]})

    return phens.select("phen_id", "indiv_id", "value").groupBy("phen_id").applyInPandas(run, "phen_id int, n long, heritability double, p_value double, vg double, ve double")


def trait_blups(phens: DataFrame, k: np.ndarray | LowRank, ids: list[str]) -> DataFrame:
    """phen_id, indiv_id, value, blup, residual."""
    shared = phens.sparkSession.sparkContext.broadcast((k, {x: i for i, x in enumerate(ids)}))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        k, place = shared.value
        pdf, at, y = _observations(pdf, place)
        if len(y) < 3 or np.ptp(y) == 0:
            u = np.zeros(len(y))
        elif isinstance(k, LowRank):
            own = k.at(at).scaled()
            u = own.blup(y, own.fit(y).heritability)
        else:
            zkz = scale_k(k[np.ix_(at, at)])
            u = blup(y, zkz, fit(y, zkz, whiten=False).heritability)
        return pd.DataFrame({"phen_id": pdf["phen_id"], "indiv_id": pdf["indiv_id"], "value": y, "blup": u, "residual": y - y.mean() - u if len(y) else y})

    return phens.select("phen_id", "indiv_id", "value").groupBy("phen_id").applyInPandas(run, "phen_id int, indiv_id string, value double, blup double, residual double")


def _observations(pdf: pd.DataFrame, place: dict[str, int]) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """(rows of individuals in the kinship that have a value, their places, their values), by place and value."""
    at, y = pdf["indiv_id"].map(place).to_numpy(float), pdf["value"].to_numpy(float)
    rows = np.flatnonzero(~np.isnan(at) & ~np.isnan(y))
    rows = rows[np.lexsort((y[rows], at[rows]))]
    return pdf.iloc[rows], at[rows].astype(int), y[rows]


def cross_validated_blup(spark, y, k: np.ndarray, n_folds: int = 5, n_repeats: int = 1, seed: int = 0) -> DataFrame:
    """repeat, fold, idx, observed, predicted, heritability of a k-fold genomic prediction; folds run as tasks."""
    y, k = np.asarray(y, float), scale_k(np.asarray(k, float))
    n = len(y)
    size = int(n / n_folds + 1)
    shared = spark.sparkContext.broadcast((y, k))
    tasks = spark.createDataFrame([(r, f) for r in range(n_repeats) for f in range(n_folds)], "repeat int, fold int").repartition(n_repeats * n_folds)

    def run(it):
        y, k = shared.value
        for pdf in it:
            for r, f in zip(pdf["repeat"], pdf["fold"]):
                order = np.random.default_rng([seed, int(r)]).permutation(n)
                test = np.sort(order[f * size : (f + 1) * size])
                if not len(test):
                    continue
                train = np.setdiff1d(np.arange(n), test)
                m = fit(y[train], k[np.ix_(train, train)])
                h, mean = m.heritability, y[train].mean()
                v = h * k[np.ix_(train, train)] + (1 - h) * np.eye(len(train))
                pred = mean + h * k[np.ix_(test, train)] @ np.linalg.solve(v, y[train] - mean)
                yield pd.DataFrame({"repeat": r, "fold": f, "idx": test.astype("int32"), "observed": y[test], "predicted": pred, "heritability": h})

    return tasks.mapInPandas(run, "repeat int, fold int, idx int, observed double, predicted double, heritability double")


def prediction_accuracy(predictions: DataFrame) -> DataFrame:
    """repeat, correlation, r2, mean heritability."""
    p = predictions.groupBy("repeat").agg(F.corr("observed", "predicted").alias("correlation"), F.avg("heritability").alias("mean_heritability"))
    return p.withColumn("r2", F.col("correlation") * F.col("correlation"))


# ------------------------------------------------------- local against global


def local_against_global(y, k_local: np.ndarray, k_global: np.ndarray) -> dict:
    """Likelihood-ratio test of a local kinship beside the global one, and the shares of the variance.

    perc_var1 belongs to the global matrix, perc_var2 to the local one.
    """
    y = np.asarray(y, float)
    ll0 = fit(y, scale_k(k_global), method="ML").ll
    two = fit_two(y, k_global, k_local, method="ML")
    stat = max(0.0, 2 * (two["ll"] - ll0))
    return {"stat": stat, "p_value": float(chi2_sf(stat, 1)), "perc_var1": two["perc_var1"], "perc_var2": two["perc_var2"], "pseudo_heritability": two["fit"].heritability}


_RESULT = ("stat", "p_value", "perc_var1", "perc_var2", "pseudo_heritability")


def _against_rest(panel: Panel, sums: DataFrame, y, total: Gram) -> DataFrame:
    """grp, n_markers and the test of each group's kinship against that of all other markers, one task per group."""
    n = panel.n
    eig = Eigen.of(total.mean())
    shared = panel.spark.sparkContext.broadcast((np.asarray(y, float), total, eig))

    def run(it):
        y, total, eig = shared.value
        for pdf in it:
            for grp, m, k in zip(pdf["grp"], pdf["m"], pdf["k"]):
                row = {"grp": grp, "n_markers": m}
                if 0 < m < total.m:
                    local = np.frombuffer(k).reshape(n, n)
                    root = LocalAndRest.root_of(local / m)
                    # beyond that rank a decomposition per ratio costs less than the rank's square per value
                    few = root.shape[1] <= max(16, n // 8)
                    row |= LocalAndRest(y, eig, total.mean(), total.m, root, m).test() if few else local_against_global(y, local / m, (total.k - local) / (total.m - m))
                else:
                    row |= dict.fromkeys(_RESULT, np.nan)
                yield pd.DataFrame([row])

    return sums.select("grp", "m", "k").mapInPandas(run, "grp long, n_markers long, " + ", ".join(f"{c} double" for c in _RESULT))


def _groups_against_rest(panel: Panel, y, total: Gram, method: str) -> DataFrame:
    """The same for many small groups of markers (column _grp), as windows and genes are.

    A group's markers come together and are used as columns; only a group of more
    markers than that pays for is added up to a matrix, one at a time in a task.
    """
    n, fmt = panel.n, panel.data_format
    most = max(16, n // 8)
    shared = panel.spark.sparkContext.broadcast((np.asarray(y, float), total, Eigen.of(total.mean())))
    fields = ["grp", "n_markers", *_RESULT]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, total, eig = shared.value
        mean = total.mean()

        def tested(code: int, m: int, parts: list[np.ndarray], whole: np.ndarray | None, offset: float) -> pa.RecordBatch:
            row = dict.fromkeys(_RESULT, float("nan"))
            if 0 < m < total.m:
                if whole is None:
                    root = np.concatenate([*parts, np.full((1, n), np.sqrt(offset * m))] if offset else parts).T / np.sqrt(m)
                    row = LocalAndRest(y, eig, mean, total.m, root, m).test()
                else:
                    row = local_against_global(y, whole / m, (total.k - whole) / (total.m - m))
            return pa.RecordBatch.from_arrays([pa.array([code]), pa.array([m]), *[pa.array([row[c]], pa.float64()) for c in _RESULT]], fields)

        code, m, parts, rows, whole, shift = None, 0, [], 0, None, 0.0
        for b in batches:
            groups = b.column("_grp").to_numpy()
            cuts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1], True]) if len(groups) else []
            for a, e in zip(cuts[:-1], cuts[1:]):
                if groups[a] != code:
                    if code is not None:
                        yield tested(code, m, parts, whole, shift)
                    code, m, parts, rows, whole = int(groups[a]), 0, [], 0, None
                x, scale, shift, used = features(calls_matrix(b.column("calls").slice(a, e - a), n), method, fmt)
                m += int(used.sum())
                x = np.sqrt(scale) * x
                if whole is None and rows + len(x) <= most:
                    parts.append(x)
                    rows += len(x)
                    continue
                if whole is None:
                    whole = sum((p.T @ p for p in parts), np.zeros((n, n))) + shift * (m - int(used.sum()))
                    parts = []
                whole += x.T @ x + shift * int(used.sum())
        if code is not None:
            yield tested(code, m, parts, whole, shift)

    # a search per group is the work, not the bytes, so the number of tasks is fixed and not left to their size
    tasks = max(int(panel.spark.conf.get("spark.sql.shuffle.partitions")), 2 * panel.spark.sparkContext.defaultParallelism)
    markers = panel.markers.select("_grp", "calls").repartition(tasks, "_grp").sortWithinPartitions("_grp")
    return markers.mapInArrow(run, "grp long, n_markers long, " + ", ".join(f"{c} double" for c in _RESULT))


def _total(panel: Panel, method: str) -> Gram:
    parts = grams(panel, method)
    return parts[0]


def chromosome_scan(panel: Panel, y, method: str = "ibd") -> DataFrame:
    """chrom and the test of its kinship against that of the other chromosomes."""
    return _against_rest(panel, gram_table(panel, method, "chrom"), y, _total(panel, method)).withColumnRenamed("grp", "chrom")


def window_scan(panel: Panel, y, half_width: int = 500_000, step: int = 250_000, method: str = "ibd") -> DataFrame:
    """chrom, centre and test per window: centres from a chromosome's first to its last position every step; windows without markers don't appear."""
    first = panel.markers.groupBy("chrom").agg(F.min("pos").alias("_a"), F.max("pos").alias("_b"))
    m = panel.markers.join(first, "chrom")
    last = F.floor((F.col("_b") - F.col("_a")) / step)
    low = F.greatest(F.lit(0), F.ceil((F.col("pos") - half_width - F.col("_a")) / step))
    high = F.least(last, F.floor((F.col("pos") + half_width - F.col("_a")) / step))
    m = m.filter(low <= high).withColumn("w", F.explode(F.sequence(low, high)))
    m = m.withColumn("_grp", F.col("chrom").cast("long") * (1 << 40) + F.col("_a") + F.col("w") * step)
    out = _groups_against_rest(panel.with_markers(m), y, _total(panel, method), method)
    return out.select(F.shiftright("grp", 40).cast("int").alias("chrom"), F.col("grp").bitwiseAND((1 << 40) - 1).alias("centre"), "n_markers", *_RESULT)


def gene_scan(panel: Panel, y, genes: DataFrame, radius: int = 20_000, method: str = "ibd") -> DataFrame:
    """gene_id and the test of the markers within radius of it."""
    g = genes.select("gene_id", "chrom", (F.col("start_pos") - radius).alias("lo"), (F.col("end_pos") + radius).alias("hi")).withColumn("_grp", F.xxhash64("gene_id"))
    j = range_join(panel.markers.select("marker_id", "chrom", "pos", "calls"), g, "lo", "hi")
    out = _groups_against_rest(panel.with_markers(j), y, _total(panel, method), method)
    return out.join(g.select("gene_id", F.col("_grp").alias("grp")), "grp").select("gene_id", "n_markers", *_RESULT)


def relatedness_pairs(phens: DataFrame, phen_id: int, k: np.ndarray, ids: list[str]) -> DataFrame:
    """id1, id2, relatedness, squared_difference of individual means, for pairs of one trait's individuals."""
    v = {r.indiv_id: r.v for r in phens.filter(F.col("phen_id") == phen_id).groupBy("indiv_id").agg(F.avg("value").alias("v")).collect()}  # individuals of one trait
    own = [x for x in ids if x in v]
    k = reorder(k, ids, own)
    rows = phens.sparkSession.createDataFrame([(i, own[i], float(v[own[i]]), k[i].tolist()) for i in range(len(own))], "i int, id1 string, v1 double, r array<double>")
    others = phens.sparkSession.createDataFrame([(i, x, float(v[x])) for i, x in enumerate(own)], "j int, id2 string, v2 double")
    pairs = rows.select("i", "id1", "v1", F.posexplode("r").alias("j", "relatedness")).filter("j < i").join(F.broadcast(others), "j")  # one row per individual
    return pairs.select("id1", "id2", "relatedness", F.pow(F.col("v1") - F.col("v2"), 2).alias("squared_difference"))


def relatedness_fit(pairs: DataFrame) -> DataFrame:
    """One row: slope, intercept and correlation of squared difference on relatedness."""
    return pairs.agg(
        F.regr_slope("squared_difference", "relatedness").alias("slope"), F.regr_intercept("squared_difference", "relatedness").alias("intercept"),
        F.corr("squared_difference", "relatedness").alias("correlation"), F.count("*").alias("n_pairs"),
    )


def neg_log(p: float) -> float:
    return 323.0 if p == 0 else -math.log10(p)
