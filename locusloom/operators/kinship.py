"""Kinship from markers: sums of products over markers, gathered per partition and added up.

Each partition turns its markers into one n x n sum, so the data that moves is a
matrix per partition, not a row per pair and marker. Sums are added in two
levels. Matrices are dense over individuals and end on the driver: up to about
10,000 individuals.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.reml import scale_k
from ..panel import Panel

METHODS = ("ibs", "ibd")
_DDL = "grp long, m long, k binary, s binary"
_ARROW = pa.schema([("grp", pa.int64()), ("m", pa.int64()), ("k", pa.binary()), ("s", pa.binary())])


def calls_matrix(column: pa.Array, n: int) -> np.ndarray:
    """Calls as a (markers x n) float matrix, NaN for missing."""
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = c.flatten()
    if len(flat) != len(c) * n:
        raise ValueError("a marker has another number of calls than the panel has individuals")
    return flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(c), n)


def features(g: np.ndarray, method: str, data_format: str) -> tuple[np.ndarray, float, float, np.ndarray]:
    """(X, scale, offset per marker, used): K gains scale * X'X + offset per used marker.

    ibs, binary: similarity 1 for equal calls, 0 else. ibs, diploid:
    1 - |a - b| / 2. ibd: product of z-scores with the population sd; markers
    without variation aren't used. Missing calls count as the mean.
    """
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = np.nanmean(g, axis=1, keepdims=True) if len(g) else np.zeros((0, 1))
    g = np.where(np.isnan(g), mean, g)
    used = ~np.isnan(g).any(axis=1)
    if method == "ibd":
        sd = g.std(axis=1)
        used &= sd > 1e-12
        g = g[used]
        return (g - g.mean(axis=1, keepdims=True)) / g.std(axis=1, keepdims=True), 1.0, 0.0, used
    if method != "ibs":
        raise ValueError(f"kinship methods: {', '.join(METHODS)}")
    g = g[used]
    if data_format == "diploid_int":
        # |a - b| is the sum over thresholds of differing indicators, each a +-1 product
        x = np.concatenate([np.clip(2 * g, 0, 2) - 1, np.clip(2 * (g - 1), 0, 2) - 1])
        return x, 0.25, 0.5, used
    return 2 * g - 1, 0.5, 0.5, used


@dataclass
class Gram:
    """Unscaled sums: k over m markers, s the sums of the features per individual."""

    k: np.ndarray
    m: int
    s: np.ndarray

    def mean(self) -> np.ndarray:
        return self.k / max(self.m, 1)

    def minus(self, other: Gram) -> Gram:
        return Gram(self.k - other.k, self.m - other.m, self.s - other.s)

    def plus(self, other: Gram) -> Gram:
        return Gram(self.k + other.k, self.m + other.m, self.s + other.s)


def _partials(n: int, method: str, data_format: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for b in batches:
            grp = b.column("grp").to_numpy()
            g = calls_matrix(b.column("calls"), n)
            for code in np.unique(grp):
                x, scale, offset, used = features(g[grp == code], method, data_format)
                m = int(used.sum())
                if int(code) not in sums:
                    sums[int(code)] = [0, np.zeros((n, n)), np.zeros(n)]
                t = sums[int(code)]
                t[0] += m
                t[1] += scale * (x.T @ x) + offset * m
                t[2] += x.sum(axis=0)
        for code, (m, k, s) in sums.items():
            yield pa.RecordBatch.from_pydict({"grp": [code], "m": [m], "k": [k.tobytes()], "s": [s.tobytes()]}, schema=_ARROW)

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group: one sum per group, one matrix in memory."""
    code, m, k, s = None, 0, None, None

    def out():
        return pa.RecordBatch.from_pydict({"grp": [code], "m": [m], "k": [k.tobytes()], "s": [s.tobytes()]}, schema=_ARROW)

    for b in batches:
        for i in range(b.num_rows):
            c, mi = b.column("grp")[i].as_py(), b.column("m")[i].as_py()
            ki, si = np.frombuffer(b.column("k")[i].as_py()), np.frombuffer(b.column("s")[i].as_py())
            if c != code:
                if code is not None:
                    yield out()
                code, m, k, s = c, mi, ki.copy(), si.copy()
            else:
                m, k, s = m + mi, k + ki, s + si
    if code is not None:
        yield out()


def gram_table(panel: Panel, method: str = "ibs", group: str | None = None, fan: int = 64) -> DataFrame:
    """(grp, m, k, s): the sums per value of an integer column of the markers, or of all markers as group 0.

    k and s are bytes of doubles, n x n and n.
    """
    m = panel.markers.select((F.col(group).cast("long") if group else F.lit(0).cast("long")).alias("grp"), "calls")
    part = m.mapInArrow(_partials(panel.n, method, panel.data_format), _DDL)
    part = part.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(fan)))
    first = part.repartition("grp", "_salt").sortWithinPartitions("grp").drop("_salt").mapInArrow(_add, _DDL)
    return first.repartition("grp").sortWithinPartitions("grp").mapInArrow(_add, _DDL)


def grams(panel: Panel, method: str = "ibs", group: str | None = None) -> dict[int, Gram]:
    """The sums of gram_table on the driver."""
    n = panel.n
    return {r.grp: Gram(np.frombuffer(r.k).reshape(n, n).copy(), r.m, np.frombuffer(r.s).copy()) for r in gram_table(panel, method, group).collect()}


def _total(panel: Panel, method: str) -> Gram:
    return grams(panel, method).get(0) or Gram(np.zeros((panel.n, panel.n)), 0, np.zeros(panel.n))


def ibs_kinship(panel: Panel, scaled: bool = True) -> np.ndarray:
    """Identity by state; diagonal 1 before scaling for complete binary calls."""
    k = _total(panel, "ibs").mean()
    if panel.data_format == "diploid_int":
        np.fill_diagonal(k, 1.0)
    return scale_k(k) if scaled else k


def ibd_kinship(panel: Panel, scaled: bool = True) -> np.ndarray:
    """Realised relationship: mean product of z-scores."""
    k = _total(panel, "ibd").mean()
    return scale_k(k) if scaled else k


def kinship(panel: Panel, method: str = "ibs", scaled: bool = True) -> np.ndarray:
    return {"ibs": ibs_kinship, "ibd": ibd_kinship}[method](panel, scaled)


def marker_covariance(panel: Panel) -> np.ndarray:
    """Covariance between individuals of z-scored markers, after each individual's mean is taken off."""
    t = _total(panel, "ibd")
    mean = t.s / max(t.m, 1)
    return t.mean() - np.outer(mean, mean)


def downdate(k_full: np.ndarray, m_full: int, k_removed: np.ndarray, m_removed: int) -> np.ndarray:
    """Unscaled kinship of the markers that remain: (K M - k m) / (M - m)."""
    return (k_full * m_full - k_removed * m_removed) / (m_full - m_removed)


def downdate_monomorphic(k_full: np.ndarray, m_full: int, n_removed: int) -> np.ndarray:
    """IBS after monomorphic markers go, each of which counted 1 for every pair."""
    return (k_full * m_full - n_removed) / (m_full - n_removed)


def local_and_rest(panel: Panel, inside: Column, method: str = "ibd", scaled: bool = True) -> tuple[np.ndarray | None, np.ndarray | None, int, int]:
    """Kinship of the markers that meet a condition and of the others, from one pass: (local, rest, m, M - m)."""
    marked = panel.with_markers(panel.markers.withColumn("_in", inside.cast("int")))
    parts = grams(marked, method, "_in")
    done = lambda g: None if g is None or not g.m else (scale_k(g.mean()) if scaled else g.mean())
    a, b = parts.get(1), parts.get(0)
    return done(a), done(b), a.m if a else 0, b.m if b else 0


def window_condition(chrom: int, pos: int, half_width: int):
    """Markers within half_width of a locus."""
    return (F.col("chrom") == chrom) & F.col("pos").between(pos - half_width, pos + half_width)


def chromosome_kinships(panel: Panel, method: str = "ibd", scaled: bool = True) -> dict[int, tuple[np.ndarray, np.ndarray | None]]:
    """Per chromosome: its kinship and that of all others, by subtraction from one grouped pass."""
    parts = grams(panel, method, "chrom")
    total = None
    for g in parts.values():
        total = g if total is None else total.plus(g)
    fin = lambda g: scale_k(g.mean()) if scaled else g.mean()
    return {c: (fin(g), fin(total.minus(g)) if total.m > g.m else None) for c, g in parts.items() if g.m}


def reorder(k: np.ndarray, ids: list[str], wanted: list[str]) -> np.ndarray:
    """Rows and columns for the wanted ids in their order; unknown ones are passed over, repeats allowed."""
    place = {x: i for i, x in reversed(list(enumerate(ids)))}
    at = [place[x] for x in wanted if x in place]
    return k[np.ix_(at, at)]


def prune_related(k: np.ndarray, threshold: float) -> list[int]:
    """Places that stay when i goes for any later j with k[i, j] above the threshold."""
    upper = np.triu(k, 1) > threshold
    return [i for i in range(len(k)) if not upper[i].any()]


def unrelated(panel: Panel, method: str, threshold: float) -> list[int]:
    """Places that prune_related leaves; all where no marker tells of a relation, without a matrix."""
    t = grams(panel, method).get(0)
    return prune_related(scale_k(t.mean()), threshold) if t is not None and t.m else list(range(panel.n))


# ---------------------------------------------------------------------- tables


def to_table(spark: SparkSession, k: np.ndarray) -> DataFrame:
    """(i, j, k) of all cells; one row per individual is sent, cells are made on the executors."""
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(k)], "i int, r array<double>")
    return rows.select("i", F.posexplode("r").alias("j", "k"))


def from_table(df: DataFrame, n: int) -> np.ndarray:
    """The dense matrix of an (i, j, k) table."""
    k = np.zeros((n, n))
    for r in df.groupBy("i").agg(F.collect_list(F.struct("j", "k")).alias("c")).collect():  # one row per individual
        for c in r.c:
            k[r.i, c.j] = c.k
    return k


def save_kinship(spark: SparkSession, path: str, k: np.ndarray, ids: list[str], n_markers: int, method: str = "ibs") -> None:
    """Parquet with a row per individual: idx, indiv_id, k, and the marker count."""
    rows = [(i, x, r.tolist(), n_markers, method) for i, (x, r) in enumerate(zip(ids, k))]
    spark.createDataFrame(rows, "idx int, indiv_id string, k array<double>, n_markers long, method string").write.mode("overwrite").parquet(path)


def load_kinship(spark: SparkSession, path: str, ids: list[str] | None = None, scaled: bool = True) -> tuple[np.ndarray, list[str], int]:
    """(kinship, ids, marker count), for the wanted ids only where given."""
    rows = spark.read.parquet(path).orderBy("idx").collect()
    k, own = np.array([r.k for r in rows]), [r.indiv_id for r in rows]
    if ids is not None:
        k, own = reorder(k, own, ids), [x for x in ids if x in set(own)]
    return (scale_k(k) if scaled else k), own, rows[0].n_markers if rows else 0


def save_kinship_text(spark: SparkSession, path: str, k: np.ndarray, ids: list[str], delim: str = ",") -> None:
    """Text, one line per individual: id, then its row."""
    rows = spark.createDataFrame([(i, x, r.tolist()) for i, (x, r) in enumerate(zip(ids, k))], "i int, x string, r array<double>")
    rows.coalesce(1).sortWithinPartitions("i").select(F.concat_ws(delim, "x", F.concat_ws(delim, F.transform("r", lambda v: v.cast("string"))))).write.mode("overwrite").text(path)


def upgma(k: np.ndarray) -> list[tuple[int, int, float, int]]:
    """Average linkage of 1 - k scaled to its maximum: (a, b, height, size) per merge, new clusters numbered from n."""
    n = len(k)
    d = k.max() - k.astype(float)
    np.fill_diagonal(d, np.inf)
    size, name, out = np.ones(n), list(range(n)), []
    near = d.argmin(axis=1) if n else np.zeros(0, int)
    least = d[np.arange(n), near]
    for step in range(n - 1):
        i = int(least.argmin())
        i, j = sorted((i, int(near[i])))
        a, b = sorted((name[i], name[j]))
        w = size[i] + size[j]
        out.append((a, b, float(d[i, j]), int(w)))
        row = (size[i] * d[i] + size[j] * d[j]) / w  # infinite for clusters that are gone
        row[[i, j]] = np.inf
        d[i], d[:, i] = row, row
        d[j], d[:, j] = np.inf, np.inf
        size[i], name[i] = w, n + step
        least[j] = np.inf
        for c in np.flatnonzero(np.isfinite(least) & ((near == i) | (near == j) | (row < least)) | (np.arange(n) == i)):
            near[c] = d[c].argmin()
            least[c] = d[c, near[c]]
    return out
