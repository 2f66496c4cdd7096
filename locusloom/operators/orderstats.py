"""Exact order statistics without sorting or copying the whole column.

The values are cut into buckets at approximate quantiles, and the buckets are
counted exactly. A wanted rank then lies in a known bucket; buckets that hold one
are cut again until they are small, and only their distinct values are put in
order. Whatever the number of rows, the driver holds bucket bounds and counts only,
and no task holds more than a bucket.

Defined cases: NULL and NaN don't count; infinities are values; ties share a value;
an empty column has n = 0 and no order statistic.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Distinct bounds of the first cut, and rows up to which a bucket is put in order.
SPLITS, SMALL = 512, 1_000_000
_INF = float("inf")


def cut_at(values: DataFrame, bounds: list[float]) -> DataFrame:
    """Adds ``bucket``: how many bounds lie at or below x."""
    if not bounds:
        return values.withColumn("bucket", F.lit(0))
    inner = [b for b in bounds if -_INF < b < _INF]
    out = Bucketizer(splits=[-_INF, *inner, _INF], inputCol="x", outputCol="bucket").transform(values) if inner else values.withColumn("bucket", F.lit(0.0))
    return out.withColumn("bucket", F.col("bucket").cast("int"))


def within(ranges: list[tuple[float, float]]) -> Column:
    """x in one of few ranges (low included, high not), in a form a scan can take."""
    cond = F.lit(False)
    for low, high in ranges:
        one = F.lit(True)
        if low > -_INF:
            one = one & (F.col("x") >= low)
        if high < _INF:
            one = one & (F.col("x") < high)
        cond = cond | one
    return cond


class Ordered:
    """The order of one column; ``x`` may be given in several samples, marked by ``which``."""

    def __init__(self, df: DataFrame, score: str = "score", splits: int = SPLITS, small: int = SMALL):
        self.small, self.splits = small, splits
        self.values = df.select(F.col(score).cast("double").alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x"))
        self.bounds = quantile_bounds(self.values, splits)
        counted = cut_at(self.values, self.bounds).groupBy("bucket").agg(F.count("*").alias("n")).collect()  # one row per bucket
        self.counts = [0] * (len(self.bounds) + 1)
        for r in counted:
            self.counts[r.bucket] = r.n
        self.n = sum(self.counts)

    def _edges(self, k: int) -> tuple[float, float]:
        return (self.bounds[k - 1] if k else -_INF), (self.bounds[k] if k < len(self.bounds) else _INF)

    def starts(self) -> list[int]:
        """Number of values before each bucket."""
        out, total = [], 0
        for c in self.counts:
            out.append(total)
            total += c
        return out

    def rows(self, buckets: list[int]) -> DataFrame:
        """Values of some buckets, with their bucket."""
        part = self.values
        if len(buckets) <= 32:
            part = part.filter(within([self._edges(k) for k in buckets]))
        return cut_at(part, self.bounds).filter(F.col("bucket").isin(buckets))

    def refine(self, buckets: list[int]) -> bool:
        """Cuts some buckets again; False if that brought nothing."""
        parts = max(4, 4 * self.splits // len(buckets))
        got = self.rows(buckets).groupBy("bucket").agg(F.percentile_approx("x", [i / parts for i in range(1, parts)], 10 * parts).alias("q")).collect()
        fresh = sorted({v for r in got for v in r.q if -_INF < v < _INF} - set(self.bounds))
        if not fresh:
            return False
        old_bounds, old_counts = self.bounds, self.counts
        touched = self.rows(buckets)
        self.bounds = sorted({*old_bounds, *fresh})
        counted = {r.bucket: r.n for r in cut_at(touched.drop("bucket"), self.bounds).groupBy("bucket").agg(F.count("*").alias("n")).collect()}
        again = set(buckets)
        self.counts = []
        for k in range(len(self.bounds) + 1):
            low = self.bounds[k - 1] if k else -_INF
            parent = bisect_right(old_bounds, low) if k else 0
            self.counts.append(counted.get(k, 0) if parent in again else old_counts[parent])
        return True

    def holding(self, places: list[int]) -> dict[int, list[int]]:
        """Buckets and the wanted 0-based places they hold."""
        starts = self.starts()
        out: dict[int, list[int]] = {}
        for p in places:
            k = bisect_right(starts, p) - 1
            while not self.counts[k]:
                k -= 1
            out.setdefault(k, []).append(p)
        return out

    def at(self, places: list[int]) -> dict[int, float]:
        """The values at 0-based places of the ascending order; places outside are left out."""
        wanted = sorted({p for p in places if 0 <= p < self.n})
        if not wanted:
            return {}
        held = self.holding(wanted)
        for _ in range(6):
            large = [k for k in held if self.counts[k] > self.small]
            if not large or not self.refine(large):
                break
            held = self.holding(wanted)
        starts = self.starts()
        ordered = self.ordered(list(held))
        spark = self.values.sparkSession
        ask = spark.createDataFrame([(k, p - starts[k], p) for k, ps in held.items() for p in ps], "bucket int, k long, p long")
        found = ordered.join(F.broadcast(ask), "bucket").filter((F.col("k") >= F.col("before")) & (F.col("k") < F.col("upto")))  # one row per place
        return {r.p: r.x for r in found.select("p", "x").collect()}

    def ordered(self, buckets: list[int]) -> DataFrame:
        """bucket, x, before, upto: distinct values of some buckets with the number of values before and up to them in the bucket."""
        distinct = self.rows(buckets).groupBy("bucket", "x").agg(F.count("*").alias("m"))
        w = Window.partitionBy("bucket").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
        return distinct.withColumn("upto", F.sum("m").over(w)).withColumn("before", F.col("upto") - F.col("m"))


def quantile_bounds(values: DataFrame, splits: int) -> list[float]:
    """Distinct approximate quantiles of x, finite ones only."""
    q = values.agg(F.percentile_approx("x", [i / splits for i in range(1, splits)], 10 * splits).alias("q")).first().q
    return sorted({v for v in q or [] if -_INF < v < _INF})


def greatest_gap(a: DataFrame, b: DataFrame | None, score: str = "score", splits: int = SPLITS, small: int = SMALL) -> tuple[float | None, int, int]:
    """(D, n of a, n of b): the greatest distance between two distribution functions; b None is the uniform one on 0..1.

    Bounds on the distance within each bucket follow from the counts at its edges;
    only buckets that could exceed the distance found at the edges are read.
    """
    one = lambda df, w: df.select(F.col(score).cast("double").alias("x"), F.lit(w).alias("w")).filter(F.col("x").isNotNull() & ~F.isnan("x"))
    values = one(a, 1)
    if b is not None:
        values = values.unionByName(one(b, 0))
    bounds = quantile_bounds(values, splits)

    def count(df: DataFrame, bounds: list[float]) -> dict[int, tuple[int, int]]:
        got = cut_at(df, bounds).groupBy("bucket").agg(F.sum("w").alias("na"), F.count("*").alias("n")).collect()  # one row per bucket
        return {r.bucket: (r.na, r.n - r.na) for r in got}

    counts = count(values, bounds)
    na, nb = sum(x for x, _ in counts.values()), sum(y for _, y in counts.values())
    if not na or b is not None and not nb:
        return None, na, nb
    clip = lambda v: min(1.0, max(0.0, v))
    for last in (False,) * 4 + (True,):
        floor, limits, starts, ca, cb = 0.0, {}, {}, 0, 0
        for k in range(len(bounds) + 1):
            low, high = (bounds[k - 1] if k else -_INF), (bounds[k] if k < len(bounds) else _INF)
            x, y = counts.get(k, (0, 0))
            starts[k] = ca, cb
            if b is None:
                floor = max(floor, abs(ca / na - clip(low)))  # the value just before the bucket
                limits[k] = max((ca + x) / na - clip(low), clip(high) - ca / na)
            else:
                floor = max(floor, abs(ca / na - cb / nb))
                limits[k] = max((ca + x) / na - cb / nb, (cb + y) / nb - ca / na)
            ca, cb = ca + x, cb + y
        open_ = [k for k in limits if k in counts and limits[k] > floor * (1 - 1e-12)]
        large = [k for k in open_ if sum(counts[k]) > small]
        if last or not large:
            break
        edges = [((bounds[k - 1] if k else -_INF), (bounds[k] if k < len(bounds) else _INF)) for k in large]
        part = values.filter(within(edges)) if len(edges) <= 32 else cut_at(values, bounds).filter(F.col("bucket").isin(large)).drop("bucket")
        fresh = {v for v in quantile_bounds(part, splits)} - set(bounds)
        if not fresh:
            break
        bounds = sorted({*bounds, *fresh})
        counts = count(values, bounds)
    rows = cut_at(values, bounds).filter(F.col("bucket").isin(open_))
    distinct = rows.groupBy("bucket", "x").agg(F.sum("w").alias("a"), F.sum(1 - F.col("w")).alias("b"))
    w = Window.partitionBy("bucket").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    offsets = values.sparkSession.createDataFrame([(k, *starts[k]) for k in open_], "bucket int, sa long, sb long")
    run = distinct.withColumn("ua", F.sum("a").over(w)).withColumn("ub", F.sum("b").over(w)).join(F.broadcast(offsets), "bucket")  # one row per bucket
    fa, before = (F.col("sa") + F.col("ua")) / na, (F.col("sa") + F.col("ua") - F.col("a")) / na
    if b is None:
        u = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("x")))
        gap = F.greatest(fa - u, u - before)
    else:
        gap = F.abs(fa - (F.col("sb") + F.col("ub")) / nb)
    d = run.agg(F.max(gap).alias("d")).first().d
    return max(d if d is not None else 0.0, floor if b is not None else 0.0), na, nb
