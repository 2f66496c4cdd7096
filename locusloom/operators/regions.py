"""Intervals, nearest loci and regions of association results.

Range joins go through bins: positions get ``pos div width``, intervals are
exploded over the bins they touch, and the join is on chromosome and bin with the
exact bounds kept as a condition. Only bins, not chromosomes, end up together.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import Along
from .orderstats import Ordered


def range_join(points: DataFrame, intervals: DataFrame, low: str, high: str, width: int = 100_000, how: str = "inner") -> DataFrame:
    """points (chrom, pos, ...) joined to intervals (chrom, low, high, ...) with low <= pos <= high.

    how: inner, left, left_semi or left_anti. Interval columns must not clash with
    the points' but for chrom, which is kept once.
    """
    p = points.withColumn("_bin", F.floor(F.col("pos") / width))
    spans = intervals.filter(F.col(low) <= F.col(high)).withColumn("_ibin", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width)))).withColumnRenamed("chrom", "_ichrom")
    on = (p["chrom"] == spans["_ichrom"]) & (p["_bin"] == spans["_ibin"]) & (p["pos"] >= spans[low]) & (p["pos"] <= spans[high])
    return p.join(spans, on, how).drop("_bin", "_ibin", "_ichrom")


def around(loci: DataFrame, radius: int | Column, low: str = "lo", high: str = "hi") -> DataFrame:
    """Loci (chrom, pos, ...) as intervals of +-radius."""
    return loci.withColumn(low, F.col("pos") - radius).withColumn(high, F.col("pos") + radius).withColumnRenamed("pos", "locus_pos")


def nearest_distance(results: DataFrame, loci: DataFrame, name: str = "distance", row_id: str = "row_id") -> DataFrame:
    """results with the distance to the nearest locus of the same chromosome, -1 where there is none.

    The nearest locus is the last one at or before, or the first one at or after;
    both are found by one pass along the sorted union, not by comparing all pairs.
    """
    cols = results.columns
    r = results.select(F.struct(*cols).alias("row"), "chrom", "pos", F.lit(1).alias("kind"), F.col(row_id).cast("long").alias("tie"))
    k = loci.select("chrom", "pos").distinct().select(F.lit(None).cast(r.schema["row"].dataType).alias("row"), "chrom", "pos", F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("tie"))
    u = r.unionByName(k).withColumn("at", F.when(F.col("kind") == 0, F.col("pos")))
    along = Along(u.withColumn("_t", F.struct("kind", "tie")), "_t")
    inside = Window.partitionBy(*along.keys).orderBy("pos", "_t")
    d = along.df.select(
        "*", F.last("at", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("_b"),
        F.first("at", ignorenulls=True).over(Window.partitionBy(*along.keys).orderBy("pos", F.col("kind").desc(), "tie").rowsBetween(0, Window.unboundedFollowing)).alias("_a"),
    )
    seg = along.df.groupBy(*along.keys).agg(F.max("at").alias("_hi"), F.min("at").alias("_lo"))
    seg = seg.select(
        *along.keys, F.last("_hi", ignorenulls=True).over(along.across().rowsBetween(Window.unboundedPreceding, -1)).alias("_bo"),
        F.first("_lo", ignorenulls=True).over(along.across().rowsBetween(1, Window.unboundedFollowing)).alias("_ao"),
    )
    d = d.filter("kind = 1").join(seg, along.keys, "left")
    before, after = F.col("pos") - F.coalesce("_b", "_bo"), F.coalesce("_a", "_ao") - F.col("pos")
    return d.select("row.*", F.coalesce(F.least(before, after), F.lit(-1)).cast("long").alias(name))


def all_distances(results: DataFrame, loci: DataFrame, max_loci: int = 1000) -> DataFrame:
    """Every result row against every locus: chrom_distance and pos_distance.

    The output is by definition results x loci, so the list is limited: a longer
    one is an error, never cut short; summed_distances has no such limit.
    """
    n = loci.limit(max_loci + 1).count()
    if n > max_loci:
        raise ValueError(f"more than {max_loci} loci; use nearest_distance or range_join")
    k = loci.select(F.col("chrom").alias("locus_chrom"), F.col("pos").alias("locus_pos"))
    out = results.crossJoin(F.broadcast(k))
    return out.withColumn("chrom_distance", F.abs(F.col("chrom") - F.col("locus_chrom"))).withColumn("pos_distance", F.abs(F.col("pos") - F.col("locus_pos")))


def summed_distances(results: DataFrame, loci: DataFrame) -> DataFrame:
    """locus_chrom, locus_pos, chrom_distance, pos_distance, n: distances of all results to a locus, summed per locus.

    No pair is made. The loci cut an axis into stretches; the number and the sum of
    the results in each give every locus its sum, so one pass over the results is
    enough for a list of any length, a row per locus being held.
    """
    k = [(r.chrom, r.pos, r.n) for r in loci.groupBy("chrom", "pos").agg(F.count("*").alias("n")).collect()]  # the loci
    axes = [np.unique(np.array([r[i] for r in k if r[i] is not None], np.int64)) for i in range(2)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = ([np.zeros(len(a) + 1, np.int64) for a in axes] for _ in range(2))
        rows = 0
        for b in batches:
            rows += b.num_rows
            for i, a in enumerate(axes):
                x = b.column(i).drop_null().to_numpy()
                at = np.searchsorted(a, x)
                np.add.at(n[i], at, 1)
                np.add.at(sums[i], at, x)
        yield pa.RecordBatch.from_pydict({"axis": [-1], "stretch": [0], "n": [rows], "total": [0]}, columns)
        for i in range(2):
            at = np.flatnonzero(n[i])
            yield pa.RecordBatch.from_pydict({"axis": np.full(len(at), i), "stretch": at, "n": n[i][at], "total": sums[i][at]}, columns)

    columns = pa.schema([(c, pa.int64()) for c in ("axis", "stretch", "n", "total")])
    per = results.select(F.col("chrom").cast("long").alias("chrom"), F.col("pos").cast("long").alias("pos")).mapInArrow(run, "axis long, stretch long, n long, total long")
    per = per.groupBy("axis", "stretch").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()  # two rows per locus
    every = sum(r.n for r in per if r.axis == -1)
    found: list[dict[int, int]] = []
    for i, a in enumerate(axes):
        here = {r.stretch: (r.n, int(r.total)) for r in per if r.axis == i}
        n_all, total = (sum(x[j] for x in here.values()) for j in range(2))
        below = below_sum = 0
        found.append({})
        for j, x in enumerate(a.tolist()):
            m, t = here.get(j, (0, 0))
            below, below_sum = below + m, below_sum + t
            if n_all:
                found[i][x] = x * below - below_sum + (total - below_sum) - x * (n_all - below)
    times = lambda x, n: None if x is None else x * n
    rows = [(c, x, times(found[0].get(c), n), times(found[1].get(x), n), every * n) for c, x, n in k] if every else []
    return results.sparkSession.createDataFrame(rows, "locus_chrom int, locus_pos long, chrom_distance long, pos_distance long, n long")


def regions(hits: DataFrame, radius: int = 20_000, tie: str = "row_id") -> DataFrame:
    """Runs of hits with gaps of at most radius: chrom, start_pos, end_pos padded by radius, n_hits."""
    a = Along(hits.select("chrom", "pos", tie), tie).lag({"prev": "pos"})
    a = a._again(a.df.withColumn("new", F.when(F.col("prev").isNull() | (F.col("pos") - F.col("prev") > radius), 1).otherwise(0).cast("long")))
    a = a.running_sum("new", "island")
    out = a.df.groupBy("chrom", "island").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.count("*").alias("n_hits"))
    return out.select("chrom", (F.col("lo") - radius).alias("start_pos"), (F.col("hi") + radius).alias("end_pos"), "n_hits")


def _outermost(results: DataFrame, order: list[Column], width: int) -> DataFrame:
    """Hits that, in rank order, lie outside of all better hits of their cell of ``width`` bases.

    Any other hit lies between two better ones that are at most width apart, so
    a padding of half a width already covers it.
    """
    w = Window.partitionBy("chrom", F.floor(F.col("pos") / max(width, 1))).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    seen = results.withColumn("_lo", F.min("pos").over(w)).withColumn("_hi", F.max("pos").over(w))
    return seen.filter(F.col("_lo").isNull() | (F.col("pos") < F.col("_lo")) | (F.col("pos") > F.col("_hi"))).drop("_lo", "_hi")


def top_regions(results: DataFrame, n: int, distance: int = 25_000, ascending: bool = True) -> DataFrame:
    """Regions around the best hits, merged where they overlap, as soon as n of them exist.

    Hits are taken in rank order and each adds +-distance, clipped to the
    chromosome; overlapping regions merge. Where a short list of the best hits
    doesn't give n regions, the list grows, but only hits that widen the hits of
    their neighbourhood come to the driver.
    """
    ends = {r.chrom: r.end for r in results.groupBy("chrom").agg(F.max("pos").alias("end")).collect()}  # one row per chromosome
    order = [F.col("score").asc() if ascending else F.col("score").desc(), F.col("row_id")]
    usable = results.filter(F.col("score").isNotNull() & ~F.isnan("score")).select("row_id", "chrom", "pos", "score")
    k = max(64, 8 * n)
    best = usable.orderBy(*order).limit(k).collect()
    found, done = _merge_regions(best, ends, n, distance)
    if not done and len(best) == k:
        ranked = Ordered(usable)
        while True:
            k *= 32
            last = ranked.n - 1 if k >= ranked.n else k
            edge = ranked.at([last if ascending else ranked.n - 1 - last])
            edge = next(iter(edge.values()))
            some = usable.filter(F.col("score") <= edge if ascending else F.col("score") >= edge)
            found, done = _merge_regions(_outermost(some, order, distance).orderBy(*order).collect(), ends, n, distance)
            if done or k >= ranked.n:
                break
    return results.sparkSession.createDataFrame([tuple(map(int, r)) for r in sorted(found)], "chrom int, start_pos long, end_pos long")


def _merge_regions(hits: list, ends: dict, n: int, distance: int) -> tuple[list[tuple[int, int, int]], bool]:
    """Regions of hits in rank order until there are n; disjoint regions are kept sorted, so a hit looks at its neighbours only."""
    per: dict[int, list[tuple[int, int]]] = {}
    count = 0
    for h in hits:
        lo, hi = max(0, h.pos - distance), min(ends[h.chrom], h.pos + distance)
        have = per.setdefault(h.chrom, [])
        a = bisect_left(have, (lo, lo))
        while a > 0 and have[a - 1][1] >= lo:
            a -= 1
        b = a
        while b < len(have) and have[b][0] <= hi:
            lo, hi = min(lo, have[b][0]), max(hi, have[b][1])
            b += 1
        if a == b and count == n:
            break
        count += 1 - (b - a)
        have[a:b] = [(lo, hi)]
        if count == n:
            break
    return [(c, lo, hi) for c, have in per.items() for lo, hi in have], count >= n


def region_rows(results: DataFrame, chrom: int, start: int, end: int, buffer: int = 0) -> DataFrame:
    """Rows within [start - buffer, end + buffer] of a chromosome."""
    return results.filter((F.col("chrom") == chrom) & F.col("pos").between(start - buffer, end + buffer))


def top_region_rows(results: DataFrame, n: int, distance: int = 25_000, buffer: int = 25_000, ascending: bool = True) -> DataFrame:
    """Result rows in the top regions, with the region's bounds."""
    r = top_regions(results, n, distance, ascending).withColumn("lo", F.col("start_pos") - buffer).withColumn("hi", F.col("end_pos") + buffer)
    return range_join(results, r, "lo", "hi").drop("lo", "hi")


def count_nearby(results: DataFrame, loci: DataFrame, radius: int) -> DataFrame:
    """One row: how many of the loci have a hit within radius."""
    spans = around(results.select("chrom", "pos"), radius).select("chrom", "lo", "hi")
    return range_join(loci.select("chrom", "pos").distinct(), spans, "lo", "hi", how="left_semi").agg(F.count("*").alias("n_nearby"))


def power_analysis(hits: DataFrame, causal: DataFrame, windows: list[int]) -> DataFrame:
    """window, tpr (causal loci with a hit within it), fdr (hits without a causal locus within it)."""
    out = None
    for w in windows:
        c, h = causal.select("chrom", "pos").distinct(), hits.select("chrom", "pos")
        found = range_join(c, around(h, w).select("chrom", "lo", "hi"), "lo", "hi", how="left_semi").agg(F.count("*").alias("found"))
        false = range_join(h, around(c, w).select("chrom", "lo", "hi"), "lo", "hi", how="left_anti").agg(F.count("*").alias("false_hits"))
        n = c.agg(F.count("*").alias("n_causal")).crossJoin(h.agg(F.count("*").alias("n_hits")))  # one row each
        row = found.crossJoin(false).crossJoin(n).select(
            F.lit(w).cast("long").alias("window"), F.try_divide("found", "n_causal").alias("tpr"), F.try_divide("false_hits", "n_hits").alias("fdr")
        )
        out = row if out is None else out.unionByName(row)
    return out


def gene_bins(results: DataFrame, genes: DataFrame, radii: list[int]) -> DataFrame:
    """gene_id, radius, min_p, n_markers: results with start - r < pos <= end + r; 1 and 0 where there are none.

    Radius -1 stands for the whole chromosome, -2 for all results.
    """
    widest = max(radii)
    g = genes.select("gene_id", "chrom", "start_pos", "end_pos")
    spans = g.withColumn("lo", F.col("start_pos") - widest + 1).withColumn("hi", F.col("end_pos") + widest)
    near = range_join(results.select("chrom", "pos", "score"), spans, "lo", "hi", width=max(100_000, 2 * widest))
    aggs = []
    for r in radii:
        inside = (F.col("pos") > F.col("start_pos") - r) & (F.col("pos") <= F.col("end_pos") + r)
        aggs += [F.min(F.when(inside, F.col("score"))).alias(f"p{r}"), F.count_if(inside).alias(f"n{r}")]
    wide = g.join(near.groupBy("gene_id").agg(*aggs), "gene_id", "left")
    cells = F.array(*[F.struct(F.lit(r).cast("long").alias("radius"), F.coalesce(F.col(f"p{r}"), F.lit(1.0)).alias("min_p"), F.coalesce(F.col(f"n{r}"), F.lit(0)).cast("long").alias("n_markers")) for r in radii])
    out = wide.select("gene_id", F.explode(cells).alias("c")).select("gene_id", "c.*")
    per = results.groupBy("chrom").agg(F.min("score").alias("p"), F.count("score").alias("n"))
    whole = per.agg(F.min("p").alias("p"), F.sum("n").alias("n"))
    same = g.join(per, "chrom", "left").select("gene_id", F.lit(-1).cast("long").alias("radius"), F.coalesce("p", F.lit(1.0)).alias("min_p"), F.coalesce("n", F.lit(0)).cast("long").alias("n_markers"))
    every = g.crossJoin(F.broadcast(whole)).select("gene_id", F.lit(-2).cast("long").alias("radius"), F.coalesce("p", F.lit(1.0)).alias("min_p"), F.coalesce("n", F.lit(0)).cast("long").alias("n_markers"))  # whole is one row
    return out.unionByName(same).unionByName(every)


def gene_best_hit_distance(results: DataFrame, genes: DataFrame) -> DataFrame:
    """gene_id, chrom_distance, pos_distance from the best hit to the nearer gene end, 0 inside the gene."""
    best = results.orderBy("score", "row_id").limit(1).select(F.col("chrom").alias("_c"), F.col("pos").alias("_p"))
    g = genes.crossJoin(F.broadcast(best))  # one row
    d = F.when(F.col("_p").between(F.col("start_pos"), F.col("end_pos")), 0).otherwise(F.least(F.abs(F.col("_p") - F.col("start_pos")), F.abs(F.col("_p") - F.col("end_pos"))))
    return g.select("gene_id", F.abs(F.col("chrom") - F.col("_c")).alias("chrom_distance"), d.cast("long").alias("pos_distance"))


def farthest_stronger(results: DataFrame, loci: DataFrame, ascending: bool = True) -> DataFrame:
    """Among results stronger than the weakest listed locus: the one farthest from the list.

    A result on another chromosome than all loci is farther than any on the same
    one; distances compare as (chromosome distance, position distance).
    """
    at = results.join(loci.select("chrom", "pos").distinct(), ["chrom", "pos"], "left_semi")
    edge = at.agg((F.max if ascending else F.min)("score").alias("edge"))
    stronger = results.crossJoin(F.broadcast(edge)).filter(F.col("score") < F.col("edge") if ascending else F.col("score") > F.col("edge")).drop("edge")  # one row
    d = nearest_distance(stronger, loci)
    chroms = loci.select(F.col("chrom").alias("_c")).distinct().agg(F.collect_set("_c").alias("_cs"))
    d = d.crossJoin(F.broadcast(chroms)).withColumn("chrom_distance", F.array_min(F.transform("_cs", lambda c: F.abs(c - F.col("chrom"))))).drop("_cs")
    return d.orderBy(F.col("chrom_distance").desc(), F.when(F.col("distance") >= 0, F.col("distance")).desc_nulls_last(), "row_id").limit(1)


def pick_at_regions(markers: DataFrame, spans: DataFrame) -> DataFrame:
    """Markers with start_pos < pos <= end_pos of any listed span, once per span."""
    s = spans.select("chrom", "start_pos", "end_pos").withColumn("lo", F.col("start_pos") + 1)
    return range_join(markers, s, "lo", "end_pos").drop("lo")
