"""Operators on two tables: alignment of genotypes and phenotypes, merging and comparing panels, priors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..panel import Panel
from .markers import filter_monomorphic, gather, only_biallelic, pick_individuals
from .ordering import Along
from .regions import range_join


def coordinate(panel: Panel, phens: DataFrame, phen_id: int, keep_replicates: bool = True) -> tuple[Panel, DataFrame, list[int]]:
    """Genotypes and one trait on common individuals.

    Returns the panel cut to them, the trait's values with ``idx`` (place in the
    panel) in order of idx and value, and the panel place of each value, which is
    how replicates find their genotype. Markers without variation are dropped,
    for binary panels all without exactly two classes.
    """
    v = phens.filter((F.col("phen_id") == phen_id) & F.col("value").isNotNull() & ~F.isnan("value"))
    have = {r.indiv_id for r in v.select("indiv_id").distinct().collect()}  # individuals of one trait
    at = [i for i, x in enumerate(panel.ids) if x in have]
    cut = pick_individuals(panel, at)
    values = v.join(F.broadcast(cut.individuals()), "indiv_id")  # individuals, bounded as in Panel
    if not keep_replicates:
        values = values.groupBy("idx", "indiv_id", "phen_id").agg(F.avg("value").alias("value"))
    values = values.orderBy("idx", "value")
    cut = only_biallelic(cut) if panel.data_format == "binary" else filter_monomorphic(cut)
    return cut, values, [r.idx for r in values.select("idx").collect()]


def marker_trait_pairs(panel: Panel, marker: DataFrame, phens: DataFrame, phen_id: int) -> DataFrame:
    """indiv_id, g, value of one marker and one trait without missing ones."""
    g = marker.select(F.posexplode("calls").alias("idx", "g")).filter("g is not null")
    v = phens.filter((F.col("phen_id") == phen_id) & F.col("value").isNotNull()).select("indiv_id", "value")
    return g.join(F.broadcast(panel.individuals()), "idx").join(v, "indiv_id").select("indiv_id", "g", "value")


def _onto(panel: Panel, ids: list[str]) -> DataFrame:
    """Markers with calls in the order of ids, NULL for individuals the panel lacks."""
    place = {x: i for i, x in reversed(list(enumerate(panel.ids)))}
    at = F.array(*[F.lit(place.get(x, -1) + 1) for x in ids])
    return panel.markers.withColumn("calls", gather("calls", at))


def _mismatch(a: Column, b: Column) -> tuple[Column, Column]:
    """(differing, comparable) calls of two arrays."""
    z = F.arrays_zip(a.alias("a"), b.alias("b"))
    both = F.filter(z, lambda s: s["a"].isNotNull() & s["b"].isNotNull())
    return F.size(F.filter(both, lambda s: s["a"] != s["b"])), F.size(both)


def merge_panels(left: Panel, right: Panel, individuals: str = "intersection", error_threshold: float = 0.1, discard_threshold: float = 0.1) -> Panel:
    """Two panels as one.

    individuals: intersection, union or left. At a common locus the calls are
    merged, the left ones first, if at most error_threshold of the comparable
    calls differ; the locus is discarded above discard_threshold; in between the
    left calls stay. Other loci of either panel are kept, markers without any
    call dropped. Repeated loci are merged pairwise.
    """
    ids = {
        "intersection": [x for x in left.ids if x in set(right.ids)], "union": left.ids + [x for x in right.ids if x not in set(left.ids)], "left": list(left.ids),
    }[individuals]
    a = _onto(left, ids).select("chrom", "pos", F.col("calls").alias("a"))
    b = _onto(right, ids).select("chrom", "pos", F.col("calls").alias("b"))
    j = a.join(b, ["chrom", "pos"], "full")
    bad, both = _mismatch(F.col("a"), F.col("b"))
    j = j.withColumn("error", F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.coalesce(F.try_divide(bad, both), F.lit(0.0))))
    merged = F.transform(F.arrays_zip("a", "b"), lambda s: F.coalesce(s["a"], s["b"]))
    calls = F.when(F.col("b").isNull(), F.col("a")).when(F.col("a").isNull(), F.col("b")).when(F.col("error") <= error_threshold, merged).otherwise(F.col("a"))
    j = j.filter(F.col("error").isNull() | (F.col("error") <= error_threshold) | (F.col("error") <= discard_threshold))
    j = j.select("chrom", "pos", calls.alias("calls")).filter(F.size(F.filter("calls", lambda x: x.isNotNull())) > 0)
    return Panel(j.withColumn("marker_id", F.xxhash64("chrom", "pos", F.col("calls").cast("string"))).select("marker_id", "chrom", "pos", "calls"), ids, left.data_format)


def extend_panel(left: Panel, right: Panel, union_individuals: bool = True) -> Panel:
    """Markers of right after those of left, over the union or left's individuals; nothing is merged."""
    ids = left.ids + [x for x in right.ids if x not in set(left.ids)] if union_individuals else list(left.ids)
    cols = ["marker_id", "chrom", "pos", "calls"]
    return Panel(_onto(left, ids).select(*cols).unionByName(_onto(right, ids).select(*cols)), ids, left.data_format)


def compare_panels(left: Panel, right: Panel, by: str = "marker") -> DataFrame:
    """Calls of two panels on common individuals and loci.

    by marker: chrom, pos, n_compared, n_different, error_rate, missing_left,
    missing_right; by individual the same per indiv_id; by total one row.
    """
    ids = [x for x in left.ids if x in set(right.ids)]
    a = _onto(left, ids).select("chrom", "pos", F.col("calls").alias("a"))
    b = _onto(right, ids).select("chrom", "pos", F.col("calls").alias("b"))
    j = a.join(b, ["chrom", "pos"])
    gaps = lambda c: F.size(F.filter(c, lambda x: x.isNull()))
    if by in ("marker", "total"):
        bad, both = _mismatch(F.col("a"), F.col("b"))
        m = j.select("chrom", "pos", both.alias("n_compared"), bad.alias("n_different"), gaps("a").alias("missing_left"), gaps("b").alias("missing_right"))
        if by == "total":
            m = m.agg(*[F.sum(c).alias(c) for c in ("n_compared", "n_different", "missing_left", "missing_right")], F.count("*").alias("n_markers"))
        return m.withColumn("error_rate", F.try_divide("n_different", "n_compared"))
    z = j.select(F.posexplode(F.arrays_zip("a", "b")).alias("idx", "c"))
    both = F.col("c.a").isNotNull() & F.col("c.b").isNotNull()
    m = z.groupBy("idx").agg(F.count_if(both).alias("n_compared"), F.count_if(both & (F.col("c.a") != F.col("c.b"))).alias("n_different"), F.count_if(F.col("c.a").isNull()).alias("missing_left"), F.count_if(F.col("c.b").isNull()).alias("missing_right"))
    names = left.spark.createDataFrame(list(enumerate(ids)), "idx int, indiv_id string")
    return m.join(F.broadcast(names), "idx").withColumn("error_rate", F.try_divide("n_different", "n_compared")).drop("idx")


def filter_bad_markers(left: Panel, right: Panel, max_errors: int = 0) -> Panel:
    """Markers of left whose calls differ from right's at most max_errors times; those without counterpart stay."""
    bad = compare_panels(left, right).filter(F.col("n_different") > max_errors).select("chrom", "pos")
    return left.with_markers(left.markers.join(bad, ["chrom", "pos"], "left_anti"))


def attach_stats(results: DataFrame, stats: DataFrame) -> DataFrame:
    """results with maf and mac of the marker at the locus."""
    per = stats.groupBy("chrom", "pos").agg(F.min("maf").alias("maf"), F.min("mac").alias("mac"))
    return results.drop("maf", "mac").join(per, ["chrom", "pos"], "left")


# ---------------------------------------------------------------------- priors


def candidate_priors(loci: DataFrame, genes: DataFrame, radius: int = 10_000, expected_causal: float = 1.0, fold: float = 50.0, method: str = "sum_all_priors") -> DataFrame:
    """chrom, pos, prior: expected_causal / m, raised by fold within start - radius <= pos <= end + radius + 1 of a candidate gene.

    sum_all_priors rescales so that the priors sum to expected_causal.
    """
    spans = genes.select("chrom", (F.col("start_pos") - radius).alias("lo"), (F.col("end_pos") + radius + 1).alias("hi"))
    keys = loci.select("chrom", "pos")
    near = range_join(keys.distinct(), spans, "lo", "hi", how="left_semi").withColumn("near", F.lit(True))
    m = keys.join(near, ["chrom", "pos"], "left").select("chrom", "pos", F.when(F.col("near"), F.lit(float(fold))).otherwise(1.0).alias("w"))
    t = m.agg(F.count("*").alias("m"), F.sum("w").alias("s"))
    scale = F.lit(float(expected_causal)) / (F.col("s") if method == "sum_all_priors" else F.col("m"))
    return m.crossJoin(F.broadcast(t)).select("chrom", "pos", (F.col("w") * scale).alias("prior"))  # t is one row


def interpolated_priors(loci: DataFrame, points: DataFrame | None = None, genes: DataFrame | None = None, radius: int = 25_000, expected_causal: float = 10.0, fold: float = 10.0) -> DataFrame:
    """chrom, pos, prior: points (chrom, pos, prior) interpolated linearly between neighbours on the chromosome.

    Beyond the outermost points the nearest one counts; values are rescaled to
    1..1001, raised by fold near candidate genes, and normalised to the expected
    number of causal loci. Chromosomes without points get the lowest value.
    """
    keys = loci.select("chrom", "pos").distinct()
    if points is None:
        v = keys.withColumn("v", F.lit(1.0))
    else:
        p = points.groupBy("chrom", "pos").agg(F.avg("prior").alias("prior"))
        u = keys.join(p, ["chrom", "pos"], "full").withColumn("at", F.when(F.col("prior").isNotNull(), F.struct("pos", "prior")))
        a = Along(u, "pos")
        inside = a.inside()
        d = a.df.select("*", F.last("at", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("b0"), F.first("at", ignorenulls=True).over(inside.rowsBetween(0, Window.unboundedFollowing)).alias("a0"))
        seg = a.df.groupBy(*a.keys).agg(F.max_by("at", F.when(F.col("at").isNotNull(), F.col("pos"))).alias("hi"), F.min_by("at", F.when(F.col("at").isNotNull(), F.col("pos"))).alias("lo"))
        seg = seg.select(*a.keys, F.last("hi", ignorenulls=True).over(a.across().rowsBetween(Window.unboundedPreceding, -1)).alias("b1"), F.first("lo", ignorenulls=True).over(a.across().rowsBetween(1, Window.unboundedFollowing)).alias("a1"))
        d = d.join(seg, a.keys, "left").withColumn("b", F.coalesce("b0", "b1")).withColumn("a", F.coalesce("a0", "a1"))
        gap = F.col("a.pos") - F.col("b.pos")
        between = F.when(gap > 0, F.col("b.prior") + (F.col("a.prior") - F.col("b.prior")) * (F.col("pos") - F.col("b.pos")) / gap).otherwise(F.col("b.prior"))
        raw = F.when(F.col("b").isNotNull() & F.col("a").isNotNull(), between).otherwise(F.coalesce("b.prior", "a.prior"))
        d = d.select("chrom", "pos", raw.alias("raw")).join(keys, ["chrom", "pos"], "left_semi")
        t = d.agg(F.min("raw").alias("x0"), F.max("raw").alias("x1"))
        scaled = F.when(F.col("x1") > F.col("x0"), 1 + 1000 * (F.coalesce("raw", "x0") - F.col("x0")) / (F.col("x1") - F.col("x0"))).otherwise(1.0)
        v = d.crossJoin(F.broadcast(t)).select("chrom", "pos", scaled.alias("v"))  # t is one row
    if genes is not None:
        spans = genes.select("chrom", (F.col("start_pos") - radius).alias("lo"), (F.col("end_pos") + radius + 1).alias("hi"))
        near = range_join(v.select("chrom", "pos"), spans, "lo", "hi", how="left_semi").withColumn("near", F.lit(True))
        v = v.join(near, ["chrom", "pos"], "left").select("chrom", "pos", F.when(F.col("near"), F.col("v") * float(fold)).otherwise(F.col("v")).alias("v"))
    t = v.agg(F.sum("v").alias("s"))
    return v.crossJoin(F.broadcast(t)).select("chrom", "pos", (F.col("v") * float(expected_causal) / F.col("s")).alias("prior"))  # t is one row


def union_panels(panels: list[Panel]) -> Panel:
    """Panels of the same individuals as one, marker ids made unique per part."""
    if any(p.ids != panels[0].ids for p in panels):
        raise ValueError("individuals differ")
    parts = [p.markers.select(F.struct(F.lit(i), "marker_id").alias("k"), "chrom", "pos", "calls") for i, p in enumerate(panels)]
    m = reduce(DataFrame.unionByName, parts)
    return Panel(m.select(F.xxhash64("k").alias("marker_id"), "chrom", "pos", "calls"), panels[0].ids, panels[0].data_format)
