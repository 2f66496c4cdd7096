"""Linkage between markers: pair frequencies, r2, pruning and haplotype homozygosity.

Pairs within a distance window are made by a binned range join, so only markers of
neighbouring bins meet. Pair products run over the two call arrays of the pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..panel import Panel
from .markers import n_typed, total
from .regions import range_join


def marker_pairs(panel: Panel, window: int | None = None, inner: int = 0, max_markers: int = 2000) -> DataFrame:
    """id1, pos1, a, id2, pos2, b, chrom: pairs of one chromosome with inner <= pos2 - pos1 <= window.

    Without a window all pairs of the panel are made, which is limited to a
    shortlist of max_markers; a longer one is an error.
    """
    m = panel.markers.select("marker_id", "chrom", "pos", "calls")
    if window is None:
        if m.limit(max_markers + 1).count() > max_markers:
            raise ValueError(f"more than {max_markers} markers; give a window")
        a = m.select(F.col("marker_id").alias("id1"), "chrom", F.col("pos").alias("pos1"), F.col("calls").alias("a"))
        b = m.select(F.col("marker_id").alias("id2"), F.col("chrom").alias("chrom2"), F.col("pos").alias("pos2"), F.col("calls").alias("b"))
        before = (F.struct("chrom", "pos1", "id1") < F.struct("chrom2", "pos2", "id2"))
        return a.join(F.broadcast(b), before)  # at most max_markers rows
    a = m.select(F.col("marker_id").alias("id1"), "chrom", F.col("pos").alias("pos1"), F.col("calls").alias("a"), (F.col("pos") + inner).alias("lo"), (F.col("pos") + window).alias("hi"))
    b = m.select(F.col("marker_id").alias("id2"), "chrom", "pos", F.col("calls").alias("b"))
    j = range_join(b, a, "lo", "hi", width=max(1, window)).filter((F.col("pos") > F.col("pos1")) | ((F.col("pos") == F.col("pos1")) & (F.col("id2") > F.col("id1"))))
    return j.withColumnRenamed("pos", "pos2").withColumn("chrom2", F.col("chrom")).drop("lo", "hi")


def _complete() -> Column:
    return F.filter(F.arrays_zip("a", "b"), lambda s: s["a"].isNotNull() & s["b"].isNotNull())


def pair_frequencies(pairs: DataFrame) -> DataFrame:
    """id1, id2, n, f0..f3: frequencies of the two-locus haplotypes 2 a + b among complete calls of binary markers."""
    z = pairs.withColumn("_z", _complete())
    f = lambda k: F.try_divide(F.size(F.filter("_z", lambda s: 2 * s["a"] + s["b"] == k)), F.size("_z"))
    return z.select("id1", "id2", "chrom", "pos1", "pos2", F.size("_z").alias("n"), *[f(k).alias(f"f{k}") for k in range(4)])


def unbiased_pairs(panel: Panel, pairs: DataFrame, window: int) -> DataFrame:
    """Pairs whose first marker lies at least window before the last marker of its chromosome."""
    last = panel.markers.groupBy("chrom").agg(F.max("pos").alias("_last"))
    return pairs.join(last, "chrom").filter(F.col("_last") - F.col("pos1") >= window).drop("_last")


def _sums() -> list[Column]:
    add = lambda f: F.aggregate("_z", F.lit(0.0), lambda s, x: s + f(x["a"].cast("double"), x["b"].cast("double")))
    return [
        F.size("_z").alias("n"), add(lambda a, b: a).alias("sa"), add(lambda a, b: b).alias("sb"),
        add(lambda a, b: a * b).alias("sab"), add(lambda a, b: a * a).alias("saa"), add(lambda a, b: b * b).alias("sbb"),
    ]


def pair_r2(pairs: DataFrame) -> DataFrame:
    """id1, id2, n, r2: squared correlation over complete calls, NULL without variation."""
    s = pairs.withColumn("_z", _complete()).select("id1", "id2", "chrom", "pos1", "pos2", *_sums())
    n = F.col("n")
    cov, va, vb = n * F.col("sab") - F.col("sa") * F.col("sb"), n * F.col("saa") - F.col("sa") * F.col("sa"), n * F.col("sbb") - F.col("sb") * F.col("sb")
    return s.select("id1", "id2", "chrom", "pos1", "pos2", "n", F.when((va > 1e-9) & (vb > 1e-9), cov * cov / (va * vb)).alias("r2"))


def top_correlated(panel: Panel, calls: list, least: float = 0.5) -> DataFrame:
    """marker_id, chrom, pos, r2 of markers with r2 above the bound to one given marker."""
    m = panel.markers.select(F.col("marker_id").alias("id2"), "chrom", F.col("pos").alias("pos2"), F.col("calls").alias("b")).withColumn("a", F.array(*[F.lit(None if v is None else float(v)) for v in calls]))
    m = m.withColumn("id1", F.lit(-1).cast("long")).withColumn("pos1", F.col("pos2"))
    return pair_r2(m).filter(F.col("r2") > least).select(F.col("id2").alias("marker_id"), "chrom", F.col("pos2").alias("pos"), "r2")


def _greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Linked pairs, per chromosome from the last later marker on: what each kept marker removes.

    A removed marker is forgotten once the stream has passed its place.
    """
    gone: dict[tuple[int, int], int] = {}
    chrom: int | None = None
    for b in batches:
        out: list[tuple[int, int]] = []
        for c, p1, i1, p2, i2 in zip(*(b.column(x).to_pylist() for x in ("chrom", "pos1", "id1", "pos2", "id2"))):
            if c != chrom:
                gone, chrom = {}, c
            if (p2, i2) in gone or (p1, i1) in gone:
                continue
            gone[p1, i1] = i2
            out.append((i1, i2))
            if len(gone) > 100_000:
                gone = {k: v for k, v in gone.items() if k <= (p2, i2)}
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["marker_id", "kept_id"])


def prune_linked(panel: Panel, least: float = 0.8, window: int | None = None) -> tuple[Panel, DataFrame]:
    """Greedy pruning from the last marker on: a kept marker removes the earlier ones left with r2 of at least the bound.

    The pairs are found distributed; the choice walks down each chromosome over
    the linked pairs and holds what lies within reach of its place. Returns the
    pruned panel and the removed markers with the kept one that removed them
    (marker_id, kept_id).
    """
    linked = pair_r2(marker_pairs(panel, window)).filter(F.col("r2") >= least).select(F.col("chrom").cast("int").alias("chrom"), "pos1", "id1", "pos2", "id2")
    down = linked.repartition("chrom").sortWithinPartitions("chrom", *[F.col(x).desc() for x in ("pos2", "id2", "pos1", "id1")])
    gone = down.mapInArrow(_greedy, "marker_id long, kept_id long")
    return panel.with_markers(panel.markers.join(gone, "marker_id", "left_anti")), gone


def ehh(panel: Panel, chrom: int, start: int, end: int) -> DataFrame:
    """One row: sum over haplotypes of c (c - 1) / (n (n - 1)), for markers start <= pos <= end."""
    inside = panel.with_markers(panel.markers.filter((F.col("chrom") == chrom) & F.col("pos").between(start, end)))
    per = inside.long().groupBy("idx").agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct("pos", "marker_id", F.coalesce(F.col("g").cast("string"), F.lit(".")).alias("g")))), lambda s: s["g"])).alias("h"))
    c = per.groupBy("h").agg(F.count("*").alias("c"))
    n = F.sum("c")
    return c.agg(F.try_divide(F.sum(F.col("c") * (F.col("c") - 1)).cast("double"), n * (n - 1)).alias("ehh"))


def total_ehh(panel: Panel, window: int, inner: int = 0) -> DataFrame:
    """One row: sum and number of the homozygosities of all windowed pairs, each over the markers from one to the other."""
    p = marker_pairs(panel, window, inner).select("chrom", "id1", "pos1", "id2", "pos2")
    m = panel.markers.select("chrom", "pos", "marker_id", "calls")
    spans = p.withColumn("lo", F.col("pos1")).withColumn("hi", F.col("pos2"))
    j = range_join(m, spans, "lo", "hi", width=max(1, window))
    order = F.struct("pos", "marker_id", F.transform("calls", lambda x: F.coalesce(x.cast("string"), F.lit("."))).alias("g"))
    rows = j.groupBy("id1", "id2").agg(F.sort_array(F.collect_list(order)).alias("rows"))
    n = F.size(F.element_at("rows", 1)["g"])
    haps = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat_ws(",", F.transform("rows", lambda r: F.element_at(r["g"], i))))
    h = rows.select("id1", "id2", n.alias("n"), F.explode(haps).alias("h")).groupBy("id1", "id2", "n", "h").agg(F.count("*").alias("c"))
    e = h.groupBy("id1", "id2", "n").agg((F.sum(F.col("c") * (F.col("c") - 1)) / (F.first("n") * (F.first("n") - 1))).alias("e"))
    return e.agg(F.sum("e").alias("sum_ehh"), F.count("*").alias("n_pairs"))


def singleton_share(panel: Panel) -> DataFrame:
    """One row: share of markers whose rarer allele occurs once."""
    ones, n = total(), n_typed()
    return panel.markers.agg(F.avg(((ones == 1) | (n - ones == 1)).cast("double")).alias("singletons"))
