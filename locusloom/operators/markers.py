"""Statistics, filters, recoding and imputation of markers, all as array expressions.

Nothing here shuffles: every operator works on one marker row at a time, except
``drop_unusable`` and ``haplotype_codes``, which look at neighbours on the
chromosome. Missing calls are NULL. maf is a frequency, mac a count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..panel import Panel
from .ordering import Along


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def typed(calls: Column | str = "calls") -> Column:
    """The calls that aren't missing."""
    return F.filter(_col(calls), lambda x: x.isNotNull())


def count_of(value, calls: Column | str = "calls") -> Column:
    """How many calls equal a value."""
    return F.size(F.filter(_col(calls), lambda x: x == F.lit(value)))


def n_typed(calls: Column | str = "calls") -> Column:
    return F.size(typed(calls))


def n_missing(calls: Column | str = "calls") -> Column:
    return F.size(_col(calls)) - n_typed(calls)


def missing_rate(calls: Column | str = "calls") -> Column:
    return n_missing(calls) / F.size(_col(calls))


def alleles(calls: Column | str = "calls") -> Column:
    """Distinct calls in order, without missing."""
    return F.array_sort(F.array_distinct(typed(calls)))


def total(calls: Column | str = "calls") -> Column:
    """Sum of the calls as a double."""
    return F.aggregate(typed(calls), F.lit(0.0), lambda s, x: s + x.cast("double"))


def mean_call(calls: Column | str = "calls") -> Column:
    return F.try_divide(total(calls), n_typed(calls))


def sd_call(calls: Column | str = "calls") -> Column:
    """Population standard deviation."""
    m = mean_call(calls)
    square = F.aggregate(typed(calls), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return F.sqrt(F.greatest(F.try_divide(square, n_typed(calls)) - m * m, F.lit(0.0)))


def mac(data_format: str = "binary", calls: Column | str = "calls") -> Column:
    """Minor allele count: least class count, or min(n0, n2) + n1 / 2 for diploid calls."""
    if data_format == "diploid_int":
        return F.least(count_of(0, calls), count_of(2, calls)) + count_of(1, calls) / 2
    if data_format == "float":
        return F.least(total(calls), 2 * n_typed(calls) - total(calls))
    counts = F.transform(alleles(calls), lambda a: F.size(F.filter(_col(calls), lambda x: x == a)))
    return F.when(F.size(alleles(calls)) > 1, F.array_min(counts).cast("double")).otherwise(0.0)


def maf(data_format: str = "binary", calls: Column | str = "calls") -> Column:
    """Minor allele frequency among typed calls; NULL if none is typed."""
    return F.try_divide(mac(data_format, calls), n_typed(calls))


def marker_stats(panel: Panel, *more: str) -> DataFrame:
    """marker_id, more columns of the markers, chrom, pos, n_typed, n_missing, missing_rate, n_alleles, mean, mac, maf."""
    f = panel.data_format
    if f in ("binary", "diploid_int"):
        return _small_stats(panel, more)
    return panel.markers.select(
        "marker_id", *more, "chrom", "pos", n_typed().alias("n_typed"), n_missing().alias("n_missing"), missing_rate().alias("missing_rate"),
        F.size(alleles()).alias("n_alleles"), (mean_call() if f != "nucleotides" else F.lit(None).cast("double")).alias("mean"), mac(f).alias("mac"), maf(f).alias("maf"),
    )


def _small_stats(panel: Panel, more: tuple[str, ...]) -> DataFrame:
    """marker_stats of calls 0, 1 and 2, counted once per batch of markers."""
    diploid = panel.data_format == "diploid_int"
    given = panel.markers.select("marker_id", *more, "chrom", "pos", F.col("calls").cast("array<tinyint>").alias("calls"))
    added = ["n_typed int", "n_missing int", "missing_rate double", "n_alleles int", "mean double", "mac double", "maf double"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("calls")
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(b.num_rows), size)
            flat = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
            n = np.bincount(row[flat >= 0], minlength=b.num_rows)
            kinds = np.stack([np.bincount(row[flat == v], minlength=b.num_rows) for v in range(int(flat.max(initial=0)) + 1)])
            total = (kinds * np.arange(len(kinds))[:, None]).sum(axis=0)
            present = (kinds > 0).sum(axis=0)
            if diploid:
                three = np.vstack([kinds, np.zeros((3, b.num_rows), np.int64)])
                minor = np.minimum(three[0], three[2]) + three[1] / 2
            else:
                minor = np.where(present > 1, np.where(kinds > 0, kinds, np.iinfo(np.int64).max).min(axis=0), 0).astype(float)
            share = lambda x, y: pa.array(np.divide(x, np.maximum(y, 1)), mask=y == 0)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(n, pa.int32()), pa.array(size - n, pa.int32()), share(size - n, size), pa.array(present, pa.int32()), share(total, n), pa.array(minor), share(minor, n)],
                names=[*b.schema.names[:-1], *[a.split()[0] for a in added]],
            )

    fields = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in given.schema.fields[:-1])
    return given.mapInArrow(run, f"{fields}, {', '.join(added)}")


def individual_missing(panel: Panel) -> DataFrame:
    """idx, n_markers, n_missing, missing_rate per individual: summed per partition, then over partitions."""
    g = panel.long().groupBy("idx").agg(F.count("*").alias("n_markers"), F.count_if(F.col("g").isNull()).alias("n_missing"))
    return g.withColumn("missing_rate", F.col("n_missing") / F.col("n_markers"))


# -------------------------------------------------------------------- filters


def keep_where(panel: Panel, condition: Column) -> Panel:
    return panel.with_markers(panel.markers.filter(condition))


def filter_monomorphic(panel: Panel) -> Panel:
    """Markers with more than one call value."""
    return keep_where(panel, F.size(alleles()) > 1)


def only_biallelic(panel: Panel) -> Panel:
    """Markers with exactly two call values."""
    return keep_where(panel, F.size(alleles()) == 2)


def filter_mac(panel: Panel, least: float = 15) -> Panel:
    """Markers with a minor count of at least ``least``; binary ones need both classes."""
    ok = mac(panel.data_format) >= least
    return keep_where(panel, ok & (F.size(alleles()) == 2) if panel.data_format == "binary" else ok)


def filter_maf(panel: Panel, above: float, upto: float = 1.0, strict: bool = False) -> Panel:
    """Markers with above <= maf <= upto, or above < maf where strict."""
    f = maf(panel.data_format)
    return keep_where(panel, ((f > above) if strict else (f >= above)) & (f <= upto))


def filter_missing(panel: Panel, max_rate: float | None = None, max_count: int | None = None) -> Panel:
    """Markers with a missing rate or count of at most the bound."""
    ok = F.lit(True)
    if max_rate is not None:
        ok = ok & (missing_rate() <= max_rate)
    if max_count is not None:
        ok = ok & (n_missing() <= max_count)
    return keep_where(panel, ok)


def region(panel: Panel, chrom: int, start: int | None = None, end: int | None = None) -> Panel:
    """Markers of a chromosome with start <= pos < end."""
    ok = F.col("chrom") == chrom
    if start is not None:
        ok = ok & (F.col("pos") >= start)
    if end is not None:
        ok = ok & (F.col("pos") < end)
    return keep_where(panel, ok)


def at_locus(panel: Panel, chrom: int, pos: int) -> Panel:
    return keep_where(panel, (F.col("chrom") == chrom) & (F.col("pos") == pos))


def split_region(panel: Panel, chrom: int, start: int | None = None, end: int | None = None) -> tuple[Panel, Panel]:
    """Markers with start < pos <= end on a chromosome, and all others; a whole chromosome without bounds."""
    inside = F.col("chrom") == chrom
    if start is not None:
        inside = inside & (F.col("pos") > start)
    if end is not None:
        inside = inside & (F.col("pos") <= end)
    return keep_where(panel, inside), keep_where(panel, ~inside)


def keep_markers(panel: Panel, loci: DataFrame) -> Panel:
    """Markers at the given (chrom, pos)."""
    return panel.with_markers(panel.markers.join(loci.select("chrom", "pos").distinct(), ["chrom", "pos"], "left_semi"))


def drop_markers(panel: Panel, loci: DataFrame) -> Panel:
    """Markers at none of the given (chrom, pos)."""
    return panel.with_markers(panel.markers.join(loci.select("chrom", "pos").distinct(), ["chrom", "pos"], "left_anti"))


def keep_marker_ids(panel: Panel, ids: DataFrame, complement: bool = False) -> Panel:
    """Markers by marker_id."""
    return panel.with_markers(panel.markers.join(ids.select("marker_id").distinct(), "marker_id", "left_anti" if complement else "left_semi"))


def sample_markers(panel: Panel, fraction: float, seed: int = 0) -> Panel:
    """Bernoulli sample that depends on marker and seed only, not on partitioning."""
    u = F.pmod(F.xxhash64("marker_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return keep_where(panel, u < fraction)


def scale_positions(panel: Panel, factor: float) -> Panel:
    return panel.with_markers(panel.markers.withColumn("pos", (F.col("pos") * factor).cast("long")))


def beside(calls: Column | str, value: Column, f) -> Column:
    """f(call, value) for every call of the row.

    The value is handed in as an array of its copies, not named in the lambda:
    when the optimizer moves filters, it replaces column names by their
    expressions, and within a lambda those would be computed for every element.
    """
    c = _col(calls)
    return F.zip_with(c, F.array_repeat(value, F.size(c)), f)


def gather(column: str, places: Column) -> Column:
    """Elements at 1-based places, NULL for places outside."""
    return F.zip_with(places, F.array_repeat(F.col(column), F.size(places)), lambda i, c: F.when((i > 0) & (i <= F.size(c)), F.element_at(c, F.greatest(i, F.lit(1)))))


def _replace_gaps(panel: Panel, value: Column, kind: str | None = None) -> DataFrame:
    """Missing calls become the marker's value."""
    fill = (lambda x, v: F.coalesce(x.cast("double"), v).cast(kind)) if kind else (lambda x, v: F.coalesce(x, v))
    return panel.markers.withColumn("calls", beside("calls", value, fill))


def pick_individuals(panel: Panel, at: list[int]) -> Panel:
    """The panel with the individuals at these places, in this order; places may repeat."""
    if at == list(range(panel.n)):
        return panel
    places = F.array(*[F.lit(i + 1) for i in at]) if at else F.array().cast("array<int>")
    markers = panel.markers.withColumn("calls", gather("calls", places))
    if "probs" in markers.columns:
        markers = markers.withColumn("probs", gather("probs", places))
    return Panel(markers, [panel.ids[i] for i in at], panel.data_format)


def keep_individuals(panel: Panel, ids: list[str]) -> Panel:
    """Individuals in the given order, each once; unknown ids are passed over."""
    place = {x: i for i, x in reversed(list(enumerate(panel.ids)))}
    return pick_individuals(panel, [place[x] for x in dict.fromkeys(ids) if x in place])


def drop_individuals(panel: Panel, ids: list[str]) -> Panel:
    gone = set(ids)
    return pick_individuals(panel, [i for i, x in enumerate(panel.ids) if x not in gone])


def filter_individuals_by_missing(panel: Panel, max_rate: float = 0.2) -> Panel:
    """Individuals with a missing rate of at most max_rate."""
    bad = {r.idx for r in individual_missing(panel).filter(F.col("missing_rate") > max_rate).collect()}
    return pick_individuals(panel, [i for i in range(panel.n) if i not in bad])


def keep_countries(panel: Panel, metadata: DataFrame, countries: list[str], complement: bool = False, id_col: str = "indiv_id") -> Panel:
    """Individuals whose metadata name one of the countries, or none of them."""
    match = {r[0] for r in panel.individuals().join(metadata.select(F.col(id_col).alias("indiv_id"), "country"), "indiv_id").filter(F.col("country").isin(*countries)).select("indiv_id").collect()}
    return pick_individuals(panel, [i for i, x in enumerate(panel.ids) if (x in match) != complement])


# -------------------------------------------------------------------- recoding


def to_binary(panel: Panel, reference_id: str | None = None, only_biallelic_: bool = True) -> Panel:
    """Nucleotide calls as 0 and 1: the reference individual's allele is 0, else the first in order.

    Markers with more than two alleles are dropped, or keep codes 0, 1, 2, ...
    """
    if panel.data_format != "nucleotides":
        raise ValueError("the panel has no nucleotides")
    order = alleles()
    if reference_id is not None:
        own = F.element_at("calls", panel.ids.index(reference_id) + 1)
        order = F.when(own.isNotNull(), F.concat(F.array(own), F.array_remove(order, own))).otherwise(order)
    m = panel.markers.withColumn("_order", order)
    if only_biallelic_:
        m = m.filter(F.size("_order") == 2)
    m = m.withColumn("calls", beside("calls", F.col("_order"), lambda x, o: F.when(x.isNotNull(), (F.array_position(o, x) - 1).cast("tinyint")))).drop("_order")
    return Panel(m, panel.ids, "binary" if only_biallelic_ else "int")


def mask_low_probability(panel: Panel, least: float) -> Panel:
    """Calls whose probability in ``probs`` is below the bound become missing."""
    z = F.transform(F.arrays_zip("calls", "probs"), lambda s: F.when(s["probs"] >= least, s["calls"]))
    return panel.with_markers(panel.markers.withColumn("calls", z))


def mask_ambiguous(panel: Panel, max_missing: int | None = None) -> Panel:
    """IUPAC ambiguity codes become missing; then markers with too many gaps are dropped."""
    p = panel.with_markers(panel.markers.withColumn("calls", F.transform("calls", lambda x: F.when(x.isin("A", "C", "G", "T", "-"), x))))
    return p if max_missing is None else filter_missing(p, max_count=max_missing)


def z_scores(panel: Panel) -> DataFrame:
    """marker_id, chrom, pos, z: calls minus mean over population sd; NULL for sd 0, 0 for missing calls."""
    z = beside("calls", F.struct(mean_call().alias("m"), sd_call().alias("s")), lambda x, v: F.coalesce((x.cast("double") - v["m"]) / v["s"], F.lit(0.0)))
    return panel.markers.select("marker_id", "chrom", "pos", F.when(sd_call() > 0, z).alias("z"))


def mode_call(calls: Column | str = "calls", values: tuple[int, ...] = (0, 1, 2)) -> Column:
    """The most frequent call; ties go to the smaller code."""
    best = F.array_max(F.array(*[F.struct(count_of(v, calls).alias("n"), F.lit(-v).alias("v")) for v in values]))
    return F.when(best["n"] > 0, (-best["v"]).cast("tinyint"))


def impute_mode(panel: Panel) -> Panel:
    """Missing calls become the marker's most frequent call."""
    return panel.with_markers(_replace_gaps(panel, mode_call()))


def impute_rounded_mean(panel: Panel) -> Panel:
    """Missing calls become the marker's mean call, rounded half up."""
    return panel.with_markers(_replace_gaps(panel, F.floor(mean_call() + 0.5).cast("tinyint")))


def impute_mean(panel: Panel) -> Panel:
    """Missing calls become the marker's mean; the panel turns to floats."""
    return Panel(_replace_gaps(panel, mean_call(), "float"), panel.ids, "float")


def drop_unusable(panel: Panel, missing_threshold: float, impute: str | None, drop_monomorphic: bool, drop_zero_position: bool) -> Panel:
    """Quality control at load: missing calls above 2 * threshold * n, monomorphic markers, repeated and zero positions.

    The factor 2 is kept from the format's original definition, in which the
    threshold counts alleles.
    """
    p = keep_where(panel, n_missing() <= 2 * missing_threshold * panel.n)
    if impute:
        p = impute_mode(p)
    if drop_monomorphic:
        p = filter_monomorphic(p)
    m = p.markers
    if drop_zero_position:
        m = m.filter("pos > 0")
    # markers are placed on the chromosome, so neighbours are looked up within short stretches of it
    w = Window.partitionBy("chrom", "pos").orderBy("marker_id")
    m = m.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")
    m = m.withColumn("freq", mean_call() / 2).withColumn("missing_count", n_missing())
    return p.with_markers(m)


# ------------------------------------------------------------------ haplotypes


def haplotype_codes(panel: Panel, window: int = 1) -> DataFrame:
    """marker_id, chrom, pos, codes: each marker's calls replaced by the number of the haplotype over +-window markers.

    Numbers are ranks of the haplotypes in order of their calls within the marker,
    from 0, a missing call before all others; windows are shorter at chromosome
    ends.
    """
    n = panel.n
    m = panel.markers.select("marker_id", "chrom", "pos", F.transform("calls", lambda x: F.coalesce(x.cast("short"), F.lit(-1).cast("short"))).alias("g"))
    near = Along(m, "marker_id").neighbours(window, lambda w: {"near": F.flatten(F.collect_list("g").over(w))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = []
            for x in b.column("near"):
                rows = x.values.to_numpy().reshape(-1, n)
                codes.append(np.unique(rows, axis=1, return_inverse=True)[1].ravel().astype(np.int32))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(codes, pa.list_(pa.int32()))], ["marker_id", "chrom", "pos", "codes"])

    return near.select("marker_id", F.col("chrom").cast("int").alias("chrom"), F.col("pos").cast("long").alias("pos"), "near").mapInArrow(run, "marker_id long, chrom int, pos long, codes array<int>")


def haplotype_counts(panel: Panel) -> DataFrame:
    """(haplotype, n): distinct columns of calls over all markers of the panel, which should be few."""
    per = panel.long().groupBy("idx").agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct("chrom", "pos", "marker_id", F.coalesce(F.col("g").cast("string"), F.lit(".")).alias("g")))), lambda s: s["g"])).alias("haplotype"))
    return per.groupBy("haplotype").agg(F.count("*").alias("n"))


def frequency_bins(panel: Panel, bins: int = 10) -> DataFrame:
    """Markers per bin of the frequency of allele 0; the last bin includes 1."""
    b = F.least(F.floor(F.try_divide(count_of(0), n_typed()) * bins), F.lit(bins - 1)).cast("int")
    return panel.markers.select(b.alias("bin")).groupBy("bin").agg(F.count("*").alias("n_markers"))


def mean_allele_frequency(panel: Panel) -> DataFrame:
    """One row: the mean over markers of min(c, 1 - c), c the frequency of allele 0."""
    c = F.try_divide(count_of(0), n_typed())
    return panel.markers.select(F.least(c, 1 - c).alias("c")).agg(F.avg("c").alias("mean_frequency"))
