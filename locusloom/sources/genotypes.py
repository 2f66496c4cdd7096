"""Readers of genotype files. Every reader returns a Panel with missing calls as NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.markers import drop_unusable, gather, impute_mode, impute_rounded_mean, to_binary
from ..panel import Panel
from .text import fields, first_lines, guess_delimiter, numbered_lines

#: IUPAC codes of heterozygous pairs (fixed values).
PAIR_CODES = {"AC": "M", "AG": "R", "AT": "W", "CG": "S", "CT": "Y", "GT": "K"}
#: Codes that stand for themselves (fixed values).
SINGLE_CODES = "ACGTRYSWKMBDHV-"
_HEADS = ("chromosome", "chr", "chrom")
_MISSING_TEXT = ("", "NA", "N", "X", "|", "?", "nan", "NaN")


def decode_nucleotides(col: Column) -> Column:
    """IUPAC code of a nucleotide or pair, NULL for anything unknown."""
    code = F.upper(col)
    pairs = F.create_map(*[F.lit(x) for k, v in PAIR_CODES.items() for x in (k, v, k[::-1], v)])
    same = (F.length(code) == 2) & (F.substring(code, 1, 1) == F.substring(code, 2, 1))
    one = F.when(same, F.substring(code, 1, 1)).otherwise(code)
    return F.when(one.isin(*SINGLE_CODES), one).otherwise(F.try_element_at(pairs, one))


def in_pairs(values: Column, f) -> Column:
    """f of the first and second, third and fourth, ... element."""
    return F.zip_with(F.filter(values, lambda x, i: i % 2 == 0), F.filter(values, lambda x, i: i % 2 == 1), f)


def _header(spark: SparkSession, path: str, delim: str) -> tuple[list[str], list[str] | None, int]:
    """Individual ids, array ids and the number of header lines."""
    lines = [[x.strip() for x in line.split(delim)] for line in first_lines(spark, path, 2)]
    if lines and lines[0][0].lower() in _HEADS:
        return lines[0][2:], None, 1
    if len(lines) > 1 and lines[1][0].lower() in _HEADS:
        return lines[1][2:], lines[0][2:], 2
    raise ValueError("no header line that begins with the chromosome column")


def _matrix_file(spark: SparkSession, path: str, delim: str, call, keep: list[str] | None, fraction: float, seed: int) -> tuple[DataFrame, list[str]]:
    ids, _, skip = _header(spark, path, delim)
    at = list(range(len(ids))) if keep is None else [i for i, x in enumerate(ids) if x in set(keep)]
    rows = numbered_lines(spark, path).filter((F.col("line_no") >= skip) & (F.length(F.trim("value")) > 0))
    if fraction < 1:
        rows = rows.sample(False, fraction, seed)
    f = rows.withColumn("f", fields(delim))
    picked = F.slice("f", 3, len(ids)) if len(at) == len(ids) else gather("f", F.array(*[F.lit(i + 3) for i in at]))
    markers = f.select(
        (F.col("line_no") - skip).alias("marker_id"), F.element_at("f", 1).cast("int").alias("chrom"), F.element_at("f", 2).cast("double").cast("long").alias("pos"),
        F.transform(picked, call).alias("calls"),
    )
    return markers, [ids[i] for i in at]


def read_numeric(spark: SparkSession, path: str, data_format: str = "binary", delim: str = ",", missing: str = "NA", keep: list[str] | None = None, fraction: float = 1.0, seed: int = 0) -> Panel:
    """Numeric genotype CSV: chromosome, position, then one call per individual.

    Integer formats take -1 as missing too. keep: only these individuals;
    fraction: Bernoulli sample of the rows.
    """
    kind = "float" if data_format == "float" else "tinyint"

    def call(x: Column) -> Column:
        v = F.when((x != missing) & ~x.isin(*_MISSING_TEXT), x.try_cast("double"))
        return v.cast(kind) if data_format == "float" else F.when(v >= 0, v.try_cast(kind))

    markers, ids = _matrix_file(spark, path, delim, call, keep, fraction, seed)
    return Panel(markers, ids, data_format)


def read_nucleotides(spark: SparkSession, path: str, delim: str = ",", decode: bool = True, keep: list[str] | None = None, fraction: float = 1.0, seed: int = 0) -> Panel:
    """Nucleotide CSV with an optional first line of array ids; calls become IUPAC codes."""
    call = decode_nucleotides if decode else (lambda x: F.when(~x.isin(*_MISSING_TEXT), x))
    markers, ids = _matrix_file(spark, path, delim, call, keep, fraction, seed)
    return Panel(markers, ids, "nucleotides")


def read_genotypes(spark: SparkSession, path: str, fmt: str = "binary", **options) -> Panel:
    """Reader by format: binary, int, diploid_int, float, nucleotides, nucleotides_binary."""
    if fmt == "nucleotides":
        return read_nucleotides(spark, path, **options)
    if fmt == "nucleotides_binary":
        return to_binary(read_nucleotides(spark, path, **options))
    return read_numeric(spark, path, fmt, **options)


def read_loci(spark: SparkSession, path: str, delim: str = ",") -> DataFrame:
    """Only (chrom, pos) of a genotype CSV."""
    _, _, skip = _header(spark, path, delim)
    f = numbered_lines(spark, path).filter((F.col("line_no") >= skip) & (F.length(F.trim("value")) > 0)).withColumn("f", F.split("value", delim, 3))
    return f.select(F.element_at("f", 1).cast("int").alias("chrom"), F.element_at("f", 2).cast("double").cast("long").alias("pos"))


def read_chromosome_files(spark: SparkSession, prefix: str, chromosomes: list[int], data_format: str = "diploid_int", min_mac: int = 5, **options) -> Panel:
    """One CSV per chromosome: the file filtered for min_mac if it exists, else the unfiltered one, filtered here."""
    from ..operators.markers import filter_mac

    parts: list[Panel] = []
    for c in chromosomes:
        base = f"{prefix}chr_{c}_{data_format}"
        for path, done in ((f"{base}_mac{min_mac}.csv", True), (f"{base}.csv", False)):
            jvm = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            if jvm.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm):
                part = read_numeric(spark, path, data_format, **options)
                parts.append(part if done else filter_mac(part, min_mac))
                break
        else:
            raise FileNotFoundError(base)
    if any(p.ids != parts[0].ids for p in parts):
        raise ValueError("individuals differ between chromosomes")
    markers = parts[0].markers
    for p in parts[1:]:
        markers = markers.unionByName(p.markers)
    return Panel(markers.withColumn("marker_id", F.col("chrom").cast("long") * (1 << 40) + F.col("marker_id")), parts[0].ids, data_format)


# ---------------------------------------------------------------- PLINK files


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """(marker_id, chrom, snp_id, cm, pos) of a four-column MAP file."""
    f = numbered_lines(spark, path).filter(F.length(F.trim("value")) > 0).withColumn("f", fields("blanks"))
    e = lambda i: F.element_at("f", i)
    return f.select(F.col("line_no").alias("marker_id"), e(1).cast("int").alias("chrom"), e(2).alias("snp_id"), e(3).cast("double").alias("cm"), e(4).cast("long").alias("pos"))


def read_fam(spark: SparkSession, path: str) -> DataFrame:
    """(idx, fam_id, indiv_id, sex, phenotype): sex 1 or 2 else NULL, phenotype NULL for NA and -9."""
    f = numbered_lines(spark, path).filter(F.length(F.trim("value")) > 0).withColumn("f", fields("blanks"))
    e = lambda i: F.try_element_at("f", F.lit(i))
    sex = e(5).try_cast("int")
    phen = e(6).try_cast("double")
    return f.select(
        F.col("line_no").cast("int").alias("idx"), e(1).alias("fam_id"), F.coalesce(e(2), e(1)).alias("indiv_id"),
        F.when(sex.isin(1, 2), sex).alias("sex"), F.when(~F.isnan(phen) & (phen != -9), phen).alias("phenotype"),
    )


def read_ped(spark: SparkSession, prefix: str, only_biallelic: bool = True) -> tuple[Panel, DataFrame]:
    """PED and MAP files: dosages of the second allele in sorted order, and (marker_id, a0, a1, n_alleles, n_missing).

    A call with an allele 0 is missing. Rows of the PED file are turned by
    exploding each person's calls and regrouping them by marker.
    """
    loci = read_map(spark, f"{prefix}.map")
    f = numbered_lines(spark, f"{prefix}.ped").filter(F.length(F.trim("value")) > 0).withColumn("f", fields("blanks"))
    people = [r.indiv_id for r in f.select("line_no", F.element_at("f", 2).alias("indiv_id")).orderBy("line_no").collect()]
    alleles = F.slice("f", 7, F.size("f"))
    pairs = in_pairs(alleles, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    calls = f.select(F.col("line_no").cast("int").alias("idx"), F.posexplode(pairs).alias("marker_id", "p")).select("idx", F.col("marker_id").cast("long").alias("marker_id"), "p.x", "p.y")
    calls = calls.withColumn("ok", (F.col("x") != "0") & (F.col("y") != "0"))
    seen = calls.filter("ok").select("marker_id", F.explode(F.array("x", "y")).alias("a")).groupBy("marker_id").agg(F.sort_array(F.collect_set("a")).alias("alleles"))
    missing = calls.groupBy("marker_id").agg(F.count_if(~F.col("ok")).alias("n_missing"))
    info = loci.join(seen, "marker_id", "left").join(missing, "marker_id", "left")
    info = info.select("marker_id", "chrom", "pos", "snp_id", F.try_element_at("alleles", F.lit(1)).alias("a0"), F.try_element_at("alleles", F.lit(2)).alias("a1"), F.coalesce(F.size("alleles"), F.lit(0)).alias("n_alleles"), "n_missing")
    kept = info.filter("n_alleles = 2") if only_biallelic else info
    g = calls.join(kept.select("marker_id", "a0"), "marker_id").select(
        "marker_id", "idx", F.when(F.col("ok"), (F.col("x") != F.col("a0")).cast("int") + (F.col("y") != F.col("a0")).cast("int")).cast("tinyint").alias("g")
    )
    rows = g.groupBy("marker_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "g"))), lambda s: s["g"]).alias("calls"))
    markers = kept.join(rows, "marker_id").select("marker_id", "chrom", "pos", "snp_id", "a0", "a1", "calls")
    return Panel(markers, people, "diploid_int"), info


def _tped_fields(spark: SparkSession, prefix: str, n: int) -> DataFrame:
    """Numbered TPED lines with their fields and why a line can't be taken."""
    f = numbered_lines(spark, f"{prefix}.tped").withColumn("f", fields("blanks"))
    e = lambda i: F.try_element_at("f", F.lit(i))
    bad = F.exists(F.slice("f", 5, 2 * n), lambda x: ~x.isin("0", "1", "2"))
    reason = (
        F.when(F.length(F.trim("value")) == 0, "empty_line").when(F.size("f") != 4 + 2 * n, "field_count").when(e(1).try_cast("int").isNull(), "chromosome")
        .when(e(4).try_cast("long").isNull(), "position").when(bad, "allele")
    )
    return f.withColumn("reason", reason)


def rejected_tped(spark: SparkSession, prefix: str) -> DataFrame:
    """(line_no, value, reason) of the lines read_tped leaves out."""
    n = read_fam(spark, f"{prefix}.tfam").count()
    return _tped_fields(spark, prefix, n).filter(F.col("reason").isNotNull()).select("line_no", "value", "reason")


def read_tped(spark: SparkSession, prefix: str, impute: str | None = "simple", bim: bool = False) -> tuple[Panel, DataFrame]:
    """TPED (alleles 1 and 2, 0 missing) with TFAM: dosages of allele 2, and the individuals.

    impute: ``simple`` rounded mean, ``mode`` the most frequent call, None keeps
    gaps. bim: take snp ids and alleles from a BIM file. Lines that can't be
    taken are those of rejected_tped.
    """
    people = read_fam(spark, f"{prefix}.tfam")
    ids = [r.indiv_id for r in people.orderBy("idx").collect()]
    n = len(ids)
    f = _tped_fields(spark, prefix, n).filter(F.col("reason").isNull())
    alleles = F.transform(F.slice("f", 5, 2 * n), lambda x: x.cast("tinyint"))
    calls = in_pairs(alleles, lambda x, y: F.when((x > 0) & (y > 0), (x + y - 2).cast("tinyint")))
    e = lambda i: F.element_at("f", i)
    markers = f.select(F.col("line_no").alias("marker_id"), e(1).cast("int").alias("chrom"), e(4).cast("long").alias("pos"), e(2).alias("snp_id"), calls.alias("calls"))
    if bim:
        b = numbered_lines(spark, f"{prefix}.bim").withColumn("f", fields("blanks"))
        b = b.select(F.col("line_no").alias("marker_id"), e(2).alias("snp_id"), e(5).alias("a0"), e(6).alias("a1"))
        markers = markers.drop("snp_id").join(b, "marker_id", "left")
    panel = Panel(markers, ids, "diploid_int")
    if impute == "simple":
        panel = impute_rounded_mean(panel)
    elif impute == "mode":
        panel = impute_mode(panel)
    return panel, people


def read_plink12(spark: SparkSession, prefix: str, impute: str | None = "mode", drop_monomorphic: bool = True, missing_threshold: float = 0.1) -> tuple[Panel, DataFrame]:
    """PLINK 12-coded TPED, BIM and TFAM with quality control.

    Markers with more than 2 * threshold * n missing calls, with position 0 or a
    position repeated on its chromosome, and monomorphic ones are dropped.
    """
    panel, people = read_tped(spark, prefix, None, bim=True)
    return drop_unusable(panel, missing_threshold, impute, drop_monomorphic, drop_zero_position=True), people


def _geno_fields(spark: SparkSession, prefix: str, n: int) -> DataFrame:
    """Numbered .geno lines with their calls and why a line can't be taken."""
    text = F.trim(F.regexp_replace("value", r"\r$", ""))
    digits = F.filter(F.split(text, ""), lambda x: x != "")
    calls = F.transform(digits, lambda x: F.when(x.isin("0", "1", "2"), x.cast("tinyint")))
    reason = F.when(F.length(text) == 0, "empty_line").when(F.length(text) != n, "call_count").when(~text.rlike("^[0-29]*$"), "call")
    return numbered_lines(spark, f"{prefix}.geno").select(F.col("line_no").alias("marker_id"), "value", calls.alias("calls"), reason.alias("reason"))


def rejected_geno(spark: SparkSession, prefix: str) -> DataFrame:
    """(line_no, value, reason) of the .geno lines read_eigenstrat leaves out."""
    n = numbered_lines(spark, f"{prefix}.ind").filter(F.length(F.trim("value")) > 0).count()
    return _geno_fields(spark, prefix, n).filter(F.col("reason").isNotNull()).select(F.col("marker_id").alias("line_no"), "value", "reason")


def read_eigenstrat(spark: SparkSession, prefix: str, impute: str | None = "mode", drop_monomorphic: bool = True, missing_threshold: float = 0.1) -> tuple[Panel, DataFrame]:
    """EIGENSTRAT .ind, .snp and .geno (one digit per person, 9 missing) with the same quality control.

    Lines that can't be taken are those of rejected_geno.
    """
    e = lambda i: F.element_at("f", i)
    ind = numbered_lines(spark, f"{prefix}.ind").filter(F.length(F.trim("value")) > 0).withColumn("f", fields("blanks"))
    people = ind.select(F.col("line_no").cast("int").alias("idx"), e(1).alias("indiv_id"), F.when(e(2) == "M", 1).when(e(2) == "F", 2).alias("sex"), e(3).alias("phenotype"))
    ids = [r.indiv_id for r in people.orderBy("idx").collect()]
    snp = numbered_lines(spark, f"{prefix}.snp").filter(F.length(F.trim("value")) > 0).withColumn("f", fields("blanks"))
    t = lambda i: F.try_element_at("f", F.lit(i))
    snp = snp.select(F.col("line_no").alias("marker_id"), e(1).alias("snp_id"), e(2).cast("int").alias("chrom"), e(4).cast("long").alias("pos"), t(5).alias("a0"), t(6).alias("a1"))
    geno = _geno_fields(spark, prefix, len(ids)).filter(F.col("reason").isNull()).select("marker_id", "calls")
    panel = Panel(snp.join(geno, "marker_id"), ids, "diploid_int")
    return drop_unusable(panel, missing_threshold, impute, drop_monomorphic, drop_zero_position=False), people


def read_ibs_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(i, j, k) of a text matrix of blank-separated numbers."""
    f = numbered_lines(spark, path).filter(F.length(F.trim("value")) > 0).withColumn("f", fields("blanks"))
    return f.select(F.col("line_no").cast("int").alias("i"), F.posexplode("f").alias("j", "k")).select("i", "j", F.col("k").cast("double").alias("k"))


__all__ = [n for n in globals() if n.startswith("read_") or n in ("decode_nucleotides", "guess_delimiter")]
