"""Readers of result, phenotype, annotation, candidate-gene and metadata files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lines import LEGACY_NAMES
from .text import fields, first_lines, guess_delimiter, numbered_lines

_RESULT_NAMES = {"chromosomes": "chrom", "positions": "pos", "scores": "score", "mafs": "maf", "macs": "mac"}


@dataclass(frozen=True)
class ResultKind:
    """Where the result files of one analysis lie, and whether their scores want a logarithm."""

    method: str
    directory: str
    dataset: str = ""
    extension: str = ".pvals"
    log_transform: bool | None = None

    def path(self, phen_id: int, phen_name: str, second_run: bool = False) -> str:
        middle = f"{self.dataset}_" if self.dataset else ""
        return f"{self.directory.rstrip('/')}/{self.method}_{middle}{phen_id}_{phen_name}{'.run2' if second_run else ''}{self.extension}"

    @property
    def wants_log(self) -> bool:
        return self.extension == ".pvals" if self.log_transform is None else self.log_transform

    def __str__(self) -> str:
        return f"{self.method} {self.dataset}".strip()


def read_result(spark: SparkSession, path: str, delim: str | None = None) -> DataFrame:
    """A result file of numbers: row_id, chrom, pos, score, maf, mac and its other columns.

    The delimiter is found from the header, legacy names are renamed; a value
    that is no number becomes NULL. For separation of damaged lines see
    ``sources.lines``.
    """
    head = first_lines(spark, path, 1)[0]
    d = delim or guess_delimiter(head)
    names = [LEGACY_NAMES.get(x.strip().lower(), x.strip().lower()) for x in head.split(d)]
    f = numbered_lines(spark, path).filter((F.col("line_no") > 0) & (F.length(F.trim("value")) > 0)).withColumn("f", fields(d))
    kinds = {"chromosomes": "int", "positions": "long", "macs": "long"}

    def col(i: int, name: str) -> Column:
        v = F.try_element_at("f", F.lit(i + 1)).try_cast("double")
        return (v.cast(kinds[name]) if name in kinds else v).alias(_RESULT_NAMES.get(name, name))

    return f.select((F.col("line_no") - 1).alias("row_id"), *[col(i, n) for i, n in enumerate(names)])


def read_phenotypes(spark: SparkSession, path: str, fmt: str = "guess", delim: str | None = None, with_db_ids: bool = True) -> DataFrame:
    """Long phenotypes: phen_id, phen_name, indiv_id, replicate_id, value, raw_value, transformation.

    fmt: ``wide`` (id, then one column per trait named number_name; NA dropped),
    ``long`` (phenotype_id, phenotype_name, ecotype_id, value, replicate_id) or
    ``guess``.
    """
    head = first_lines(spark, path, 1)[0]
    d = delim or guess_delimiter(head)
    names = [x.strip() for x in head.split(d)]
    if fmt == "guess":
        fmt = "long" if {"phenotype_id", "replicate_id"} & set(names) else "wide"
    f = numbered_lines(spark, path).filter((F.col("line_no") > 0) & (F.length(F.trim("value")) > 0)).withColumn("f", fields(d))
    e = lambda i: F.try_element_at("f", F.lit(i))
    if fmt == "long":
        out = f.select(
            e(1).cast("int").alias("phen_id"), e(2).alias("phen_name"), e(3).alias("indiv_id"), e(5).try_cast("int").alias("replicate_id"), e(4).try_cast("double").alias("value"),
        )
    else:
        traits = names[1:]
        ids = [int(t.split("_")[0]) for t in traits] if with_db_ids else list(range(1, len(traits) + 1))
        cells = F.array(*[F.struct(F.lit(p).alias("phen_id"), F.lit(t).alias("phen_name"), e(i + 2).alias("v")) for i, (p, t) in enumerate(zip(ids, traits))])
        out = f.select(e(1).alias("indiv_id"), F.explode(cells).alias("c")).select("c.phen_id", "c.phen_name", "indiv_id", F.lit(None).cast("int").alias("replicate_id"), F.col("c.v").try_cast("double").alias("value"))
    out = out.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    return out.withColumn("raw_value", F.col("value")).withColumn("transformation", F.lit(None).cast("string"))


def read_candidate_genes(spark: SparkSession, path: str) -> DataFrame:
    """(gene_id, name) of a CSV; ids in upper case."""
    f = numbered_lines(spark, path).filter(F.length(F.trim("value")) > 0).withColumn("f", fields(","))
    return f.select(F.upper(F.element_at("f", 1)).alias("gene_id"), F.try_element_at("f", F.lit(2)).alias("name"))


def read_id_metadata(spark: SparkSession, path: str, key: str = "nativename") -> DataFrame:
    """A tab-separated table with the lower-cased key as ``lookup``."""
    df = spark.read.csv(path, sep="\t", header=True)
    return df.withColumn("lookup", F.lower(F.trim(F.col(key))))


_GENES = ("gene", "transposable_element_gene", "pseudogene", "transposable_element")
_RNAS = ("mRNA", "tRNA", "rRNA", "miRNA", "ncRNA", "snoRNA", "snRNA", "pseudogenic_transcript")


def rejected_gff(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value, reason) of the lines read_gff leaves out; comments aren't among them."""
    f = numbered_lines(spark, path).filter(~F.col("value").startswith("#")).withColumn("f", F.split("value", r"\s+", 9))
    e = lambda i: F.try_element_at("f", F.lit(i)).try_cast("long")
    reason = F.when(F.length(F.trim("value")) == 0, "empty_line").when(F.size("f") != 9, "field_count").when(e(4).isNull() | e(5).isNull(), "position")
    return f.select("line_no", "value", reason.alias("reason")).filter(F.col("reason").isNotNull())


def read_gff(spark: SparkSession, path: str, descriptions: str | None = None, chrom: int | None = None, start: int | None = None, end: int | None = None, only_genes: bool = False) -> DataFrame:
    """Gene models: one row per gene with isoforms, their exons, coding parts, UTRs and protein, and transposon fragments.

    A region keeps the genes that overlap it. Descriptions join by isoform. Lines
    that can't be taken are those of rejected_gff.
    """
    f = numbered_lines(spark, path).filter(~F.col("value").startswith("#")).withColumn("f", F.split("value", r"\s+", 9)).filter(F.size("f") == 9)
    f = f.filter(F.element_at("f", 4).try_cast("long").isNotNull() & F.element_at("f", 5).try_cast("long").isNotNull())
    e = lambda i: F.element_at("f", i)
    attribute = lambda name: F.nullif(F.regexp_extract(F.element_at("f", 9), rf"(?:^|;)\s*{name}=([^;]*)", 1), F.lit(""))
    a = f.select(
        e(1).alias("seqid"), F.regexp_extract(e(1), r"(\d+)$", 1).try_cast("int").alias("chrom"), e(3).alias("type"), e(4).cast("long").alias("start_pos"), e(5).cast("long").alias("end_pos"),
        e(7).alias("strand"), e(8).try_cast("int").alias("frame"), F.trim(attribute("ID")).alias("id"), attribute("Note").alias("note"), attribute("Name").alias("name"),
        attribute("Parent").alias("parent"), attribute("Alias").alias("alias"), attribute("Derives_from").alias("derives"),
    )
    if chrom is not None:
        a = a.filter(F.col("chrom") == chrom)
    genes = a.filter(F.col("type").isin(*_GENES)).select(F.col("id").alias("gene_id"), F.col("type").alias("gene_type"), "name", "note", "alias", "strand", "chrom", "start_pos", "end_pos")
    if only_genes:
        genes = genes.filter("gene_type = 'gene'")
    if start is not None and end is not None:
        genes = genes.filter((F.col("start_pos") <= end) & (F.col("end_pos") >= start))
    gene_of = lambda c: F.regexp_extract(c, r"^([^.]+)", 1)
    rna = a.filter(F.col("type").isin(*_RNAS)).select(F.col("id").alias("isoform_id"), F.col("type").alias("rna_type"), F.col("name").alias("isoform_name"), F.col("start_pos").alias("iso_start"), F.col("end_pos").alias("iso_end"))
    owner = F.trim(F.split(F.coalesce("parent", "derives", "name"), ",").getItem(0))
    span = F.struct(F.col("start_pos").alias("s"), F.col("end_pos").alias("e"))
    of = lambda *types: F.col("type").isin(*types)
    parts = a.filter(of("exon", "pseudogenic_exon", "CDS", "five_prime_UTR", "three_prime_UTR", "protein")).groupBy(owner.alias("isoform_id")).agg(
        F.sort_array(F.collect_list(F.when(of("exon", "pseudogenic_exon"), span))).alias("exons"),
        F.sort_array(F.collect_list(F.when(of("CDS"), F.struct(F.col("start_pos").alias("s"), F.col("end_pos").alias("e"), F.col("frame").alias("frame"))))).alias("cds"),
        F.min(F.when(of("five_prime_UTR"), span)).alias("utr5"), F.min(F.when(of("three_prime_UTR"), span)).alias("utr3"), F.min(F.when(of("protein"), span)).alias("protein"),
    )
    iso = rna.join(parts, "isoform_id", "left")
    if descriptions:
        d = numbered_lines(spark, descriptions).filter("line_no > 0").withColumn("f", fields("\t"))
        t = lambda i: F.try_element_at("f", F.lit(i))
        d = d.select(t(1).alias("isoform_id"), t(2).alias("desc_type"), t(3).alias("short_description"), t(4).alias("curator_summary"), t(5).alias("computational_description"))
        iso = iso.join(d, "isoform_id", "left")
    iso_cols = [c for c in iso.columns]
    iso = iso.groupBy(gene_of("isoform_id").alias("gene_id")).agg(F.sort_array(F.collect_list(F.struct(*iso_cols))).alias("isoforms"))
    fragments = a.filter("type = 'transposon_fragment'").groupBy(owner.alias("gene_id")).agg(F.sort_array(F.collect_list(span)).alias("fragments"))
    return genes.join(iso, "gene_id", "left").join(fragments, "gene_id", "left")
