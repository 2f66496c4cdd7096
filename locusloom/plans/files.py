"""Queries that write files in each supported format and read them back, with SQL over the tables they were made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import kinship as K
from ..operators import ld, markers, simulate
from ..panel import Panel
from ..session import scratch_path, table
from ..sources import genotypes, sinks, tables
from .association import _matrix, r, s
from .domain import _CALLS, _PHEN, _RUN, run_results, stored_calls, stored_phenotypes
from .fixtures import A_SQL, C_SQL, E_SQL, D_SQL, genes_e, panel_a, phenotypes_c, with_sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def text(lines: DataFrame, order: list[str], path: str) -> None:
    """Column ``value`` as text files in order."""
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.mode("overwrite").text(path)


def _people(spark: SparkSession, prefix: str, lines: list[str], ending: str) -> None:
    spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, value string").coalesce(1).sortWithinPartitions("i").select("value").write.text(f"{prefix}.{ending}")


def _placed(spark: SparkSession, d: str) -> DataFrame:
    """Stored markers that a position file can hold, with snp id and calls."""
    g = table(spark, d, "genot_data").select("marker_id", "snp_id", "a0", "a1")
    return stored_calls(spark, d).join(g, "marker_id").filter("chrom is not null and pos is not null and size(calls) = 80")


_PLACED = _CALLS + ", k as (select marker_id, chrom, pos from genot_data where chrom is not null and pos is not null and len(raw_snps) = 80), x as (select g.marker_id, k.chrom, k.pos, idx, v from g join k using (marker_id))\n"
_SUMS = "chrom, pos, coalesce(sum(v), 0)::bigint as total, count(v)::int as n_typed"


def _sums(p: Panel) -> DataFrame:
    return p.markers.select("chrom", "pos", markers.total().cast("long").alias("total"), markers.n_typed().alias("n_typed"))


@query(_PLACED + f"select {_SUMS} from x group by marker_id, chrom, pos")
def tped_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Stored calls as TPED and TFAM, read back."""
    prefix = scratch_path(spark, "tped")
    pair = lambda x: F.when(x.isNull(), "0 0").when(x == 0, "1 1").when(x == 1, "1 2").otherwise("2 2")
    m = _placed(spark, d)
    line = F.concat_ws(" ", F.col("chrom").cast("string"), F.coalesce(F.nullif(F.regexp_replace("snp_id", r"\s", "_"), F.lit("")), F.lit("none")), F.lit("0"), F.col("pos").cast("string"), F.concat_ws(" ", F.transform("calls", pair)))
    text(m.select("marker_id", line.alias("value")), ["marker_id"], f"{prefix}.tped")
    _people(spark, prefix, [f"f{k} i{k} 0 0 {k % 3} {k / 10}" for k in range(80)], "tfam")
    return _sums(genotypes.read_tped(spark, prefix, None)[0])


@query("select reason, count(*) as n from (select unnest(['field_count', 'chromosome', 'position', 'allele', 'empty_line']) as reason) group by 1")
def tped_rejects(spark: SparkSession, d: str) -> DataFrame:
    """Why lines of a damaged TPED file can't be taken."""
    prefix = scratch_path(spark, "tped")
    lines = ["1 a 0 5 1 1 2 2", "1 b 0 6 1 1 2", "x c 0 7 1 1 2 2", "1 d 0 7.5 1 1 2 2", "1 e 0 8 1 1 2 3", "", "2 f 0 9 0 0 1 2"]
    _people(spark, prefix, lines, "tped")
    _people(spark, prefix, ["f a 0 0 1 1", "f b 0 0 2 1"], "tfam")
    return genotypes.rejected_tped(spark, prefix).groupBy("reason").agg(F.count("*").alias("n"))


_USABLE = ", u as (select marker_id, any_value(chrom) as chrom, any_value(pos) as pos, count(*) - count(v) as gaps, count(distinct v) as kinds from x group by 1), once as (select * from u where gaps <= 16), r as (select *, count(*) over (partition by chrom, pos) as same from once)\n"


@query(_PLACED + f"select {_SUMS} from x group by marker_id, chrom, pos")
def eigenstrat_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Stored calls as EIGENSTRAT files, read back; markers are told apart by a running position, which quality control needs."""
    prefix = scratch_path(spark, "eigenstrat")
    m = _placed(spark, d)
    text(m.select("marker_id", F.concat_ws(" ", F.concat(F.lit("m"), F.col("marker_id").cast("string"), F.lit("_"), F.col("pos").cast("string")), F.col("chrom").cast("string"), F.lit("0.0"), F.col("marker_id").cast("string"), F.lit("A"), F.lit("C")).alias("value")), ["marker_id"], f"{prefix}.snp")
    digit = lambda x: F.coalesce(x.cast("string"), F.lit("9"))
    text(m.select("marker_id", F.concat_ws("", F.transform("calls", digit)).alias("value")), ["marker_id"], f"{prefix}.geno")
    _people(spark, prefix, [f"i{k} {'MFU'[k % 3]} {k}" for k in range(80)], "ind")
    p, _ = genotypes.read_eigenstrat(spark, prefix, None, False, 1.0)
    return _sums(p.with_markers(p.markers.withColumn("pos", F.split("snp_id", "_")[1].cast("long"))))


@query(with_sql(A_SQL) + ", k as (select chrom, pos::bigint as pos, sum(g)::bigint as ones, count(*)::int as n from a group by all) select chrom, pos, (2 * ones)::bigint as total, n as n_typed from k where ones between 1 and n - 1")
def ped_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A panel as PED and MAP files, one line per individual, read back."""
    prefix = scratch_path(spark, "ped")
    e = table(spark, d, "embeddings")
    calls = F.concat_ws(" ", F.transform("embedding", lambda v: F.when(v > 0, "C C").otherwise("A A")))
    text(e.select("vec_id", F.concat_ws(" ", F.lit("f"), F.col("vec_id").cast("string"), F.lit("0 0 1"), F.col("label").cast("string"), calls).alias("value")), ["vec_id"], f"{prefix}.ped")
    _people(spark, prefix, [f"{m // 16 + 1} m{m} 0 {(m % 16 + 1) * 1000}" for m in range(64)], "map")
    return _sums(genotypes.read_ped(spark, prefix)[0])


@query(with_sql(A_SQL) + ", k as (select *, case when (vec_id + marker_id) % 11 = 0 then null else g end as v from a) select chrom, pos::bigint as pos, coalesce(sum(v), 0)::bigint as total, count(v)::int as n_typed from k group by all")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A panel with gaps as genotype CSV in several files, read back."""
    p, _ = panel_a(spark, d)
    ids = F.array(*[F.lit(int(x)) for x in p.ids])
    gaps = F.transform(F.arrays_zip(F.col("calls").alias("calls"), ids.alias("i")), lambda x: F.when((x["i"] + F.col("_id")) % 11 != 0, x["calls"]))
    p = p.with_markers(p.markers.withColumn("_id", F.col("marker_id")).withColumn("calls", gaps).drop("_id"))
    path = scratch_path(spark, "csv")
    sinks.write_genotype_csv(p, path)
    return _sums(genotypes.read_numeric(spark, path))


@query(with_sql(A_SQL) + ", k as (select chrom, pos::bigint as pos, sum(g)::bigint as ones, count(*)::int as n from a group by all) select chrom, pos, ones as total, n as n_typed from k where ones between 1 and n - 1")
def nucleotide_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A panel as nucleotide CSV with array ids, read back and recoded to 0 and 1."""
    p, _ = panel_a(spark, d)
    letters = Panel(p.markers.withColumn("calls", F.transform("calls", lambda x: F.when(x == 0, "A").otherwise("T"))), p.ids, "nucleotides")
    path = scratch_path(spark, "nucleotides")
    sinks.write_genotype_csv(letters, path, array_ids=[f"array{k}" for k in range(p.n)])
    return _sums(genotypes.read_genotypes(spark, path, "nucleotides_binary"))


@query(with_sql(A_SQL) + "select chrom, count(distinct pos) as n, max(pos)::bigint as last from a group by 1")
def loci_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Loci only, of a written genotype CSV."""
    path = scratch_path(spark, "loci")
    sinks.write_genotype_csv(panel_a(spark, d)[0], path)
    return genotypes.read_loci(spark, path).groupBy("chrom").agg(F.count("*").alias("n"), F.max("pos").alias("last"))


@query(with_sql(A_SQL) + "select chrom, pos::bigint as pos, sum(g)::bigint as total, count(*)::int as n_typed from a group by chrom, pos having least(sum(g), count(*) - sum(g)) >= 5 or chrom = 1")
def chromosome_files_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """One CSV per chromosome; the first is taken as filtered already, the others are filtered on reading."""
    p, _ = panel_a(spark, d)
    prefix = scratch_path(spark, "chromosomes") + "/"
    for c in range(1, 5):
        sinks.write_genotype_csv(p.with_markers(p.markers.filter(F.col("chrom") == c)), f"{prefix}chr_{c}_binary{'_mac5' if c == 1 else ''}.csv")
    return _sums(genotypes.read_chromosome_files(spark, prefix, [1, 2, 3, 4], "binary"))


@query(_CALLS + "select chrom, call_batch, count(*) as n_markers, coalesce(sum(total), 0)::bigint as total from (select marker_id, chrom, call_batch, sum(v) as total from g group by all) where chrom is not null group by all")
def store_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The stored calls as a partitioned store, read back."""
    path = scratch_path(spark, "store")
    m = stored_calls(spark, d).filter("chrom is not null")
    sinks.write_panel(Panel(m, [str(k) for k in range(80)], "int"), path)
    return sinks.read_panel(spark, path).markers.groupBy("chrom", "call_batch").agg(F.count("*").alias("n_markers"), F.sum(markers.total().cast("long")).alias("total"))


@query(_PHEN + f"select phen_id, count(*) as n, {s('sum(value)', 3)} as total, max(replicate) as replicates from (select *, row_number() over (partition by phen_id, indiv_id) as replicate from c where not contains(indiv_id, ',')) group by phen_id")
def phenotype_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The stored phenotypes as a long file with replicate numbers, read back."""
    path = scratch_path(spark, "phenotypes")
    p = stored_phenotypes(spark, d).filter(~F.col("indiv_id").contains(",")).withColumn("phen_name", F.lit("t"))
    sinks.write_phenotypes(p, path)
    out = spark.read.csv(path, header=True)  # every part has its header
    one = scratch_path(spark, "phenotypes")
    head = spark.createDataFrame([(0, ",".join(out.columns))], "k int, value string")
    body = out.select(F.lit(1).alias("k"), F.concat_ws(",", *[F.coalesce(c, F.lit("")) for c in out.columns]).alias("value"))
    text(head.unionByName(body), ["k", "value"], one)
    x = tables.read_phenotypes(spark, one)
    return x.groupBy("phen_id").agg(F.count("*").alias("n"), r(F.sum("value"), 3).alias("total"), F.max("replicate_id").cast("long").alias("replicates"))


@query(with_sql(C_SQL) + ", v as (select phen_id, indiv_id, avg(value) as value from c group by all) select phen_id, count(*) as n, " + s("sum(value)", 3) + " as total from v group by 1")
def wide_phenotypes(spark: SparkSession, d: str) -> DataFrame:
    """Means per individual as a wide file, read back."""
    v = phenotypes_c(spark, d).groupBy("indiv_id").pivot("phen_id", [1, 2, 3, 4, 5]).agg(F.avg("value"))
    path = scratch_path(spark, "wide")
    head = spark.createDataFrame([(0, "ecotype," + ",".join(f"{k}_trait" for k in range(1, 6)))], "k int, value string")
    body = v.select(F.lit(1).alias("k"), F.concat_ws(",", "indiv_id", *[F.coalesce(F.col(str(k)).cast("string"), F.lit("NA")) for k in range(1, 6)]).alias("value"))
    text(head.unionByName(body), ["k", "value"], path)
    return tables.read_phenotypes(spark, path).groupBy("phen_id").agg(F.count("*").alias("n"), r(F.sum("value"), 3).alias("total"))


@query(_RUN + f"select chrom, count(*) as n, {s('sum(score)', 3)} as total, count(maf) as n_maf, sum(pos)::double as pos from d where chrom is not null group by 1")
def result_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """All usable result rows as a file, read back; every part repeats its header, which is no row."""
    path = scratch_path(spark, "results")
    x = run_results(spark, d).filter("chrom is not null").withColumn("maf", F.when(~F.isnan("maf"), F.col("maf")))
    sinks.write_result(x, path)
    x = tables.read_result(spark, path).filter("chrom is not null")
    return x.groupBy("chrom").agg(F.count("*").alias("n"), r(F.sum("score"), 3).alias("total"), F.count("maf").alias("n_maf"), F.sum("pos").cast("double").alias("pos"))


@query(_RUN + ", e as (select list_sort(list(score))[least(len(list(score)) - 1, floor(len(list(score)) * 0.2)::bigint) + 1] as edge from d) select count(*) as n from d, e where score < edge")
def result_fraction(spark: SparkSession, d: str) -> DataFrame:
    """The lowest fifth of the scores, written as Parquet."""
    path = scratch_path(spark, "results")
    sinks.write_result(run_results(spark, d), path, max_fraction=0.2, fmt="parquet")
    return spark.read.parquet(path).agg(F.count("*").alias("n"))


@query(with_sql(D_SQL, E_SQL) + "select gene_id, chrom, start_pos, end_pos, 'gene' as gene_type, 1 as n_isoforms, 2 as n_exons from genes")
def gff_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Genes with one isoform of two exons as GFF, read back."""
    path = scratch_path(spark, "gff")
    col = lambda *x: F.concat_ws("\t", *[v if isinstance(v, Column) else F.lit(v) for v in x])
    g = genes_e(spark, d).withColumn("k", F.col("gene_id").cast("long"))
    seq, a, b = F.concat(F.lit("Chr"), F.col("chrom").cast("string")), F.col("start_pos").cast("string"), F.col("end_pos").cast("string")
    gene, rna = F.concat(F.lit("ID=G"), "gene_id", F.lit(";Name=G"), "gene_id"), F.concat(F.lit("ID=G"), "gene_id", F.lit(".1;Parent=G"), "gene_id")
    part = F.concat(F.lit("Parent=G"), "gene_id", F.lit(".1"))
    middle = ((F.col("start_pos") + F.col("end_pos")) / 2).cast("long").cast("string")
    rows = [col(seq, "db", "gene", a, b, ".", "+", ".", gene), col(seq, "db", "mRNA", a, b, ".", "+", ".", rna), col(seq, "db", "exon", a, middle, ".", "+", ".", part), col(seq, "db", "exon", middle, b, ".", "+", ".", part)]
    text(g.select("k", F.posexplode(F.array(*rows)).alias("line", "value")), ["k", "line"], path)
    x = tables.read_gff(spark, path)
    return x.select(F.substring("gene_id", 2, 99).alias("gene_id"), "chrom", "start_pos", "end_pos", "gene_type", F.size("isoforms").alias("n_isoforms"), F.size(F.col("isoforms")[0]["exons"]).alias("n_exons"))


@query("select s_suppkey::varchar as gene_id, s_name as name from supplier")
def candidate_genes_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Candidate genes as CSV, read back."""
    path = scratch_path(spark, "genes")
    s_ = table(spark, d, "supplier")
    text(s_.select("s_suppkey", F.concat_ws(",", F.col("s_suppkey").cast("string"), "s_name").alias("value")), ["s_suppkey"], path)
    return tables.read_candidate_genes(spark, path)


@query(with_sql(A_SQL) + f", i as (select x.vec_id as i, w.vec_id as j, avg((x.g = w.g)::int) as k from a as x join a as w using (marker_id) group by all) select i, j, {s('k')} as k from i")
def kinship_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A kinship matrix saved and loaded again."""
    p, _ = panel_a(spark, d)
    path = scratch_path(spark, "kinship")
    K.save_kinship(spark, path, K.ibs_kinship(p, scaled=False), p.ids, 64)
    return _matrix(spark, K.load_kinship(spark, path, p.ids, scaled=False)[0], p)


@query(with_sql(A_SQL) + ", p as (select x.marker_id as m, w.marker_id as n, any_value(w.pos - x.pos) as gap, count(*) filter (x.g = 0 and w.g = 0) as c0, count(*) filter (x.g = 0 and w.g = 1) as c1, count(*) filter (x.g = 1 and w.g = 0) as c2, count(*) filter (x.g = 1 and w.g = 1) as c3 from a as x join a as w on w.vec_id = x.vec_id and w.chrom = x.chrom and w.pos > x.pos and w.pos - x.pos <= 3000 group by all) select concat_ws(' ', gap, c0, c1, c2, c3) as value, count(*) as n from p group by 1")
def pair_counts_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Haplotype counts of neighbouring markers as a file, read back as lines."""
    path = scratch_path(spark, "pairs")
    sinks.write_pair_counts(ld.marker_pairs(panel_a(spark, d)[0], 3000), path)
    return spark.read.text(path).groupBy("value").agg(F.count("*").alias("n"))


@query(with_sql(A_SQL) + "select (row_number() over (order by vec_id) - 1)::varchar as idx, vec_id::varchar as indiv_id, label::varchar as country from embeddings")
def individuals_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Individuals with metadata as CSV, read back."""
    p, _ = panel_a(spark, d)
    path = scratch_path(spark, "individuals")
    meta = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("indiv_id"), F.col("label").cast("string").alias("country"))
    sinks.write_individuals(p, meta, path)
    return spark.read.csv(path, header=True)


@query("select 1000 as n_markers, 100 as least_calls, 100 as most_calls, true as binary")
def simulated_shape(spark: SparkSession, d: str) -> DataFrame:
    """Shape of simulated genotypes: markers, calls per marker, and that calls are 0 or 1."""
    m = simulate.genotypes(spark, 100, 1000).markers
    n = F.size("calls")
    ok = F.forall("calls", lambda x: x.isin(0, 1))
    return m.agg(F.count("*").cast("int").alias("n_markers"), F.min(n).alias("least_calls"), F.max(n).alias("most_calls"), F.bool_and(ok).alias("binary"))
