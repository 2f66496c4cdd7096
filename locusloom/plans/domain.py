"""Association operators over the project's own tables: stored calls, phenotype files and results of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import markers, ranking, regions, traits
from ..operators.fill import fill_calls
from ..operators.references import clean_key
from ..panel import Panel
from ..session import table
from .association import r, rounded, s
from .preparation import _P2_CTES, _key_sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def stored_calls(spark: SparkSession, d: str) -> DataFrame:
    """marker_id, call_batch, chrom, pos, data_format, calls with every kind of missing call as NULL."""
    g = table(spark, d, "genot_data").filter(F.col("raw_snps").isNotNull())
    top = F.when(F.col("data_format") == "diploid_int", 2).otherwise(1)
    calls = markers.beside("raw_snps", top, lambda x, t: F.when((x >= 0) & (x <= t), x))
    return g.select("marker_id", "call_batch", "chrom", "pos", "data_format", calls.alias("calls"))


_CALLS = """with e as (
  select marker_id, call_batch, chrom, data_format, unnest(raw_snps) as v, generate_subscripts(raw_snps, 1) - 1 as idx from genot_data where raw_snps is not null
), g as (select * replace (case when v in (0, 1) or v = 2 and data_format = 'diploid_int' then v end as v) from e),
st as (select marker_id, call_batch, chrom, data_format, count(v) as n_typed, count(*) - count(v) as n_missing,
  case when data_format = 'diploid_int' then least(count(*) filter (v = 0), count(*) filter (v = 2)) + count(*) filter (v = 1) / 2 else least(count(*) filter (v = 0), count(*) filter (v = 1)) end as mac
  from g group by marker_id, call_batch, chrom, data_format)
"""


def _stats(df: DataFrame) -> DataFrame:
    m = F.when(F.col("data_format") == "diploid_int", markers.mac("diploid_int")).otherwise(markers.mac("binary"))
    return df.select("marker_id", "call_batch", "chrom", "data_format", markers.n_typed().alias("n_typed"), markers.n_missing().alias("n_missing"), m.alias("mac"))


@query(_CALLS + f"select marker_id, n_typed::int as n_typed, n_missing::int as n_missing, mac::double as mac, {s('mac / nullif(n_typed, 0)')} as maf from st")
def stored_marker_stats(spark: SparkSession, d: str) -> DataFrame:
    """Typed and missing calls, minor count and frequency of the stored markers."""
    x = _stats(stored_calls(spark, d))
    return x.select("marker_id", "n_typed", "n_missing", "mac", r(F.try_divide("mac", "n_typed")).alias("maf"))


@query(_CALLS + "select call_batch, chrom, count(*) as n_markers, count(*) filter (n_missing <= 8 and mac >= 4) as n_kept from st group by all")
def stored_quality(spark: SparkSession, d: str) -> DataFrame:
    """Markers per batch and chromosome, and those that pass missingness and minor count."""
    x = _stats(stored_calls(spark, d))
    return x.groupBy("call_batch", "chrom").agg(F.count("*").alias("n_markers"), F.count_if((F.col("n_missing") <= 8) & (F.col("mac") >= 4)).alias("n_kept"))


@query(_CALLS + f"select call_batch, idx::int as idx, count(*) as n_markers, count(*) - count(v) as n_missing, {s('1 - count(v) / count(*)')} as missing_rate from g group by all")
def stored_chip_missing(spark: SparkSession, d: str) -> DataFrame:
    """Missing calls per chip of a batch."""
    x = stored_calls(spark, d).select("call_batch", F.posexplode("calls").alias("idx", "v"))
    x = x.groupBy("call_batch", "idx").agg(F.count("*").alias("n_markers"), F.count_if(F.col("v").isNull()).alias("n_missing"))
    return x.withColumn("missing_rate", r(F.col("n_missing") / F.col("n_markers")))


@query(_P2_CTES + f" select marker_id, {s('avg(v)')} as mean, (count(*) - count(v))::int as n_missing from calls group by 1")
def stored_filled_frequencies(spark: SparkSession, d: str) -> DataFrame:
    """Frequency of the second allele per marker after filling."""
    f = fill_calls(table(spark, d, "genot_data"))
    return f.select("marker_id", r(markers.mean_call()).alias("mean"), markers.n_missing().alias("n_missing"))


_PHEN = f"""with p as (select phenotype_id as phen_id, {_key_sql('ecotype_id')} as indiv_id, phen_value as value from phenotypes where phen_value is not null and not isnan(phen_value)),
c as (select * from p where indiv_id is not null)
"""


def stored_phenotypes(spark: SparkSession, d: str) -> DataFrame:
    """The phenotype table in the library's columns, ids in comparable form, without missing values."""
    p = table(spark, d, "phenotypes")
    out = p.select(
        F.col("phenotype_id").alias("phen_id"), F.col("phenotype_name").alias("phen_name"), clean_key("ecotype_id").alias("indiv_id"), "replicate_id",
        F.col("phen_value").alias("value"), F.col("phen_value").alias("raw_value"), "transformation",
    )
    return out.filter(F.col("indiv_id").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value"))


@query(_PHEN + f"select phen_id, indiv_id, {s('avg(value)')} as value, count(*) as n_replicates from c group by all")
def stored_averages(spark: SparkSession, d: str) -> DataFrame:
    """Means per trait and line, whatever the spelling of the line's id."""
    return rounded(traits.averages(stored_phenotypes(spark, d)), "value")


@query(_PHEN + f""", i as (select phen_id, indiv_id, count(*) as n, sum(value) as t, sum(value * value) as q from c group by all),
  h as (select phen_id, sum(n)::bigint as n, count(*) as k, (sum(t * t / n) - sum(t) ^ 2 / sum(n)) / nullif(sum(q) - sum(t) ^ 2 / sum(n), 0) as h2 from i group by all)
select phen_id, n as n_values, k as n_individuals, {s('h2', 4)} as h2 from h""")
def stored_heritability(spark: SparkSession, d: str) -> DataFrame:
    """Broad-sense heritability of the stored traits."""
    h = traits.broad_sense_heritability(stored_phenotypes(spark, d))
    return rounded(h.select("phen_id", "n_values", "n_individuals", "h2"), "h2", digits=4)


_RUN = """with d as (select result_id as row_id, run_id, chrom, pos, score, maf, mac from results where score is not null and not isnan(score) and pos is not null)
"""


def run_results(spark: SparkSession, d: str) -> DataFrame:
    """Usable rows of the result table with row_id."""
    x = table(spark, d, "results")
    x = x.filter(F.col("score").isNotNull() & ~F.isnan("score") & F.col("pos").isNotNull())
    return x.select(F.col("result_id").alias("row_id"), "run_id", "chrom", "pos", "score", "maf", "mac")


@query(_RUN + """, h as (select * from d where score >= 3), n as (select *, case when pos - lag(pos) over c > 50000 or lag(pos) over c is null then 1 else 0 end as new from h window c as (partition by chrom order by pos, row_id)),
  i as (select *, sum(new) over (partition by chrom order by pos, row_id) as island from n)
select chrom, min(pos) - 50000 as start_pos, max(pos) + 50000 as end_pos, count(*) as n_hits from i group by chrom, island""")
def run_regions(spark: SparkSession, d: str) -> DataFrame:
    """Regions of all runs' hits above 3."""
    return regions.regions(run_results(spark, d).filter("score >= 3"), 50_000)


@query(_RUN + "select row_id, row_number() over (order by score desc, row_id) as rank from d")
def run_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Ranks of all usable rows."""
    return ranking.ranks(run_results(spark, d), ascending=False).select("row_id", "rank")


@query(_RUN + "select run_id, chrom, count(*) as n_scores, min(score) as min_score, max(score) as max_score, max(pos) as end_pos from d group by all")
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    """Extent of every run and chromosome."""
    x = run_results(spark, d)
    return x.groupBy("run_id", "chrom").agg(F.count("*").alias("n_scores"), F.min("score").alias("min_score"), F.max("score").alias("max_score"), F.max("pos").alias("end_pos"))


@query(_RUN + ", a as (select distinct chrom, pos from d where score >= 3), b as (select chrom, pos from chrom_results where ps between 0 and 0.001) select count(*) as n_nearby from a where exists (select 1 from b where b.chrom = a.chrom and abs(b.pos - a.pos) <= 20000)")
def scan_replication(spark: SparkSession, d: str) -> DataFrame:
    """Hits of the result table with a small p-value of a chromosome scan within 20 kb."""
    hits = run_results(spark, d).filter("score >= 3")
    small = table(spark, d, "chrom_results").filter("ps between 0 and 0.001")
    return regions.count_nearby(small, hits, 20_000)


@query(_CALLS + f""", x as (select marker_id, count(distinct v) as n_alleles, avg(v) as mean from g group by 1), p as (select marker_id, any_value(pos) as pos from genot_data group by 1)
select marker_id, chrom, pos, call_batch, data_format, n_typed::int as n_typed, n_missing::int as n_missing, {s('n_missing / (n_typed + n_missing)')} as missing_rate, n_alleles::int as n_alleles, {s('mean')} as mean, mac::double as mac, {s('mac / nullif(n_typed, 0)')} as maf
from st join x using (marker_id) join p using (marker_id)""")
def stored_panel(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of every stored marker with calls, those of each batch and format as a panel."""
    x = stored_calls(spark, d)
    diploid = F.col("data_format").eqNullSafe("diploid_int")
    ids = [str(k) for k in range(80)]
    # batches of a format differ in their individuals only, on which these statistics don't depend, so one pass serves them all
    one = lambda rows, f: markers.marker_stats(Panel(rows, ids, f), "call_batch", "data_format")
    out = one(x.filter(diploid), "diploid_int").unionByName(one(x.filter(~diploid), "binary"))
    return rounded(out.withColumn("mac", F.col("mac").cast("double")), "missing_rate", "mean", "maf")
