"""Queries of the smaller operators over the derived panels and the stored tables, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import kinship as K
from ..operators import ld, markers, panels, ranking, regions, scan, sparse, stepwise, traits
from ..panel import Panel
from ..session import table
from . import frames
from .association import _LM, _P, _matrix, r, rounded, s
from .domain import _CALLS, stored_calls
from .fixtures import A_SQL, B_SQL, C_SQL, D_SQL, E_SQL, loci_e, panel_a, panel_b, phenotypes_c, results_d, sparse_b, with_sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


# ------------------------------------------------------------------- traits

_SHIFT = "st as (select phen_id, min(value) as lo, max(value) as hi, stddev_pop(value) as sd from c group by 1)"


@query(with_sql(C_SQL.replace("value from events", "value / 1000 as value from events"), _SHIFT) + f"select phen_id, indiv_id, {s('exp(value - lo + 0.1 * sd)')} as value from c join st using (phen_id)")
def exp_transform(spark: SparkSession, d: str) -> DataFrame:
    p = phenotypes_c(spark, d).withColumn("value", F.col("value") / 1000)
    return rounded(traits.transform(p, "exp").select("phen_id", "indiv_id", "value"), "value")


@query(with_sql(C_SQL, _SHIFT) + f"select phen_id, indiv_id, {s('asin(sqrt((value - lo) / (hi - lo)))')} as value, 'arcsin_sqrt' as transformation from c join st using (phen_id)")
def arcsin_transform(spark: SparkSession, d: str) -> DataFrame:
    """Arcsine of the root of values brought to 0..1."""
    p = phenotypes_c(spark, d)
    ends = p.groupBy("phen_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    unit = p.join(ends, "phen_id").withColumn("value", (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))).drop("lo", "hi")
    return rounded(traits.transform(unit, "arcsin_sqrt").select("phen_id", "indiv_id", "value", "transformation"), "value")


@query(with_sql(C_SQL) + f"select phen_id, indiv_id, {s('value')} as value from c")
def reverted_traits(spark: SparkSession, d: str) -> DataFrame:
    """Raw values again after a transformation."""
    return rounded(traits.revert(traits.transform(phenotypes_c(spark, d), "log")).select("phen_id", "indiv_id", "value"), "value")


@query(with_sql(C_SQL) + f"select phen_id, indiv_id, 1 as replicate_id, {s('avg(value)')} as value, {s('avg(value)')} as raw_value from c group by all")
def averaged_traits(spark: SparkSession, d: str) -> DataFrame:
    """Replicates replaced by their means."""
    return rounded(traits.to_averages(phenotypes_c(spark, d)).select("phen_id", "indiv_id", "replicate_id", "value", "raw_value"), "value", "raw_value")


@query(with_sql(C_SQL) + "select phen_id, indiv_id, string_agg(value::varchar, ';' order by value) as listed, count(*) as n_replicates from (select phen_id, indiv_id, round(value * 100)::bigint as value from c) group by all")
def trait_value_lists(spark: SparkSession, d: str) -> DataFrame:
    """All values of every individual in order, in hundredths."""
    p = phenotypes_c(spark, d).withColumn("value", F.round(F.col("value") * 100).cast("long"))
    return traits.value_lists(p).select("phen_id", "indiv_id", F.array_join(F.col("values").cast("array<string>"), ";").alias("listed"), "n_replicates")


@query(with_sql(C_SQL) + ", q as (select phen_id, quantile_disc(value, 0.25) as a, quantile_disc(value, 0.75) as b from c group by 1) select phen_id, count(*) as n from c join q using (phen_id) where value between a - 0.4 * (b - a) and b + 0.4 * (b - a) group by 1")
def trait_outliers(spark: SparkSession, d: str) -> DataFrame:
    """Values left per trait within 0.4 interquartile ranges of the quartiles."""
    return traits.drop_outliers(phenotypes_c(spark, d), 0.4).groupBy("phen_id").agg(F.count("*").alias("n"))


@query(with_sql(C_SQL) + "select phen_id, count(*) as n from c group by 1 having count(*) >= (select avg(n) from (select count(*) as n from c group by phen_id))")
def traits_with_values(spark: SparkSession, d: str) -> DataFrame:
    """Traits of more than average size."""
    p = phenotypes_c(spark, d)
    mean = p.count() / p.select("phen_id").distinct().count()
    return traits.keep_traits_with_values(p, mean).groupBy("phen_id").agg(F.count("*").alias("n"))


@query(with_sql(C_SQL) + "select phen_id, indiv_id, count(*) as n from c where phen_id in (2, 3) and indiv_id::bigint % 3 = 0 group by all")
def trait_subset(spark: SparkSession, d: str) -> DataFrame:
    """Two traits of listed individuals."""
    p = traits.keep_traits(phenotypes_c(spark, d), [2, 3])
    ids = p.select("indiv_id").distinct().filter(F.col("indiv_id").cast("long") % 3 == 0)
    return traits.keep_trait_individuals(p, ids).groupBy("phen_id", "indiv_id").agg(F.count("*").alias("n"))


@query(with_sql(C_SQL) + """, i as (select indiv_id, dense_rank() over (order by indiv_id) - 1 as col, row_number() over (order by indiv_id, value) - 1 as row from c where phen_id = 3)
select row::int as row, indiv_id, col::int as col from i""")
def trait_incidence(spark: SparkSession, d: str) -> DataFrame:
    """Which individual each value of one trait belongs to."""
    return traits.incidence(phenotypes_c(spark, d), 3).select(F.col("row").cast("int").alias("row"), "indiv_id", "col")


@query(with_sql(C_SQL) + """, v as (select phen_id, indiv_id, avg(value) as value from c group by all), w as (select *, max(value) over (partition by phen_id) - min(value) over (partition by phen_id) as width, min(value) over (partition by phen_id) as lo, stddev_pop(value) over (partition by phen_id) as sd, count(*) over (partition by phen_id) as n from v),
  f as (select phen_id, any_value(n) as n, max(k) as fullest from (select phen_id, floor(50 * (value - lo) / sd + 0.1 + 0.5) as bin, count(*) as k, any_value(n) as n from w group by all) group by all)
select phen_id, n from f where not fullest > n - 15""")
def varied_traits(spark: SparkSession, d: str) -> DataFrame:
    """Traits whose means aren't nearly constant."""
    return traits.drop_near_constant(traits.to_averages(phenotypes_c(spark, d))).groupBy("phen_id").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ markers


@query(with_sql(A_SQL) + f", h as (select vec_id, g as h from a where marker_id = 5), k as (select marker_id, any_value(chrom) as chrom, any_value(pos)::bigint as pos, corr(g, h) ^ 2 as r2 from a join h using (vec_id) group by 1) select marker_id, chrom, pos, {s('r2')} as r2 from k where r2 > 0.001")
def correlated_markers(spark: SparkSession, d: str) -> DataFrame:
    """Markers correlated with one given marker."""
    p, _ = panel_a(spark, d)
    return rounded(ld.top_correlated(p, p.markers.filter("marker_id = 5").first().calls, 0.001), "r2")


@query(with_sql(A_SQL) + ", m as (select distinct marker_id, chrom, pos from a), l as (select chrom, max(pos) as last from m group by 1) select x.marker_id as id1, y.marker_id as id2 from m as x join m as y on y.chrom = x.chrom and y.pos > x.pos and y.pos - x.pos <= 4000 join l on l.chrom = x.chrom where last - x.pos >= 4000")
def unbiased_marker_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs within 4 kb that a chromosome's end doesn't cut."""
    p, _ = panel_a(spark, d)
    return ld.unbiased_pairs(p, ld.marker_pairs(p, 4000), 4000).select("id1", "id2")


@query(with_sql(A_SQL) + f", c as (select marker_id, sum(g) as k, count(*) as n from a group by 1) select {s('avg((k = 1 or n - k = 1)::int)')} as singletons from c")
def singleton_share(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ld.singleton_share(panel_a(spark, d)[0]), "singletons")


@query(with_sql(A_SQL) + "select distinct marker_id, chrom, (pos * 0.5)::bigint as pos from a")
def scaled_positions(spark: SparkSession, d: str) -> DataFrame:
    return markers.scale_positions(panel_a(spark, d)[0], 0.5).markers.select("marker_id", "chrom", "pos")


def _with_loci(spark: SparkSession, p: Panel) -> DataFrame:
    return p.markers.filter("marker_id % 3 = 0").select("chrom", "pos")


@query(with_sql(A_SQL) + ", m as (select distinct marker_id from a) select 'kept' as part, marker_id from m where marker_id % 3 = 0 union all select 'dropped', marker_id from m where marker_id % 3 <> 0 union all select 'ids', marker_id from m where marker_id > 20 union all select 'locus', 17")
def marker_choices(spark: SparkSession, d: str) -> DataFrame:
    """Markers by list of loci, without a list, by ids, and at one locus."""
    p, _ = panel_a(spark, d)
    loci = _with_loci(spark, p)
    parts = [("kept", markers.keep_markers(p, loci)), ("dropped", markers.drop_markers(p, loci)), ("ids", markers.keep_marker_ids(p, p.markers.filter("marker_id > 20").select("marker_id"))), ("locus", markers.at_locus(p, 2, 2000))]
    out = None
    for name, x in parts:
        one = x.markers.select(F.lit(name).alias("part"), "marker_id")
        out = one if out is None else out.unionByName(one)
    return out


_PEOPLE = (
    A_SQL,
    "people as (select vec_id, row_number() over (order by vec_id) - 1 as idx from embeddings), k as (select a.*, idx from a join people using (vec_id))",
)


@query(with_sql(*_PEOPLE) + "select 'kept' as part, marker_id, sum(g)::bigint as total, count(*)::int as n from k where vec_id % 4 = 1 group by all union all select 'dropped', marker_id, sum(g)::bigint, count(*)::int from k where vec_id % 4 <> 1 group by all union all select 'picked', marker_id, sum(g)::bigint, count(*)::int from k where idx < 20 group by all")
def individual_choices(spark: SparkSession, d: str) -> DataFrame:
    """Call sums over individuals kept, dropped and picked by place."""
    p, _ = panel_a(spark, d)
    some = [x for x in p.ids if int(x) % 4 == 1]
    out = None
    for name, x in (("kept", markers.keep_individuals(p, some)), ("dropped", markers.drop_individuals(p, some)), ("picked", markers.pick_individuals(p, list(range(20))))):
        one = x.markers.select(F.lit(name).alias("part"), "marker_id", markers.total().cast("long").alias("total"), F.size("calls").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query(with_sql(B_SQL) + ", n as (select idx, 1 - count(g) / count(*) as rate from bm group by 1) select idx::varchar as indiv_id from n where rate <= (select avg(rate) from n)")
def individuals_typed(spark: SparkSession, d: str) -> DataFrame:
    """Individuals with at most the mean missing rate."""
    p, _ = sparse_b(spark, d, gaps=True)
    mean = sparse.individual_missing(p).agg(F.avg("missing_rate")).first()[0]
    return sparse.filter_individuals_by_missing(p, mean).individuals().select("indiv_id")


@query("select s_suppkey::varchar as indiv_id from supplier where s_nationkey in (3, 7)")
def individuals_by_country(spark: SparkSession, d: str) -> DataFrame:
    """Individuals of two countries, by their metadata."""
    p, _ = panel_b(spark, d)
    meta = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("indiv_id"), F.col("s_nationkey").cast("string").alias("country"))
    return markers.keep_countries(p, meta, ["3", "7"]).individuals().select("indiv_id")


_LETTERS = _CALLS + """, x as (select g.*, upper(a0) as a0, upper(a1) as a1 from g join (select marker_id, a0, a1 from genot_data where data_format is distinct from 'diploid_int' and regexp_full_match(upper(a0), '[ACGT]') and regexp_full_match(upper(a1), '[ACGT]') and upper(a0) <> upper(a1)) using (marker_id)),
l as (select *, case v when 0 then a0 when 1 then a1 end as letter from x),
o as (select marker_id, count(distinct letter) as k, min(letter) as first from l group by 1)
"""


def nucleotides(spark: SparkSession, d: str) -> Panel:
    """The stored binary markers with their alleles as letters."""
    al = table(spark, d, "genot_data").select("marker_id", F.upper("a0").alias("a0"), F.upper("a1").alias("a1"))
    al = al.filter(F.col("a0").rlike("^[ACGT]$") & F.col("a1").rlike("^[ACGT]$") & (F.col("a0") != F.col("a1")))
    m = stored_calls(spark, d).filter(~F.col("data_format").eqNullSafe("diploid_int")).join(al, "marker_id")
    letters = markers.beside("calls", F.struct("a0", "a1"), lambda x, a: F.when(x == 0, a["a0"]).when(x == 1, a["a1"]))
    return Panel(m.select("marker_id", "chrom", "pos", letters.alias("calls")), [str(k) for k in range(80)], "nucleotides")


@query(_LETTERS + "select marker_id, sum((letter <> first)::int)::bigint as ones, count(letter)::int as n_typed from l join o using (marker_id) where k = 2 group by 1")
def recoded_markers(spark: SparkSession, d: str) -> DataFrame:
    """Letters recoded to 0 and 1, markers with two alleles only."""
    b = markers.to_binary(nucleotides(spark, d))
    return b.markers.select("marker_id", markers.total().cast("long").alias("ones"), markers.n_typed().alias("n_typed"))


@query(_LETTERS + "select marker_id, count(letter)::int as n_typed from l group by 1 having count(*) - count(letter) <= 8")
def unambiguous_markers(spark: SparkSession, d: str) -> DataFrame:
    """Markers with at most eight gaps once ambiguous codes are masked."""
    p = markers.mask_ambiguous(nucleotides(spark, d), 8)
    return p.markers.select("marker_id", markers.n_typed().alias("n_typed"))


@query(with_sql(A_SQL) + ", q as (select *, (vec_id * 7 + marker_id * 13) % 100 / 100.0 as prob from a) select marker_id, count(*) filter (prob >= 0.25)::int as n_typed, (sum(g) filter (prob >= 0.25))::bigint as total from q group by 1")
def masked_calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls left where their probability is high enough."""
    p, _ = panel_a(spark, d)
    ids = F.array(*[F.lit(int(x)) for x in p.ids])
    probs = markers.beside(ids, F.col("marker_id"), lambda x, m: (x * 7 + m * 13) % 100 / 100.0)
    out = markers.mask_low_probability(p.with_markers(p.markers.withColumn("probs", probs)), 0.25)
    return out.markers.select("marker_id", markers.n_typed().alias("n_typed"), markers.total().cast("long").alias("total"))


@query(with_sql(A_SQL) + ", t as (select marker_id, chrom, pos::bigint as pos, sum(g)::bigint as total from a group by all) select chrom, pos, total, count(*) as n from (select * from t union all select * from t where marker_id < 10) group by all")
def united_panels(spark: SparkSession, d: str) -> DataFrame:
    """Two panels of the same individuals one after the other."""
    p, _ = panel_a(spark, d)
    u = panels.union_panels([p, p.with_markers(p.markers.filter("marker_id < 10"))])
    return u.markers.select("chrom", "pos", markers.total().cast("long").alias("total")).groupBy("chrom", "pos", "total").agg(F.count("*").alias("n"))


@query(with_sql(*_PEOPLE) + ", n as (select count(*) as n from embeddings) select marker_id, (case when part = 1 then n - 30 else 30 end)::int as n_typed, any_value(n)::int as n from (select marker_id, unnest([1, 2]) as part from (select distinct marker_id from a)), n group by marker_id, part, n.n")
def extended_panel(spark: SparkSession, d: str) -> DataFrame:
    """A panel of the first 30 individuals appended to one of the others, over the union of both."""
    p, _ = panel_a(spark, d)
    x = panels.extend_panel(markers.pick_individuals(p, list(range(30, p.n))), markers.pick_individuals(p, list(range(30))))
    return x.markers.select("marker_id", markers.n_typed().alias("n_typed"), F.size("calls").alias("n"))


@query(with_sql(A_SQL) + f", m as (select chrom, pos::bigint as pos, least(sum(g), count(*) - sum(g))::double as mac, count(*) as n from a group by marker_id, chrom, pos) select chrom, pos, mac, {s('mac / n')} as maf from m")
def results_with_frequencies(spark: SparkSession, d: str) -> DataFrame:
    """Frequencies of the markers brought to result rows."""
    p, _ = panel_a(spark, d)
    rows = p.markers.select(F.col("marker_id").alias("row_id"), "chrom", "pos", F.lit(1.0).alias("score"))
    return rounded(panels.attach_stats(rows, markers.marker_stats(p)).select("chrom", "pos", "mac", "maf"), "maf")


@query(with_sql(A_SQL) + ", a2 as (select vec_id, m as marker_id, (embedding[m + 1] > 0.02)::int as h from embeddings, (select unnest(range(64)) as m)) select marker_id from a join a2 using (vec_id, marker_id) group by 1 having sum((g <> h)::int) <= (select count(*) * 0.06 from embeddings)")
def agreeing_markers(spark: SparkSession, d: str) -> DataFrame:
    """Markers that differ from another coding in at most six of a hundred individuals."""
    p, _ = panel_a(spark, d)
    return panels.filter_bad_markers(p, panel_a(spark, d, 0.02)[0], int(p.n * 0.06)).markers.select("marker_id")


# ------------------------------------------------------------------ results


@query(with_sql(D_SQL, E_SQL) + ", k as (select chrom as locus_chrom, pos as locus_pos from loci) select locus_chrom, locus_pos, sum(abs(chrom - locus_chrom))::bigint as chrom_distance, sum(abs(pos - locus_pos))::bigint as pos_distance, count(*) as n from d, k group by all")
def summed_distances(spark: SparkSession, d: str) -> DataFrame:
    """Distances of all results to every locus, summed per locus."""
    return regions.summed_distances(results_d(spark, d), loci_e(spark, d))


@query(with_sql(D_SQL) + f"select (select row_id from d order by score desc, row_id limit 1) as best, (select row_id from d order by score, row_id limit 1) as least, count(*) as n_scores, {s('min(score)')} as min_score, {s('max(score)')} as max_score, (select sum(e) from (select max(pos) as e from d group by chrom))::bigint as genome_length from d")
def result_extremes(spark: SparkSession, d: str) -> DataFrame:
    """Best and least row, number and range of scores, length of the genome."""
    x = results_d(spark, d)
    best, least = (ranking.extreme(x, "score", k).select(F.col("row_id").alias(n)) for k, n in ((True, "best"), (False, "least")))
    out = best.crossJoin(least).crossJoin(ranking.summary(x)).crossJoin(ranking.genome_length(x))  # one row each
    return rounded(out, "min_score", "max_score")


@query(with_sql(D_SQL) + f""", k as (select score as x, row_number() over (order by score) as k, count(*) over () as n from d)
select {s("max(greatest(k / n - least(1, greatest(0, x)), least(1, greatest(0, x)) - (k - 1) / n))")} as d, {s("0.5 - max(case when k = n // 2 + 1 then x end)")} as median_offset from k""")
def qq_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Distance from the uniform distribution and offset of the median."""
    return rounded(frames.qq_statistics(results_d(spark, d)).select("d", "median_offset"), "d", "median_offset")


@query(with_sql(D_SQL) + "select row_id, score <= 0.05 / (select count(*) from d) * 1000 as low, score < 0.05 / (select count(*) from d) as significant from d where score < 0.2 or row_id % 50 = 0")
def significant_rows(spark: SparkSession, d: str) -> DataFrame:
    """Which rows pass the corrected threshold, over the rows kept by id."""
    x = ranking.significant(results_d(spark, d))
    ids = x.filter("score < 0.2 or row_id % 50 = 0").select("row_id")
    n = results_d(spark, d).count()
    return ranking.keep_rows(x, ids).select("row_id", (F.col("score") <= 0.05 / n * 1000).alias("low"), "significant")


# ------------------------------------------------------------- single models


@query(with_sql(A_SQL) + f"""select {s('regr_slope(y, g)')} as slope, {s('regr_intercept(y, g)')} as intercept, {s('regr_syy(y, g) - regr_sxy(y, g) ^ 2 / regr_sxx(y, g)', 3)} as rss,
  {s('-0.5 * count(*) * (1 + ln(2 * pi()) + ln((regr_syy(y, g) - regr_sxy(y, g) ^ 2 / regr_sxx(y, g)) / count(*)))', 4)} as ll from a where marker_id = 0""")
def linear_model(spark: SparkSession, d: str) -> DataFrame:
    """The regression object with one marker as covariate."""
    p, y = panel_a(spark, d)
    m = scan.LinearModel(y)
    m.add_factor(p.markers.filter("marker_id = 0").first().calls)
    out = spark.createDataFrame([(float(m.betas[1]), float(m.betas[0]), m.rss, float(m.ll))], "slope double, intercept double, rss double, ll double")
    return rounded(rounded(rounded(out, "rss", digits=3), "ll", digits=4), "slope", "intercept")


_NESTED = (
    A_SQL,
    """w as (select vec_id, any_value(y) as y, max(case when marker_id = 0 then g end)::double as u, max(case when marker_id = 1 then g end)::double as v from a group by 1),
c as (select count(*) as n, var_pop(y) * count(*) as yy, regr_sxx(y, u) as uu, regr_sxx(y, v) as vv, regr_sxy(v, u) as uv, regr_sxy(y, u) as uy, regr_sxy(y, v) as vy from w),
e as (select n, yy, yy - uy ^ 2 / uu as r1, yy - uy ^ 2 / uu - (vy - uv * uy / uu) ^ 2 / (vv - uv ^ 2 / uu) as r2 from c)""",
)


@query(with_sql(*_NESTED) + f"select {s('(yy / r2 - 1) * (n - 3) / 2')} as f_both, {s('(r1 / r2 - 1) * (n - 3)')} as f_second from e")
def nested_tests(spark: SparkSession, d: str) -> DataFrame:
    """F of two coefficients being zero, and of adding the second marker to the first."""
    p, y = panel_a(spark, d)
    u, v = (np.array(x.calls, float) for x in p.markers.filter("marker_id < 2").orderBy("marker_id").collect())
    x = np.column_stack([np.ones(p.n), u, v])
    both = scan.general_f_test(y, x, [[0, 1, 0], [0, 0, 1]], [0, 0])[0]
    second = scan.test_covariate(y, x[:, :2], v)[0]
    return rounded(spark.createDataFrame([(float(both), float(second))], "f_both double, f_second double"), "f_both", "f_second")


@query(with_sql(B_SQL) + f"""select marker_id, k::double as n_classes, {s('case when k > 1 then (sst / (sst - ssb) - 1) * (n - k) / (k - 1) else 0 end', 4)} as f_stat from (
  select marker_id, count(*) as k, sum(n) as n, sum(q) - sum(t) ^ 2 / sum(n) as sst, sum(t ^ 2 / n) - sum(t) ^ 2 / sum(n) as ssb
  from (select marker_id, coalesce(g, -1) as g, count(*) as n, sum(y) as t, sum(y * y) as q from bm group by all) group by all)""")
def anova_missing_class(spark: SparkSession, d: str) -> DataFrame:
    """Analysis of variance with missing calls as a class of their own."""
    p, y = sparse_b(spark, d, gaps=True)
    return rounded(sparse.anova_scan(p, scan.Null(y), missing_class=True).select("marker_id", "n_classes", "f_stat"), "f_stat", digits=4)


@query(with_sql(*_LM) + f"""select {s('rss0', 3)} as mahalanobis_rss, {s('max(case when k = m // 2 + 1 then p end)')} as pval_median, {s('max(greatest(k / m - p, p - (k - 1) / m))')} as ks_stat from (
  select p, rss0, row_number() over (order by p) as k, count(*) over () as m from (select *, {_P} as p from lm)) group by rss0""".replace("group by rss0", "group by round(rss0, 3)").replace("select round(rss0, 3)", "select round(any_value(rss0), 3)"))
def step_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Median and Kolmogorov-Smirnov distance of the p-values at the first step of a search, and its residual sum."""
    p, y = panel_a(spark, d)
    t = stepwise.single_step(p, y, [], distribution=True)[0]
    out = spark.createDataFrame([(t.mahalanobis_rss, t.pval_median, t.ks_stat)], "mahalanobis_rss double, pval_median double, ks_stat double")
    return rounded(rounded(out, "mahalanobis_rss", digits=3), "pval_median", "ks_stat")


# ------------------------------------------------------------------- kinship

_Z = (A_SQL, "z as (select vec_id, marker_id, chrom, pos, (g - avg(g) over m) / nullif(stddev_pop(g) over m, 0) as z from a window m as (partition by marker_id))")


@query(with_sql(*_Z) + f"""select part, i, j, {s('k')} as k from (
  select case when x.chrom = 2 and x.pos between 3000 and 9000 then 'local' else 'rest' end as part, x.vec_id as i, w.vec_id as j, sum(x.z * w.z) / count(*) as k from z as x join z as w using (marker_id) where x.z is not null group by all)""")
def local_kinship(spark: SparkSession, d: str) -> DataFrame:
    """Kinship of a window's markers and of all others, from one pass."""
    p, _ = panel_a(spark, d)
    local, rest, _, _ = K.local_and_rest(p, K.window_condition(2, 6000, 3000), scaled=False)
    return _matrix(spark, local, p).select(F.lit("local").alias("part"), "*").unionByName(_matrix(spark, rest, p).select(F.lit("rest").alias("part"), "*"))


@query(with_sql(*_Z) + f"select x.vec_id as i, w.vec_id as j, {s('sum(x.z * w.z) / count(*)')} as k from z as x join z as w using (marker_id) where x.z is not null and x.marker_id >= 16 group by all")
def downdated_kinship(spark: SparkSession, d: str) -> DataFrame:
    """Kinship without the first chromosome, from the whole one and that chromosome's."""
    p, _ = panel_a(spark, d)
    first = p.with_markers(p.markers.filter("marker_id < 16"))
    return _matrix(spark, K.downdate(K.ibd_kinship(p, scaled=False), 64, K.ibd_kinship(first, scaled=False), 16), p)


@query(with_sql(A_SQL) + f", i as (select x.vec_id as i, w.vec_id as j, avg((x.g = w.g)::int) as k from a as x join a as w using (marker_id) where x.vec_id % 2 = 0 and w.vec_id % 2 = 0 group by all) select i, j, {s('k')} as k from i")
def reordered_kinship(spark: SparkSession, d: str) -> DataFrame:
    """Kinship of half of the individuals, taken from the whole matrix in another order."""
    p, _ = panel_a(spark, d)
    wanted = [x for x in reversed(p.ids) if int(x) % 2 == 0]
    k = K.reorder(K.ibs_kinship(p, scaled=False), p.ids, wanted)
    return _matrix(spark, k, Panel(p.markers, wanted))
