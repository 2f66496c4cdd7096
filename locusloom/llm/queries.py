"""Queries of the corpus-preparation operators and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import table
from .leaks import find_leaks, leaked_items
from .mixture import Mixture
from .quantiles import merge_summaries, percentiles, summarize
from .residue import find_residue, without_residue
from .topn import top_n

PROBS = [0.05, 0.25, 0.5, 0.75, 0.95]
SCORE_KEYS = ["src_table", "run_id", "chrom", "day"]
EPS = 0.005
_SALTS = 16


def _score_values(spark: SparkSession, d: str) -> DataFrame:
    ps = table(spark, d, "chrom_results").select(F.lit("chrom_results").alias("src_table"), "run_id", "chrom", F.col("scan_day").alias("day"), F.col("ps").alias("x"))
    ps = ps.filter((F.col("x") >= 0) & (F.col("x") <= 1))
    sc = table(spark, d, "results").select(F.lit("results").alias("src_table"), "run_id", "chrom", F.to_date("scored_at").alias("day"), F.col("score").alias("x"))
    return ps.unionByName(sc)


def p4_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of p-values and scores per run, chromosome and day, with the rank error."""
    return percentiles(summarize(_score_values(spark, d), SCORE_KEYS, "x"), SCORE_KEYS, PROBS).withColumn("day", F.col("day").cast("string"))


def p4_over_days(spark: SparkSession, d: str) -> DataFrame:
    """The same per run and chromosome, from the merged daily summaries."""
    daily = summarize(_score_values(spark, d), SCORE_KEYS, "x")
    keys = ["src_table", "run_id", "chrom"]
    return percentiles(merge_summaries(daily, keys), keys, PROBS)


def p4_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of each run and of each whole table, from daily summaries merged level by level, held against the exact ranks.

    within: no reported value's rank lies further from the wanted one than
    rank_error; bounded: rank_error is at most eps of the values.
    """
    x = _score_values(spark, d)
    by_run = merge_summaries(merge_summaries(summarize(x, SCORE_KEYS, "x", EPS), SCORE_KEYS[:3]), SCORE_KEYS[:2])
    runs = percentiles(by_run, SCORE_KEYS[:2], PROBS)
    tables = percentiles(merge_summaries(by_run, ["src_table"]), ["src_table"], PROBS)
    values = x.filter(~F.isnan("x")).select("src_table", "run_id", "x")
    # a run may hold a third of all values, so each is met by its percentiles in several places
    salted = values.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(_SALTS)))
    copies = runs.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SALTS - 1).cast("long"))))
    run_rows = salted.join(copies, ["src_table", "run_id", "_salt"]).withColumn("run", F.col("run_id").cast("string"))
    table_rows = values.join(F.broadcast(tables), "src_table").withColumn("run", F.lit("all"))  # one row per table
    names = [f"p{round(100 * p):02d}" for p in PROBS]
    keep = ["src_table", "run", "n", "rank_error", *names]
    ranks = run_rows.select(*keep, "x").unionByName(table_rows.select(*keep, "x")).groupBy(*keep)
    ranks = ranks.agg(*[F.struct(F.count_if(F.col("x") < F.col(p)).alias("below"), F.count_if(F.col("x") <= F.col(p)).alias("upto")).alias(f"r_{p}") for p in names])
    ok = F.lit(True)
    for p, name in zip(PROBS, names):
        want = F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col("n")))
        ok = ok & (F.col(f"r_{name}.below") + 1 - F.col("rank_error") <= want) & (F.col(f"r_{name}.upto") + F.col("rank_error") >= want)
    return ranks.select("src_table", "run", "n", ok.alias("within"), (F.col("rank_error") <= EPS * F.col("n")).alias("bounded"))


def _top_loci(spark: SparkSession, d: str) -> DataFrame:
    return top_n(table(spark, d, "results"), ["run_id", "chrom"], "pos", "score", "result_id", 5)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the five best loci of every run and chromosome."""
    return _top_loci(spark, d).select("run_id", "chrom", "result_id")


def p5_top_loci(spark: SparkSession, d: str) -> DataFrame:
    """The same with locus, score and rank."""
    order = Window.partitionBy("run_id", "chrom").orderBy(F.col("score").desc(), "pos")
    return _top_loci(spark, d).withColumn("place", F.row_number().over(order))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents and items that share twelve consecutive words, or a whole shorter item."""
    return _leaks(spark, d).filter("distance = 0").select("doc_id", "item_id")


def p6_near(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold twelve words of an item with one or two words changed, but not unchanged."""
    found = find_leaks(table(spark, d, "documents"), table(spark, d, "benchmark"), max_edits=2)
    return found.filter("distance > 0").select("doc_id", "item_id", "distance")


def p6_items(spark: SparkSession, d: str) -> DataFrame:
    """Items that leaked, also with one word changed, and into how many documents."""
    return leaked_items(_leaks(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with template residue, filler, error pages or script notices."""
    return find_residue(table(spark, d, "documents")).select("doc_id")


def p8_kept(spark: SparkSession, d: str) -> DataFrame:
    """Documents without residue."""
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", "text")
    return without_residue(docs, find_residue(docs)).select("doc_id", "source", "lang")


#: Ranks file of the public tokenizer that measures sizes.
TOKENIZER = os.environ.get("LOCUSLOOM_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Chatty sources fade, long and edited ones come in.
CURRICULUM = {
    "forum": [(0.0, 1.5), (0.5, 1.0), (1.0, 0.5)],
    "thesis_excerpts": [(0.0, 0.25), (0.6, 1.0), (1.0, 2.0)],
    "press_notes": [(0.0, 2.0), (1.0, 0.0)],
}


def _mixture(spark: SparkSession, d: str, tokenizer: str | None = None) -> Mixture:
    return Mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"), tokenizer or TOKENIZER, schedules=CURRICULUM)


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    """Documents in training order, with their position and use number."""
    return _mixture(spark, d).rows


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares reached against targets."""
    return _mixture(spark, d).report()


QUERIES = {f.__name__: f for f in (p4_percentiles, p4_over_days, p4_bounds, p5_found, p5_top_loci, p6_found, p6_near, p6_items, p7_mixture, p7_shares, p8_found, p8_kept)}

_P5 = """
with r as (
  select * from results where pos is not null and score is not null and not isnan(score)
  qualify row_number() over (partition by run_id, chrom, pos order by score desc, result_id) = 1
)
select {columns} from r qualify row_number() over (partition by run_id, chrom order by score desc, pos) <= 5"""

_SCORES = """
with x as (
  select 'chrom_results' as src_table, run_id, chrom, scan_day::date::varchar as day, ps as x from chrom_results where ps >= 0 and ps <= 1 and not isnan(ps)
  union all select 'results', run_id, chrom, scored_at::date::varchar, score from results where score is not null and not isnan(score)
)"""
#: Exact, as long as no group holds more values than a summary keeps without compression.
_P4 = _SCORES + """, s as (select src_table, run_id, chrom, day, count(*) as n, list_sort(list(x)) as v from x group by all)
select src_table, run_id, chrom, day, n, """ + ", ".join(f"v[greatest(1, ceil({p}::double * n))::int] as p{round(100 * p):02d}" for p in PROBS) + """, 0::bigint as rank_error from s"""
_P4_BOUNDS = _SCORES + """
select src_table, run_id::varchar as run, count(*) as n, true as within, true as bounded from x group by 1, 2
union all select src_table, 'all', count(*), true, true from x group by 1"""



def _words_sql(text: str) -> str:
    """Words of a text: invisible characters out, broken words joined, accents off, lower case."""
    bare = f"translate({text}, chr(8203)||chr(8204)||chr(8205)||chr(8288)||chr(65279)||chr(173), '')"
    joined = f"regexp_replace({bare}, '([\\p{{L}}\\p{{N}}])[-‐][ \\t]*\\r?\\n[ \\t]*([\\p{{L}}\\p{{N}}])', '\\1\\2', 'g')"
    # strip_accents leaves compatibility forms; those of the Latin alphabet and of digits are brought back here
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    narrow = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
    quote = lambda x: x.replace("'", "''")
    folded = f"replace(replace(replace(translate({joined}, '{quote(wide)}', '{quote(narrow)}'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬀ', 'ff')"
    return f"regexp_extract_all(lower(strip_accents({folded})), '[\\p{{L}}\\p{{N}}]+')"


_P6 = f"""
with d as (select doc_id, {_words_sql('text')} as w from documents where text is not null),
b as (select item_id, {_words_sql('text')} as w from benchmark where text is not null),
dg as (select distinct doc_id, array_to_string(w[i:i + 11], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 10)) as i from d)),
bg as (select distinct item_id, array_to_string(w[i:i + 11], ' ') as g from (select item_id, w, unnest(range(1, len(w) - 10)) as i from b))
select distinct doc_id, item_id from dg join bg using (g)
union
select doc_id, item_id from d join b on len(b.w) between 1 and 11 and contains(' '||array_to_string(d.w, ' ')||' ', ' '||array_to_string(b.w, ' ')||' ')"""

ORACLES = {
    "p6_found": _P6,
    "p4_percentiles": _P4,
    "p4_bounds": _P4_BOUNDS,
    "p5_found": _P5.format(columns="run_id, chrom, result_id"),
    "p5_top_loci": _P5.format(columns="run_id, chrom, pos, score, result_id, (row_number() over (partition by run_id, chrom order by score desc, pos))::int as place"),
}
