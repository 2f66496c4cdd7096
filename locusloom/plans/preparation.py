"""Queries of the general data-preparation operators, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.fill import fill_calls, fill_counts, fill_genotypes, filled_slots, methods
from ..operators.references import find_orphans, orphan_report, references
from ..session import table
from ..sources.lines import parse_lines, rejected_rows, valid_rows

#: table, id column, row id, time of the row
REFERENCING = (
    ("phenotypes", "ecotype_id", "record_id", "recorded_at"),
    ("panel_accessions", "accession", "entry_id", "listed_at"),
    ("indiv_data", "indiv_id", "row_id", "stored_at"),
)


def _tped(spark: SparkSession, d: str) -> DataFrame:
    return parse_lines(table(spark, d, "tped_lines"), table(spark, d, "line_layouts"), "tped", text_col="raw_snps")


def _results(spark: SparkSession, d: str) -> DataFrame:
    body = table(spark, d, "result_lines").filter("line_no is distinct from 1")
    return parse_lines(body, table(spark, d, "line_layouts"), "result", text_col="raw_line")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines that aren't valid."""
    parts = [rejected_rows(f(spark, d)).select(F.lit(t).alias("src_table"), "line_id") for t, f in (("tped_lines", _tped), ("result_lines", _results))]
    return parts[0].unionByName(parts[1])


def p1_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Rejected lines per table and reason."""
    parts = [rejected_rows(f(spark, d)).select(F.lit(t).alias("src_table"), "reason") for t, f in (("tped_lines", _tped), ("result_lines", _results))]
    return parts[0].unionByName(parts[1]).groupBy("src_table", "reason").agg(F.count("*").alias("n_lines"))


def p1_markers(spark: SparkSession, d: str) -> DataFrame:
    """The valid TPED lines as typed markers, their calls as text."""
    return valid_rows(_tped(spark, d)).withColumn("calls", F.array_join(F.col("calls").cast("array<string>"), ",", "NA"))


def p1_result_rows(spark: SparkSession, d: str) -> DataFrame:
    """The valid result lines as typed rows."""
    return valid_rows(_results(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Slots the filling gave a value."""
    g = table(spark, d, "genot_data")
    return filled_slots(fill_calls(g), fill_counts(g))


def p2_filled(spark: SparkSession, d: str) -> DataFrame:
    """The table with all its columns, calls and counts filled and marked; lists as text."""
    filled = fill_genotypes(table(spark, d, "genot_data"))
    return filled.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",", "NA") for c in ("raw_snps", "call_method", "call_distance")})


def p2_methods(spark: SparkSession, d: str) -> DataFrame:
    """How many values came by which method, and how far from the marker they were taken."""
    g = table(spark, d, "genot_data")
    return methods(fill_calls(g), fill_counts(g))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    refs = [references(table(spark, d, t), t, key, row, time) for t, key, row, time in REFERENCING]
    return find_orphans(refs, table(spark, d, "ecotype_info"), "ecotype_id", "registered_at", "deleted_at")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """References without a live parent."""
    return _orphans(spark, d).select("ref_table", "ref_month", "row_id")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphans per table, month and kind."""
    return orphan_report(_orphans(spark, d))


QUERIES = {f.__name__: f for f in (p1_found, p1_reasons, p1_markers, p1_result_rows, p2_found, p2_filled, p2_methods, p3_found, p3_report)}

_NUM = "[+-]?[0-9]+([.][0-9]+)?([eE][+-]?[0-9]+)?"
_TAB, _CR, _Q = "chr(9)", "chr(13)", "chr(34)"


def _p1_sql() -> str:
    """Lines as fields: a delimiter, then a quoted or an unquoted field, again and again."""
    number = f"regexp_full_match({{x}}, '{_NUM}')"
    field = "('('||dl||'(\"([^\"]|\"\")*\"|([^\"'||dl||'][^\"'||dl||']*)?))')"

    def val(name: str) -> str:
        raw = f"list_extract(fs, list_position(cols, '{name}')::int)"
        body = f"substr({raw}, 2)"
        return f"trim(case when starts_with({body}, {_Q}) then replace(substr({body}, 2, length({body}) - 2), {_Q}||{_Q}, {_Q}) else {body} end, ' '||{_TAB})"

    def num(name: str, cond: str, gap: bool) -> str:
        v = val(name)
        d = f"try_cast({v} as double)"
        ok = f"({number.format(x=v)} and {cond.format(d=d)})"
        return f"({v} in ('', 'NA') or {ok})" if gap else ok

    whole = "{d} = floor({d}) and not isinf({d})"
    checks = [
        num("chromosomes", "{d} in (1, 2, 3, 4, 5)", False),
        num("positions", whole + " and {d} >= 1", False),
        num("scores", "true", False),
        num("mafs", "{d} >= 0 and {d} <= 0.5", True),
        num("macs", whole + " and {d} >= 0", True),
        f"(list_position(cols, 'perc_var_expl') is null or list_position(cols, 'perc_var_expl') = 0 or {num('perc_var_expl', 'true', False)})",
    ]
    renames = "case trim(lower(c)) when 'chromosome' then 'chromosomes' when 'position' then 'positions' when 'score' then 'scores' when 'marf' then 'mafs' when 'maf' then 'macs' else trim(lower(c)) end"
    return f"""
with t as (
  select line_id, case when ends_with(raw_snps, {_CR}) then left(raw_snps, length(raw_snps) - 1) else raw_snps end as s, n_indiv
  from tped_lines left join (select * from line_layouts where file_kind = 'tped') using (layout_id)
), t_bad as (
  select line_id from t where not coalesce(regexp_full_match(s, '[ \\t]*[1-5][ \\t]+[^ \\t]+[ \\t]+{_NUM}[ \\t]+[0-9]+([ \\t]+[012])'||'{{'||(2 * n_indiv)||'}}[ \\t]*', 's'), false)
), lay as (
  select layout_id, case delim when 'comma' then ',' when 'tab' then chr(9) when 'blank' then ' ' end as dl,
    [{renames} for c in string_split(col_names, ',')] as cols
  from line_layouts where file_kind = 'result'
), r as (
  select line_id, dl, cols, case when ends_with(raw_line, {_CR}) then left(raw_line, length(raw_line) - 1) else raw_line end as s
  from result_lines left join lay using (layout_id) where line_no is distinct from 1
), f as (
  select line_id, cols, regexp_full_match(dl||s, {field}||'+', 's') as fits, regexp_extract_all(dl||s, {field}, 0, 's') as fs from r
), r_bad as (
  select line_id from f where not coalesce(fits and len(fs) = len(cols) and {' and '.join(checks)}, false)
)
select 'tped_lines' as src_table, line_id from t_bad union all select 'result_lines', line_id from r_bad"""


def _reason_ctes() -> str:
    """Both tables line by line with fields, values and the first rule each line breaks."""
    number = f"regexp_full_match({{}}, '{_NUM}')"
    bare = "regexp_replace({}, chr(13)||'$', '')"
    quoted = "'\"([^\"]|\"\")*\"'"

    def val(name: str) -> str:
        raw = f"list_extract(fs, list_position(cols, '{name}')::int)"
        body = f"substr({raw}, 2)"
        return f"trim(case when starts_with({body}, {_Q}) then replace(substr({body}, 2, length({body}) - 2), {_Q}||{_Q}, {_Q}) else {body} end, ' '||{_TAB}) as v_{name}"

    def gap(name: str) -> str:
        return f"v_{name} in ('', 'NA')"

    def d(name: str) -> str:
        return f"try_cast(v_{name} as double)"

    whole = "({d} = floor({d}) and not isinf({d}) and {d} >= {low})"
    ok = {
        "chromosomes": f"{number.format('v_chromosomes')} and {d('chromosomes')} in (1, 2, 3, 4, 5)",
        "positions": f"{number.format('v_positions')} and {whole.format(d=d('positions'), low=1)}",
        "scores": number.format("v_scores"),
        "mafs": f"({gap('mafs')} or {number.format('v_mafs')} and {d('mafs')} between 0 and 0.5)",
        "macs": f"({gap('macs')} or {number.format('v_macs')} and {whole.format(d=d('macs'), low=0)})",
        "perc_var_expl": f"(coalesce(list_position(cols, 'perc_var_expl'), 0) = 0 or {number.format('v_perc_var_expl')})",
    }
    names = [*ok, "note"]
    renames = "case trim(lower(c)) when 'chromosome' then 'chromosomes' when 'position' then 'positions' when 'score' then 'scores' when 'marf' then 'mafs' when 'maf' then 'macs' else trim(lower(c)) end"
    return f"""
with t as (
  select line_id, raw_snps, trim({bare.format('raw_snps')}, ' '||{_TAB}) as s, n_indiv
  from tped_lines left join (select * from line_layouts where file_kind = 'tped') using (layout_id)
), t_f as (
  select *, regexp_split_to_array(s, '[ '||{_TAB}||']+') as f from t
), t_r as (
  select *, f[5:] as alleles, case when raw_snps is null then 'null_line' when n_indiv is null then 'unknown_layout' when s = '' then 'empty_line'
    when len(f) <> 4 + 2 * n_indiv then 'field_count' when not regexp_full_match(f[1], '[1-5]') then 'chromosome' when not {number.format('f[3]')} then 'centimorgan'
    when not regexp_full_match(f[4], '[0-9]+') then 'position' when len(list_filter(f[5:], lambda x: x not in ('0', '1', '2'))) > 0 then 'allele' end as reason
  from t_f
), lay as (
  select layout_id, case delim when 'comma' then ',' when 'tab' then chr(9) when 'blank' then ' ' end as dl,
    [{renames} for c in string_split(col_names, ',')] as cols
  from line_layouts where file_kind = 'result' and delim in ('comma', 'tab', 'blank')
), r as (
  select line_id, dl, cols, raw_line, {bare.format('raw_line')} as s
  from result_lines left join lay using (layout_id) where line_no is distinct from 1
), r_p as (
  select *, substr(s, length(regexp_extract(s, '^(({quoted[1:-1]}|[^"'||dl||']*)'||dl||')*', 0, 's')) + 1) as rest,
    regexp_extract_all(dl||s, '('||dl||'({quoted[1:-1]}|([^"'||dl||'][^"'||dl||']*)?))', 0, 's') as fs
  from r
), r_v as (
  select *, {', '.join(map(val, names))} from r_p
), r_r as (
  select *, case when raw_line is null then 'null_line' when cols is null then 'unknown_layout' when trim(s, ' '||{_TAB}) = '' then 'empty_line'
    when starts_with(rest, {_Q}) and not regexp_matches(rest, '^'||{quoted}||'([^"]|$)', 's') then 'open_quote'
    when starts_with(rest, {_Q}) and not regexp_full_match(rest, {quoted}, 's') then 'text_after_quote'
    when not starts_with(rest, {_Q}) and contains(rest, {_Q}) then 'stray_quote'
    when len(fs) <> len(cols) then 'field_count'
    {' '.join(f"when not ({rule}) then '{name}'" for name, rule in ok.items())} end as reason
  from r_v
)"""


_P1_REASONS_SQL = _reason_ctes() + """
select src_table, reason, count(*) as n_lines
from (select 'tped_lines' as src_table, reason from t_r union all select 'result_lines', reason from r_r) where reason is not null group by all"""
_P1_MARKERS_SQL = _reason_ctes() + """
select line_id, f[1]::int as chrom, f[2] as snp_id, f[3]::double as cm, try_cast(f[4] as bigint) as pos,
  array_to_string(list_transform(range(1, 2 * n_indiv, 2), lambda i: case when alleles[i] <> '0' and alleles[i + 1] <> '0' then (alleles[i]::int + alleles[i + 1]::int - 2)::varchar else 'NA' end), ',') as calls,
  case when try_cast(f[4] as bigint) is null then 'position='||f[4] end as wide
from t_r where reason is null"""
_P1_ROWS_SQL = _reason_ctes() + """
, w as (
  select *, case when v_macs not in ('', 'NA') then v_macs end as t_macs, case when v_mafs not in ('', 'NA') then v_mafs end as t_mafs from r_r where reason is null
)
select line_id, v_chromosomes::double::int as chrom, try_cast(v_positions::double as bigint) as pos, v_scores::double as score, t_mafs::double as maf, try_cast(t_macs::double as bigint) as mac,
  v_perc_var_expl::double as perc_var_expl, v_note as note,
  nullif(concat_ws(';', case when try_cast(v_positions::double as bigint) is null then 'positions='||v_positions end, case when t_macs is not null and try_cast(t_macs::double as bigint) is null then 'macs='||t_macs end), '') as wide
from w"""


_P2_SQL = """
with e as (
  select marker_id, data_format, unnest(raw_snps) as v, generate_subscripts(raw_snps, 1) - 1 as slot from genot_data
), f as (
  select *, coalesce(v in (0, 1) or (v = 2 and data_format = 'diploid_int'), false) as ok from e
), h as (select marker_id from f group by 1 having bool_or(ok)),
k as (select *, coalesce(missing_counts >= 0 and missing_counts <= n_typed, false) as ok from genot_data),
kk as (select chrom, call_batch from k group by all having bool_or(ok))
select marker_id, slot::int as slot from f join h using (marker_id) where not ok
union all
select marker_id, -1 as slot from k join kk on k.chrom is not distinct from kk.chrom and k.call_batch is not distinct from kk.call_batch where not ok"""


_P2_CTES = """
with g as (select *, case when pos > 0 then pos end as p, case when data_format = 'diploid_int' then 2 else 1 end as top from genot_data),
e as (select marker_id, call_batch, chrom, p, top, unnest(raw_snps) as v, generate_subscripts(raw_snps, 1) as s from g),
o as (select *, coalesce(v between 0 and top, false) as ok, case when coalesce(v between 0 and top, false) and p is not null then struct_pack(p := p, v := v) end as ob from e),
w as (
  select *, last_value(ob ignore nulls) over (partition by call_batch, chrom, s order by p, marker_id rows between unbounded preceding and 1 preceding) as pr,
    first_value(ob ignore nulls) over (partition by call_batch, chrom, s order by p, marker_id rows between 1 following and unbounded following) as nx,
    count(*) filter (ok and v = 0) over (partition by marker_id) as n0, count(*) filter (ok and v = 1) over (partition by marker_id) as n1, count(*) filter (ok and v = 2) over (partition by marker_id) as n2
  from o
), r as (
  select *, case when pr.v <= top and p - pr.p <= 10000000 then p - pr.p end as dp, case when nx.v <= top and nx.p - p <= 10000000 then nx.p - p end as dn,
    case when n0 >= n1 and n0 >= n2 then 0 when n1 >= n2 then 1 else 2 end as mode
  from w
), c as (
  select *, case when ok then 0 when n0 + n1 + n2 = 0 then null when dp is not null and dp <= coalesce(dn, dp) then 2 when dn is not null then 1 else 3 end as method from r
), calls as (
  select marker_id, s, method, case method when 0 then v when 2 then pr.v when 1 then nx.v when 3 then mode end as v, case method when 0 then 0 when 2 then dp when 1 then dn end as distance from c
), k as (
  select marker_id, call_batch, chrom, p, n_typed, missing_counts::double as v, coalesce(missing_counts >= 0 and missing_counts <= coalesce(n_typed, 2147483647), false) as ok from g
), kw as (
  select *, last_value(case when ok and p is not null then struct_pack(p := p, v := v) end ignore nulls) over (partition by call_batch, chrom order by p, marker_id rows between unbounded preceding and 1 preceding) as a,
    first_value(case when ok and p is not null then struct_pack(p := p, v := v) end ignore nulls) over (partition by call_batch, chrom order by p, marker_id rows between 1 following and unbounded following) as b,
    first_value(case when ok then v end ignore nulls) over (partition by call_batch, chrom order by p nulls last, marker_id rows between unbounded preceding and unbounded following) as least
  from k
), km as (
  select *, case when ok then 'observed' when p is not null and a is not null and b is not null then 'interpolated' when p is not null and a is not null then 'previous_marker'
    when p is not null and b is not null then 'next_marker' when least is not null then 'first_observed' end as method, p - a.p as da, b.p - p as db
  from kw
), counts as (
  select marker_id, method, least(n_typed::double, case method when 'observed' then v when 'interpolated' then case when da + db > 0 then a.v + (b.v - a.v) * da / (da + db) else (a.v + b.v) / 2 end
    when 'previous_marker' then a.v when 'next_marker' then b.v when 'first_observed' then least end) as v,
    case method when 'observed' then 0 when 'interpolated' then least(da, db) when 'previous_marker' then da when 'next_marker' then db end as distance
  from km
)"""
_P2_FILLED_SQL = _P2_CTES + """
, lists as (
  select marker_id, string_agg(coalesce(v::varchar, 'NA'), ',' order by s) as raw_snps, string_agg(coalesce(method::varchar, 'NA'), ',' order by s) as call_method, string_agg(coalesce(distance::varchar, 'NA'), ',' order by s) as call_distance
  from calls group by 1
)
select marker_id, call_batch, chrom, pos, snp_id, a0, a1, data_format, n_typed, freqs,
  coalesce(l.raw_snps, case when g.raw_snps is not null then '' end) as raw_snps, case when counts.method is not null then counts.v end as missing_counts,
  coalesce(call_method, case when g.raw_snps is not null then '' end) as call_method, coalesce(call_distance, case when g.raw_snps is not null then '' end) as call_distance,
  counts.method as count_method, counts.distance as count_distance
from genot_data as g left join lists as l using (marker_id) join counts using (marker_id)"""
_P2_METHODS_SQL = _P2_CTES + """
select 'calls' as what, coalesce(['observed', 'next_marker', 'previous_marker', 'marker_mode'][method + 1], 'open') as method, count(*) as n_values, avg(distance) as mean_distance from calls group by all
union all select 'missing_counts', coalesce(method, 'open'), count(*), avg(distance) from counts group by all"""


def _key_sql(c: str) -> str:
    t = f"trim({c}, ' '||chr(9))"
    return (
        f"(case when {t} is null or {t} = '' or lower({t}) = 'na' then null when regexp_full_match({t}, '[0-9]+([.]0+)?') "
        f"then coalesce(nullif(ltrim(regexp_replace({t}, '[.]0+$', ''), '0'), ''), '0') else lower({t}) end)"
    )


def _p3_refs_sql() -> str:
    rows = " union all ".join(f"select '{t}' as ref_table, {row} as row_id, {_key_sql(key)} as k, {time} as t from {t}" for t, key, row, time in REFERENCING)
    return f"with r as ({rows}), p as (select distinct {_key_sql('ecotype_id')} as k, registered_at as s, coalesce(deleted_at, timestamp '9999-01-01') as e from ecotype_info where registered_at is not null)"


def _p3_sql() -> str:
    return _p3_refs_sql() + """
select ref_table, strftime(t, '%Y-%m') as ref_month, row_id from r
where k is not null and not exists (select 1 from p where p.k = r.k and p.s <= r.t and r.t < p.e)"""


def _p3_report_sql() -> str:
    return _p3_refs_sql() + """
, j as (
  select ref_table, row_id, any_value(t) as t, count(p.k) as known,
    coalesce(bool_or(p.s <= t and t < p.e), false) as live, coalesce(bool_or(p.s <= t), false) as begun, coalesce(bool_or(p.s > t), false) as ahead
  from r left join p on p.k = r.k and p.s < p.e where r.k is not null group by ref_table, row_id
)
select ref_table, strftime(t, '%Y-%m') as ref_month,
  case when t is null then 'no_time' when known = 0 then 'unknown' when not begun then 'too_early' when ahead then 'between' else 'deleted' end as status,
  count(*) as n_refs
from j where not live group by all"""


ORACLES = {
    "p1_found": _p1_sql(), "p1_reasons": _P1_REASONS_SQL, "p1_markers": _P1_MARKERS_SQL, "p1_result_rows": _P1_ROWS_SQL,
    "p2_found": _P2_SQL, "p2_filled": _P2_FILLED_SQL, "p2_methods": _P2_METHODS_SQL, "p3_found": _p3_sql(), "p3_report": _p3_report_sql(),
}
