"""Loading of damaged lines."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from locusloom.sources import lines as L

LAYOUTS = [(1, "tped", "blanks", 2, None), (2, "result", "comma", None, "chromosome,position,score,marf,maf,note"), (3, "result", "blank", None, "chromosomes,positions,scores,mafs,macs,note")]
DDL = "layout_id int, file_kind string, delim string, n_indiv int, col_names string"


def layouts(spark):
    return spark.createDataFrame(LAYOUTS, DDL)


def parsed(spark, rows, kind, **kw):
    df = spark.createDataFrame(rows, "line_id long, layout_id int, raw string, reason string, detail string")
    return {r.line_id: r for r in L.parse_lines(df, layouts(spark), kind, text_col="raw", **kw).collect()}


TPED = {
    1: ("1 m1 0 100 1 2 0 1", None), 2: ("1\tm1\t0.5\t100\t1\t1\t2\t2\r", None), 3: ("  3  m  -1e-3 7 2 2 1 1 \t", None), 4: ("", "empty_line"), 5: (None, "null_line"),
    6: ("1 m1 0 100 1 2 0", "field_count"), 7: ("6 m1 0 100 1 2 0 1", "chromosome"), 8: ("1 m1 nan 100 1 2 0 1", "centimorgan"), 9: ("1 m1 0 1e3 1 2 0 1", "position"),
    10: ("1 m1 0 100 1 3 0 1", "allele"), 11: ("1 m1 0 100 1 １ 0 1", "allele"), 12: ("1 m1 0 99999999999999999999 1 1 1 1", None), 13: ("1 m1 .5 100 1 1 1 1", "centimorgan"), 14: ("1;m1;0;100", "field_count"),
}


@pytest.mark.parametrize("block,size", [(8192, 1 << 24), (3, 1 << 24), (1, 1), (256, 10)])
def test_tped(spark, block, size):
    got = parsed(spark, [(i, 1, t, "x", "y") for i, (t, _) in TPED.items()], "tped", block=block, block_bytes=size)
    assert {i: r.reason for i, r in got.items()} == {i: why for i, (_, why) in TPED.items()}
    assert got[1].calls == [1, None] and got[2].calls == [0, 2] and got[3].cm == -0.001
    assert got[12].pos is None and got[12].wide == "position=99999999999999999999"


RESULT = {
    1: ("1,100,0.5,0.1,7,ok", None), 2: ('2.0,"1e3", 5e-2 ,NA,,"a ""b"", c"', None), 3: ('1,100,0.5,0.1,7,"open', "open_quote"), 4: ('1,100,0.5,0.1,7,a"b', "stray_quote"), 5: ('1,100,0.5,0.1,7,"a"b', "text_after_quote"),
    6: ("1,0,0.5,0.1,7,x", "positions"), 7: ("1,1.5,0.5,0.1,7,x", "positions"), 8: ("1,100,NA,0.1,7,x", "scores"), 9: ("1,100,0.5,0.6,7,x", "mafs"), 10: ("1,100,0.5,0.1,-1,x", "macs"), 11: ("5.5,1,1,0.1,1,x", "chromosomes"),
    12: ("1,100,0.5,0.1,7", "field_count"), 13: ("1,100,+.5,0.1,7,x", "scores"), 14: ('1, "100",0.5,0.1,7,x', "stray_quote"), 15: ("1,100,0.5,0.1,1e400,x", "macs"), 16: ("   ", "empty_line"), 17: ("1,100,1e999,,NA,\r", None), 18: ("1,1e30,1,,1e25,x", None), 19: ("1,9223372036854775807,1,,,x", None),
}


@pytest.mark.parametrize("block", [8192, 4])
def test_result(spark, block):
    got = parsed(spark, [(i, 2, t, None, None) for i, (t, _) in RESULT.items()], "result", block=block)
    assert {i: r.reason for i, r in got.items()} == {i: why for i, (_, why) in RESULT.items()}
    assert (got[2].pos, got[2].note, got[2].maf, got[2].mac) == (1000, 'a "b", c', None, None)
    assert (got[18].pos, got[18].mac, got[18].wide) == (None, None, "positions=1e30;macs=1e25")
    assert got[4].detail == 'a"b' and got[3].detail == '"open'


def test_layouts(spark):
    rows = [(1, 9, "1 m 0 1 1 1 1 1", None, None), (2, None, "x", None, None), (3, 2, "x", None, None)]
    assert {r.reason for r in parsed(spark, rows, "tped").values()} == {"unknown_layout"}
    assert parsed(spark, [], "tped") == {}
    assert parsed(spark, [(1, 3, '1 2 3 0.1 4 "a b"', None, None)], "result")[1].note == "a b"


def test_repeated_rows(spark):
    df = spark.createDataFrame([(1, 1, "x")] * 3, "line_id long, layout_id int, raw string")
    assert L.rejected_rows(L.parse_lines(df, layouts(spark), "tped", text_col="raw")).count() == 3


FIELD = st.one_of(st.sampled_from(["1", "5", "0.2", "NA", "", " 3 ", '"7"', '"', 'a"b', '"x""y"', "1e2", "nan", "５", "x,y", "0x1", "+4", "1_0", "-"]), st.text(alphabet='01.,"- eE', max_size=5))


def one_by_one(texts, fast, strict, schema):
    """Every line under the strict rules alone."""
    return L._diagnose(pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string()), strict, schema).to_pylist()


def in_block(texts, fast, strict, schema, offset=0):
    ids, lines = pa.array(range(-offset, len(texts)), pa.int64()), pa.array(["x y"] * offset + texts, pa.string())
    got = pa.concat_tables([schema.empty_table(), *L.parse_block(ids.slice(offset), lines.slice(offset), fast, strict, schema)])
    return sorted(got.to_pylist(), key=lambda r: r["line_id"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(FIELD, min_size=4, max_size=7).map(",".join)), min_size=1, max_size=12), st.integers(0, 2))
def test_fast_path_agrees_with_strict_rules(texts, offset):
    rules = L._rules("result", "comma:chromosomes,positions,scores,mafs,macs,note")
    assert in_block(texts, *rules, L._RESULT_ARROW, offset) == one_by_one(texts, *rules, L._RESULT_ARROW)


TOKEN = st.sampled_from(["1", "5", "0", "2", "m", "é", "0.5", "1e3", "9", "12", "１", "\r", "\n", "\u00a0", "99999999999999999999", "007"])
BLANK = st.sampled_from([" ", "\t", "  ", " \t", ""])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.just("1 m 0.5 100 1 2 0 1\r"), st.lists(st.tuples(TOKEN, BLANK), max_size=9).map(lambda t: "".join(a + b for a, b in t)), st.lists(TOKEN, min_size=8, max_size=8).map(" ".join)), min_size=1, max_size=12), st.integers(0, 2))
def test_tped_fast_path_agrees_with_strict_rules(texts, offset):
    rules = L._rules("tped", "2")
    assert in_block(texts, *rules, L._TPED_ARROW, offset) == one_by_one(texts, *rules, L._TPED_ARROW)


@given(st.lists(st.booleans(), max_size=40))
def test_bisection_finds_refused_lines(ok):
    assert sorted(L.isolate(np.array(ok, bool))) == [i for i, x in enumerate(ok) if not x]


def test_block_that_cannot_be_parsed_is_halved():
    def fast(ids, lines):
        if "c" in lines.to_pylist():
            raise pa.ArrowInvalid("no")
        return L._tped_block(ids, lines, 2)

    got = in_block(["1 m 0 1 1 1 1 1", "c", "1 m 0 2 1 1 1 1"], fast, lambda t: L._tped_line(t, 2), L._TPED_ARROW)
    assert [r["reason"] for r in got] == [None, "field_count", None]


@pytest.mark.parametrize("kind,table,col", [("tped", "tped_lines", "raw_snps"), ("result", "result_lines", "raw_line")])
def test_valid_lines_stay_off_the_strict_path(duck, kind, table, col):
    """The strict parser sees the damaged lines and next to nothing else."""
    spec = "n_indiv::varchar" if kind == "tped" else "delim||':'||col_names"
    rows = duck.sql(f"select {spec} as spec, list({col}) as texts from {table} join line_layouts using (layout_id) where line_no <> 1 or '{kind}' = 'tped' group by 1").fetchall()
    seen = bad = 0
    schema = L._TPED_ARROW if kind == "tped" else L._RESULT_ARROW
    for layout, texts in rows:
        fast, strict = L._rules(kind, layout)

        def counted(text):
            nonlocal seen
            seen += 1
            return strict(text)

        bad += sum(r["reason"] not in (None, "null_line") for r in in_block(texts, fast, counted, schema))
    assert bad <= seen <= 1.2 * bad
