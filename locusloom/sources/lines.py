"""Loading raw TPED and result lines with separation of the damaged ones.

Lines are gathered by layout into blocks of ``block`` lines, and each block is
parsed column-wise in one go: TPED lines over the bytes of the whole block, result
lines by a split, those with quotes by one pattern with a group per field. The
block parser gives the typed rows it accepts and a verdict per line; it is sound,
that is, it only accepts what the strict rules accept. A block that isn't clean is
bisected by the running count of its refused lines until single lines are left, so
no piece is parsed twice; only a block the columnar path cannot take at all is
parsed again in halves. The single lines left go through the strict rules, which
name the reason (or accept the rare value that the fast path leaves to them).

Defined cases: a NULL line is rejected as ``null_line``; a line whose layout is
unknown, or of the other file kind, as ``unknown_layout``; an empty table gives
empty results; repeated lines are judged one by one; other columns of the input
are ignored, whatever their names; lines of any length are taken whole. A whole
number beyond 64 bits is valid where the rules allow it: its column is NULL and
``wide`` holds it as name=text (several separated by a semicolon).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NUMBER = r"[+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?"
_NUMBER = re.compile(NUMBER)
_WHOLE_LINE_NUMBER = f"^{NUMBER}$"
_BLANKS = " \t"
DELIMITERS = {"comma": ",", "tab": "\t", "blank": " "}
#: Legacy column names of result files and what they are called now (fixed values).
LEGACY_NAMES = {
    "chromosome": "chromosomes",
    "position": "positions",
    "score": "scores",
    "marf": "mafs",
    "maf": "macs",
}

TPED_SCHEMA = (
    "line_id long, reason string, detail string, chrom int, snp_id string, "
    "cm double, pos long, calls array<tinyint>, wide string"
)
RESULT_SCHEMA = (
    "line_id long, reason string, detail string, chrom int, pos long, score double, "
    "maf double, mac long, perc_var_expl double, note string, wide string"
)
_TPED_ARROW = pa.schema([
    ("line_id", pa.int64()), ("reason", pa.string()), ("detail", pa.string()), ("chrom", pa.int32()),
    ("snp_id", pa.string()), ("cm", pa.float64()), ("pos", pa.int64()), ("calls", pa.list_(pa.int8())), ("wide", pa.string()),
])
_RESULT_ARROW = pa.schema([
    ("line_id", pa.int64()), ("reason", pa.string()), ("detail", pa.string()), ("chrom", pa.int32()),
    ("pos", pa.int64()), ("score", pa.float64()), ("maf", pa.float64()), ("mac", pa.int64()),
    ("perc_var_expl", pa.float64()), ("note", pa.string()), ("wide", pa.string()),
])
_BIGINT = 2**63 - 1


class LineError(ValueError):
    """One line breaks a rule; carries the reason and what was found."""

    def __init__(self, reason: str, detail: str = ""):
        super().__init__(reason)
        self.reason, self.detail = reason, detail


def column_names(text: str | None) -> list[str]:
    """Names of a result layout: lower case, legacy names renamed."""
    names = [n.strip().lower() for n in (text or "").split(",")]
    return [LEGACY_NAMES.get(n, n) for n in names]


def _without_cr(lines: pa.Array) -> pa.Array:
    last = pc.ends_with(lines, "\r")
    if not pc.any(last, min_count=0).as_py():
        return lines
    return pc.if_else(last, pc.replace_substring_regex(lines, r"\r$", ""), lines)


def _truth(mask: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return pc.fill_null(mask, False).to_numpy(zero_copy_only=False).astype(bool)


def _is_number(col: pa.Array) -> np.ndarray:
    return _truth(pc.match_substring_regex(col, _WHOLE_LINE_NUMBER))


# ------------------------------------------------------------------ TPED


def _bytes(lines: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Buffer]:
    """Offsets and bytes of an array of texts."""
    _, offsets, data = lines.buffers()
    at = np.frombuffer(offsets, np.int32)[lines.offset : lines.offset + len(lines) + 1]
    data = data if data is not None and data.size else pa.py_buffer(b"\0")
    return at, np.frombuffer(data, np.uint8), data


def _pieces(starts: np.ndarray, ends: np.ndarray, data: pa.Buffer) -> pa.Array:
    """Stretches of a buffer, in order and disjoint, as texts."""
    if not len(starts):
        return pa.array([], pa.string())
    edges = np.stack([starts, ends], axis=1).astype(np.int32).ravel()
    between = pa.Array.from_buffers(pa.string(), len(edges) - 1, [None, pa.py_buffer(edges), data])
    return between.take(pa.array(np.arange(0, len(edges) - 1, 2)))


def _tped_block(ids: pa.Array, lines: pa.Array, n_indiv: int) -> tuple[pa.Table, np.ndarray]:
    width, n = 4 + 2 * n_indiv, len(lines)
    offsets, raw, buffer = _bytes(lines)
    base = int(offsets[0])
    data, edge = raw[base : max(int(offsets[-1]), base)], offsets - base
    some = np.diff(edge) > 0
    first, last = edge[:-1][some], edge[1:][some] - 1
    blank = (data == 32) | (data == 9)
    blank[last[data[last] == 13]] = True
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:], after[:-1] = blank[:-1], blank[1:]
    before[first], after[last] = True, True
    starts, ends = np.flatnonzero(~blank & before), np.flatnonzero(~blank & after) + 1
    upto = np.searchsorted(starts, edge)
    ok = (np.diff(upto) == width) & _truth(pc.is_valid(lines))
    rows = np.flatnonzero(ok)
    at = upto[:-1][rows, None] + np.arange(width)
    s, e = starts[at], ends[at]
    code = data[s[:, 4:]].astype(np.int8) - np.int8(48)
    fine = ((e[:, 4:] - s[:, 4:] == 1) & (code >= 0) & (code <= 2)).all(axis=1)
    chrom = data[s[:, 0]].astype(np.int32) - 48
    fine &= (e[:, 0] - s[:, 0] == 1) & (chrom >= 1) & (chrom <= 5)
    head = [_pieces(base + s[:, k], base + e[:, k], buffer) for k in (1, 2, 3)]
    fine &= _is_number(head[1]) & _truth(pc.match_substring_regex(head[2], "^[0-9]{1,18}$"))
    ok[rows[~fine]] = False
    keep = pa.array(np.flatnonzero(fine))
    snp, cm, pos = (h.take(keep) for h in head)
    pair = code[fine].reshape(-1, 2)
    typed = (pair > 0).all(axis=1)
    values = pa.array((pair.sum(axis=1, dtype=np.int8) - np.int8(2)), pa.int8(), mask=~typed)
    m = len(keep)
    calls = pa.ListArray.from_arrays(pa.array(np.arange(m + 1) * n_indiv, pa.int32()), values)
    none = pa.nulls(m, pa.string())
    typed_rows = [ids.filter(pa.array(ok)), none, none, pa.array(chrom[fine]), snp, cm.cast(pa.float64()), pos.cast(pa.int64()), calls, none]
    return pa.Table.from_arrays(typed_rows, schema=_TPED_ARROW), ok


def _tped_line(text: str, n_indiv: int) -> dict:
    if text.endswith("\r"):
        text = text[:-1]
    fields = [f for f in re.split(r"[ \t]+", text) if f]
    if not fields:
        raise LineError("empty_line")
    if len(fields) != 4 + 2 * n_indiv:
        raise LineError("field_count", f"{len(fields)} fields, {4 + 2 * n_indiv} expected")
    chrom, snp, cm, pos, *alleles = fields
    if chrom not in ("1", "2", "3", "4", "5"):
        raise LineError("chromosome", chrom)
    if not _NUMBER.fullmatch(cm):
        raise LineError("centimorgan", cm)
    if not re.fullmatch("[0-9]+", pos):
        raise LineError("position", pos)
    for a in alleles:
        if a not in ("0", "1", "2"):
            raise LineError("allele", a)
    code = list(map(int, alleles))
    calls = [a + b - 2 if a and b else None for a, b in zip(code[::2], code[1::2])]
    short = pos.lstrip("0") or "0"
    fits = len(short) < 19 or len(short) == 19 and int(short) <= _BIGINT
    return {"chrom": int(chrom), "snp_id": snp, "cm": float(cm), "pos": int(short) if fits else None, "calls": calls, "wide": None if fits else f"position={pos}"}


# ---------------------------------------------------------------- result files


def _field_pattern(n: int, delim: str) -> str:
    """One line of n fields, quoted or not, with a named group per field."""
    d = {"\t": r"\t"}.get(delim, delim)
    return r"\A" + d.join(rf'(?P<f{k}>"(?:[^"]|"")*"|[^"{d}]*)' for k in range(n)) + r"\z"


def _columns(lines: pa.Array, n: int, delim: str) -> tuple[np.ndarray, list[pa.Array]]:
    """Which lines have n well-quoted fields, and those lines' fields by column, blanks removed."""
    quoted = _truth(pc.match_substring(lines, '"'))
    plain = np.flatnonzero(~quoted)
    split = pc.split_pattern(lines.take(pa.array(plain)), delim)
    good = _truth(pc.equal(pc.list_value_length(split), n))
    plain = plain[good]
    flat = split.filter(pa.array(good)).flatten()
    at = np.arange(len(plain)) * n
    cols = [flat.take(pa.array(at + k)) for k in range(n)]
    rows = plain
    hard = np.flatnonzero(quoted)
    if len(hard):
        found = pc.extract_regex(lines.take(pa.array(hard)), _field_pattern(n, delim))
        good = _truth(pc.is_valid(found))
        found = found.filter(pa.array(good))
        rows = np.concatenate([plain, hard[good]])
        order = pa.array(np.argsort(rows))
        for k in range(n):
            f = pc.struct_field(found, k)
            inner = pc.replace_substring(pc.utf8_slice_codeunits(f, 1, -1), '""', '"')
            f = pc.if_else(pc.starts_with(f, '"'), inner, f)
            cols[k] = pa.concat_arrays([cols[k], f.cast(pa.string())]).take(order)
        rows = np.sort(rows)
    return rows, [pc.utf8_trim(c, characters=_BLANKS) for c in cols]


def _result_block(ids: pa.Array, lines: pa.Array, names: list[str], delim: str) -> tuple[pa.Table, np.ndarray]:
    ok = np.zeros(len(lines), bool)
    rows, fields = _columns(_without_cr(lines.fill_null("")), len(names), delim)
    col = dict(zip(names, fields))
    fine = _truth(pc.is_valid(lines))[rows]
    number: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for name, to, low, high, whole, may_lack in (
        ("chromosomes", "chrom", 1, 5, True, False),
        ("positions", "pos", 1, 2.0**53, True, False),
        ("scores", "score", -np.inf, np.inf, False, False),
        ("mafs", "maf", 0, 0.5, False, True),
        ("macs", "mac", 0, 2.0**53, True, True),
        ("perc_var_expl", "perc_var_expl", -np.inf, np.inf, False, False),
    ):
        if name not in col:
            continue
        gap = _truth(pc.is_in(col[name], pa.array(["", "NA"]))) & may_lack
        numeric = _is_number(col[name])
        v = pc.if_else(pa.array(numeric), col[name], "0").cast(pa.float64()).to_numpy(zero_copy_only=False)
        fine &= gap | numeric & (v >= low) & (v <= high) & (not whole or v == np.floor(v))
        number[to] = v, gap
    ok[rows[fine]] = True
    m = int(fine.sum())
    out: dict[str, pa.Array] = {}
    for to in ("chrom", "pos", "score", "maf", "mac", "perc_var_expl"):
        kind = _RESULT_ARROW.field(to).type
        if to not in number:
            out[to] = pa.nulls(m, kind)
            continue
        v, gap = (x[fine] for x in number[to])
        out[to] = pa.array(np.where(gap, 0, v).astype(kind.to_pandas_dtype()), kind, mask=gap)
    note = col["note"].filter(pa.array(fine)) if "note" in col else pa.nulls(m, pa.string())
    none = pa.nulls(m, pa.string())
    typed_rows = [ids.filter(pa.array(ok)), none, none, out["chrom"], out["pos"], out["score"], out["maf"], out["mac"], out["perc_var_expl"], note, none]
    return pa.Table.from_arrays(typed_rows, schema=_RESULT_ARROW), ok


def split_quoted(text: str, delim: str) -> list[str]:
    """Fields of one line; raises where quoting is broken."""
    out, i, n = [], 0, len(text)
    while True:
        if i < n and text[i] == '"':
            part, j = [], i + 1
            while True:
                end = text.find('"', j)
                if end < 0:
                    raise LineError("open_quote", text[i:])
                part.append(text[j:end])
                if text[end + 1 : end + 2] == '"':
                    part.append('"')
                    j = end + 2
                    continue
                break
            out.append("".join(part))
            i = end + 1
            if i < n and text[i] != delim:
                raise LineError("text_after_quote", text[i:])
        else:
            end = text.find(delim, i)
            end = n if end < 0 else end
            field = text[i:end]
            if '"' in field:
                raise LineError("stray_quote", field)
            out.append(field)
            i = end
        if i >= n:
            return out
        i += 1


def _result_line(text: str, names: list[str], delim: str) -> dict:
    if text.endswith("\r"):
        text = text[:-1]
    if not text.strip(_BLANKS):
        raise LineError("empty_line")
    fields = split_quoted(text, delim)
    if len(fields) != len(names):
        raise LineError("field_count", f"{len(fields)} fields, {len(names)} expected")
    col = {k: v.strip(_BLANKS) for k, v in zip(names, fields)}

    def number(name: str, may_lack: bool = False) -> float | None:
        v = col[name]
        if may_lack and v in ("", "NA"):
            return None
        if not _NUMBER.fullmatch(v):
            raise LineError(name, v)
        return float(v)

    def whole(name: str, low: float, may_lack: bool = False) -> int | None:
        v = number(name, may_lack)
        if v is None:
            return None
        if v in (float("inf"), float("-inf")) or v != int(v) or v < low:
            raise LineError(name, col[name])
        if v >= 2.0**63:
            wide.append(f"{name}={col[name]}")
            return None
        return int(v)

    wide: list[str] = []
    out = {"chrom": None, "pos": None, "score": None, "maf": None, "mac": None, "perc_var_expl": None, "note": col.get("note")}
    if "chromosomes" in col:
        out["chrom"] = whole("chromosomes", 1)
        if out["chrom"] is None or out["chrom"] > 5:
            raise LineError("chromosomes", col["chromosomes"])
    if "positions" in col:
        out["pos"] = whole("positions", 1)
    if "scores" in col:
        out["score"] = number("scores")
    if "mafs" in col:
        out["maf"] = number("mafs", True)
        if out["maf"] is not None and not 0 <= out["maf"] <= 0.5:
            raise LineError("mafs", col["mafs"])
    if "macs" in col:
        out["mac"] = whole("macs", 0, True)
    if "perc_var_expl" in col:
        out["perc_var_expl"] = number("perc_var_expl")
    out["wide"] = ";".join(wide) or None
    return out


# ------------------------------------------------------------------- bisection


def isolate(ok: np.ndarray) -> list[int]:
    """Bisect a block into clean pieces and single refused lines; returns the latter."""
    refused = np.r_[0, np.cumsum(~ok)]
    single, open_ = [], [(0, len(ok))]
    while open_:
        a, b = open_.pop()
        if refused[b] == refused[a]:
            continue
        if refused[b] - refused[a] == b - a:  # nothing clean left to cut off
            single.extend(range(a, b))
            continue
        half = (a + b) // 2
        open_ += [(half, b), (a, half)]
    return single


def parse_block(ids: pa.Array, lines: pa.Array, fast, strict, schema: pa.Schema) -> list[pa.Table]:
    """Typed rows of one block, and its refused lines with the reason.

    ``fast(ids, lines)`` returns the rows it accepts and a verdict per line, or
    raises ArrowInvalid; ``strict(text)`` returns the typed values of one line or
    raises LineError.
    """
    n = len(ids)
    if n == 0:
        return []
    try:
        rows, ok = fast(ids, lines)
    except pa.ArrowInvalid:
        if n > 1:
            half = n // 2
            return [t for a, b in ((0, half), (half, n - half)) for t in parse_block(ids.slice(a, b), lines.slice(a, b), fast, strict, schema)]
        rows, ok = schema.empty_table(), np.zeros(1, bool)
    out = [rows] if rows.num_rows else []
    bad = isolate(ok)
    if bad:
        at = pa.array(bad)
        out.append(_diagnose(ids.take(at), lines.take(at), strict, schema))
    return out


def _diagnose(ids: pa.Array, lines: pa.Array, strict, schema: pa.Schema) -> pa.Table:
    rows = []
    for i, text in zip(ids.to_pylist(), lines.to_pylist()):
        row = dict.fromkeys(schema.names)
        row["line_id"] = i
        try:
            if text is None:
                raise LineError("null_line")
            row |= strict(text)
        except LineError as e:
            row |= {"reason": e.reason, "detail": e.detail}
        rows.append(row)
    return pa.Table.from_pylist(rows, schema=schema)


def _rules(kind: str, layout: str | None):
    """The block parser and the line parser of a layout."""
    if layout is None:
        return _none, _unknown
    if kind == "tped":
        n = int(layout)
        return (lambda i, t: _tped_block(i, t, n)), (lambda t: _tped_line(t, n))
    name, _, columns = layout.partition(":")
    names, d = column_names(columns), DELIMITERS[name]
    return (lambda i, t: _result_block(i, t, names, d)), (lambda t: _result_line(t, names, d))


def _none(ids: pa.Array, lines: pa.Array) -> tuple[pa.Table, np.ndarray]:
    return _TPED_ARROW.empty_table(), np.zeros(len(ids), bool)


def _unknown(text: str) -> dict:
    raise LineError("unknown_layout")


def _blocks(batches: Iterator[pa.RecordBatch], block: int, block_bytes: int) -> Iterator[tuple[str | None, pa.Array, pa.Array]]:
    """(layout, ids, lines) in blocks of one layout; what waits is bounded in lines and bytes."""
    held: dict[str | None, list[pa.RecordBatch]] = {}
    size: dict[str | None, list[int]] = {}

    def flush(layout: str | None):
        t = pa.Table.from_batches(held.pop(layout)).combine_chunks()
        del size[layout]
        for k in range(0, t.num_rows, block):
            part = t.slice(k, block)
            yield layout, part["line_id"].combine_chunks(), part["text"].combine_chunks()

    for b in batches:
        known = b.column("layout").dictionary_encode()
        code = known.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        for c in np.unique(code):
            layout = None if c < 0 else known.dictionary[int(c)].as_py()
            part = b.filter(pa.array(code == c)).select(["line_id", "text"])
            held.setdefault(layout, []).append(part)
            n = size.setdefault(layout, [0, 0])
            n[0], n[1] = n[0] + part.num_rows, n[1] + part.nbytes
        for layout in [k for k, (rows, space) in size.items() if rows >= block or space >= block_bytes]:
            yield from flush(layout)
        while sum(rows for rows, _ in size.values()) > 4 * block or sum(space for _, space in size.values()) > 4 * block_bytes:
            yield from flush(max(size, key=lambda k: size[k][1]))
    for layout in list(held):
        yield from flush(layout)


def parse_lines(
    lines: DataFrame, layouts: DataFrame, kind: str, id_col: str = "line_id", text_col: str = "raw_snps",
    layout_col: str = "layout_id", block: int = 8192, block_bytes: int = 16 << 20,
) -> DataFrame:
    """Every line as one row: typed values where it is valid, else the reason.

    kind: ``tped`` or ``result``. block, block_bytes: lines and bytes of one
    layout that are gathered and parsed at once.
    The layout table is joined, so Spark broadcasts it only while it is small.
    """
    schema, ddl = (_TPED_ARROW, TPED_SCHEMA) if kind == "tped" else (_RESULT_ARROW, RESULT_SCHEMA)
    rules = F.col("n_indiv").cast("string") if kind == "tped" else F.when(F.col("delim").isin(*DELIMITERS), F.concat_ws(":", "delim", F.coalesce("col_names", F.lit(""))))
    spec = layouts.select(F.col("layout_id").alias("_layout"), F.when(F.col("file_kind") == kind, rules).alias("layout")).dropDuplicates(["_layout"])
    src = lines.select(F.col(id_col).cast("long").alias("line_id"), F.col(layout_col).alias("_l"), F.col(text_col).alias("text"))
    joined = src.join(spec, F.col("_l") == F.col("_layout"), "left").select("line_id", "layout", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for layout, ids, text in _blocks(batches, block, block_bytes):
            fast, strict = _rules(kind, layout)
            for t in parse_block(ids, text, fast, strict, schema):
                yield from t.combine_chunks().to_batches()

    return joined.mapInArrow(run, ddl)


def valid_rows(parsed: DataFrame) -> DataFrame:
    """The typed rows of parse_lines."""
    return parsed.filter(F.col("reason").isNull()).drop("reason", "detail")


def rejected_rows(parsed: DataFrame) -> DataFrame:
    """The rejected lines of parse_lines with reason and detail."""
    return parsed.filter(F.col("reason").isNotNull()).select("line_id", "reason", "detail")
