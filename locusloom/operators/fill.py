"""Filling missing calls and counts along the position axis of each panel.

The entity is one call batch on one chromosome; its markers, ordered by position,
are the time axis. Counts are interpolated between the observed neighbours. Calls
are carried from the nearest observed marker of the same chip if that lies within
``gap_limit`` bases, else taken from the most frequent call of the same marker.
Each filled value has its method and its distance.

An entity may be arbitrarily large, so one of more than ``segment_rows`` markers is
cut into segments of about that many (by its own mean spacing). A segment takes the
nearest observation of each chip on either side with it, as the few markers that
hold them: they are found by a walk over the outermost observations of all segments.

Defined cases: a NULL or empty ``raw_snps`` stays as it is; a row without any
observed call keeps its gaps (nothing of its own supports a value); NULL batch
or chromosome forms a group of its own; a position that is NULL or below 1 is
unknown: such a row is filled from its own calls and from the entity's first
observed count, and others take from it only if no placed row has one; markers at
one position are ordered by id; repeated rows are filled alike; a NULL data format
permits only 0 and 1; other columns pass through the caller's join, none is needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OBSERVED, CARRIED_BACKWARD, CARRIED_FORWARD, MODE = 0, 1, 2, 3
METHOD_NAMES = {OBSERVED: "observed", CARRIED_BACKWARD: "next_marker", CARRIED_FORWARD: "previous_marker", MODE: "marker_mode"}
_GAP = np.int8(-128)
_CALLS_DDL = "marker_id long, calls array<tinyint>, call_method array<tinyint>, call_distance array<long>"


#: Segments over which rows of unknown position are spread.
_LOOSE = 64


def _with_segment(genotypes: DataFrame, rows: int) -> DataFrame:
    """Key columns k, c, the segment, whether the entity has several, and pos as NULL where unknown."""
    base = genotypes.select(
        "marker_id",
        F.coalesce(F.concat(F.lit("b"), "call_batch"), F.lit("")).alias("k"),
        F.coalesce("chrom", F.lit(-(2**31))).alias("c"),
        F.when(F.col("pos") > 0, F.col("pos")).alias("pos"), "data_format", "raw_snps", "n_typed", "missing_counts",
    )
    span = base.groupBy("k", "c").agg(F.count("pos").alias("_n"), F.min("pos").alias("_low"), F.max("pos").alias("_high")).filter(F.col("_n") > rows)
    width = F.ceil((F.col("_high") - F.col("_low") + 1) * F.lit(float(rows)) / F.col("_n"))
    large = span.select("k", "c", "_low", width.alias("_width"))
    where = F.when(F.col("pos").isNull(), -1 - F.pmod(F.xxhash64("marker_id"), F.lit(_LOOSE))).otherwise(F.coalesce(F.floor((F.col("pos") - F.col("_low")) / F.col("_width")), F.lit(0)))
    return base.join(large, ["k", "c"], "left").withColumn("seg", where.cast("long")).withColumn("several", F.col("_width").isNotNull() & F.col("pos").isNotNull()).drop("_low", "_width")


# ---------------------------------------------------------------------- calls


def _matrix(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Calls as rows of equal width (gaps and padding -128), and the lengths."""
    lengths = np.diff(lists.offsets.to_numpy())
    flat = lists.values.slice(lists.offsets[0].as_py(), int(lengths.sum())).fill_null(int(_GAP)).to_numpy()
    out = np.full((len(lengths), max(1, lengths.max(initial=0))), _GAP, np.int8)
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out, lengths


def fill_block(entity: np.ndarray, pos: np.ndarray, calls: np.ndarray, lengths: np.ndarray, top: np.ndarray, gap_limit: int):
    """Fill one block of rows sorted by entity and position.

    entity: code per row; pos: position or -1 where unknown; calls: int8 matrix;
    top: largest permitted code per row. Returns values (-128 where unfilled),
    methods (-1 where unfilled) and distances (-1 where none).
    """
    n, width = calls.shape
    inside = np.arange(width) < lengths[:, None]
    seen = inside & (calls >= 0) & (calls <= top[:, None])
    start = np.r_[True, entity[1:] != entity[:-1]] if n else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(start, np.arange(n), 0))
    end = np.r_[start[1:], True] if n else start
    last = np.minimum.accumulate(np.where(end, np.arange(n), n)[::-1])[::-1]
    placed = pos >= 0
    source = seen & placed[:, None]
    rows = np.arange(n)[:, None]
    before = np.maximum.accumulate(np.where(source, rows, -1), axis=0)
    after = np.minimum.accumulate(np.where(source, rows, n)[::-1], axis=0)[::-1]
    far = np.int64(2**62)

    def reach(at: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = ok & placed[:, None]
        at = np.where(ok, at, 0)
        d = np.where(ok, np.abs(pos[:, None] - pos[at]), far)
        value = np.take_along_axis(calls, at, axis=0)
        return value, np.where((d <= gap_limit) & (value <= top[:, None]), d, far)

    pv, pd_ = reach(before, before >= first[:, None])
    nv, nd = reach(after, after <= last[:, None])
    counts = np.stack([((calls == g) & seen).sum(axis=1) for g in (0, 1, 2)], axis=1)
    mode = counts.argmax(axis=1).astype(np.int8)
    has = counts.any(axis=1)
    gap = inside & ~seen & has[:, None]
    method = np.where(seen, OBSERVED, -1).astype(np.int8)
    value = np.where(seen, calls, _GAP)
    distance = np.where(seen, 0, np.int64(-1))
    use_prev = gap & (pd_ < far) & (pd_ <= nd)
    use_next = gap & (nd < far) & ~use_prev
    use_mode = gap & ~use_prev & ~use_next
    value = np.where(use_prev, pv, np.where(use_next, nv, np.where(use_mode, mode[:, None], value)))
    method[use_prev], method[use_next], method[use_mode] = CARRIED_FORWARD, CARRIED_BACKWARD, MODE
    distance = np.where(use_prev, pd_, np.where(use_next, nd, distance))
    return value, method, distance


def _as_lists(m: np.ndarray, lengths: np.ndarray, none: int, kind: pa.DataType) -> pa.Array:
    flat = m[np.arange(m.shape[1]) < lengths[:, None]]
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)], pa.int32()), pa.array(flat, kind, mask=flat == none))


def _fill_rows(t: pa.Table, gap_limit: int) -> pa.RecordBatch:
    t = t.combine_chunks()
    new = np.zeros(t.num_rows, np.int64)
    for x in ("k", "c", "seg"):
        col = t[x].combine_chunks()
        new[1:] |= pc.not_equal(col.slice(1), col.slice(0, len(col) - 1)).to_numpy(zero_copy_only=False)
    entity = np.cumsum(new)
    pos = t["pos"].fill_null(-1).to_numpy()
    top = _top(t["data_format"].combine_chunks())
    lists = t["raw_snps"].combine_chunks()
    calls, lengths = _matrix(lists)
    value, method, distance = fill_block(entity, pos, calls, lengths, top, gap_limit)
    own = t["own"].to_numpy()
    keep = np.flatnonzero(own)
    out = [t["marker_id"].combine_chunks().take(pa.array(keep))]
    for m, none, kind in ((value, int(_GAP), pa.int8()), (method, -1, pa.int8()), (distance, -1, pa.int64())):
        out.append(_as_lists(m[keep], lengths[keep], none, kind))
    return pa.RecordBatch.from_arrays(out, ["marker_id", "calls", "call_method", "call_distance"])


_ROW_DDL = "marker_id long, k string, c int, seg long, pos long, data_format string, raw_snps array<tinyint>"


def _top(formats: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.where(pc.fill_null(pc.equal(formats, "diploid_int"), False).to_numpy(zero_copy_only=False), 2, 1).astype(np.int8)


def _outermost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch the rows that hold the first or last observation of some chip in their segment."""
    for b in batches:
        if not b.num_rows:
            continue
        b = b.take(pc.sort_indices(b.select(["k", "c", "seg", "pos", "marker_id"]), [(x, "ascending") for x in ("k", "c", "seg", "pos", "marker_id")]))
        calls, lengths = _matrix(b.column("raw_snps"))
        seen = (np.arange(calls.shape[1]) < lengths[:, None]) & (calls >= 0) & (calls <= _top(b.column("data_format"))[:, None])
        n = b.num_rows
        new = np.zeros(n, bool)
        new[0] = True
        for x in ("k", "c", "seg"):
            col = b.column(x)
            new[1:] |= pc.not_equal(col.slice(1), col.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        start = np.flatnonzero(new)
        rows = np.arange(n)[:, None]
        first = np.minimum.reduceat(np.where(seen, rows, n), start, axis=0)
        last = np.maximum.reduceat(np.where(seen, rows, -1), start, axis=0)
        keep = np.unique(np.r_[first[first < n], last[last >= 0]])
        if len(keep):
            yield b.take(pa.array(keep))


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Gives each segment the rows before it, in the order of the stream, that hold the latest observation of some chip."""
    key: tuple | None = None
    held: list[dict] = []  # rows in order
    latest: dict[int, int] = {}  # chip -> number of the row
    number = 0
    out: list[dict] = []
    for b in batches:
        calls, lengths = _matrix(b.column("raw_snps"))
        seen = (np.arange(calls.shape[1]) < lengths[:, None]) & (calls >= 0) & (calls <= _top(b.column("data_format"))[:, None])
        for i, row in enumerate(b.to_pylist()):
            now = row["k"], row["c"], row["seg"]
            if key is None or now[:2] != key[:2]:
                held, latest, number = [], {}, 0
            elif now != key:
                used = set(latest.values())
                held = [r for r in held if r["_no"] in used]
                out += [{**r, "seg": row["seg"]} for r in held]
            key = now
            number += 1
            latest.update(dict.fromkeys(np.flatnonzero(seen[i]).tolist(), number))
            held.append({**row, "_no": number})
            if len(held) > 4096:
                used = set(latest.values())
                held = [r for r in held if r["_no"] in used]
        if out:
            yield pa.RecordBatch.from_pylist([{x: r[x] for x in b.schema.names} for r in out], schema=b.schema)
            out = []


def _call_stream(gap_limit: int, least_rows: int):
    """Fills whole segments together as soon as ``least_rows`` rows of them are there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, last = 0, None
        for b in batches:
            if not b.num_rows:
                continue
            where = [b.column(c) for c in ("k", "c", "seg")]
            end = tuple(c[-1].as_py() for c in where)
            if rows >= least_rows:
                # rows of the batch that still belong to the segment held last
                same = pc.and_(pc.and_(*(pc.equal(c, x) for c, x in zip(where[:2], last))), pc.equal(where[2], last[2])).to_numpy(zero_copy_only=False)
                cut = int(same.sum())
                if cut < b.num_rows:
                    yield _fill_rows(pa.Table.from_batches([*held, b.slice(0, cut)]), gap_limit)
                    held, rows, b = [], 0, b.slice(cut)
            held.append(b)
            rows, last = rows + b.num_rows, end
        if rows:
            yield _fill_rows(pa.Table.from_batches(held), gap_limit)

    return run


def fill_calls(genotypes: DataFrame, gap_limit: int = 10_000_000, segment_rows: int = 4096, least_rows: int = 4096) -> DataFrame:
    """(marker_id, calls, call_method, call_distance), one row per marker with calls.

    gap_limit: bases over which a call may be carried; segment_rows: markers of an
    entity that are filled as one; least_rows: rows gathered before whole segments
    are filled together. The default limit suits sparse panels, in which the next
    observed marker of a chip lies within 10 Mb for some 95 of 100 gaps.
    """
    base = _with_segment(genotypes.filter(F.col("raw_snps").isNotNull()), segment_rows)
    rows = base.select("marker_id", "k", "c", "seg", "pos", "data_format", "raw_snps")
    edges = base.filter("several").select(rows.columns).mapInArrow(_outermost, _ROW_DDL)
    walks = [
        edges.repartition("k", "c").sortWithinPartitions("k", "c", *[F.col(x).asc() if up else F.col(x).desc() for x in ("seg", "pos", "marker_id")]).mapInArrow(_walk, _ROW_DDL)
        for up in (True, False)
    ]
    spread = rows.withColumn("own", F.lit(True))
    for w in walks:
        spread = spread.unionByName(w.withColumn("own", F.lit(False)))
    ordered = spread.repartition("k", "c", "seg").sortWithinPartitions("k", "c", "seg", "pos", "marker_id")
    return ordered.mapInArrow(_call_stream(gap_limit, least_rows), _CALLS_DDL)


# --------------------------------------------------------------------- counts


def fill_counts(genotypes: DataFrame, segment_rows: int = 4096) -> DataFrame:
    """(marker_id, missing_counts, count_method, count_distance), one row per marker.

    A count is missing if NULL, negative or above n_typed. method: observed,
    interpolated, previous_marker, next_marker, first_observed (a row of unknown
    position, or an entity whose only observed rows have none: the entity's first
    observed count, by position, then id, unknown positions last), or NULL where
    the entity has no observed count. Interpolated values are clipped to n_typed.
    """
    base = _with_segment(genotypes, segment_rows).drop("raw_snps", "data_format")
    value = F.col("missing_counts").cast("double")
    good = F.coalesce((F.col("missing_counts") >= 0) & (F.col("missing_counts") <= F.coalesce("n_typed", F.lit(2**31 - 1))), F.lit(False))
    base = base.withColumn("obs", F.when(good, F.struct(F.col("pos").alias("p"), value.alias("v"))))
    placed = F.col("pos").isNotNull()
    source = F.when(placed, F.col("obs"))
    here = Window.partitionBy("k", "c", "seg").orderBy("pos", "marker_id")
    near = base.select(
        "*",
        F.last(source, ignorenulls=True).over(here.rowsBetween(Window.unboundedPreceding, -1)).alias("prev_in"),
        F.first(source, ignorenulls=True).over(here.rowsBetween(1, Window.unboundedFollowing)).alias("next_in"),
    )
    order = F.struct("pos", "marker_id")
    observed = base.filter("obs is not null")
    edges = observed.filter(placed).groupBy("k", "c", "seg").agg(F.min_by("obs", order).alias("first_obs"), F.max_by("obs", order).alias("last_obs"))
    # every segment with rows of a large entity, so that those without an observation look outside too
    segments = base.filter("several").select("k", "c", "seg").distinct().join(edges, ["k", "c", "seg"], "left")
    along = Window.partitionBy("k", "c").orderBy("seg")
    outside = segments.select(
        "k", "c", "seg",
        F.last("last_obs", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("prev_out"),
        F.first("first_obs", ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing)).alias("next_out"),
    )
    least = observed.groupBy("k", "c").agg(F.min_by("obs", F.struct(F.col("pos").isNull().alias("u"), "pos", "marker_id")).alias("least_obs"))
    full = near.join(outside, ["k", "c", "seg"], "left").join(least, ["k", "c"], "left")
    full = full.withColumn("a", F.when(placed, F.coalesce("prev_in", "prev_out"))).withColumn("b", F.when(placed, F.coalesce("next_in", "next_out")))
    da, db = F.col("pos") - F.col("a.p"), F.col("b.p") - F.col("pos")
    between = F.when(da + db > 0, F.col("a.v") + (F.col("b.v") - F.col("a.v")) * da / (da + db)).otherwise((F.col("a.v") + F.col("b.v")) / 2)
    a, b = F.col("a").isNotNull(), F.col("b").isNotNull()
    method = (
        F.when(F.col("obs").isNotNull(), "observed").when(a & b, "interpolated").when(a, "previous_marker").when(b, "next_marker")
        .when(F.col("least_obs").isNotNull(), "first_observed")
    )
    by = lambda *cases: F.coalesce(*[F.when(method == m, x) for m, x in cases])
    filled = by(("observed", value), ("interpolated", between), ("previous_marker", F.col("a.v")), ("next_marker", F.col("b.v")), ("first_observed", F.col("least_obs.v")))
    distance = by(("observed", F.lit(0).cast("long")), ("interpolated", F.least(da, db)), ("previous_marker", da), ("next_marker", db))
    return full.select("marker_id", F.when(method.isNotNull(), F.least(filled, F.col("n_typed").cast("double"))).alias("missing_counts"), method.alias("count_method"), distance.alias("count_distance"))


def fill_genotypes(genotypes: DataFrame, gap_limit: int = 10_000_000, segment_rows: int = 4096) -> DataFrame:
    """All columns of the table with calls and counts filled, each fill marked.

    ``raw_snps`` and ``missing_counts`` are replaced; call_method, call_distance,
    count_method and count_distance are added (columns of these names are
    replaced). marker_id must be unique.
    """
    calls = fill_calls(genotypes, gap_limit, segment_rows)
    counts = fill_counts(genotypes, segment_rows).withColumnRenamed("missing_counts", "_filled_count")
    added = ("call_method", "call_distance", "count_method", "count_distance", "calls")
    keep = [c for c in genotypes.columns if c not in added]
    out = genotypes.select(*keep).join(calls, "marker_id", "left").join(counts, "marker_id", "left")
    return out.select(
        *[F.col(c) for c in keep if c not in ("raw_snps", "missing_counts")],
        F.col("calls").alias("raw_snps"), F.col("_filled_count").alias("missing_counts"),
        "call_method", "call_distance", "count_method", "count_distance",
    )


def filled_slots(calls: DataFrame, counts: DataFrame) -> DataFrame:
    """(marker_id, slot) of every filled value: slot of the call, -1 for the count."""
    a = calls.select("marker_id", F.posexplode("call_method").alias("slot", "m")).filter("m > 0").select("marker_id", "slot")
    b = counts.filter(F.col("count_method") != "observed").select("marker_id", F.lit(-1).alias("slot"))
    return a.unionByName(b)


def methods(calls: DataFrame, counts: DataFrame) -> DataFrame:
    """(what, method, n_values, mean_distance): how values were filled, what is observed and what stayed open."""
    names = F.create_map(*[F.lit(x) for k, v in METHOD_NAMES.items() for x in (k, v)])
    c = calls.select(F.explode(F.arrays_zip("call_method", "call_distance")).alias("z")).select(
        F.lit("calls").alias("what"), F.coalesce(F.try_element_at(names, F.col("z.call_method").cast("int")), F.lit("open")).alias("method"), F.col("z.call_distance").alias("distance")
    )
    n = counts.select(F.lit("missing_counts").alias("what"), F.coalesce("count_method", F.lit("open")).alias("method"), F.col("count_distance").alias("distance"))
    return c.unionByName(n).groupBy("what", "method").agg(F.count("*").alias("n_values"), F.avg("distance").alias("mean_distance"))
