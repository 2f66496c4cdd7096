"""Percentiles of very large columns from mergeable rank-interval summaries.

A summary holds tuples (v, g, d): value, gap to the previous tuple's least rank,
and width of the rank interval, so that the least rank of a tuple is the running
sum of g and its greatest rank that plus d. Nothing is random: the same rows in
the same partitions give the same summary, and any two summaries merge.

The uncertainty of a tuple is g + d. Merging adds rank intervals exactly: if no
tuple of any part exceeds a share of its own n, none of the merged summary exceeds
that share of the merged n. Only compression adds uncertainty, and it drops a tuple
only where the one that takes over its rank stays within the permitted share of
the merged n. That share depends on how often a summary was merged: a summary of
``level`` merges may use eps * (1 - 1 / (level + 2)) on each side, so every
merge has some left to spend and no tree of merges, however deep or lopsided, ever
spends more than eps. Tuples per summary grow with the square of the level.

Building: each partition is sorted by group and value block by block and each
group's tuples are compressed; parts of large groups are merged within the
partition before anything is shuffled. Merging is hierarchical with a fixed fan-in:
as soon as ``fan_in`` parts of a group are in memory they become one, and those
become one again.

The guarantee: the value reported for a quantile has a rank within ``rank_error``
of the true one, and rank_error is at most eps * n (the largest eps merged).

Defined cases: NULL and NaN never count (other bounds are the caller's filter);
infinities are values; equal values share ranks in any order; a NULL key forms a
group of its own; groups without values have no summary; an empty table gives
none; repeated rows count as often as they occur; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SUMMARY = [
    T.StructField("n", T.LongType()),
    T.StructField("eps", T.DoubleType()),
    T.StructField("level", T.IntegerType()),
    T.StructField("v", T.ArrayType(T.DoubleType())),
    T.StructField("g", T.ArrayType(T.LongType())),
    T.StructField("d", T.ArrayType(T.LongType())),
]


def group_codes(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """Group number per row, in order of first appearance, and a row of each group."""
    code = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        d = c.dictionary_encode()
        part = d.indices.fill_null(len(d.dictionary)).to_numpy(zero_copy_only=False)
        code = code * (len(d.dictionary) + 1) + part
        _, code = np.unique(code, return_inverse=True)
    _, at, code = np.unique(code, return_index=True, return_inverse=True)
    return code, at


def merge_tuples(group: np.ndarray, part: np.ndarray, v: np.ndarray, g: np.ndarray, d: np.ndarray):
    """Merge the summaries of each group, all groups at once.

    Rows are tuples in order within each (group, part). Returns tuples sorted by
    group and value with exact sums of rank bounds.
    """
    m = len(v)
    new = np.r_[True, (group[1:] != group[:-1]) | (part[1:] != part[:-1])] if m else np.zeros(0, bool)
    start = np.flatnonzero(new)
    size = np.diff(np.r_[start, m])
    total = np.cumsum(g)
    low = total - np.repeat(total[start] - g[start], size)
    high = low + d
    end = start + size - 1
    # upper bound on the rank of what follows each tuple within its own summary
    after = np.empty(m, np.int64)
    after[:-1] = high[1:] - 1
    after[end] = low[end]
    rise = after - (high - 1)
    order = np.lexsort((np.arange(m), part, v, group))
    sg = group[order]
    gstart = np.flatnonzero(np.r_[True, sg[1:] != sg[:-1]]) if m else np.zeros(0, np.int64)
    gsize = np.diff(np.r_[gstart, m])

    def running(x: np.ndarray) -> np.ndarray:
        s = np.cumsum(x)
        return s - np.repeat(s[gstart] - x[gstart], gsize)

    base = np.add.reduceat((np.where(new, high - 1, 0))[order], gstart) if m else np.zeros(0, np.int64)
    low_all = running(g[order])
    up_all = np.repeat(base, gsize) + running(rise[order])
    high_all = high[order] + up_all - after[order]
    g_out = low_all.copy()
    g_out[1:] -= low_all[:-1]
    g_out[gstart] = low_all[gstart]
    return sg, v[order], g_out, high_all - low_all


def permitted(n: np.ndarray, eps: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Greatest g + d of a summary of n values after ``level`` merges."""
    return np.floor(2 * n * eps * (1 - 1 / (level + 2))).astype(np.int64)


def compress(group: np.ndarray, v: np.ndarray, g: np.ndarray, d: np.ndarray, most: np.ndarray):
    """Drop tuples as long as g + d of those that are left stays within ``most``.

    most: per group number. The first and last tuple of a group stay, and what
    already exceeds ``most`` stays as it is.
    """
    m = len(v)
    if not m:
        return group, v, g, d
    new = np.r_[True, group[1:] != group[:-1]]
    start = np.flatnonzero(new)
    size = np.diff(np.r_[start, m])
    total = np.cumsum(g)
    low = total - np.repeat(total[start] - g[start], size)
    which = np.arange(len(start))
    able = (most[group[start]] >= 2) & (size > 2)
    if not able.any():
        return group, v, g, d
    keep = ~np.repeat(able, size)
    # a tuple may take over all those after the first whose least rank is at least this far
    room = np.repeat(most[group[start]], size)
    offset = np.cumsum(np.r_[0, low[start + size - 1][:-1] + 1])
    axis = low + np.repeat(offset, size)
    first = np.repeat(start, size)
    back = np.searchsorted(axis, np.maximum(low + d - room, 0) + np.repeat(offset, size), "left")
    back = np.minimum(np.maximum(back, first), np.arange(m) - 1)
    at = (start + size - 1)[which[able]]
    while len(at):
        keep[at] = True
        at = back[at[at > first[at]]]
    left = np.flatnonzero(keep)
    lk, gk = low[left], group[left]
    g_out = lk.copy()
    g_out[1:] -= np.where(gk[1:] == gk[:-1], lk[:-1], 0)
    return gk, v[left], g_out, d[left]


def _lists(keys: list[pa.Array], at: np.ndarray, names: list[str], group, v, g, d, eps: np.ndarray, level: np.ndarray) -> pa.RecordBatch:
    count = np.bincount(group, minlength=len(at))
    offsets = pa.array(np.r_[0, np.cumsum(count)], pa.int32())
    n = np.zeros(len(at), np.int64)
    np.add.at(n, group, g)
    pick = pa.array(at)
    arrays = [k.take(pick) for k in keys]
    arrays += [pa.array(n), pa.array(eps), pa.array(level, pa.int32())]
    arrays += [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (v, g, d)]
    return pa.RecordBatch.from_arrays(arrays, names)


PART = ["n", "eps", "level", "v", "g", "d"]


def merge_parts(t: pa.Table, keys: list[str]) -> pa.RecordBatch:
    """One summary per group of the rows, in whatever order they come."""
    t = t.combine_chunks()
    cols = [t[k].combine_chunks() for k in keys]
    group, at = group_codes(cols)
    parts = np.bincount(group, minlength=len(at))
    eps, level = np.zeros(len(at)), np.zeros(len(at), np.int64)
    np.maximum.at(eps, group, t["eps"].to_numpy())
    np.maximum.at(level, group, t["level"].to_numpy())
    level += parts > 1
    lists = t["v"].combine_chunks()
    size = np.diff(lists.offsets.to_numpy())
    order = np.argsort(group, kind="stable")
    row = np.repeat(np.arange(len(size)), size)
    v, g, d = (t[c].combine_chunks().flatten().to_numpy() for c in ("v", "g", "d"))
    if (np.diff(group) < 0).any():
        rank = np.empty(len(size), np.int64)
        rank[order] = np.arange(len(size))
        o = np.argsort(rank[row], kind="stable")
        row, v, g, d = row[o], v[o], g[o], d[o]
    of, v, g, d = merge_tuples(group[row], row, v, g, d)
    n = np.zeros(len(at), np.int64)
    np.add.at(n, group, t["n"].to_numpy())
    most = np.where(parts > 1, permitted(n, eps, level), 0)
    return _lists(cols, at, [*keys, *PART], *compress(of, v, g, d, most), eps, level)


def _tuples(t: pa.Table | pa.RecordBatch) -> int:
    return pc.sum(pc.list_value_length(t["v"])).as_py() or 0


def _leaf(keys: list[str], value: str, eps: float, block: int, hold: int):
    names = [*keys, *PART]

    def summary(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        cols = [t[k].combine_chunks() for k in keys]
        v = t[value].to_numpy()
        group, at = group_codes(cols)
        order = np.lexsort((v, group))
        group, v = group[order], v[order]
        n = np.bincount(group, minlength=len(at))
        one, zero = np.ones(len(v), np.int64), np.zeros(len(at), np.int64)
        share = np.full(len(at), eps)
        return _lists(cols, at, names, *compress(group, v, one, one * 0, permitted(n, share, zero)), share, zero)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        large: list[pa.RecordBatch] = []
        waiting = 0

        def blocks() -> Iterator[pa.RecordBatch]:
            nonlocal held, rows
            for b in batches:
                held.append(b)
                rows += b.num_rows
                if rows >= block:
                    yield summary(held)
                    held, rows = [], 0
            if rows:
                yield summary(held)

        for s in blocks():
            # a group that was compressed will come again: its parts are merged here
            big = pc.less(pc.cast(pc.list_value_length(s["v"]), pa.int64()), s["n"])
            yield s.filter(pc.invert(big))
            part = s.filter(big)
            if part.num_rows:
                large.append(part)
                waiting += _tuples(part)
            if waiting >= hold:
                yield merge_parts(pa.Table.from_batches(large), keys)
                large, waiting = [], 0
        if large:
            yield merge_parts(pa.Table.from_batches(large), keys)

    return run


def _merge(keys: list[str], fan_in: int, hold: int):
    """Merge streams sorted by keys."""

    def group_starts(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        for k in keys:
            part = t[k].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            new[1:] |= part[1:] != part[:-1]
        return np.flatnonzero(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: pa.Table | None = None  # merged parts of the group still open
        held: list[pa.RecordBatch] = []
        rows = tuples = 0

        def gathered() -> pa.Table:
            return pa.Table.from_batches(held).combine_chunks()

        for b in batches:
            held.append(b)
            rows, tuples = rows + b.num_rows, tuples + _tuples(b)
            if rows < fan_in and tuples < hold:
                continue
            t = gathered()
            if done is not None:
                t = pa.concat_tables([done, t]).combine_chunks()
                done = None
            starts = group_starts(t)
            cut = int(starts[-1]) if len(starts) else 0
            if cut:
                yield merge_parts(t.slice(0, cut), keys)
            t = t.slice(cut)
            # nothing but parts of one group is left; a full load of them becomes one part
            if t.num_rows >= fan_in or _tuples(t) >= hold and t.num_rows > 1:
                done, held = pa.Table.from_batches([merge_parts(t, keys)]), []
            else:
                held = t.combine_chunks().to_batches()
            rows, tuples = sum(x.num_rows for x in held), sum(map(_tuples, held))
        rest = [x for x in (done, gathered() if rows else None) if x is not None]
        if rest:
            yield merge_parts(pa.concat_tables(rest), keys)

    return run


def _schema(df: DataFrame, keys: list[str], extra: list[T.StructField] = []) -> T.StructType:
    return T.StructType([df.schema[k] for k in keys] + extra + SUMMARY)


def merge_summaries(summaries: DataFrame, keys: list[str], slices: int = 1, fan_in: int = 4096, hold: int = 2_000_000) -> DataFrame:
    """One summary per group of ``keys`` from summaries of finer groups or parts.

    slices: more than 1 merges each group first within so many slices of the
    partitions, so that no group with very many parts comes to one task; fan_in,
    hold: parts and tuples a task holds before it merges them.
    """
    df = summaries.select(*keys, *PART)
    # parts of a group in an order that doesn't hang on which came first
    order = [F.col("n"), F.xxhash64("v")]
    if slices > 1:
        df = df.withColumn("_slice", F.pmod(F.spark_partition_id(), F.lit(slices)))
        by = [*keys, "_slice"]
        df = df.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(_merge(by, fan_in, hold), _schema(df, by))
    df = df.select(*keys, *PART).repartition(*keys).sortWithinPartitions(*keys, *order)
    return df.mapInArrow(_merge(keys, fan_in, hold), _schema(df, keys))


def summarize(df: DataFrame, keys: list[str], value: str, eps: float = 0.005, slices: int = 1, block: int = 200_000, hold: int = 2_000_000) -> DataFrame:
    """One summary per group: keys, n, eps, level, v, g, d.

    eps: permitted rank error as a share of n; block: rows sorted at once in a
    partition; hold: tuples of large groups a partition keeps to merge them.
    """
    if not 0 < eps < 1:
        raise ValueError("eps must lie between 0 and 1")
    rows = df.select(*keys, F.col(value).cast("double").alias("_x")).filter(F.col("_x").isNotNull() & ~F.isnan("_x"))
    leaves = rows.mapInArrow(_leaf(keys, "_x", eps, block, hold), _schema(rows, keys))
    return merge_summaries(leaves, keys, slices, hold=hold)


def _answers(keys: list[str], probs: list[float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v_list = b.column("v")
            size = np.diff(v_list.offsets.to_numpy())
            v, g, d = (b.column(c).flatten().to_numpy() for c in ("v", "g", "d"))
            start = np.r_[0, np.cumsum(size)[:-1]]
            n = b.column("n").to_numpy()
            row = np.repeat(np.arange(len(n)), size)
            total = np.cumsum(g)
            low = total - np.repeat(total[start] - g[start], size)
            high = low + d
            err = np.zeros(len(n), np.int64)
            out = [b.column(k) for k in keys] + [pa.array(n)]
            place = np.arange(len(v))
            for p in probs:
                want = np.clip(np.ceil(p * n), 1, n).astype(np.int64)
                off = np.maximum(high - want[row], want[row] - low)
                least = np.minimum.reduceat(off, start)
                best = np.minimum.reduceat(np.where(off == least[row], place, len(v)), start)
                out.append(pa.array(v[best]))
                err = np.maximum(err, least)
            out.append(pa.array(err))
            yield pa.RecordBatch.from_arrays(out, [*keys, "n", *[f"p{round(100 * p):02d}" for p in probs], "rank_error"])

    return run


def percentiles(summaries: DataFrame, keys: list[str], probs: list[float]) -> DataFrame:
    """keys, n, one column pNN per probability, rank_error (in ranks).

    The value of probability p is that of rank ceil(p * n); the tuple whose rank
    interval lies nearest is reported, and rank_error is the greatest distance
    from the rank wanted to the far end of its interval.
    """
    fields = [summaries.schema[k] for k in keys] + [T.StructField("n", T.LongType())]
    fields += [T.StructField(f"p{round(100 * p):02d}", T.DoubleType()) for p in probs] + [T.StructField("rank_error", T.LongType())]
    return summaries.select(*keys, "n", "v", "g", "d").mapInArrow(_answers(keys, probs), T.StructType(fields))
