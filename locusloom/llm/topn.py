"""The best N items of every group by secondary sort, without holding a group.

Rows are sorted within partitions by group, score, position and identifier, and
Arrow batches are streamed through a filter that keeps the first N items of each
group and remembers only those. The filter runs twice: over the partitions as
they are read, so that a huge group, spread over many of them, shrinks to at
most N items per partition before any shuffle, and after hash-partitioning by
group.

Defined cases: rows with a NULL item or score, or a NaN score, never count; a
NULL group column forms a group of its own; an item counts once, by its highest
score, then smallest identifier; ties go to the smaller item; infinities are
scores; fewer items than N are all kept; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _codes(columns: list[pa.Array]) -> np.ndarray:
    """True where a row starts a new group; NULLs equal each other."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    for c in columns:
        ok = c.is_valid().to_numpy(zero_copy_only=False)
        if pa.types.is_string(c.type) or pa.types.is_large_string(c.type):
            v = c.dictionary_encode().indices.fill_null(-1).to_numpy()
        else:
            v = pc.fill_null(c, 0).to_numpy(zero_copy_only=False)
        new[1:] |= (v[1:] != v[:-1]) | (ok[1:] != ok[:-1])
    return new


class FirstN:
    """Keeps the first n distinct items of each group in rows sorted by group."""

    def __init__(self, groups: list[str], item: str, n: int):
        self.groups, self.item, self.n = groups, item, n
        self.key: tuple | None = None
        self.held: list = []

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.take(pa.array(self.keep(b)))

    def keep(self, b: pa.RecordBatch) -> np.ndarray:
        columns = [b.column(c) for c in self.groups]
        item = b.column(self.item).to_numpy(zero_copy_only=False)
        new = _codes(columns)
        group = np.cumsum(new)
        first_key = tuple(c[0].as_py() for c in columns)
        carried = self.held if first_key == self.key else []
        # only a group's first rows can be kept unless items repeat, so rows are taken in rounds
        start = np.flatnonzero(np.r_[True, new[1:]])
        size = np.diff(np.r_[start, len(item)])
        rank = np.arange(len(item)) - np.repeat(start, size)
        done = np.zeros(len(start), bool)
        kept = [[] for _ in range(2)]
        taken = np.zeros(len(start), np.int64)
        taken[0] = len(carried)
        low = np.zeros(len(start), np.int64)
        seen_group, seen_item = np.zeros(len(carried), np.int64), np.array(carried, item.dtype)
        while True:
            done |= (taken >= self.n) | (low >= size)
            if done.all():
                break
            reach = low + np.maximum(4 * (self.n - taken), 16)
            at = np.flatnonzero((~done[group]) & (rank >= low[group]) & (rank < reach[group]))
            g, x = np.r_[seen_group, group[at]], np.r_[seen_item, item[at]]
            order = np.lexsort((np.arange(len(g)), x, g))
            fresh = np.ones(len(g), bool)
            fresh[order[1:]] = (g[order[1:]] != g[order[:-1]]) | (x[order[1:]] != x[order[:-1]])
            fresh = np.flatnonzero(fresh[len(seen_group) :])
            fg = group[at[fresh]]
            place = taken[fg] + np.arange(len(fg)) - np.searchsorted(fg, fg, "left")
            fresh = at[fresh[place < self.n]]
            kept[0].append(fresh)
            taken += np.bincount(group[fresh], minlength=len(start))
            seen_group, seen_item = np.r_[seen_group, group[fresh]], np.r_[seen_item, item[fresh]]
            low = np.where(done, low, reach)
        rows = np.sort(np.concatenate(kept[0])) if kept[0] else np.zeros(0, np.int64)
        last = len(start) - 1
        own = item[rows[group[rows] == last]].tolist()
        self.key = tuple(c[len(c) - 1].as_py() for c in columns)
        self.held = (carried if last == 0 else []) + own
        return rows


def top_n(df: DataFrame, groups: list[str], item: str, score: str, tie: str, n: int) -> DataFrame:
    """The n best items of each group with columns groups, item, score, tie and rank.

    item: what counts once within its group, an integer column; score: higher is
    better; tie: identifier that decides between rows of one item.
    """
    if n < 1:
        raise ValueError("n must be positive")
    rows = df.select(*groups, F.col(item), F.col(score).cast("double").alias(score), F.col(tie))
    rows = rows.filter(F.col(item).isNotNull() & F.col(score).isNotNull() & ~F.isnan(score))
    order = [*groups, F.col(score).desc(), F.col(item), F.col(tie)]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return FirstN(groups, item, n)(batches)

    local = rows.sortWithinPartitions(*order).mapInArrow(first, rows.schema)
    return local.repartition(*groups).sortWithinPartitions(*order).mapInArrow(first, rows.schema)
