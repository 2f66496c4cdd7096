"""Finding references to records that are missing, deleted or not there yet.

Keys are placed on a 64-bit hash axis that is cut into ranges of equal width;
each range holds its parents' live intervals as sorted arrays, and batches of
references are probed against them by vectorised binary search. A range with
many references is split into parts, each with a copy of that range's parents,
so no key, however frequent, ends up in one task.

Defined cases: NULL, blank and NA are no references; a reference without a time
is reported with NULL month as ``no_time`` since no record is live then; parents
without key or start are ignored; repeated parent rows and overlapping intervals
are merged; an interval that ends before it starts is empty; extra columns are
ignored; empty tables of parents make every reference ``unknown``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_OPEN = 2**63 - 1
LIVE, UNKNOWN, DELETED, TOO_EARLY, BETWEEN, NO_TIME = "live", "unknown", "deleted", "too_early", "between", "no_time"


def clean_key(col: Column | str) -> Column:
    """The comparable form of an id, NULL if it is no reference.

    Blanks and tabs around are dropped; digits only, or digits, a point and
    zeros, compare by value; everything else regardless of case.
    """
    c = F.col(col) if isinstance(col, str) else col
    t = F.regexp_replace(c, r"\A[ \t]+|[ \t]+\z", "")
    number = F.regexp_extract(t, r"\A0*([0-9]+?)(\.0+)?\z", 1)
    key = F.when(t.rlike(r"\A[0-9]+(\.0+)?\z"), number).otherwise(F.lower(t))
    return F.when((t != "") & (F.lower(t) != "na"), key)


def _micros(col: str) -> Column:
    return F.unix_micros(F.col(col).cast("timestamp"))


def live_intervals(parents: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, s, e): disjoint live intervals per key in microseconds, end excluded."""
    rows = parents.select(clean_key(key).alias("key"), _micros(start).alias("s"), F.coalesce(_micros(end), F.lit(_OPEN)).alias("e"))
    rows = rows.filter("key is not null and s is not null and s < e").distinct()
    order = Window.partitionBy("key").orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("new", F.when(reach.isNull() | (F.col("s") > reach), 1).otherwise(0))
    rows = rows.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("key", "island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("island")


class _Range:
    """Live intervals of one key range as sorted arrays."""

    def __init__(self, h: np.ndarray, key: np.ndarray, s: np.ndarray, e: np.ndarray):
        order = np.lexsort((s, key.astype(str), h)) if len(h) else np.zeros(0, np.int64)
        self.h, self.key, self.s, self.e = h[order], key[order], s[order], e[order]

    def probe(self, h: np.ndarray, key: np.ndarray, t: np.ndarray, timed: np.ndarray) -> np.ndarray:
        """Status codes: index into STATUS."""
        lo = np.searchsorted(self.h, h, "left")
        hi = np.searchsorted(self.h, h, "right")
        out = np.full(len(h), 1, np.int8)
        known = hi > lo
        if len(self.h) and known.any():
            at = np.minimum(lo, len(self.h) - 1)
            # keys of one hash are adjacent and sorted; a run of several keys is a hash collision
            same = known & (self.key[at] == key) & (self.key[np.minimum(hi, len(self.h)) - 1] == key)
            for i in np.flatnonzero(known & ~same):
                hit = np.flatnonzero(self.key[lo[i] : hi[i]] == key[i])
                if len(hit):
                    hi[i], lo[i] = lo[i] + hit[-1] + 1, lo[i] + hit[0]
                    same[i] = True
            known = same
            a, b = lo.copy(), hi.copy()
            while (open_ := known & (a < b)).any():  # last interval that starts at or before t
                mid = (a + b) // 2
                ahead = open_ & (self.s[np.minimum(mid, len(self.s) - 1)] <= t)
                a = np.where(ahead, mid + 1, a)
                b = np.where(open_ & ~ahead, mid, b)
            last = a - 1
            started = known & (last >= lo)
            live = started & (self.e[np.maximum(last, 0)] > t)
            out[known & ~started] = 3
            out[started & ~live & (a >= hi)] = 2
            out[started & ~live & (a < hi)] = 4
            out[live] = 0
        out[~timed] = 5
        return out


STATUS = [LIVE, UNKNOWN, DELETED, TOO_EARLY, BETWEEN, NO_TIME]
_OUT = pa.schema([("ref_table", pa.string()), ("row_id", pa.int64()), ("t", pa.int64()), ("status", pa.string())])


def _runs(code: np.ndarray) -> list[tuple[int, int]]:
    cuts = np.flatnonzero(np.r_[True, code[1:] != code[:-1], True]) if len(code) else np.zeros(1, np.int64)
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))


def _probe_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by range, part and kind: parents of a range first, then its references."""
    at: tuple[int, int] | None = None
    gathered: list[tuple] = []
    current: _Range | None = None
    empty = np.zeros(0, np.int64)
    for b in batches:
        r, p = b.column("rng").to_numpy(), b.column("part").to_numpy()
        kind = b.column("kind").to_numpy()
        h, key = b.column("h").to_numpy(), b.column("key").to_numpy(zero_copy_only=False)
        t_col = b.column("t")
        t, e = pc.fill_null(t_col, 0).to_numpy(), pc.fill_null(b.column("e"), 0).to_numpy()
        timed = t_col.is_valid().to_numpy(zero_copy_only=False)
        for i, j in _runs(np.stack([r, p, kind], 1).view([("", np.int64)] * 3).ravel()) if len(r) else []:
            if (int(r[i]), int(p[i])) != at:
                at, gathered, current = (int(r[i]), int(p[i])), [], None
            if kind[i] == 0:
                gathered.append((h[i:j], key[i:j], t[i:j], e[i:j]))
                continue
            if current is None:
                parts = [np.concatenate(x) for x in zip(*gathered)] if gathered else [empty, np.zeros(0, object), empty, empty]
                current, gathered = _Range(*parts), []
            found = current.probe(h[i:j], key[i:j], t[i:j], timed[i:j])
            miss = np.flatnonzero(found)
            if len(miss):
                rows = pa.array(miss + i)
                yield pa.RecordBatch.from_arrays(
                    [b.column("ref_table").take(rows).cast(pa.string()), b.column("row_id").take(rows), t_col.take(rows), pa.array([STATUS[c] for c in found[miss]], pa.string())],
                    schema=_OUT,
                )


def references(df: DataFrame, name: str, key: str, row_id: str, time: str) -> DataFrame:
    """One table's references in the common form the probe takes."""
    return df.select(F.lit(name).alias("ref_table"), F.col(row_id).cast("long").alias("row_id"), clean_key(key).alias("key"), _micros(time).alias("t")).filter("key is not null")


def find_orphans(
    refs: list[DataFrame], parents: DataFrame, key: str, start: str, end: str,
    parents_per_range: int = 20_000, refs_per_part: int = 200_000,
) -> DataFrame:
    """(ref_table, ref_month, row_id, status) of every reference without a live parent.

    refs: results of ``references``. parents_per_range bounds the arrays one task
    holds, refs_per_part the references that share a copy of them.
    """
    spark = parents.sparkSession
    live = live_intervals(parents, key, start, end)
    n_ranges = max(1, -(-parents.count() // parents_per_range))
    width = -(-(2**64) // n_ranges)
    h = F.xxhash64("key")
    # the hash axis from -2**63 on, in steps of width; the division is exact in decimals
    rng = ((h.cast("decimal(20,0)") + F.lit(str(2**63)).cast("decimal(20,0)")) / F.lit(str(width)).cast("decimal(20,0)")).cast("long") if n_ranges > 1 else F.lit(0).cast("long")
    all_refs = reduce(DataFrame.unionByName, refs).withColumn("h", h).withColumn("rng", rng)
    sizes = all_refs.groupBy("rng").agg(F.count("*").alias("n"))
    parts = sizes.select("rng", F.ceil(F.col("n") / refs_per_part).cast("long").alias("parts"))
    placed = all_refs.join(parts, "rng").select(
        "rng", F.pmod(F.xxhash64("ref_table", "row_id"), F.col("parts")).alias("part"), F.lit(1).cast("long").alias("kind"),
        "h", "key", "t", F.lit(None).cast("long").alias("e"), "ref_table", "row_id",
    )
    copies = (
        live.withColumn("h", h).withColumn("rng", rng).join(parts, "rng")
        .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        .select("rng", "part", F.lit(0).cast("long").alias("kind"), "h", "key", F.col("s").alias("t"), "e", F.lit(None).cast("string").alias("ref_table"), F.lit(None).cast("long").alias("row_id"))
    )
    stream = copies.unionByName(placed).repartition("rng", "part").sortWithinPartitions("rng", "part", "kind")
    found = stream.mapInArrow(_probe_stream, "ref_table string, row_id long, t long, status string")
    month = F.date_format(F.timestamp_micros("t"), "yyyy-MM")
    return found.select("ref_table", month.alias("ref_month"), "row_id", "status")


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per table, month and kind of miss."""
    return orphans.groupBy("ref_table", "ref_month", "status").agg(F.count("*").alias("n_refs"))
