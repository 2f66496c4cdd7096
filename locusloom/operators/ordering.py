"""Order-dependent columns without one task per group.

``row_numbers`` numbers all rows of a table in a total order by range
partitioning. ``Along`` computes lags, running sums and neighbour windows along
the positions of each chromosome: windows run within short segments, and a small
table with one row per segment carries what crosses their borders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

_BITS = 33


def row_numbers(df: DataFrame, order: list[Column], name: str = "row_no") -> DataFrame:
    """df with the 0-based place of each row in the given total order.

    The rows are range-partitioned and sorted once and kept in the shared folder,
    so that the places hold whatever is recomputed later. Ties in ``order`` are
    numbered in an arbitrary but fixed way.
    """
    m = F.monotonically_increasing_id()
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", m))
    placed = placed.withColumn("_p", F.shiftright("_m", _BITS)).withColumn("_k", F.col("_m").bitwiseAND((1 << _BITS) - 1)).drop("_m")
    counts = sorted((r._p, r.n) for r in placed.groupBy("_p").agg(F.count("*").alias("n")).collect())  # one row per partition
    offsets, total = [], 0
    for p, n in counts:
        offsets.append((p, total))
        total += n
    table = df.sparkSession.createDataFrame(offsets, "_p long, _o long")
    return placed.join(F.broadcast(table), "_p").withColumn(name, F.col("_k") + F.col("_o")).drop("_p", "_k", "_o")


class Along:
    """Rows of a table in order of position within each chromosome.

    tie: unique column that orders rows of one position; width: bases per segment.
    """

    def __init__(self, df: DataFrame, tie: str, chrom: str = "chrom", pos: str = "pos", width: int = 1_000_000):
        self.chrom, self.pos, self.tie = chrom, pos, tie
        self.df = df.withColumn("_seg", F.coalesce(F.floor(F.col(pos) / width), F.lit(-1)))

    @property
    def keys(self) -> list[str]:
        return [self.chrom, "_seg"]

    def inside(self) -> Window:
        return Window.partitionBy(*self.keys).orderBy(self.pos, self.tie)

    def across(self) -> Window:
        return Window.partitionBy(self.chrom).orderBy("_seg")

    def _with(self, df: DataFrame, per_segment: DataFrame) -> DataFrame:
        return df.join(per_segment, self.keys, "left")

    def lag(self, values: dict[str, str]) -> Along:
        """Adds the previous row's value of columns: {new name: column}."""
        order = F.struct(self.pos, self.tie)
        ends = self.df.groupBy(*self.keys).agg(*[F.max_by(F.struct(c), order).alias(f"_e_{n}") for n, c in values.items()])
        carry = ends.select(*self.keys, *[F.lag(f"_e_{n}").over(self.across()).alias(f"_e_{n}") for n in values])
        out = self.df.select("*", *[F.lag(F.struct(c)).over(self.inside()).alias(f"_i_{n}") for n, c in values.items()])
        out = self._with(out, carry)
        for n, c in values.items():
            out = out.withColumn(n, F.coalesce(f"_i_{n}", f"_e_{n}")[c]).drop(f"_i_{n}", f"_e_{n}")
        return self._again(out)

    def running_sum(self, column: str, name: str) -> Along:
        """Adds the sum of a column over this and all earlier rows of the chromosome."""
        sums = self.df.groupBy(*self.keys).agg(F.sum(column).alias("_s"))
        before = self.across().rowsBetween(Window.unboundedPreceding, -1)
        carry = sums.select(*self.keys, F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_o"))
        run = F.sum(column).over(self.inside().rowsBetween(Window.unboundedPreceding, 0))
        out = self._with(self.df.withColumn("_r", run), carry)
        return self._again(out.withColumn(name, F.col("_r") + F.col("_o")).drop("_r", "_o"))

    def neighbours(self, rows: int, add: Callable[[Window], dict[str, Column]], block: int = 4096) -> DataFrame:
        """Adds columns over the +-rows nearest rows: add gets the window and names the columns.

        Rows are numbered along the chromosome and cut into blocks that overlap
        by ``rows``.
        """
        if rows >= block:
            raise ValueError("block must exceed rows")
        numbered = self._again(self.df.withColumn("_one", F.lit(1).cast("long"))).running_sum("_one", "_rn").df
        own = F.floor(F.col("_rn") / block)
        reach = F.array_distinct(F.array(own, F.floor((F.col("_rn") - rows) / block), F.floor((F.col("_rn") + rows) / block)))
        spread = numbered.withColumn("_own", own).withColumn("_block", F.explode(reach))
        w = Window.partitionBy(self.chrom, "_block").orderBy("_rn").rowsBetween(-rows, rows)
        out = spread.select("*", *[c.alias(n) for n, c in add(w).items()]).filter("_block = _own")
        return out.drop("_one", "_rn", "_own", "_block", "_seg")

    def _again(self, df: DataFrame) -> Along:
        out = object.__new__(Along)
        out.chrom, out.pos, out.tie, out.df = self.chrom, self.pos, self.tie, df
        return out

    def done(self) -> DataFrame:
        return self.df.drop("_seg")
