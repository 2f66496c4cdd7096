"""The marker panel: one row per marker with its calls in individual order."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("binary", "int", "diploid_int", "float", "nucleotides")
RESULT_COLUMNS = ("chrom", "pos", "score", "maf", "mac")


@dataclass(frozen=True)
class Panel:
    """Markers (marker_id, chrom, pos, calls and more columns) and the ids the calls belong to.

    A missing call is NULL inside ``calls``, whatever its code in the source.
    Individuals live on the driver, since there are few of them against markers.
    """

    markers: DataFrame
    ids: list[str]
    data_format: str = "binary"

    def __post_init__(self):
        if self.data_format not in FORMATS:
            raise ValueError(f"data_format is one of {', '.join(FORMATS)}")

    @property
    def n(self) -> int:
        return len(self.ids)

    @property
    def spark(self) -> SparkSession:
        return self.markers.sparkSession

    def with_markers(self, markers: DataFrame) -> Panel:
        return replace(self, markers=markers)

    def individuals(self) -> DataFrame:
        """(idx, indiv_id)."""
        return self.spark.createDataFrame(list(enumerate(self.ids)), "idx int, indiv_id string")

    def long(self) -> DataFrame:
        """(marker_id, chrom, pos, idx, g), one row per call."""
        return self.markers.select("marker_id", "chrom", "pos", F.posexplode("calls").alias("idx", "g"))

    def loci(self) -> DataFrame:
        """(chrom, pos) in genome order."""
        return self.markers.select("chrom", "pos").orderBy("chrom", "pos")

    def describe(self) -> dict:
        """Counts of individuals, repeated ids, markers and chromosomes."""
        r = self.markers.agg(F.count("*").alias("m"), F.countDistinct("chrom").alias("c")).first()
        return {"individuals": self.n, "repeated_ids": self.n - len(set(self.ids)), "markers": r.m, "chromosomes": r.c}


def build_panel(spark: SparkSession, loci: list[tuple[int, int]], calls: list[list], ids: list[str], data_format: str = "binary") -> Panel:
    """A panel from driver lists, sorted by chromosome and position."""
    kind = {"float": "float", "nucleotides": "string"}.get(data_format, "tinyint")
    order = sorted(range(len(loci)), key=lambda i: loci[i])
    rows = [(k, int(loci[i][0]), int(loci[i][1]), list(calls[i])) for k, i in enumerate(order)]
    if any(len(r[3]) != len(ids) for r in rows):
        raise ValueError("each marker needs one call per individual")
    return Panel(spark.createDataFrame(rows, f"marker_id long, chrom int, pos long, calls array<{kind}>"), list(ids), data_format)


#: Calls that a batch of dense markers holds at most.
_CELLS = 8_000_000


@dataclass(frozen=True)
class SparsePanel:
    """Dosages most of which are 0: a marker's row holds only its typed calls of 1 and 2.

    Columns of the markers: marker_id, chrom, pos, places (individuals from 0, in
    order), doses (their calls), gap and fill. Missing calls come by sets of
    individuals, as when a batch wasn't typed: ``gap`` is the set that lacks the
    marker, NULL for none, and ``sets`` names each individual's set. ``fill`` is the
    call that was put in for them, NULL while they are missing.
    """

    markers: DataFrame
    ids: list[str]
    sets: np.ndarray

    data_format = "diploid_int"

    @property
    def n(self) -> int:
        return len(self.ids)

    @property
    def spark(self) -> SparkSession:
        return self.markers.sparkSession

    def with_markers(self, markers: DataFrame) -> SparsePanel:
        return replace(self, markers=markers)

    def individuals(self) -> DataFrame:
        """(idx, indiv_id)."""
        return self.spark.createDataFrame(list(enumerate(self.ids)), "idx int, indiv_id string")

    def dense(self) -> Panel:
        """The same panel with every call."""
        sets, n = self.sets, self.n
        step = max(1, _CELLS // max(n, 1))

        def run(batches):
            for whole in batches:
                for start in range(0, whole.num_rows, step):
                    b = whole.slice(start, step)
                    out = np.zeros((b.num_rows, n), np.int8)
                    size = pc.list_value_length(b.column("places")).to_numpy(zero_copy_only=False)
                    out[np.repeat(np.arange(b.num_rows), size), b.column("places").flatten().to_numpy()] = b.column("doses").flatten().to_numpy()
                    gap, fill = (pc.fill_null(b.column(c), -1).to_numpy(zero_copy_only=False) for c in ("gap", "fill"))
                    out = np.where(gap[:, None] == sets, fill[:, None].astype(np.int8), out)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * n, pa.int32()), pa.array(out.ravel(), mask=out.ravel() < 0))
                    yield pa.RecordBatch.from_arrays([*b.columns[:3], lists], ["marker_id", "chrom", "pos", "calls"])

        rows = self.markers.select("marker_id", "chrom", "pos", "places", "doses", "gap", "fill")
        return Panel(rows.mapInArrow(run, "marker_id long, chrom int, pos long, calls array<tinyint>"), self.ids, self.data_format)
