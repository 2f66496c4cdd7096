"""Results and calls that arrive over time, with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.markers import mac, maf, missing_rate


def daily_best(results: DataFrame, time: str = "scored_at", late: str = "2 days") -> DataFrame:
    """chrom, day, n, best score of a stream of results; rows later than ``late`` are left out."""
    ok = results.filter(F.col("score").isNotNull() & ~F.isnan("score")).withColumn(time, F.col(time).cast("timestamp"))
    return (
        ok.withWatermark(time, late).groupBy(F.window(time, "1 day").alias("w"), "chrom")
        .agg(F.count("*").alias("n"), F.max("score").alias("best_score"))
        .select("chrom", F.col("w.start").alias("day"), "n", "best_score")
    )


def marker_quality(markers: DataFrame, data_format: str = "diploid_int", calls: str = "raw_snps", max_missing: float = 0.1, min_maf: float = 0.0) -> DataFrame:
    """Markers of a stream that pass quality control, with their statistics; stateless."""
    top = 2 if data_format == "diploid_int" else 1
    clean = markers.withColumn("calls", F.transform(calls, lambda x: F.when((x >= 0) & (x <= top), x)))
    s = clean.select("*", missing_rate().alias("missing_rate"), mac(data_format).alias("mac"), maf(data_format).alias("maf"))
    return s.filter((F.col("missing_rate") <= max_missing) & (F.col("maf") >= min_maf))


def distinct_loci(results: DataFrame, time: str = "scored_at", late: str = "2 days") -> DataFrame:
    """A stream without rows that repeat run, locus and score within the watermark."""
    return results.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(["run_id", "chrom", "pos", "score"])
