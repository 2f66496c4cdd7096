"""Text files with line numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BITS = 33


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) of a text file, or of a folder's files in order of name, from 0, without a sort or a single task.

    Lines are numbered within each split; the offset of a split is the number of
    lines before it, of which there are as many as splits.
    """
    df = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_m"))
    df = df.withColumn("_p", F.shiftright("_m", _BITS)).withColumn("_k", F.col("_m").bitwiseAND((1 << _BITS) - 1))
    splits = df.groupBy("_p", "_f", "_b").agg(F.count("*").alias("n"), F.min("_k").alias("k")).collect()  # one row per split
    offsets, total = [], 0
    for r in sorted(splits, key=lambda r: (r._f, r._b)):
        offsets.append((r._p, r._f, r._b, total - r.k))
        total += r.n
    table = spark.createDataFrame(offsets, "_p long, _f string, _b long, _o long")
    return df.join(F.broadcast(table), ["_p", "_f", "_b"]).select((F.col("_k") + F.col("_o")).alias("line_no"), "value")  # one row per split


def first_lines(spark: SparkSession, path: str, n: int) -> list[str]:
    """The first lines of a file, or of a folder's files in order of name."""
    out: list[str] = []
    for f in sorted(spark.read.text(path).inputFiles()):
        out += [r.value.rstrip("\r") for r in spark.read.text(f).limit(n - len(out)).collect()]
        if len(out) >= n:
            break
    return out


def fields(delim: str = ",") -> Column:
    """The trimmed fields of column ``value``."""
    pattern = r"[ \t]+" if delim in (" ", "blanks") else {"\t": r"\t", "|": r"\|"}.get(delim, delim)
    line = F.trim(F.regexp_replace("value", r"\r$", "")) if delim in (" ", "blanks") else F.regexp_replace("value", r"\r$", "")
    return F.transform(F.split(line, pattern, -1), lambda x: F.trim(x))


def guess_delimiter(line: str, candidates: tuple[str, ...] = (",", "\t", " ")) -> str:
    """The first candidate that splits the line."""
    return next((d for d in candidates if len(line.strip().split(d)) > 1), candidates[0])
