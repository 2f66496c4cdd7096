"""Writers of genotype, phenotype, result, step and recombination files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import score_at
from ..operators.traits import number_replicates
from ..panel import Panel


def write_panel(panel: Panel, path: str) -> None:
    """Parquet, partitioned by chromosome, with the individuals beside it."""
    panel.markers.repartition("chrom", F.floor(F.col("pos") / 5_000_000)).sortWithinPartitions("chrom", "pos").write.mode("overwrite").partitionBy("chrom").parquet(f"{path}/genotypes")
    panel.individuals().withColumn("data_format", F.lit(panel.data_format)).coalesce(1).write.mode("overwrite").parquet(f"{path}/individuals")


def read_panel(spark, path: str) -> Panel:
    """What write_panel wrote; filters on chrom prune partitions."""
    people = spark.read.parquet(f"{path}/individuals").orderBy("idx").collect()
    return Panel(spark.read.parquet(f"{path}/genotypes"), [r.indiv_id for r in people], people[0].data_format)


def write_genotype_csv(panel: Panel, path: str, delim: str = ",", missing: str = "NA", array_ids: list[str] | None = None) -> None:
    """Text files in genome order; the header is the first line of the first file."""
    body = panel.markers.repartitionByRange("chrom", "pos").sortWithinPartitions("chrom", "pos", "marker_id")
    line = F.concat_ws(delim, F.col("chrom").cast("string"), F.col("pos").cast("string"), F.concat_ws(delim, F.transform("calls", lambda x: F.coalesce(x.cast("string"), F.lit(missing)))))
    heads = ([delim.join(["", "", *array_ids])] if array_ids else []) + [delim.join(["Chromosome", "Positions", *panel.ids])]
    head = panel.spark.createDataFrame([("\n".join(heads),)], "value string").coalesce(1)
    head.union(body.select(line.alias("value"))).write.mode("overwrite").text(path)


def write_phenotypes(phens: DataFrame, path: str, delim: str = ",") -> None:
    """Long CSV with replicate numbers per individual in order of value."""
    out = number_replicates(phens).select("phen_id", "phen_name", "indiv_id", "value", "replicate_id")
    out = out.toDF("phenotype_id", "phenotype_name", "ecotype_id", "value", "replicate_id")
    out.repartitionByRange("phenotype_id", "ecotype_id").sortWithinPartitions("phenotype_id", "ecotype_id", "replicate_id").write.mode("overwrite").csv(path, header=True, sep=delim)


def write_result(results: DataFrame, path: str, columns: list[str] | None = None, max_fraction: float = 1.0, fmt: str = "csv") -> None:
    """Result columns as CSV or Parquet; below 1, max_fraction keeps scores strictly under that quantile."""
    names = {"chrom": "chromosomes", "pos": "positions", "score": "scores", "maf": "mafs", "mac": "macs"}
    base = [c for c in ("chrom", "pos", "score", "maf", "mac") if c in results.columns]
    cols = base + [c for c in (columns or []) if c not in base]
    if max_fraction < 1:
        edge = score_at(results, max_fraction)
        results = results.filter(F.col("score") < edge)
    out = results.select(*[F.col(c).alias(names.get(c, c)) for c in cols])
    writer = out.repartitionByRange("chromosomes", "positions").sortWithinPartitions("chromosomes", "positions").write.mode("overwrite")
    writer.csv(path, header=True) if fmt == "csv" else writer.parquet(path)


def write_steps(steps: DataFrame, path: str) -> None:
    """Step statistics as CSV, cofactors as text."""
    from ..operators.stepwise import cofactor_text

    steps.withColumn("cofactors", cofactor_text()).coalesce(1).sortWithinPartitions("step").write.mode("overwrite").csv(path, header=True)


def write_pair_counts(pairs: DataFrame, path: str, max_pairs: int | None = None, seed: int = 0) -> None:
    """Pair haplotype counts as input of recombination estimators: distance and the four counts per line.

    With max_pairs a seeded sample of that size is written, which is this format's feature.
    """
    from ..operators.ld import pair_frequencies

    p = pair_frequencies(pairs)
    if max_pairs is not None:
        p = p.orderBy(F.xxhash64(F.lit(seed), "id1", "id2")).limit(max_pairs)
    counts = [F.round(F.col(f"f{k}") * F.col("n")).cast("int").cast("string") for k in range(4)]
    p.select(F.concat_ws(" ", (F.col("pos2") - F.col("pos1")).cast("string"), *counts)).write.mode("overwrite").text(path)


def write_individuals(panel: Panel, metadata: DataFrame, path: str) -> None:
    """Individuals with their metadata as CSV."""
    panel.individuals().join(metadata, "indiv_id", "left").coalesce(1).sortWithinPartitions("idx").write.mode("overwrite").csv(path, header=True)
