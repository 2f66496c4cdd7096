"""Summed distances to a list of loci of any length."""

import duckdb
from conftest import same

from locusloom.operators.regions import all_distances, summed_distances
from locusloom.plans import catalog


def test_more_loci_than_pairs_allow(spark, tmp_path):
    spark.createDataFrame([(997 * k, f"{k * k % 5 + 1}-X", float(k)) for k in range(1500)], "o_orderkey long, o_orderpriority string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.sql(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    same(catalog.queries()["summed_distances"](spark, str(tmp_path)).toPandas(), con.sql(catalog.oracles()["summed_distances"]).df())


def test_repeated_and_missing_places(spark):
    ddl = "chrom int, pos long"
    results = spark.createDataFrame([(1, 10), (2, None), (None, 30), (5, 10), (3, -7)], ddl)
    loci = spark.createDataFrame([(1, 10), (1, 10), (4, 12), (2, 100), (9, -50)], ddl)
    pairs = all_distances(results, loci).groupBy("locus_chrom", "locus_pos").agg({"chrom_distance": "sum", "pos_distance": "sum", "*": "count"})
    columns = ["locus_chrom", "locus_pos", "sum(chrom_distance)", "sum(pos_distance)", "count(1)"]
    assert sorted(map(tuple, summed_distances(results, loci).collect())) == sorted(map(tuple, pairs.select(*[f"`{c}`" for c in columns]).collect()))
