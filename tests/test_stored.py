"""Queries over stored calls: every batch and format counts."""

from locusloom.plans.domain import stored_panel


def test_stored_panel_has_every_batch_and_format(spark, tmp_path):
    rows = [
        (1, "a", 1, 10, "diploid_int", [0, 1, 2, 3, -1]), (2, "a", 1, 20, "diploid_int", [0, 0, 0, 2, 1]), (3, "b", 2, 10, "diploid_int", [2, 2, 1, 0, 0]),
        (4, "c", 1, 10, "binary", [0, 1, 1, 2, 1]), (5, "c", 1, 30, "binary", [0, 0, 0, 0, 0]), (6, "d", 3, 10, None, [1, 0, 0, -1, 1]), (7, None, 3, 20, "binary", [1, 1, 0, 0, 1]), (8, "a", 1, 30, "diploid_int", None),
    ]
    kind = "marker_id long, call_batch string, chrom int, pos long, data_format string, raw_snps array<tinyint>"
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/genot_data.parquet")
    got = {r.marker_id: (r.call_batch, r.data_format, r.n_typed, r.n_missing, r.mac) for r in stored_panel(spark, str(tmp_path)).collect()}
    assert got == {
        1: ("a", "diploid_int", 3, 2, 1.5), 2: ("a", "diploid_int", 5, 0, 1.5), 3: ("b", "diploid_int", 5, 0, 2.5), 4: ("c", "binary", 4, 1, 1.0),
        5: ("c", "binary", 5, 0, 0.0), 6: ("d", None, 4, 1, 2.0), 7: (None, "binary", 5, 0, 2.0),
    }
