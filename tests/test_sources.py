"""Readers and writers on small files of each format."""

import pytest

from locusloom.operators import markers as M
from locusloom.operators import panels as P
from locusloom.operators import traits as T
from locusloom.panel import build_panel
from locusloom.sources import genotypes as G
from locusloom.sources import sinks, tables
from locusloom.sources.text import numbered_lines


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def calls(panel):
    return [(r.chrom, r.pos, list(r.calls)) for r in panel.markers.orderBy("chrom", "pos", "marker_id").collect()]


def test_numbered_lines_over_splits(spark, tmp_path):
    path = put(tmp_path, "x.txt", "\n".join(f"line {k}" for k in range(5000)) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = numbered_lines(spark, path)
        assert rows.rdd.getNumPartitions() > 3
        assert all(r.value == f"line {r.line_no}" for r in rows.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_numeric(spark, tmp_path):
    path = put(tmp_path, "g.csv", "Chromosome,Positions,a,b,c\n1,100,0,1,-1\n2,50,2,NA,1\r\n\n")
    assert calls(G.read_genotypes(spark, path, "diploid_int")) == [(1, 100, [0, 1, None]), (2, 50, [2, None, 1])]
    p = G.read_numeric(spark, path, "diploid_int", keep=["c", "a"])
    assert p.ids == ["a", "c"] and calls(p)[1] == (2, 50, [2, 1])
    f = G.read_genotypes(spark, put(tmp_path, "f.csv", "Chromosome,Positions,a\n1,5,0.25\n"), "float")
    assert calls(f)[0][2] == [0.25]
    assert [tuple(r) for r in G.read_loci(spark, path).orderBy("chrom").collect()] == [(1, 100), (2, 50)]
    with pytest.raises(ValueError):
        G.read_numeric(spark, put(tmp_path, "bad.csv", "x,y\n1,2\n"))


def test_nucleotides(spark, tmp_path):
    path = put(tmp_path, "n.csv", "Array,,r1,r2,r3\nChromosome,Positions,a,b,c\n1,1,A,AG,N\n1,2,C,CC,T\n1,3,G,A,T\n")
    p = G.read_nucleotides(spark, path)
    assert calls(p) == [(1, 1, ["A", "R", None]), (1, 2, ["C", "C", "T"]), (1, 3, ["G", "A", "T"])]
    assert calls(M.to_binary(p)) == [(1, 1, [0, 1, None]), (1, 2, [0, 0, 1])]
    assert calls(M.to_binary(p, "c")) == [(1, 1, [0, 1, None]), (1, 2, [1, 1, 0])]
    assert calls(M.to_binary(p, only_biallelic_=False))[2] == (1, 3, [1, 0, 2])
    assert calls(M.mask_ambiguous(p))[0][2] == ["A", None, None] and len(calls(M.mask_ambiguous(p, 1))) == 2


def test_chromosome_files(spark, tmp_path):
    put(tmp_path, "chr_1_diploid_int_mac1.csv", "Chromosome,Positions,a,b\n1,1,0,2\n")
    put(tmp_path, "chr_2_diploid_int.csv", "Chromosome,Positions,a,b\n2,1,0,0\n2,2,0,2\n")
    p = G.read_chromosome_files(spark, f"{tmp_path}/", [1, 2], min_mac=1)
    assert calls(p) == [(1, 1, [0, 2]), (2, 2, [0, 2])]
    with pytest.raises(FileNotFoundError):
        G.read_chromosome_files(spark, f"{tmp_path}/", [3])


def test_ped(spark, tmp_path):
    put(tmp_path, "x.map", "1 s1 0 100\n1 s2 0 200\n1 s3 0 300\n")
    put(tmp_path, "x.ped", "f1\ti1\t0\t0\t1\t2.5\tA A\tC C\tG T\nf1\ti2\t0\t0\t2\t-9\tA G\t0 0\tG A\nf1\ti3\t0\t0\t2\t-9\tG G\tC C\tG 0\n")
    p, info = G.read_ped(spark, f"{tmp_path}/x")
    assert p.ids == ["i1", "i2", "i3"] and calls(p) == [(1, 100, [0, 1, 2])]
    got = {r.snp_id: (r.n_alleles, r.n_missing) for r in info.collect()}
    assert got == {"s1": (2, 0), "s2": (1, 1), "s3": (3, 1)}


def test_tped_and_plink(spark, tmp_path):
    put(tmp_path, "x.tfam", "f1 i1 0 0 1 1.5\nf2 i2 0 0 2 -9\nf3 i3 0 0 0 NA\n")
    put(tmp_path, "x.tped", "1 s1 0 100 1 1 1 2 2 2\n1 s2 0 200 2 2 0 2 2 2\n1 s3 0 200 1 2 1 1 1 1\n2 s4 0 0 1 2 1 1 1 1\n2 s5 0 9 1 1 1 1 1 1\n")
    put(tmp_path, "x.bim", "1 r1 0 100 A G\n1 r2 0 200 C T\n1 r3 0 200 C T\n2 r4 0 0 C T\n2 r5 0 9 C T\n")
    p, people = G.read_tped(spark, f"{tmp_path}/x", impute=None)
    assert calls(p)[:2] == [(1, 100, [0, 1, 2]), (1, 200, [2, None, 2])]
    assert [(r.sex, r.phenotype) for r in people.orderBy("idx").collect()] == [(1, 1.5), (2, None), (None, None)]
    assert calls(G.read_tped(spark, f"{tmp_path}/x")[0])[1][2] == [2, 2, 2]
    q, _ = G.read_plink12(spark, f"{tmp_path}/x", missing_threshold=0.2)
    got = q.markers.orderBy("chrom", "pos").collect()
    assert [(r.snp_id, r.a0, list(r.calls)) for r in got] == [("r1", "A", [0, 1, 2]), ("r3", "C", [1, 0, 0])]


def test_eigenstrat(spark, tmp_path):
    put(tmp_path, "e.ind", "i1 M Case\ni2 F Control\ni3 U Case\n")
    put(tmp_path, "e.snp", "s1 1 0 100 A G\ns2 1 0 200 A G\ns3 2 0 5 C T\n")
    put(tmp_path, "e.geno", "012\n999\n190\n")
    p, people = G.read_eigenstrat(spark, f"{tmp_path}/e", missing_threshold=0.2)
    assert calls(p) == [(1, 100, [0, 1, 2]), (2, 5, [1, 0, 0])]
    assert [r.sex for r in people.orderBy("idx").collect()] == [1, 2, None]


def test_ibs_matrix(spark, tmp_path):
    m = G.read_ibs_matrix(spark, put(tmp_path, "k.mibs", "1 0.5\n0.5 1\n"))
    assert {tuple(r) for r in m.collect()} == {(0, 0, 1.0), (0, 1, 0.5), (1, 0, 0.5), (1, 1, 1.0)}


def test_phenotypes(spark, tmp_path):
    wide = tables.read_phenotypes(spark, put(tmp_path, "w.csv", "id,1_height,2_yield\na,1.5,NA\nb,2,3\na,2.5,4\n"))
    assert {(r.phen_id, r.indiv_id, r.value) for r in wide.collect()} == {(1, "a", 1.5), (1, "b", 2.0), (1, "a", 2.5), (2, "b", 3.0), (2, "a", 4.0)}
    sinks.write_phenotypes(wide, str(tmp_path / "out"))
    lines = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))[:1])
    assert lines.startswith("phenotype_id,phenotype_name,ecotype_id,value,replicate_id")
    whole = put(tmp_path, "l.csv", "phenotype_id,phenotype_name,ecotype_id,value,replicate_id\n1,h,a,1.5,1\n1,h,a,2.5,2\n")
    long = tables.read_phenotypes(spark, whole)
    assert {(r.indiv_id, r.value, r.replicate_id) for r in long.collect()} == {("a", 1.5, 1), ("a", 2.5, 2)}
    env = long.selectExpr("*", "if(value > 2, 'x', 'y') as env")
    assert T.environment_summary(env).count() == 2 and T.environment_correlation(T.environment_summary(env), "x", "y").first().n == 1


def test_results(spark, tmp_path):
    path = put(tmp_path, "r.tsv", "Chromosome\tPosition\tScore\tMARF\tMAF\textra\n1\t10\t0.5\t0.1\t3\t7\n2\t20\tx\t0.2\t4\t8\n")
    r = tables.read_result(spark, path).orderBy("row_id").collect()
    assert (r[0].chrom, r[0].pos, r[0].score, r[0].maf, r[0].mac, r[0].extra) == (1, 10, 0.5, 0.1, 3, 7.0) and r[1].score is None
    df = spark.createDataFrame([(k, 1, k, k / 10, 0.1, 2, k) for k in range(10)], "row_id long, chrom int, pos long, score double, maf double, mac long, extra long")
    sinks.write_result(df, str(tmp_path / "r"), ["extra"], max_fraction=0.3)
    back = spark.read.csv(str(tmp_path / "r"), header=True)
    assert back.columns == ["chromosomes", "positions", "scores", "mafs", "macs", "extra"] and back.count() == 3


def test_annotation(spark, tmp_path):
    gff = "\n".join(
        "\t".join(x) for x in [
            ("Chr1", "S", "gene", "100", "500", ".", "+", ".", "ID=G1;Note=protein_coding;Name=G1"), ("Chr1", "S", "mRNA", "100", "500", ".", "+", ".", "ID=G1.1;Parent=G1;Name=G1.1"),
            ("Chr1", "S", "protein", "120", "400", ".", "+", ".", "ID=G1.1-Protein;Name=G1.1;Derives_from=G1.1"), ("Chr1", "S", "exon", "100", "200", ".", "+", ".", "Parent=G1.1"),
            ("Chr1", "S", "exon", "300", "500", ".", "+", ".", "Parent=G1.1"), ("Chr1", "S", "CDS", "120", "200", ".", "+", "0", "Parent=G1.1,G1.1-Protein"), ("Chr1", "S", "five_prime_UTR", "100", "119", ".", "+", ".", "Parent=G1.1"),
            ("Chr2", "S", "transposable_element", "5", "9", ".", "+", ".", "ID=T1;Name=T1;Alias=X"), ("Chr2", "S", "transposon_fragment", "5", "7", ".", "+", ".", "Parent=T1"),
        ]
    )
    desc = "Model\tType\tShort\tCurator\tComputational\nG1.1\tprotein_coding\tshort text\tcur\tcomp\n"
    g = {r.gene_id: r for r in tables.read_gff(spark, put(tmp_path, "a.gff", gff), put(tmp_path, "d.tsv", desc)).collect()}
    iso = g["G1"].isoforms[0]
    assert [tuple(x) for x in iso.exons] == [(100, 200), (300, 500)] and iso.cds[0].frame == 0 and tuple(iso.utr5) == (100, 119) and iso.short_description == "short text" and tuple(iso.protein) == (120, 400)
    assert [tuple(x) for x in g["T1"].fragments] == [(5, 7)] and g["T1"].alias == "X"
    assert tables.read_gff(spark, str(tmp_path / "a.gff"), chrom=1, start=450, end=600).count() == 1
    assert tables.read_gff(spark, str(tmp_path / "a.gff"), start=600, end=700).count() == 0
    assert tables.read_gff(spark, str(tmp_path / "a.gff"), only_genes=True).count() == 1
    cand = tables.read_candidate_genes(spark, put(tmp_path, "c.csv", "at1g01,x\nAT1G02\n")).orderBy("gene_id").collect()
    assert [(r.gene_id, r.name) for r in cand] == [("AT1G01", "x"), ("AT1G02", None)]
    meta = tables.read_id_metadata(spark, put(tmp_path, "m.tsv", "id\tnativename\n1\tCol-0\n"))
    assert meta.first().lookup == "col-0"


def test_panel_round_trip(spark, tmp_path):
    p = build_panel(spark, [(2, 5), (1, 9), (1, 3)], [[0, 1], [None, 2], [1, 1]], ["a", "b"], "diploid_int")
    sinks.write_panel(p, str(tmp_path / "p"))
    q = sinks.read_panel(spark, str(tmp_path / "p"))
    assert calls(q) == calls(p) == [(1, 3, [1, 1]), (1, 9, [None, 2]), (2, 5, [0, 1])] and q.data_format == "diploid_int"
    sinks.write_genotype_csv(p, str(tmp_path / "c"), missing="NA")
    text = "".join(f.read_text() for f in sorted((tmp_path / "c").glob("part-*")))
    assert text.startswith("Chromosome,Positions,a,b\n1,3,1,1\n")
    back = G.read_numeric(spark, put(tmp_path, "back.csv", text), "diploid_int")
    assert calls(back) == calls(p)


def test_panel_operators(spark):
    a = build_panel(spark, [(1, 1), (1, 2), (1, 3)], [[0, 1, 0], [1, 1, None], [0, 0, 0]], ["x", "y", "z"])
    b = build_panel(spark, [(1, 2), (1, 3), (1, 4)], [[1, 0], [1, 1], [0, 1]], ["z", "w"])
    u = P.merge_panels(a, b, "union")
    assert u.ids == ["x", "y", "z", "w"] and calls(u) == [(1, 1, [0, 1, 0, None]), (1, 2, [1, 1, 1, 0]), (1, 4, [None, None, 0, 1])]
    assert calls(P.merge_panels(a, b, "left", 0.1, 1.0))[2] == (1, 3, [0, 0, 0])
    assert P.extend_panel(a, b).markers.count() == 6
    assert {r.indiv_id: r.n_different for r in P.compare_panels(a, b, "individual").collect()} == {"z": 1}
    assert P.compare_panels(a, b, "total").first().n_markers == 2
    assert calls(P.filter_bad_markers(a, b)) == [(1, 1, [0, 1, 0]), (1, 2, [1, 1, None])]
    phens = T.phenotypes(spark, [(1, "t", "z", 2.0), (1, "t", "x", 1.0), (1, "t", "x", 0.5), (1, "t", "q", 9.0)])
    cut, values, rows = P.coordinate(a, phens, 1)
    assert cut.ids == ["x", "z"] and rows == [0, 0, 1] and [r.value for r in values.collect()] == [0.5, 1.0, 2.0]
    pairs = P.marker_trait_pairs(a, a.markers.filter("pos = 1"), phens, 1)
    assert {tuple(r) for r in pairs.collect()} == {("x", 0, 1.0), ("x", 0, 0.5), ("z", 0, 2.0)}
    assert M.keep_individuals(a, ["z", "q", "x", "z"]).ids == ["z", "x"] and M.drop_individuals(a, ["y"]).ids == ["x", "z"]
    assert M.filter_individuals_by_missing(a, 0.2).ids == ["x", "y"]
    meta = spark.createDataFrame([("x", "SWE"), ("z", "ESP")], "indiv_id string, country string")
    assert M.keep_countries(a, meta, ["SWE"]).ids == ["x"] and M.keep_countries(a, meta, ["SWE"], True).ids == ["y", "z"]
    assert M.region(a, 1, 2, 3).markers.count() == 1 and M.at_locus(a, 1, 3).markers.count() == 1
    loci = spark.createDataFrame([(1, 2)], "chrom int, pos long")
    assert M.keep_markers(a, loci).markers.count() == 1 and M.drop_markers(a, loci).markers.count() == 2
    assert M.sample_markers(a, 1.0).markers.count() == 3 and M.sample_markers(a, 0.0).markers.count() == 0
    assert a.describe() == {"individuals": 3, "repeated_ids": 0, "markers": 3, "chromosomes": 1}
    assert M.haplotype_counts(a).agg({"n": "sum"}).first()[0] == 3
    assert calls(M.impute_rounded_mean(a))[1][2] == [1, 1, 1] and M.impute_mean(a).data_format == "float"
    assert {r.idx: r.n_missing for r in M.individual_missing(a).collect()} == {0: 0, 1: 0, 2: 1}
