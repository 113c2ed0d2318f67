"""Marker lists with exact alleles, functional classes, traits one below another."""

import pytest

from locusmill.operators import group, report
from locusmill.sources import readers


def test_lists_find_exact_alleles(spark):
    lists = spark.createDataFrame([("g", ["1:10_A/C", "1:10_A/C", None, "chr1:20_AT/G"]), ("h", ["1:10_A/G", "2:5_T/C", "1:30_C/T"]), ("k", [])], "grp string, ids array<string>")
    members = group.group_markers(lists)
    rows = spark.createDataFrame([("1", 10, "A", "C", 7), ("1", 10, "A", "C", 8), ("1", 10, "A", "T", 9), ("1", 20, "AT", "G", 1), ("2", 5, "T", "C", 2), (None, 5, "T", "C", 3)], "contig string, pos long, ref string, alt string, g int")
    assert sorted((r.grp, r.g) for r in group.marker_lookup(rows, members).collect()) == [("g", 1), ("g", 7), ("g", 8), ("h", 2)]
    assert {tuple(r) for r in group.group_names(members).collect()} == {("g", "1", 10, 20, "1:10-20_g"), ("h", "multichrs", 0, 0, "multichrs:0-0_h")}
    with pytest.raises(Exception, match="not a marker: 1:10"):
        group.group_markers(spark.createDataFrame([("g", ["1:10"])], "grp string, ids array<string>")).collect()


def test_classes_by_place(spark):
    points = spark.createDataFrame([(1, "1", 5), (2, "1", 15), (3, "1", 25), (4, "1", 35), (5, "2", 15), (6, None, 15), (7, "1", 20)], "k int, contig string, pos long")
    exons = spark.createDataFrame([("1", 1, 20), ("1", 1, 20), ("1", 9, 3)], "contig string, beg long, end long")
    states = spark.createDataFrame([("1", 12, 28, "4"), ("1", 20, 30, "Active_Promoter"), ("1", 1, 40, "12"), ("1", 1, 40, None), ("1", 1, 40, "14")], "contig string, beg long, end long, label string")
    got = {r.k: r.place for r in report.functional_classes(points, exons, states).collect()}
    assert got == {1: "exon", 2: "enhancer", 3: "promoter", 4: "other", 5: "other", 6: "other", 7: "promoter"}


def test_linkage_by_position(spark):
    a = spark.createDataFrame([("1", 5, 0.1), ("2", 5, 0.2)], "contig string, pos long, pvalue double")
    l = spark.createDataFrame([("1", 5, 0.9)], "contig string, pos long, r2 double")
    assert {(r.contig, r.r2, r.ld_class) for r in report.locus_view(a, l, ("contig", "pos")).collect()} == {("1", 0.9, ">=0.8"), ("2", 0.0, "<0.1")}


def test_traits_one_below_another(spark):
    ped = spark.createDataFrame([("f", "a", "0", "0", "1", 1.0, 2.0, 3.0), ("f", "b", "0", "0", "1", 4.0, None, 6.0)], "fam_id string, ind_id string, fat_id string, mot_id string, sex string, T1 double, T2 double, AGE double")
    one = spark.createDataFrame([("a",), ("a",)], "ind_id string")
    got = readers.phenotypes(ped, covariates=["AGE"], samples=one)
    assert got.columns == ["ind_id", "AGE", "trait", "y"] and sorted(map(tuple, got.collect())) == [("a", 3.0, "T1", 1.0), ("a", 3.0, "T2", 2.0)]
    assert sorted(map(tuple, readers.phenotypes(ped, ["T1"]).collect())) == [("a", "T1", 1.0), ("b", "T1", 4.0)]
    with pytest.raises(Exception, match="missing value of T2 in b"):
        readers.phenotypes(ped, covariates=["AGE"]).collect()
    for bad in (dict(traits=["T9"]), dict(traits=["T1"], covariates=["T1"]), dict(covariates=["T1", "T2", "AGE"])):
        with pytest.raises(ValueError):
            readers.phenotypes(ped, **bad)


def test_of_equal_lines_the_first_in_the_table_counts(spark, tmp_path):
    """The query's lines are equal for many orders; the table's order decides, however rows are dealt."""
    rows = [(k, k % 7, k % 5, n % 2, 30.0, "NAR"[(k * 31 + n * n) % 3]) for n in range(6) for k in range(400)]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string"
    spark.createDataFrame(rows, names).coalesce(1).write.option("parquet.block.size", 4096).parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k,) for k in range(401)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    want = {400: "NA"}
    for k, _, _, line, _, flag in sorted(rows, key=lambda r: r[3]):
        want.setdefault(k, flag)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        from locusmill.plans import catalog

        assert {r.o_orderkey: r.flag for r in catalog.exact_lookup(spark, str(tmp_path)).collect()} == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_the_order_of_a_lookup_may_have_several_columns(spark):
    from locusmill.operators import annotate

    t = spark.createDataFrame([(k, 1, n, f"{(7 * n + k) % 5}") for k in range(50) for n in range(9, -1, -1)], "key long, line int, row long, flag string").repartition(7, "row")
    got = annotate.exact_lookup(spark.range(51).withColumnRenamed("id", "key"), t, "flag", ("key",), ("line", "row"))
    assert {r.key: r.flag for r in got.collect()} == {k: f"{k % 5}" for k in range(50)} | {50: "NA"}
