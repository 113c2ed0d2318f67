import gzip
import struct

import pytest
from pyspark.sql import functions as F

from locusmill.sources import readers, writers
from locusmill.streaming import scorer

VCF = """##fileformat=VCFv4.2
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2\tS3
20\t100\trs1\tA\tG\t.\tPASS\tAC=3;AN=6\tGT:DS:PL\t0/1:0.9:10,0,20\t1|1:2:30,10,0\t./.:.:.
20\t200\trs2\tC\tT\t.\tLOW\tAC=1;AN=4\tGT:DS:PL\t0|0:0.1:0,9,99\t0|1:1.2:300,0,5\t1/.:.:1,2
21\t50\t.\tG\tGA,GT\t.\tPASS\tX\tGT\t0/1\t0/2\t0/0
"""


@pytest.fixture
def vcf(tmp_path):
    p = tmp_path / "a.vcf.gz"
    p.write_bytes(gzip.compress(VCF.encode()))
    return str(p)


def test_vcf(spark, vcf):
    assert readers.vcf_samples(spark, vcf) == ["S1", "S2", "S3"]
    rows = readers.read_vcf(spark, vcf).orderBy("pos").collect()
    assert [(r.id, r.g, r.phase) for r in rows] == [("rs1", [1, 2, None], [0, 1, 0]), ("rs2", [0, 1, None], [1, 2, 0])]
    assert readers.read_vcf(spark, vcf, max_alleles=9).count() == 3
    assert [r.id for r in readers.read_vcf(spark, vcf, pass_only=True).collect()] == ["rs1"]
    assert [r.id for r in readers.read_vcf(spark, vcf, region="20:150-250").collect()] == ["rs2"]
    assert readers.read_vcf(spark, vcf, samples=["S2", "S1"]).orderBy("pos").first().g == [2, 1]
    assert readers.read_vcf(spark, vcf, field="DS").orderBy("pos").first().g == [0.9, 2.0, None]
    assert readers.read_vcf(spark, vcf, field="PL").orderBy("pos").collect()[1].pl == [[0, 9, 99], [255, 0, 5], None]
    s = readers.site_counts(readers.read_vcf(spark, vcf)).orderBy("pos").first()
    assert (s.ac, s.an, s.sumsq) == (3, 6, 5)
    calls = readers.to_calls(readers.read_vcf(spark, vcf), ["id"], ["S1", "S2", "S3"])
    assert {(r.id, r.sample): r.g for r in calls.collect()}["rs1", "S2"] == 2


def test_round_trips(spark, vcf, tmp_path):
    v = readers.read_vcf(spark, vcf)
    text = writers.vcf_header(["S1", "S2", "S3"]) + "\n" + "\n".join(r.value for r in writers.vcf_lines(v).collect())
    p = tmp_path / "b.vcf"
    p.write_text(text)
    again = readers.read_vcf(spark, str(p))
    assert [r.g for r in again.orderBy("pos").collect()] == [r.g for r in v.orderBy("pos").collect()]
    assert "AC=3;AN=4;NS=2;AF=0.750000" in text
    for r, w in zip(v.orderBy("pos").collect(), writers.plink_rows(v).orderBy("pos").collect()):
        assert writers.unpack_plink(bytes(w.packed), 3) == r.g
    assert [r.value for r in writers.matrix_lines(v).orderBy("value").collect()] == ["rs1\t1\t2\tNA", "rs2\t0\t1\tNA"]
    out = str(tmp_path / "res")
    writers.write_results(v.select("contig", F.col("pos").alias("beg"), F.lit(None).cast("double").alias("PVALUE")), out)
    back = readers.read_results(spark, out)
    assert back.columns == ["contig", "beg", "PVALUE"] and back.count() == 2 and back.first().PVALUE is None


def write(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_ped(spark, tmp_path):
    p = write(tmp_path, "a.ped", "#FAM_ID\tIND_ID\tFAT_ID\tMOT_ID\tSEX\tQT\tAGE\nF1\tI1\t0\t0\t1\t1.5\t40\nF2\tI2\t0\t0\t2\tNA\tx\n")
    assert [(r.ind_id, r.QT, r.AGE) for r in readers.read_ped(spark, p).collect()] == [("I1", 1.5, 40.0), ("I2", None, None)]
    q = write(tmp_path, "b.ped", "F1 I1 0 0 1 2\nF2 I2 0 0 2 1\n")
    assert readers.read_ped(spark, q).columns[-1] == "PHENOTYPE" and readers.read_ped(spark, q).count() == 2
    d = write(tmp_path, "b.dat", "T TRAITX\n")
    assert readers.read_ped(spark, q, d).columns[-1] == "TRAITX"
    bad = write(tmp_path, "c.ped", "#FAM_ID IND_ID FAT_ID MOT_ID SEX QT\nF1 I1 0 0 1\n")
    with pytest.raises(Exception, match="another width"):
        readers.read_ped(spark, bad).collect()


def test_tables(spark, tmp_path):
    b = readers.read_bed(spark, write(tmp_path, "a.bed", "track x\nchr1\t9\t20\tL\n2 0 5\n")).orderBy("contig").collect()
    assert [tuple(r) for r in b] == [("1", 10, 20, "L"), ("2", 1, 5, None)]
    g = readers.read_genes(spark, write(tmp_path, "g.txt", "GENE\tNM1\tchr3\t-\t99\t400\t149\t350\t2\t99,299,\t200,400,\n")).first()
    assert (g.gene, g.contig, g.tx_start, g.cds_start, [(e.beg, e.end) for e in g.exons]) == ("GENE", "3", 100, 150, [(100, 200), (300, 400)])
    assert sorted(tuple(r) for r in readers.read_groups(spark, write(tmp_path, "g.grp", "G1\ta\tb\nG2\tc\n")).collect()) == [("G1", "a"), ("G1", "b"), ("G2", "c")]
    assert readers.read_map(spark, write(tmp_path, "m.txt", "chrom pos rate cm\nchr1 10 0.5 1.25\n")).first().cm == 1.25
    for form, text in (("plain", "1 5 A G\n"), ("plink", " CHR SNP BP A1 F_A F_U A2\n1 rs 5 G 0 0 A\n"), ("vcf", "1\t5\t.\tA\tG\n"), ("results", "1 5 5 1:5_A/G 9\n")):
        r = readers.read_annotator_input(spark, write(tmp_path, f"i.{form}", text), form).first()
        assert (r.contig, r.pos, r.ref, r.alt) == ("1", 5, "A", "G")


def test_reference(spark, tmp_path):
    f = readers.read_fasta(spark, write(tmp_path, "r.fa", ">1 x\nACGTAC\nGTTT\n>chr2\nGGGG\n"), chunk=4)
    p = spark.createDataFrame([("1", 1, 1), ("1", 4, 4), ("1", 9, 2), ("2", 2, 3), ("3", 1, 1)], "contig string, pos long, n long")
    got = {(r.contig, r.pos): r.base for r in readers.bases_at(p, f, length="n", chunk=4).collect()}
    assert got == {("1", 1): "A", ("1", 4): "TACG", ("1", 9): "TT", ("2", 2): "GGG", ("3", 1): None}
    v = spark.createDataFrame([("1", 1, "A", "G"), ("1", 2, "T", "C"), ("1", 3, "A", "T")], "contig string, pos long, ref string, alt string")
    r = {x.pos: (x.ref, x.alt, x.ref_ok, x.swapped) for x in readers.check_reference(v, f, 4).collect()}
    assert r == {1: ("A", "G", True, False), 2: ("C", "T", True, True), 3: ("A", "T", False, False)}
    t = tmp_path / "chr1.bin"
    t.write_bytes(struct.pack("<3f", 0.5, 1.5, 2.5))
    assert [tuple(x) for x in readers.read_score_track(spark, str(t), "1").collect()] == [("1", 1, 0.5), ("1", 2, 1.5), ("1", 3, 2.5)]


def test_stream(spark, tmp_path):
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    rows = [(m, s, (m + s) % 3, t0) for m in range(3) for s in range(5)] + [(0, 0, 0, t0)]
    spark.createDataFrame(rows, "marker int, sample int, g int, ts timestamp").write.parquet(str(tmp_path / "in"))
    null = spark.createDataFrame([(s, s - 2.0, 0.25) for s in range(5)], "sample int, r double, v double")
    calls = spark.readStream.schema("marker int, sample int, g int, ts timestamp").parquet(str(tmp_path / "in"))
    q = scorer.score_stream(calls, null, ["marker"]).writeStream.outputMode("complete").format("memory").queryName("scores").start()
    q.processAllAvailable()
    q.stop()
    got = {r.marker: (r.ns, r.u, r.v) for r in spark.table("scores").collect()}
    assert got == {m: (5, sum((s - 2) * ((m + s) % 3) for s in range(5)), sum(0.25 * ((m + s) % 3) ** 2 for s in range(5))) for m in range(3)}
