"""Block-gzip files: any cuts give the same lines, a region reads only its blocks."""

import gzip

import pytest

from locusmill.sources import blockgzip as b
from locusmill.sources import readers

HEAD = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2\n"


def sites(contig, n, step=300):
    return [f"{contig}\t{k * step + 1}\tr{contig}.{k}\tA\tG\t.\tPASS\tX={'y' * (k % 70)}\tGT\t0/{k % 2}\t./." for k in range(n)]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("blocks") / "v"
    top.mkdir()
    texts = {"chr1.vcf.gz": HEAD + "\n".join(sites("1", 900)) + "\n", "chr2.vcf.gz": HEAD + "\n".join(sites("2", 700)), "long.vcf.gz": HEAD + "3\t5\t" + "z" * 200_000 + "\tA\tG\t.\tPASS\t.\tGT\t0/0\t0/1\n3\t6\tq\tA\tG\t.\tPASS\t.\tGT\t0/0\t0/1\n"}
    for name, t in texts.items():
        data = t.encode()
        (top / name).write_bytes(b"".join(b.compress(data[i : i + 1500]) for i in range(0, len(data), 1500)) + b.LAST_BLOCK)
        assert gzip.decompress((top / name).read_bytes()).decode() == t
    return str(top), texts


@pytest.mark.parametrize("split", [50, 333, 700, 5_000, 10**9])
def test_any_cuts_give_all_lines_once(spark, folder, split):
    path, texts = folder
    for name, t in texts.items():
        d = b.read_block_lines(spark, f"{path}/{name}", split=split)
        got = sorted(r.value for r in d.select("value").coalesce(4).collect())
        assert got == sorted(t.splitlines())
    assert b.read_block_lines(spark, f"{path}/chr1.vcf.gz", split=2_000).rdd.getNumPartitions() > 3


def test_same_rows_as_plain_text_and_pruned_regions(spark, folder):
    path, _ = folder
    cols = ["contig", "pos", "id", "info", "g"]
    want = sorted(map(str, readers.read_vcf(spark, f"{path}/*.gz").select(*cols).collect()))
    assert sorted(map(str, readers.read_vcf(spark, path, blocks=True).select(*cols).collect())) == want
    index = b.write_block_index(spark, path)
    assert {r.contig for r in index.collect()} == {"1", "2", "3"}
    for region in ("1:60000-61000", "2:1-1", "2", "3:5-5", "9"):
        rows = readers.read_vcf(spark, path, region=region, blocks=True).select(*cols).collect()
        assert sorted(map(str, rows)) == sorted(map(str, readers.read_vcf(spark, f"{path}/*.gz", region=region).select(*cols).collect()))
    every = b.read_block_lines(spark, path).select("file", "block").distinct().count()
    some = b.read_block_lines(spark, path, "1:60000-61000").select("file", "block").distinct().collect()
    assert {r.file.rsplit("/", 1)[1] for r in some} == {"chr1.vcf.gz"} and len(some) <= 8 < every / 5
    assert b.read_block_lines(spark, path, "9").count() == 0


def test_plain_gzip_is_an_error(spark, tmp_path):
    (tmp_path / "p.gz").write_bytes(gzip.compress(b"a\nb\n"))
    with pytest.raises(Exception, match="no block"):
        b.read_block_lines(spark, str(tmp_path / "p.gz")).collect()


def test_written_files_come_back(spark, tmp_path):
    d = spark.range(0, 5000, 1, 3).selectExpr("concat('1\t', id, '\t', repeat('x', int(id % 90))) AS value")
    b.write_block_lines(d, str(tmp_path / "out"), "#h\n", block=3000)
    got = [r.value for r in b.read_block_lines(spark, str(tmp_path / "out"), split=4000).collect()]
    assert sorted(got) == sorted(["#h"] * 3 + [r.value for r in d.collect()])
