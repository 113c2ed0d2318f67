"""Block-gzip text as a splittable source: tasks start at any block of a file, and an index of blocks prunes by contig and position."""

from __future__ import annotations

import glob
import json
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Fixed values of the format: how a block begins, its extra field, the largest block, the empty block at the end.
MAGIC, EXTRA, LARGEST = b"\x1f\x8b\x08\x04", b"BC\x02\x00", 1 << 16
LAST_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
#: Bases of a bin of the index.
BIN = 16_384


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[str, int]]:
    """(file, bytes) of a file, a folder's *.gz files or a pattern (of local files)."""
    where, name = _place(path)
    if any(c in name for c in "*?[") and isinstance(where, fs.LocalFileSystem):
        found = where.get_file_info(sorted(glob.glob(name)))
    else:
        info = where.get_file_info(name)
        found = [info] if info.type == fs.FileType.File else where.get_file_info(fs.FileSelector(name))
    head = path[: len(path) - len(name)] if path.endswith(name) else ""
    out = [(head + i.path, i.size) for i in found if i.type == fs.FileType.File and (i.path.endswith((".gz", ".bgz")) or len(found) == 1)]
    if not out:
        raise FileNotFoundError(path)
    return sorted(out)


def block_size(head: bytes) -> int:
    """Bytes of the block that begins with head (18 bytes at least), 0 if none does."""
    return int.from_bytes(head[16:18], "little") + 1 if head[:4] == MAGIC and head[12:16] == EXTRA else 0


def first_block(data: bytes, whole: bool) -> int:
    """Where the first block in data begins, -1 if nowhere: the next one must follow it, unless data ends before (whole: with the file)."""
    at = data.find(MAGIC)
    while at >= 0:
        size = block_size(data[at : at + 18])
        if size and (block_size(data[at + size : at + size + 18]) or (at + size == len(data) if whole else at + size + 18 > len(data))):
            return at
        at = data.find(MAGIC, at + 1)
    return -1


class Part(InputPartition):
    """Blocks of a file that begin from start to before end."""

    def __init__(self, file: str, start: int, end: int) -> None:
        self.file, self.start, self.end = file, start, end


class BlockGzipReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.split = int(options.get("split", 8 << 20))
        self.ranges = json.loads(options["ranges"]) if "ranges" in options else [(f, 0, n) for f, n in _files(options["path"])]

    def partitions(self) -> list[Part]:
        """No block is read for this: a task finds its first block itself."""
        return [Part(f, at, min(at + self.split, end)) for f, start, end in self.ranges for at in range(start, end, self.split)]

    def read(self, part: Part | None):
        """value, file, block: the lines after each line feed in the part's blocks (and the file's first), block being that of the line feed."""
        if part is None:  # without partitions Spark asks once all the same
            return
        where, name = _place(part.file)
        with where.open_input_file(name) as f:
            size, at = f.size(), part.start
            if at:
                f.seek(at)
                window = f.read(min(2 * LARGEST + 18, size - at))
                offset = first_block(window, at + len(window) == size)
                if offset < 0 or at + offset >= part.end:
                    return
                at += offset
            f.seek(at)
            carry, owner = b"", (0 if at == 0 else None)  # without an owner, the line belongs to the part before
            while at < size:
                head = f.read(18)
                length = block_size(head)
                if not length:
                    raise ValueError(f"{part.file}: no block at {at}")
                body = f.read(length - 18)
                lines = (carry + zlib.decompress(body[:-8], wbits=-15)).split(b"\n")
                done, carry = lines[:-1], lines[-1]
                if at >= part.end:  # only the line that is still open
                    if done and owner is not None:
                        yield self._batch(done[:1], [owner], part.file)
                        owner = None
                    if done or owner is None:
                        return
                elif done:
                    owners = [owner] + [at] * (len(done) - 1)
                    yield self._batch(done[owner is None :], owners[owner is None :], part.file)
                    owner = at
                at += length
            if carry and owner is not None:
                yield self._batch([carry], [owner], part.file)

    @staticmethod
    def _batch(lines: list[bytes], owners: list[int], file: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"value": pa.array([x.removesuffix(b"\r") for x in lines], pa.binary()).cast(pa.string()), "file": pa.array([file] * len(lines), pa.string()), "block": pa.array(owners, pa.int64())})


class BlockGzip(DataSource):
    """spark.read.format("blockgzip"): value, file, block; options path, split (compressed bytes a task), ranges."""

    @classmethod
    def name(cls) -> str:
        return "blockgzip"

    def schema(self) -> str:
        return "value string, file string, block long"

    def reader(self, schema) -> DataSourceReader:
        return BlockGzipReader(self.options)


def _bounds(region: str) -> tuple[str, int, int]:
    contig, _, rest = region.partition(":")
    low, _, high = rest.replace(",", "").partition("-")
    return contig, int(low or 0), int(high or (1 << 40))


def read_block_lines(spark: SparkSession, path: str, region: str | None = None, split: int = 8 << 20) -> DataFrame:
    """value, file, block of block-gzip files: many tasks a file.

    With a region ("7", "7:100-200") and an index (write_block_index()), only blocks that can
    hold its lines are read, of only those files that do; lines near them come along, so filter
    by position still. A file that isn't block-gzip is an error.
    """
    spark.dataSource.register(BlockGzip)
    reader = spark.read.format("blockgzip").option("path", path).option("split", str(split))
    if region and has_index(path):
        contig, low, high = _bounds(region)
        spans = spark.read.parquet(_index(path)).where((F.col("contig") == contig) & F.col("bin").between(low // BIN, high // BIN))
        rows = spans.groupBy("file").agg(F.min("first").alias("first"), F.max("last").alias("last")).collect()  # a row a file
        reader = reader.option("ranges", json.dumps([(r.file, r.first, r.last + 1) for r in rows]))
    return reader.load()


def _index(path: str) -> str:
    return path.rstrip("/*").removesuffix(".gz").rstrip("*") + ".blocks"


def has_index(path: str) -> bool:
    where, name = _place(_index(path))
    return where.get_file_info(name).type == fs.FileType.Directory


def write_block_index(spark: SparkSession, path: str) -> DataFrame:
    """Writes, beside path, and returns file, contig, bin (BIN bases), first and last: the blocks between which lines of the bin are found."""
    x = read_block_lines(spark, path).where("value <> '' and not startswith(value, '#')")
    head = F.split("value", "\t", 3)
    bins = x.groupBy("file", head[0].alias("contig"), F.floor(head[1].cast("long") / BIN).alias("bin")).agg(F.min("block").alias("first"), F.max("block").alias("last"))
    bins.coalesce(1).sortWithinPartitions("contig", "bin").write.mode("overwrite").parquet(_index(path))
    return spark.read.parquet(_index(path))


def compress(data: bytes) -> bytes:
    """One block of up to 65,280 bytes."""
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    head = MAGIC + b"\0\0\0\0\0\xff\x06\0" + EXTRA + (len(body) + 25).to_bytes(2, "little")
    return head + body + zlib.crc32(data).to_bytes(4, "little") + len(data).to_bytes(4, "little")


def write_block_lines(lines: DataFrame, path: str, header: str = "", column: str = "value", block: int = 65_280) -> None:
    """Writes a file part-N.gz for each partition of lines, in their order, each with the header (with its line feed). path is shared by all tasks.

    A file appears under its name only once it is whole, so a task that is run again leaves no half of one.
    """

    def run(k, batches):
        where, folder = _place(path)
        where.create_dir(folder)
        name = f"{folder.rstrip('/')}/part-{k:05d}.gz"
        with where.open_output_stream(name + ".open") as out:
            kept = header.encode()
            for row in batches:
                kept += (row[0] or "").encode() + b"\n"
                while len(kept) >= block:
                    out.write(compress(kept[:block]))
                    kept = kept[block:]
            if kept:
                out.write(compress(kept))
            out.write(LAST_BLOCK)
        where.move(name + ".open", name)
        yield 1

    lines.select(column).rdd.mapPartitionsWithIndex(run).count()
