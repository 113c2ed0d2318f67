"""Helpers shared by the text operators: staging, native text expressions, hashing, components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of letters and digits; every character from U+0080 on counts as a letter.
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words between ASCII white space.
SPACE_WORD = r"[^\x20\x09-\x0D]+"


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only; all other characters stay as they are."""
    return F.translate(col, UPPER, LOWER)


# ---------------------------------------------------------------- staging


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir); where it is unset, a new one for a local master only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-stage-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Rows of a narrow table in one staged file, where their number is known beforehand.
ROWS_A_FILE = 20_000


def stage(df: DataFrame, name: str = "stage", rows: int | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, survives lost executors.

    rows: about how many rows a narrow df has at most; small tables then go into few files
    (never more than df has partitions), as each file costs executors several file system calls.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(rows // ROWS_A_FILE + 1)
    path = f"{scratch_root(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def unstage(df: DataFrame) -> None:
    """Deletes what stage() wrote for df, once nothing reads it any more."""
    path = getattr(df, "_staged_path", None)
    if path:
        jvm = df.sparkSession._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def arrow_batches(spark: SparkSession, size: str = "2m"):
    """What is staged within it hands Python workers about size bytes at a time, instead of 10,000 rows of any length.

    A batch is held by the executor's JVM, outside its heap, and by the worker.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def extend(schema: StructType, ddl: str) -> StructType:
    """schema with the fields of ddl after its own."""
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])


def spare(columns: list[str], *names: str) -> list[str]:
    """names, lengthened by underscores until none is among columns (without regard to case)."""
    taken = {c.lower() for c in columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


# ---------------------------------------------------------------- filters of bounded size


def bit_filter(hashes: DataFrame, least: int = 15, most: int = 27) -> np.ndarray:
    """A packed bit table with two bits set for each of hashes (column h, long): a superset test, see may_hold.

    It has about 16 bits for each hash, but never more than 2**most (16 MB), so it can be
    broadcast; where hashes are more, it lets more through and nothing is lost.
    """
    bits = 1 << min(most, max(least, int(16 * hashes.count()).bit_length()))
    places = hashes.select(F.explode(F.array(F.expr(f"h & {bits - 1}"), F.expr(f"shiftrightunsigned(h, 32) & {bits - 1}"))).alias("b"))
    pages = places.groupBy(F.expr(f"b div {_PAGE}").alias("page")).agg(F.bitmap_construct_agg(F.col("b") % _PAGE).alias("map")).collect()  # 2**most / 32768 rows of 4 KB
    table = np.zeros(bits // 8, np.uint8)
    for r in pages:
        table[r.page * _PAGE // 8 : (r.page + 1) * _PAGE // 8] = np.frombuffer(bytes(r.map), np.uint8)
    return table


_PAGE = 32768


def may_hold(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each of h may be among the hashes of the table; true for all that are."""
    u, mask = h.view(np.uint64), np.uint64(8 * len(table) - 1)

    def bit(x):
        return (table[(x >> np.uint64(3)).astype(np.int64)] >> (x & np.uint64(7)).astype(np.uint8)) & 1

    return (bit(u & mask) & bit((u >> np.uint64(32)) & mask)).astype(bool)


def batch_filter(column: str, hashes: DataFrame) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    """For use inside mapInArrow: keeps the rows of a batch whose column (long) is among hashes (column h), and perhaps a few more.

    hashes travel as a bit_filter. A mapInArrow of its own before another one would take a
    second Python worker for each task, and send all rows through the JVM once more.
    """
    table = hashes.sparkSession.sparkContext.broadcast(bit_filter(hashes))

    def kept(batch):
        return batch.filter(pa.array(may_hold(table.value, batch.column(column).to_numpy(zero_copy_only=False).astype(np.int64))))

    return kept


def rows_that_may_hold(df: DataFrame, column: str, hashes: DataFrame) -> DataFrame:
    """The rows of df that batch_filter() keeps."""
    kept = batch_filter(column, hashes)

    def run(batches):
        for batch in batches:
            yield kept(batch)

    return df.mapInArrow(run, df.schema)


# ---------------------------------------------------------------- hashing in numpy

_MULT = np.uint64(0x9E3779B97F4A7C15 | 1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values, so that all their bits depend on all bits before."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)
        self.inverse = np.uint64(pow(int(_MULT), -1, 1 << 64))

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            grow = lambda base: np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, base, np.uint64)]))
            self.up, self.down = grow(_MULT), grow(self.inverse)
        return self.up[:n], self.down[:n]


class RangeHash:
    """Hashes of any ranges of one sequence, from prefix sums: equal ranges, equal values."""

    def __init__(self, values: np.ndarray, powers: Powers) -> None:
        up, self.down = powers.get(len(values) + 1)
        self.prefix = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=self.prefix[1:])

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix64((self.prefix[stop] - self.prefix[start]) * self.down[start] + (np.asarray(stop) - np.asarray(start)).astype(np.uint64))


def byte_table(pattern_is_word: str) -> np.ndarray:
    """For each byte, whether it belongs to a word ('alnum' or 'space' words). Bytes from 0x80 on always do."""
    b = np.arange(256)
    if pattern_is_word == "alnum":
        return (b >= 0x80) | ((b >= 0x30) & (b <= 0x39)) | ((b >= 0x61) & (b <= 0x7A))
    return ~((b == 0x20) | ((b >= 0x09) & (b <= 0x0D)))


#: Maps A-Z to a-z.
LOWER_BYTES = np.arange(256, dtype=np.uint8)
LOWER_BYTES[0x41:0x5B] += 32


def words_of(data: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes in data."""
    w = np.zeros(len(data) + 2, np.int8)
    w[1:-1] = is_word[data]
    d = np.diff(w)
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def join_bytes(texts: list[bytes], sep: bytes = b"\n") -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array with a separator after each; starts (one more than texts)."""
    data = np.frombuffer(sep.join([*texts, b""]), np.uint8) if texts else np.zeros(0, np.uint8)
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    return data, np.concatenate([[0], np.cumsum(sizes + len(sep))])


def slices(batches, rows: int = 1024):
    """The same rows in smaller batches, so that a task holds few of them as Python objects at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def batches_of_bytes(rows: list, limit: int = 1 << 19):
    """Cuts rows (text bytes first) into runs of about limit bytes, so that memory stays bounded."""
    part, total = [], 0
    for row in rows:
        part.append(row)
        total += len(row[0]) + 64
        if total >= limit:
            yield part
            part, total = [], 0
    if part:
        yield part


# ---------------------------------------------------------------- connected components


def connected_components(edges: DataFrame, max_rounds: int = 60, rows: int | None = None) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the smallest node reachable.

    Alternates large-star and small-star steps on distributed edges, which ends after
    about log(n) rounds; an error is raised where max_rounds don't suffice. Hubs are only aggregated (min with map-side combine) and joined,
    where skewed joins are split at run time; no group is gathered. Empty edges give no rows.
    rows: about how many edges there are at most, if known (for the staged files).
    """
    e = stage(edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u <> v").distinct(), "edges", rows)
    last = None
    for k in range(max_rounds + 1):
        if k == max_rounds:
            raise RuntimeError(f"components still change after {max_rounds} rounds")
        both = e.union(e.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        up = large.select(F.col("v").alias("u"), F.col("u").alias("v"))
        low2 = up.groupBy("u").agg(F.min("v").alias("m"))
        small = up.join(low2, "u").select(F.explode(F.array(F.struct(F.col("m").alias("u"), F.col("v").alias("v")), F.struct(F.col("m").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        new = stage(small, "edges", last[0] if last else rows)
        unstage(e)
        e = new
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == last:
            break
        last = now
    return e.select(F.col("v").alias("node"), F.col("u").alias("component")).union(e.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
