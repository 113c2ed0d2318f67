"""Benchmark decontamination as a prefix-filtered set join of word windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ALNUM_WORD, LOWER_BYTES, Powers, RangeHash, ascii_lower, batches_of_bytes, byte_table, extend, join_bytes, slices, spare, stage, words_of

WINDOW = 10
#: Bits of the filter that tells which words of the documents can matter; its size never changes.
FILTER_BITS = 23
_PAGE = 32768


def _word_hashes(texts: list[bytes], powers: Powers):
    """All words of texts: their hashes, first and last byte, text numbers, and the lower-cased bytes."""
    data, at = join_bytes(texts)
    data = LOWER_BYTES[data]
    lo, hi = words_of(data, byte_table("alnum"))
    h = RangeHash(data, powers)(lo, hi).view(np.int64)
    return h, lo, hi, np.searchsorted(at, lo, "right") - 1, data


def hash_words(words: DataFrame) -> DataFrame:
    """words (column w) with their hash h, as computed for documents."""

    def run(batches):
        powers = Powers()
        for batch in slices(batches):
            for part in batches_of_bytes([(w.encode(),) for w in batch.column("w").to_pylist()]):
                h = _word_hashes([x[0] for x in part], powers)[0]
                yield pa.RecordBatch.from_pydict({"w": pa.array([x[0].decode() for x in part]), "h": pa.array(h, pa.int64())})

    return words.select("w").mapInArrow(run, "w string, h long")


def windows_of(items: DataFrame, n: int = WINDOW) -> DataFrame:
    """Distinct (item_id, words, size): every run of n words; an item of fewer, but not none, is one window."""
    words = F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(ALNUM_WORD), 0)
    w = items.where("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), words.alias("words")).where(F.size("words") > 0)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - n + 1, F.lit(1))), lambda i: F.slice("words", i, n))
    return w.select("item_id", F.explode(runs).alias("words")).distinct().withColumn("size", F.size("words"))


def _filter_of(hashes: DataFrame, bits: int) -> np.ndarray:
    """A bit table of fixed size that holds two bits for each hash; a superset test for documents' words."""
    size = 1 << bits
    places = hashes.select(F.explode(F.array(F.expr(f"h & {size - 1}"), F.expr(f"shiftrightunsigned(h, 32) & {size - 1}"))).alias("b"))
    pages = places.groupBy(F.expr(f"b div {_PAGE}").alias("page")).agg(F.bitmap_construct_agg(F.col("b") % _PAGE).alias("map")).collect()  # 2**bits / 32768 rows of 4 KB
    table = np.zeros(size // 8, np.uint8)
    for r in pages:
        table[r.page * _PAGE // 8 : (r.page + 1) * _PAGE // 8] = np.frombuffer(bytes(r.map), np.uint8)
    return np.unpackbits(table, bitorder="little").astype(bool)


def _may_hold(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    mask = np.uint64(len(table) - 1)
    u = h.view(np.uint64)
    return table[(u & mask).astype(np.int64)] & table[((u >> np.uint64(32)) & mask).astype(np.int64)]


def word_counts(docs: DataFrame, vocabulary: DataFrame, bits: int) -> DataFrame:
    """(h, n): how often each word of vocabulary occurs in all texts."""
    shared = docs.sparkSession.sparkContext.broadcast(_filter_of(vocabulary, bits))

    def run(batches):
        powers = Powers()
        for batch in slices(batches):
            for part in batches_of_bytes([(t.encode(),) for t in batch.column("text").to_pylist() if t]):
                h = _word_hashes([x[0] for x in part], powers)[0]
                h, n = np.unique(h[_may_hold(shared.value, h)], return_counts=True)
                yield pa.RecordBatch.from_pydict({"h": pa.array(h, pa.int64()), "n": pa.array(n, pa.int64())})

    return docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _probe(docs: DataFrame, prefixes: DataFrame, n: int, bits: int) -> DataFrame:
    """Per text one row with n_words, and one for each place of a prefix word, with the up to 2n-1 words around it."""
    shared = docs.sparkSession.sparkContext.broadcast(_filter_of(prefixes, bits))
    keyed = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    schema = extend(keyed.select("rid", "doc_id").schema, "n_words long, h long, p long, lead int, around string")

    def run(batches):
        powers = Powers()
        for batch in slices(batches):
            rows = list(zip([b"" if t is None else t.encode() for t in batch.column("text").to_pylist()], range(batch.num_rows)))
            for part in batches_of_bytes(rows):
                h, lo, hi, doc, data = _word_hashes([x[0] for x in part], powers)
                first = np.searchsorted(doc, np.arange(len(part) + 1))
                where = pa.array([x[1] for x in part])
                size = np.diff(first)
                k = np.flatnonzero(_may_hold(shared.value, h))
                a, b = np.maximum(k - n + 1, first[doc[k]]), np.minimum(k + n, first[doc[k] + 1])
                raw = data.tobytes()
                around = [b" ".join(raw[lo[j] : hi[j]] for j in range(x, y)).decode() for x, y in zip(a, b)]
                none = np.zeros(len(part), bool)
                take = np.concatenate([np.arange(len(part)), doc[k]])
                at = where.take(pa.array(take))
                blank = lambda v, t: pa.concat_arrays([pa.nulls(len(none), t), pa.array(v, t)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("rid").take(at), batch.column("doc_id").take(at), pa.array(size[take], pa.int64()), blank(h[k], pa.int64()), blank(k - first[doc[k]], pa.int64()), blank((k - a).astype(np.int32), pa.int32()), blank(around, pa.string())],
                    schema.names,
                )

    return keyed.mapInArrow(run, schema)


def occurrences(docs: DataFrame, items: DataFrame, n: int = WINDOW, bits: int = FILTER_BITS) -> DataFrame:
    """rid, doc_id, n_words, start, size, item_id: every occurrence of an item's window, and a row with null start for each text.

    Windows are sets to be contained whole, so the prefix of each is its rarest word (counted
    over all documents; ties by hash). Documents' words probe a filter of fixed size and go to
    the join with the prefixes, which Spark plans by size. The offset of the prefix word in the
    window and the text's length bound the place (positional and length filters); the words of
    the window are then compared one by one.
    """
    rows = 100 * items.count()  # windows, roughly
    w = stage(windows_of(items, n), "windows", rows)
    words = hash_words(w.select(F.explode("words").alias("w")).distinct())
    words = stage(words.join(word_counts(docs, words.select("h"), bits), "h", "left").select("w", "h", F.coalesce("n", F.lit(0)).alias("n")), "rarity", rows)
    one = w.groupBy("words", "size").agg(F.collect_set("item_id").alias("items"))
    places = one.select(F.xxhash64(F.array_join("words", " ")).alias("wid"), "words", F.posexplode("words").alias("off", "w")).join(words, "w")
    prefix = places.groupBy("wid", "words").agg(F.min(F.struct("n", "h", "off")).alias("x")).select("words", "x.h", "x.off")
    prefix = stage(prefix.join(one, "words").select("h", "off", F.array_join("words", " ").alias("window"), "size", "items"), "prefixes", rows)
    found = stage(_probe(docs, prefix.select("h").distinct(), n, bits), "probes")
    start = F.col("p") - F.col("off")
    hit = found.where("h is not null").join(prefix, "h").where((F.col("off") <= F.col("lead")) & (start + F.col("size") <= F.col("n_words")))
    hit = hit.where(F.array_join(F.slice(F.split("around", " "), F.col("lead") - F.col("off") + 1, F.col("size")), " ") == F.col("window"))
    hit = hit.select("rid", "doc_id", "n_words", start.alias("start"), "size", "items")
    texts = found.where("h is null").select("rid", "doc_id", "n_words")
    return hit.unionByName(texts, allowMissingColumns=True)


def contamination(docs: DataFrame, items: DataFrame, n: int = WINDOW, bits: int = FILTER_BITS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each document.

    Null texts have no words; null items, items without words and null item ids give no window;
    repeated items count once by id. Rows are told apart by position, so null or repeated ids
    are fine; very long texts are read whole; other columns, whatever their names, aren't
    read. Without items nothing is hit; an empty table gives no rows.
    """
    o = occurrences(docs, items, n, bits)
    before = F.max(F.col("start") + F.col("size")).over(Window.partitionBy("rid").orderBy(F.col("start").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1))
    end = F.col("start") + F.col("size")
    o = o.withColumn("new", F.when(F.col("start").isNotNull(), F.greatest(F.lit(0), end - F.greatest(F.col("start"), F.coalesce(before, F.lit(0))))).otherwise(0))
    who = F.array_sort(F.array_distinct(F.flatten(F.collect_set("items"))))
    out = o.groupBy("rid", "doc_id", "n_words").agg(F.sum("new").cast("long").alias("n_hit"), who.alias("who"))
    return out.select("doc_id", "n_words", "n_hit", F.size("who").cast("long").alias("n_items"), F.sha2(F.array_join("who", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def without_contaminated(docs: DataFrame, items: DataFrame, n: int = WINDOW) -> DataFrame:
    """docs without the rows whose text holds a window of an item; all columns, whatever their names, and other rows stay.

    Nulls, repeated rows, long texts and empty tables fare as in contamination().
    """
    me, hit = spare(docs.columns, "me", "hit")
    tagged = docs.withColumn(me, F.struct("doc_id", F.xxhash64("text").alias("t")))
    found = contamination(tagged.select(F.col(me).alias("doc_id"), "text"), items, n).where("contaminated").select(F.col("doc_id").alias(hit)).distinct()
    return tagged.join(found, F.col(me).eqNullSafe(F.col(hit)), "left_anti").select(*docs.columns)
