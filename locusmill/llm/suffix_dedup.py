"""Suffix-array dedup: repeated byte strings found by column-wise construction over many texts.

A string of LENGTH bytes that occurs twice has the same anchor (its smallest hashed K-byte
word, the leftmost of ties) at the same place in both. Texts are therefore cut into pieces:
maximal runs of window starts with one anchor. Pieces with the same anchor meet in one group,
aligned at the anchor, and equal windows always lie in the same columns. A group's collection
is built column by column from the right: each round inserts one symbol of every piece into
the sorted order of its suffixes. A round reads the Burrows-Wheeler column (the symbols to be
inserted, in the order of the suffixes they stand before), the pieces in that order and the
common prefixes of neighbours from the sequential files of the round before, and writes them
anew; nothing else is kept from round to round. The files belong to the task that builds the
collection and end with it. A window is repeated where a neighbour's common prefix reaches
LENGTH.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pyspark.sql.types import StructType

from .common import Powers, RangeHash, extend, mix64, slices, spare, stage, unstage

LENGTH, K = 200, 32
#: Window starts looked at together; a longer text goes in several parts.
CHUNK = 1 << 20
#: Groups with more distinct pieces are cut into single windows, which need no gathering.
HOT = 50_000
#: Pieces built together in a task.
BATCH = 20_000
_POS = np.uint64((1 << 24) - 1)


def cut(parts: list[bytes], powers: Powers, length: int = LENGTH, k: int = K, single: bool = False) -> dict[str, np.ndarray]:
    """Pieces of parts (each under 8 MB in all): part, start, windows, off (anchor from the start), anchor and piece hash.

    single: every window is a piece, and its own hash is its anchor's.
    """
    size = np.array([len(p) for p in parts], np.int64)
    data = np.frombuffer(b"".join(parts), np.uint8)
    at = np.concatenate([[0], np.cumsum(size)])
    many = np.maximum(size - length + 1, 0)
    if not many.sum():
        return {c: np.zeros(0, np.int64) for c in ("part", "start", "windows", "off", "anchor", "piece")}
    part = np.repeat(np.arange(len(parts)), many)
    start = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + at[part]
    ranges = RangeHash(data, powers)
    if single:
        h = ranges(start, start + length).view(np.int64)
        return {"part": part, "start": start - at[part], "windows": np.ones(len(start), np.int64), "off": np.zeros(len(start), np.int64), "anchor": h, "piece": h}
    every = np.arange(len(data) - k + 1)
    word = ranges(every, every + k)
    low = (word & ~_POS) | every.astype(np.uint64)
    width, span = length - k + 1, 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    anchor = (low[start] & _POS).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])
    first = np.flatnonzero(new)
    windows = np.diff(np.append(first, len(start)))
    s, p = start[first], part[first]
    return {"part": p, "start": s - at[p], "windows": windows, "off": anchor[first] - s, "anchor": word[anchor[first]].view(np.int64), "piece": ranges(s, s + windows + length - 1).view(np.int64)}


def repeated_windows(pieces: list[bytes], off: np.ndarray, group: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """A flag for each piece and column (of the aligned matrix), whether the window that starts there is repeated.

    group must ascend. Also returned: the column of each piece's first byte.
    """
    size = np.array([len(p) for p in pieces], np.int64)
    left = int(off.max())
    begin = left - off
    end = begin + size
    width = int(end.max())
    flags = np.zeros((width, len(pieces)), bool)
    by_end = np.argsort(-end, kind="stable")
    entered = 0
    with tempfile.TemporaryFile() as text, _State() as old, _State() as new:
        # the texts by column, in the order in which rounds read them
        matrix = np.zeros((len(pieces), width), np.uint8)
        matrix[np.repeat(np.arange(len(pieces)), size), np.concatenate([np.arange(a, b) for a, b in zip(begin, end)])] = np.frombuffer(b"".join(pieces), np.uint8)
        np.ascontiguousarray(matrix[:, ::-1].T).tofile(text)
        del matrix
        text.seek(0)
        symbol = np.fromfile(text, np.uint8, len(pieces))
        old.write(np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint8))
        for c in range(width - 1, -1, -1):
            order, lcp, bwt = old.read()
            upto = np.searchsorted(-end[by_end], -c, "left")
            if upto > entered:  # pieces that end here come before all others of their group, with nothing in common
                fresh = np.sort(by_end[entered:upto]).astype(np.int32)
                both = np.concatenate([fresh, order])
                place = np.argsort(group[both], kind="stable")
                order, bwt = both[place], np.concatenate([symbol[fresh], bwt])[place]
                lcp = np.concatenate([np.zeros(len(fresh), np.int32), lcp])[place]
                # whoever follows a fresh piece shares nothing with it
                lcp[1:][place[:-1] < len(fresh)] = 0
                entered = upto
            live = begin[order] <= c
            if not live.all():  # pieces that begin right of here leave; their neighbours share the least of both
                idx = np.flatnonzero(live)
                lcp = np.minimum.reduceat(lcp[: idx[-1] + 1], np.concatenate([[0], idx[:-1] + 1])) if len(idx) else lcp[:0]
                order, bwt = order[idx], bwt[idx]
            if len(order):
                order, lcp = _insert(order, lcp, group[order] * 256 + bwt)
                best = lcp.copy()
                best[:-1] = np.maximum(best[:-1], lcp[1:])
                flags[c, order] = best >= length
            symbol = np.fromfile(text, np.uint8, len(pieces)) if c else symbol
            new.write(order, lcp, symbol[order])
            old, new = new, old
    return flags, begin


class _State:
    """What a round leaves to the next one, in sequential files: pieces in order, common prefixes, and the Burrows-Wheeler column."""

    kinds = (np.int32, np.int32, np.uint8)

    def __enter__(self):
        self.files = [tempfile.TemporaryFile() for _ in self.kinds]
        return self

    def __exit__(self, *_):
        for f in self.files:
            f.close()

    def write(self, *columns: np.ndarray) -> None:
        self.n = len(columns[0])
        for f, x, kind in zip(self.files, columns, self.kinds):
            f.seek(0)
            x.astype(kind).tofile(f)
            f.flush()

    def read(self) -> list[np.ndarray]:
        out = []
        for f, kind in zip(self.files, self.kinds):
            f.seek(0)
            out.append(np.fromfile(f, kind, self.n))
        return out


def _insert(order: np.ndarray, lcp: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One round: pieces in the order of their suffixes with one symbol more (key: group and symbol), and the new common prefixes.

    Pieces with the same symbol keep their order; two that follow each other then share one
    symbol more than the least common prefix between them before.
    """
    place = np.argsort(key, kind="stable")
    key = key[place]
    same = np.flatnonzero(key[1:] == key[:-1]) + 1
    a, b = place[same - 1], place[same]
    new = np.zeros(len(order), np.int32)
    if len(same):
        wide = b - a > 1
        new[same] = lcp[b] + 1
        if wide.any():
            cuts = np.stack([a[wide] + 1, b[wide] + 1], 1).ravel()
            new[same[wide]] = np.minimum.reduceat(np.append(lcp, np.int32(0)), cuts)[::2] + 1
    return order[place], new


def _runs(flags: np.ndarray) -> tuple[list[int], list[int]]:
    d = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    a = np.flatnonzero(d == 1)
    return a.tolist(), (np.flatnonzero(d == -1) - a).tolist()


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("tkey"), "text")


def _texts(batch) -> list[bytes]:
    return [b"" if t is None else t.encode() for t in batch.column("text").to_pylist()]


def _chunks(b: bytes, length: int, chunk: int):
    """(offset, bytes) parts of one text that hold each of its windows once."""
    for s in range(0, max(len(b) - length + 1, 0), chunk):
        yield s, b[s : s + chunk + length - 1]


def _pieces(docs: DataFrame, length: int, k: int, chunk: int) -> DataFrame:
    """anchor, piece, doc_id, tkey, start, windows, off of all texts, and route and known.

    An anchor that occurs twice in the run of texts at hand is known to be repeated: its first
    piece tells others so where the anchor's rows meet (route), all further ones are dealt out.
    So no place has more than one row of an anchor from each run, however often it occurs.
    """
    keyed = _keyed(docs)

    def run(batches):
        powers = Powers()
        for batch in slices(batches):
            ids, keys = batch.column("doc_id").to_pylist(), batch.column("tkey").to_pylist()
            part, total = [], 0
            todo = [(i, s, b) for i, t in enumerate(_texts(batch)) for s, b in _chunks(t, length, chunk)]
            for n, item in enumerate(todo):
                part.append(item)
                total += len(item[2])
                if total >= chunk or n == len(todo) - 1:
                    c = cut([x[2] for x in part], powers, length, k)
                    row = np.array([x[0] for x in part])[c["part"]] if len(c["part"]) else c["part"]
                    base = np.array([x[1] for x in part], np.int64)[c["part"]] if len(c["part"]) else c["part"]
                    anchor = c["anchor"]
                    _, first, which, count = np.unique(anchor, return_index=True, return_inverse=True, return_counts=True) if len(anchor) else [anchor.astype(np.int64)] * 4
                    known = count[which] > 1
                    further = known & (first[which] != np.arange(len(anchor)))
                    dealt = mix64(anchor.view(np.uint64) + mix64(c["piece"].view(np.uint64)) + np.arange(len(anchor)).astype(np.uint64)).view(np.int64)
                    yield pa.RecordBatch.from_pydict({
                        "anchor": pa.array(c["anchor"], pa.int64()), "piece": pa.array(c["piece"], pa.int64()), "doc_id": pa.array([ids[i] for i in row], batch.schema.field("doc_id").type),
                        "tkey": pa.array([keys[i] for i in row], pa.int64()), "start": pa.array(c["start"] + base, pa.int64()), "windows": pa.array(c["windows"].astype(np.int32)), "off": pa.array(c["off"].astype(np.int32)),
                        "route": pa.array(np.where(further, dealt, anchor), pa.int64()), "known": pa.array(known, pa.bool_()),
                    })
                    part, total = [], 0

    schema = StructType([*StructType.fromDDL("anchor long, piece long").fields, *keyed.select("doc_id").schema.fields, *StructType.fromDDL("tkey long, start long, windows int, off int, route long, known boolean").fields])
    return keyed.mapInArrow(run, schema)


def _with_texts(docs: DataFrame, wanted: DataFrame, cols: list[str]) -> DataFrame:
    """text, want: the texts of the rows wanted (doc_id, tkey, cols), each once."""
    w = wanted.groupBy(F.col("doc_id").alias("_d"), F.col("tkey").alias("_t")).agg(F.collect_list(F.struct(*cols)).alias("want"))
    d = _keyed(docs)
    return d.join(w, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("tkey") == F.col("_t")))


def _build(collection: DataFrame, length: int, batch_pieces: int) -> DataFrame:
    """anchor, piece, runs (start, windows) of repeated windows, from rows anchor, piece, off, n, bytes sorted by anchor."""

    def solve(rows):
        twice = [r for r in rows for _ in range(2 if r[3] > 1 else 1)]
        ids = {a: i for i, a in enumerate(dict.fromkeys(r[0] for r in twice))}
        flags, begin = repeated_windows([r[4] for r in twice], np.array([r[2] for r in twice], np.int64), np.array([ids[r[0]] for r in twice], np.int64), length)
        out, last = [], None
        for i, r in enumerate(twice):
            if r is last:
                continue
            last = r
            a, n = _runs(flags[begin[i] : begin[i] + len(r[4]) - length + 1, i])
            if a:
                out.append((r[0], r[1], [{"o": x, "n": y} for x, y in zip(a, n)]))
        kind = pa.list_(pa.struct([("o", pa.int32()), ("n", pa.int32())]))
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], kind)], ["anchor", "piece", "runs"])

    def run(batches):
        rows = []
        for batch in slices(batches):
            cols = [batch.column(c).to_pylist() for c in ("anchor", "piece", "off", "n", "bytes")]
            for r in zip(*cols):
                if len(rows) >= batch_pieces and r[0] != rows[-1][0]:
                    yield solve(rows)
                    rows = []
                rows.append(r)
        if rows:
            yield solve(rows)

    return collection.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "anchor long, piece long, runs array<struct<o:int,n:int>>")


def repeated_spans(docs: DataFrame, length: int = LENGTH, k: int = K, chunk: int = CHUNK, hot: int = HOT, batch: int = BATCH) -> DataFrame:
    """doc_id, tkey, spans: of each text with repeated windows, the byte ranges that they cover (may overlap)."""
    pieces = _pieces(docs, length, k, chunk).withColumn("met", F.count("*").over(Window.partitionBy("route")))
    shared = stage(pieces.where("known or met > 1").drop("route", "known", "met"), "pieces")
    distinct = shared.groupBy("anchor").agg(F.approx_count_distinct("piece").alias("d")).where(F.col("d") > hot).select("anchor")
    crowded = stage(distinct, "crowded")
    if not crowded.isEmpty():
        # an anchor with very many different pieces: each of its windows becomes a group of its own
        parts = _with_texts(docs, shared.join(crowded, "anchor", "left_semi"), ["start", "windows"])

        names = shared.columns

        def single(batches):
            powers = Powers()
            for b in slices(batches):
                for i, (t, want) in enumerate(zip(_texts(b), b.column("want").to_pylist())):
                    c = cut([t[w["start"] : w["start"] + w["windows"] + length - 1] for w in want], powers, length, k, single=True)
                    base = np.array([w["start"] for w in want], np.int64)[c["part"]]
                    n = len(base)
                    rep = lambda name: b.column(name).take(pa.array(np.full(n, i)))  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([pa.array(c["anchor"], pa.int64()), pa.array(c["piece"], pa.int64()), rep("doc_id"), rep("tkey"), pa.array(c["start"] + base, pa.int64()), pa.array(np.ones(n, np.int32)), pa.array(np.zeros(n, np.int32))], names)

        windows = parts.select("doc_id", "tkey", "text", "want").mapInArrow(single, shared.schema)
        shared = stage(shared.join(crowded, "anchor", "left_anti").union(windows), "pieces")
    reps = shared.groupBy("anchor", "piece", "windows", "off").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "tkey", "start")).alias("r"))
    reps = reps.select("anchor", "piece", "windows", "off", F.least("n", F.lit(2)).cast("int").alias("n"), "r.*")
    texts = _with_texts(docs, reps, ["anchor", "piece", "start", "windows", "off", "n"])

    def fetch(batches):
        for b in slices(batches):
            for t, want in zip(_texts(b), b.column("want").to_pylist()):
                names = ("anchor", "piece", "off", "n")
                cols = {c: pa.array([w[c] for w in want], pa.int64()) for c in names}
                yield pa.RecordBatch.from_pydict(cols | {"bytes": pa.array([t[w["start"] : w["start"] + w["windows"] + length - 1] for w in want], pa.binary())})

    collection = texts.select("text", "want").mapInArrow(fetch, "anchor long, piece long, off long, n long, bytes binary")
    runs = stage(_build(collection, length, batch), "repeats")
    found = shared.select("anchor", "piece", "doc_id", "tkey", "start").join(runs, ["anchor", "piece"])
    span = F.transform("runs", lambda r: F.struct((F.col("start") + r["o"]).alias("a"), (F.col("start") + r["o"] + r["n"] + (length - 1)).alias("b")))
    return found.select("doc_id", "tkey", span.alias("spans")).groupBy("doc_id", "tkey").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def _remove(docs: DataFrame, finish, ddl: str, **options) -> DataFrame:
    """docs' rows (all columns but text) with finish(text, text bytes, removed flags) as new columns."""
    d, t, cut, k = spare(docs.columns, "d", "t", "cut", "k")
    spans = repeated_spans(docs.select("doc_id", "text"), **options).withColumnsRenamed({"doc_id": d, "tkey": t, "spans": cut})
    keyed = docs.withColumn(k, F.xxhash64("text"))
    joined = keyed.join(spans, F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(k) == F.col(t)), "left").select(*docs.columns, cut)
    keep = [c for c in docs.columns if c != "text"]

    def run(batches):
        for b in slices(batches):
            for start in range(0, b.num_rows, 256):
                part = b.slice(start, 256)
                out = []
                for t, spans in zip(part.column("text").to_pylist(), part.column(cut).to_pylist()):
                    raw = b"" if t is None else t.encode()
                    gone = np.zeros(len(raw) + 1, np.int32)
                    for s in spans or ():
                        gone[s["a"]] += 1
                        gone[s["b"]] -= 1
                    out.append(finish(t, raw, np.cumsum(gone[:-1]) > 0))
                new = pa.RecordBatch.from_pylist(out, schema=pa.schema(kinds))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *new.columns], [*keep, *new.schema.names])

    kinds = [(n, {"long": pa.int64(), "string": pa.string()}[k]) for n, k in (x.split() for x in ddl.split(", "))]
    return joined.mapInArrow(run, extend(docs.select(*keep).schema, ddl))


def _left(raw: bytes, gone: np.ndarray) -> bytes:
    return np.frombuffer(raw, np.uint8)[~gone].tobytes() if len(raw) else b""


def dedup_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document.

    Null and empty texts have no bytes, texts of fewer than length bytes no window. Every row
    counts as a document: a repeated row repeats all its windows. Null ids take part; other
    columns aren't read; an empty table gives no rows. Windows are told apart by 64-bit hashes
    of their anchors and compared byte by byte in the collection; only equal pieces are
    recognised by hash (64 bits and their anchor's 64).
    """

    def finish(t, raw, gone):
        n = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1))
        return {"n_bytes": len(raw), "n_removed": int(gone.sum()), "n_spans": n, "kept_sha256": hashlib.sha256(_left(raw, gone)).hexdigest()}

    return _remove(docs.select("doc_id", "text"), finish, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", **options)


def remove_repeats(docs: DataFrame, **options) -> DataFrame:
    """docs without the bytes that repeated strings cover; characters cut in two are dropped.

    Null stays null; all columns, whatever their names, and rows stay; an empty table stays empty.
    """
    order = docs.columns
    return _remove(docs, lambda t, raw, gone: {"text": t if t is None or not gone.any() else _left(raw, gone).decode("utf-8", "ignore")}, "text string", **options).select(*order)
