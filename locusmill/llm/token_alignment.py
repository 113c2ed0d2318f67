"""Cross-tokenizer alignment: ends of two tokenizers' tokens are intersected by galloping; common ends cut groups, whose token pairs are counted corpus-wide."""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import batches_of_bytes, slices, stage

#: Folder of the vocabulary files; they are read there and never copied.
TOKENIZERS = "/opt/tokenizers"
BYTE_FILE, PIECE_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
# Fixed value: the published pattern that cuts a text before byte-level merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A pair of ids is one number: id of A << SHIFT | id of B.
SHIFT = 20
#: Both tokenizers cut before a single space between two of these characters, whatever stands around it.
_CUT = re.compile(r"(?<=[!-~À-ɏ]) (?=[!-~À-ɏ])")
#: Runs of text between such spaces whose tokens a worker remembers, at most.
REMEMBERED = 200_000


def gallop(x: np.ndarray, y: np.ndarray, run: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """Places in x and in y of the values that two increasing arrays share.

    The shorter array drives: each of its values is sought in the longer one from the place of the
    value before, by steps of 1, 2, 4 and so on, then by halving the last step. Runs of the
    shorter array advance side by side, each from its own first place.
    """
    if len(x) > len(y):
        return gallop(y, x, run)[::-1]
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    n, lanes = len(y), -(-len(x) // run)
    longer = np.append(y, np.iinfo(np.int64).max)
    short = np.full(lanes * run, x[-1], np.int64)
    short[: len(x)] = x
    short = np.ascontiguousarray(short.reshape(lanes, run).T)
    place = np.searchsorted(y, short[0])
    places = np.empty_like(short)
    for k in range(run):
        v, low, step = short[k], place, np.ones(lanes, np.int64)
        while (on := longer[np.minimum(low + step, n)] < v).any():
            low = np.where(on, low + step, low)
            step = np.where(on, 2 * step, step)
        high = np.minimum(low + step, n)
        while (on := low < high).any():
            mid = (low + high) >> 1
            less = longer[mid] < v
            low, high = np.where(on & less, mid + 1, low), np.where(on & ~less, mid, high)
        places[k] = place = low
    places = places.T.reshape(-1)[: len(x)]
    hit = longer[places] == x
    return np.flatnonzero(hit), places[hit]


def _byte_level() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable ones stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Both tokenizers over their files' contents, with the tokens of frequent runs remembered.

    A is run by tiktoken on the file's own vocabulary, whose ids are in the order of its merges;
    that gives the ids that the tokenizers library gives, several times as fast.
    """

    def __init__(self, byte_json: bytes, piece_model: bytes) -> None:
        import sentencepiece
        import tiktoken

        level, spec = _byte_level(), json.loads(byte_json)
        special = {t["content"] for t in spec["added_tokens"]}
        vocab = {bytes(level[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=vocab, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        self.a_bytes = [b""] * (1 + max(vocab.values()))
        for token, i in vocab.items():
            self.a_bytes[i] = token
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if max(len(self.a_bytes), len(self.b_bytes)) >= 1 << SHIFT:
            raise ValueError(f"vocabularies of {1 << SHIFT} ids and more")
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.digits = _digits(max(len(self.a_bytes), len(self.b_bytes)))
        # runs are encoded on their own only if no piece goes on after a space that ends another
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)
        self.known: dict[str, tuple[bytes, bytes] | None] = {}
        self.older: dict[str, tuple[bytes, bytes] | None] = {}

    def learn(self, runs: list[str]) -> None:
        """Encodes runs that aren't known, all in one text, and cuts it where they meet; None for a run that a tokenizer changes."""
        new = []
        for r in dict.fromkeys(runs):
            if r not in self.known:
                if r in self.older:
                    self.known[r] = self.older[r]
                elif r[-1:] == " ":  # what follows could join its last spaces
                    a, b = self.whole(r)
                    self.known[r] = (a.tobytes(), b.tobytes()) if len(a) else None
                else:
                    new.append(r)
        if not new:
            return
        cut = np.cumsum([1 + len(r.encode()) for r in new])
        text = " ".join(new)
        a, b = np.array(self.a.encode_ordinary(" " + text), np.int32), np.array(self.b.encode(text, num_threads=1), np.int32)
        ends_a, ends_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        at_a, at_b = np.searchsorted(ends_a, cut) + 1, np.searchsorted(ends_b, cut) + 1
        whole = (" " + text).encode()
        if not b"".join([self.a_bytes[i] for i in a]) == whole == b"".join([self.b_bytes[i] for i in b]):
            if len(new) == 1:
                self.known[new[0]] = None
            else:  # narrows it down to the runs that are changed
                self.learn(new[: len(new) // 2])
                self.learn(new[len(new) // 2 :])
            return
        last_a = last_b = 0
        a, b = a.tobytes(), b.tobytes()
        for r, i, j in zip(new, at_a.tolist(), at_b.tolist()):
            self.known[r] = a[4 * last_a : 4 * i], b[4 * last_b : 4 * j]
            last_a, last_b = i, j

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of A and B of each text with a space before; none where either doesn't give back its bytes."""
        if not self.cuts:
            return [self.whole(t) for t in texts]
        cut = [_CUT.split(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        self.learn([r for runs, t in zip(cut, texts) if t for r in runs])
        out, none = [], np.zeros(0, np.int32)
        for t, runs in zip(texts, cut):
            got = [self.known[r] for r in runs] if t else []
            if None in got:
                out.append(self.whole(t))
            else:
                out.append(tuple(np.frombuffer(b"".join([g[k] for g in got]), np.int32) if got else none for k in (0, 1)))
        return out

    def whole(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The same of one text, not cut."""
        a, b, data = self.a.encode_ordinary(" " + text), self.b.encode(text, num_threads=1), (" " + text).encode()
        if not text or not b"".join([self.a_bytes[i] for i in a]) == data == b"".join([self.b_bytes[i] for i in b]):
            a = b = []
        return np.array(a, np.int32), np.array(b, np.int32)


def _digits(most: int) -> tuple[np.ndarray, np.ndarray]:
    """ASCII digits of 0 to most, right-aligned in rows of zeros with a free last column; how many digits each has."""
    wide = len(str(most))
    n, out = np.arange(most + 1), np.zeros((most + 1, wide + 1), np.uint8)
    size = np.ones(most + 1, np.int64)
    for k in range(wide):
        part = n // 10**k
        out[:, wide - 1 - k] = np.where((part > 0) | (k == 0), 48 + part % 10, 0)
        size += (part > 0) & (k > 0)
    return out, size


def align_batch(e: Encoder, texts: list[str]) -> tuple[list[int], list[int], list[int], list[bytes], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each text: tokens of A, of B, groups, the groups as text; and (pairs of each text, one after the other: how many a text, pairs, times)."""
    ids = e.encode(texts)
    n_a, n_b = (np.array([len(x[k]) for x in ids], np.int64) for k in (0, 1))
    a, b = (np.concatenate([np.zeros(0, np.int32), *(x[k] for x in ids)]).astype(np.int64) for k in (0, 1))
    # ends go on from text to text, as both tokenizers give the same bytes
    ia, ib = gallop(np.cumsum(e.a_size[a]), np.cumsum(e.b_size[b]))
    text_a = np.repeat(np.arange(len(texts)), n_a)
    groups = np.bincount(text_a[ia], minlength=len(texts))
    # a group's ranks in A and B are those after the common end before up to its own: rank differences give what overlaps
    group_a, group_b = np.searchsorted(ia, np.arange(len(a))), np.searchsorted(ib, np.arange(len(b)))
    first_b = np.concatenate([[0], ib + 1])
    table, size = e.digits
    sheet = np.zeros((len(a) + len(b), table.shape[1]), np.uint8)
    lengths = np.zeros(len(sheet), np.int64)
    last = np.zeros(len(texts), np.int64)
    last[n_a > 0] = (np.cumsum(n_a) + np.cumsum(n_b) - 1)[n_a > 0]
    for x, group, ends, before, mark in ((a, group_a, ia, first_b[group_a], 124), (b, group_b, ib, (ia + 1)[group_b] if len(b) else group_b, 59)):
        row = np.arange(len(x)) + before
        sheet[row], lengths[row] = table[x], size[x] + 1
        sheet[row, -1] = np.where(np.arange(len(x)) == ends[group], mark, 44) if len(x) else 0
    sheet[last[n_a > 0], -1] = 0
    lengths[last[n_a > 0]] -= 1
    flat = sheet.ravel()
    flat = flat[flat > 0].tobytes()
    upto = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(n_a + n_b)])]
    said = [flat[i:j] for i, j in zip(upto[:-1], upto[1:])]
    one, times = np.unique(text_a[ia] << 2 * SHIFT | a[ia] << SHIFT | b[ib], return_counts=True)
    return n_a, n_b, groups, said, (np.bincount(one >> 2 * SHIFT, minlength=len(texts)), one & ((1 << 2 * SHIFT) - 1), times)


_ENCODERS: dict[int, Encoder] = {}


def _encoder(files) -> Encoder:
    """The worker's encoder for these files' contents; it outlives a task."""
    if (key := hash(files)) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(*files)
    return _ENCODERS[key]


def align(docs: DataFrame, folder: str = TOKENIZERS, byte_file: str = BYTE_FILE, piece_file: str = PIECE_FILE) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups ("a1,a2|b1;a3|b2,b3"), pairs and times (arrays) of each document.

    pairs are the distinct pairs of an A and a B token that end together (id of A << 20 | id of
    B), times how often. The files, some MB, are read by the driver and broadcast. Null and
    empty texts, and those that a tokenizer changes, have no tokens; ids may be null or repeated,
    repeated rows each stand for themselves; very long texts are encoded whole; other columns
    aren't read; an empty table gives no rows.
    """
    spark: SparkSession = docs.sparkSession
    files = []
    for name in (byte_file, piece_file):
        path = os.path.join(folder, name)
        if os.path.getsize(path) > 64 << 20:
            raise ValueError(f"{path} has more than 64 MB")
        with open(path, "rb") as f:
            files.append(f.read())
    sent = spark.sparkContext.broadcast(tuple(files))
    schema = StructType([docs.schema["doc_id"], *StructType.fromDDL("n_a long, n_b long, n_groups long, groups string, pairs array<long>, times array<long>").fields])

    def run(batches):
        e = _encoder(sent.value)
        for batch in slices(batches):
            rows = [((t or "").encode("utf-8", "surrogatepass"), t or "", k) for k, t in enumerate(batch.column(1).to_pylist())]
            for part in batches_of_bytes(rows, 1 << 20):
                n_a, n_b, groups, said, (many, pairs, times) = align_batch(e, [t for _, t, _ in part])
                at = pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(at, pa.array(x.astype(np.int64))) for x in (pairs, times)]
                doc = batch.column(0).take(pa.array([k for *_, k in part]))
                yield pa.RecordBatch.from_arrays([doc, *(pa.array(x, pa.int64()) for x in (n_a, n_b, groups)), pa.array(said, pa.binary()).cast(pa.string()), *lists], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pair_counts(links: DataFrame) -> DataFrame:
    """pair, count (links of the pair in all documents) and best (whether no pair of its B id has more), from columns pairs and times."""
    n = links.selectExpr("inline(arrays_zip(pairs, times))").groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("count"))
    n = stage(n.withColumn("b", F.col("pair").bitwiseAND((1 << SHIFT) - 1)), "paircounts")
    most = n.groupBy("b").agg(F.max("count").alias("most"))  # a row for each id of B's vocabulary at most
    return n.join(F.broadcast(most), "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def report(docs: DataFrame, folder: str = TOKENIZERS, max_sent: int = 1_000_000) -> DataFrame:
    """Per document doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    Pair counts, at most (ids of A) x (ids of B), are sent to all tasks while there are max_sent
    at most; beyond that pairs of all documents meet their counts by shuffle.
    """
    found = align(docs, folder)
    digest = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise(F.lit(""))
    links = stage(found.select("doc_id", "n_a", "n_b", "n_groups", digest.alias("groups_sha256"), "pairs", "times"), "links")
    counted = pair_counts(links)
    counted = stage(counted, "pairs", 1)
    one = links.withColumn("row", F.monotonically_increasing_id()).selectExpr("doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "row", "inline_outer(arrays_zip(pairs, times))")
    few = counted.count() <= max_sent
    met = one.join(F.broadcast(counted) if few else counted, F.col("pairs") == F.col("pair"), "left")
    zero = F.lit(0).cast("long")
    out = met.groupBy("row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256").agg(
        F.coalesce(F.sum("times"), zero).alias("n_links"), F.coalesce(F.sum(F.when(F.col("best"), F.col("times"))), zero).alias("n_best"), F.coalesce(F.sum(F.col("times") * F.col("count")), zero).alias("count_sum")
    )
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
