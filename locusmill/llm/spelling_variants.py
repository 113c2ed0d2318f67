"""Spelling variants by reduced alphabets: one-edit neighbourhoods of reduced words meet the reduced vocabulary, and pairs are verified on the words themselves."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, bit_filter, may_hold, mix64, slices, stage, unstage

#: Letters in UTF-8 after lower-casing A-Z: a-z, and U+00C0 to U+00FF.
_RUN = re.compile(rb"(?:[a-z]|\xC3[\x80-\xBF])+")
_LOWER = LOWER_BYTES.tobytes()
#: One run in so many loses a code point.
DELETED = 199
#: Symbols that letters are hashed to; more of them make neighbourhoods larger and false meetings rarer.
SYMBOLS = 16
#: Different words that a task counts before it hands their counts on.
COUNTED = 200_000
#: Words whose neighbourhoods a task makes.
WORDS_A_TASK = 10_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None, doc_id: int | None) -> dict[bytes, int]:
    """How often each word stands in the text, with the one code point deleted that the crc of id and word asks for."""
    runs: dict[bytes, int] = {}
    for r in _RUN.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER)):
        runs[r] = runs.get(r, 0) + 1
    out: dict[bytes, int] = {}
    first = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
    for r, n in runs.items():
        h = zlib.crc32(r, first)
        if not h % DELETED:
            w = r.decode()
            w = w[: h % len(w)] + w[h % len(w) + 1 :]
            r = w.encode()
        out[r] = out.get(r, 0) + n
    return out


def vocabulary(docs: DataFrame, least_length: int = 6, least: int = 5) -> DataFrame:
    """word, n: words of at least least_length code points that occur least times or more in all documents.

    Tasks count before they shuffle and hand on their counts whenever they hold COUNTED different
    words, so memory is bounded and a frequent word costs few rows.
    """
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def rows(counts):
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], schema=schema)

    def run(batches):
        counts: dict[bytes, int] = {}
        for batch in slices(batches):
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for w, n in words_of(t, i).items():
                    # continuation bytes don't count as code points; each letter has one at most
                    if len(w) >= least_length and (len(w) >= 2 * least_length or len(w.decode()) >= least_length):
                        counts[w] = counts.get(w, 0) + n
                if len(counts) >= COUNTED:
                    yield rows(counts)
                    counts = {}
        yield rows(counts)

    found = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def reduced(words: list[str], symbols: int = SYMBOLS) -> tuple[np.ndarray, np.ndarray]:
    """Symbols (from 1) of all words, one after the other, by a hash of the letter; and the words' lengths."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    return (mix64(points.astype(np.uint64)) % np.uint64(symbols) + np.uint64(1)).astype(np.uint64), np.array([len(w) for w in words], np.int64)


def _codes(x: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """Codes of reduced words of one length (rows of x): polynomials modulo 2**64."""
    return (x * powers[: x.shape[1]]).sum(axis=1, dtype=np.uint64)


def neighbourhood(x: np.ndarray, symbols: int = SYMBOLS) -> np.ndarray:
    """A row for each row of x (reduced words of one length): codes of the word and of all that one insertion, deletion or replacement makes."""
    n, size = x.shape
    powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size + 1, _BASE)]))
    term = x * powers[:size]
    whole = term.sum(axis=1, dtype=np.uint64)
    before = np.concatenate([np.zeros((n, 1), np.uint64), np.cumsum(term, axis=1, dtype=np.uint64)], axis=1)  # of the first k symbols
    after = whole[:, None] - before  # of those from k on
    any_symbol = np.arange(1, symbols + 1, dtype=np.uint64)
    replaced = (whole[:, None] - term)[:, :, None] + powers[:size, None] * any_symbol
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    deleted = before[:, :-1] + after[:, 1:] * inverse
    inserted = (before + after * _BASE)[:, :, None] + powers[: size + 1, None] * any_symbol
    return np.concatenate([replaced.reshape(n, -1), deleted, inserted.reshape(n, -1)], axis=1)


def word_codes(words: list[str], symbols: int = SYMBOLS) -> np.ndarray:
    """The code of each word's reduced form."""
    x, sizes = reduced(words, symbols)
    out, first = np.zeros(len(words), np.uint64), np.cumsum(sizes) - sizes
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, _BASE)]))
        out[at] = _codes(x[first[at][:, None] + np.arange(size)], powers)
    return out.view(np.int64)


def word_neighbours(words: list[str], symbols: int = SYMBOLS, limit: int = 1 << 20):
    """(places in words, codes): each distinct code of each word's neighbourhood, in pieces of about limit codes."""
    x, sizes = reduced(words, symbols)
    first = np.cumsum(sizes) - sizes
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        step = max(1, int(limit // ((2 * symbols + 1) * size + symbols)))
        for k in range(0, len(at), step):
            some = at[k : k + step]
            codes = np.sort(neighbourhood(x[first[some][:, None] + np.arange(size)], symbols), axis=1)
            new = np.ones(codes.shape, bool)
            new[:, 1:] = codes[:, 1:] != codes[:, :-1]
            yield some[np.nonzero(new)[0]], codes[new].view(np.int64)


def near_pairs(vocab: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """word, near, near_n: all pairs of different words (in both orders) that one inserted, deleted or replaced code point turns into each other.

    vocab: word, n, each word once. Words that one edit apart have reduced forms that are equal or
    one edit apart, so the full neighbourhood of a word's reduced form holds that of each near
    word. Neighbours that no reduced form can equal are left out by a filter of at most 16 MB
    before the join, which is by code, split by Spark where many words share one. Different
    reduced forms of one code only cost a verification. Spark sizes the staged vocabulary by its
    compressed files and would broadcast it at several times that size through the driver, hence
    the hints for a merge join here and below.
    """

    def code(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(word_codes(batch.column(0).to_pylist(), symbols))], names=[*batch.schema.names, "code"])

    parts = vocab.count() // WORDS_A_TASK + 1  # few bytes, but a word makes hundreds of codes
    known = stage(vocab.select("word", "n").repartition(parts).mapInArrow(code, "word string, n long, code long"), "vocabulary")
    table = vocab.sparkSession.sparkContext.broadcast(bit_filter(known.select(F.col("code").alias("h")).distinct()))

    def meet(batches):
        for batch in batches:
            words = batch.column(0)
            for at, codes in word_neighbours(words.to_pylist(), symbols):
                some = may_hold(table.value, codes)
                yield pa.RecordBatch.from_arrays([words.take(pa.array(at[some])), pa.array(codes[some])], names=["word", "code"])

    met = known.select("word").mapInArrow(meet, "word string, code long")
    other = known.select(F.col("word").alias("near"), F.col("n").alias("near_n"), "code")
    return met.join(other.hint("merge"), "code").where((F.col("word") != F.col("near")) & (F.levenshtein("word", "near", 1) == 1)).select("word", "near", "near_n")


def roots(forms: DataFrame) -> DataFrame:
    """word, root from word, form (null where there is none; no cycles): the last word that forms lead to.

    Each round doubles how far a word looks, so the rounds are log2 of the longest chain; as a
    form has several times its word's count, chains are short.
    """
    far = stage(forms.select("word", F.coalesce("form", "word").alias("root"), F.col("form").isNotNull().alias("open")), "roots")
    while far.where("open").limit(1).count():
        on = far.select(F.col("word").alias("w"), F.col("root").alias("next"), F.col("open").alias("more"))
        new = stage(far.join(on.hint("merge"), F.col("root") == F.col("w")).select("word", F.col("next").alias("root"), (F.col("open") & F.col("more")).alias("open")), "roots")
        unstage(far)
        far = new
    return far.select("word", "root")


def variants(docs: DataFrame, least_length: int = 6, least: int = 5, times: int = 5, symbols: int = SYMBOLS) -> DataFrame:
    """word, form, root, n, n_near, form_n: each word of the documents with the spelling that it is a variant of.

    A word's form is its near word of most occurrences (ties: first in code-point order), if it
    has times as many as the word or more. Null and empty texts have no words, null ids count as
    empty in the rule that deletes code points; repeated rows count as often as they stand there;
    very long texts and words are taken whole; other columns aren't read; without words, no rows.
    """
    vocab = stage(vocabulary(docs, least_length, least), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("near"))).alias("best")
    near = near_pairs(vocab, symbols).groupBy("word").agg(F.count("*").alias("n_near"), best)
    long = F.lit(0).cast("long")
    joined = vocab.join(near.hint("merge"), "word", "left").select("word", "n", F.coalesce("n_near", long).alias("n_near"), F.col("best.near").alias("near"), (-F.col("best.m")).alias("near_n"))
    fits = F.col("near_n") >= times * F.col("n")
    formed = stage(joined.select("word", F.when(fits, F.col("near")).alias("form"), "n", "n_near", F.when(fits, F.col("near_n")).alias("form_n")), "forms")
    return formed.join(roots(formed).hint("merge"), "word").select("word", "form", "root", "n", "n_near", "form_n")
