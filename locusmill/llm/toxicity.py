"""Toxicity by class-conditional Kneser-Ney models of words after words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, Powers, RangeHash, batches_of_bytes, byte_table, extend, join_bytes, slices, spare, stage, unstage, words_of

#: (discount, share) to choose from, by the likelihood of the rows on which the line is fitted.
CHOICES = tuple((d, s) for d in (2.0, 4.0, 8.0) for s in (0.003, 0.01, 0.03, 0.1))
_LEAST = min(d for d, _ in CHOICES)
#: Expressions up to which the model is broadcast (12 bytes each); beyond, texts' words are joined to it.
MOST_ROWS = 2_000_000


def _word_ids(texts: list[bytes], powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """32-bit hashes of all words (never 0), of the word before (0 at a text's start), and the words' text numbers."""
    data, at = join_bytes(texts)
    data = LOWER_BYTES[data]
    lo, hi = words_of(data, byte_table("alnum"))
    w = np.maximum(RangeHash(data, powers)(lo, hi) >> np.uint64(32), np.uint64(1))
    doc = np.searchsorted(at, lo, "right") - 1
    return w, _before(w, doc), doc


def _before(w: np.ndarray, doc: np.ndarray, n: int = 1) -> np.ndarray:
    out = np.zeros(len(w), np.uint64)
    out[n:] = np.where(doc[n:] == doc[:-n], w[:-n], np.uint64(0))
    return out


def _pairs(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The word before and the word in one value; w is its low half."""
    return ((h << np.uint64(32)) | w).view(np.int64)


def _bytes(col) -> list[bytes]:
    return [b"" if t is None else t.encode() for t in col.to_pylist()]


def pair_counts(labelled: DataFrame) -> DataFrame:
    """pair, k0, k1: after how many different words each word pair stands, by class, over all of labelled (text, toxic).

    Runs of texts send each (word before, pair, class) once and all rows of a pair meet in one
    task, so a text that occurs a thousand times counts as one.
    """

    def run(batches):
        powers = Powers()
        for batch in slices(batches):
            for part in batches_of_bytes(list(zip(_bytes(batch.column("text")), batch.column("toxic").to_pylist()))):
                w, h, doc = _word_ids([x[0] for x in part], powers)
                label = np.array([x[1] for x in part], np.uint64)[doc]
                pair, seen = _pairs(h, w), (_before(w, doc, 2) & ~np.uint64(1)) | label
                order = np.lexsort((seen, pair))
                pair, seen = pair[order], seen[order].astype(np.uint32).view(np.int32)
                new = np.ones(len(pair), bool)
                new[1:] = (pair[1:] != pair[:-1]) | (seen[1:] != seen[:-1])
                yield pa.RecordBatch.from_pydict({"pair": pa.array(pair[new]), "seen": pa.array(seen[new])})

    rows = labelled.select("text", F.col("toxic").cast("int")).mapInArrow(run, "pair long, seen int").repartition("pair")
    return rows.groupBy("pair", "seen").agg(F.lit(1)).groupBy("pair").agg(F.count_if(F.col("seen") % 2 == 0).cast("int").alias("k0"), F.count_if(F.col("seen") % 2 != 0).cast("int").alias("k1"))


def _w():
    return F.expr("pair & 4294967295").alias("w")


def _h():
    return F.expr("shiftrightunsigned(pair, 32)").alias("h")


class Counts:
    """Tables of an interpolated Kneser-Ney model of two classes, as DataFrames that grow with the corpus.

    size bounds the rows of the ratios below. words: w, c0, c1 (different words before it), of all words. pairs: pair, k0, k1, where one
    exceeds the least discount; heads: h, the sums of k0 and k1 over all pairs after h, and
    the sums of what a discount d takes from them (m0_d, m1_d), for the h of those pairs.
    What isn't in pairs or heads has all its mass discounted, at any choice.
    """

    def __init__(self, labelled: DataFrame) -> None:
        every = stage(pair_counts(labelled), "pairs")
        self.words = stage(every.groupBy(_w()).agg(F.count_if(F.col("k0") > 0).alias("c0"), F.count_if(F.col("k1") > 0).alias("c1")), "words")
        self.pairs = stage(every.where((F.col("k0") > _LEAST) | (F.col("k1") > _LEAST)), "often")
        discounts = sorted({d for d, _ in CHOICES})
        sums = [F.sum(f"k{c}").alias(f"s{c}") for c in (0, 1)] + [F.sum(F.least(F.col(f"k{c}").cast("double"), F.lit(d))).alias(f"m{c}_{d:g}") for c in (0, 1) for d in discounts]
        known = self.pairs.select(_h()).distinct()
        self.heads = stage(every.select(_h(), "k0", "k1").join(known, "h", "left_semi").groupBy("h").agg(*sums), "heads")
        unstage(every)
        self.size = sum(x.count() for x in (self.words.where((F.col("c0") > _LEAST) | (F.col("c1") > _LEAST)), self.pairs, self.heads))
        cut = [F.sum(F.least(F.col(f"c{c}").cast("double"), F.lit(d))).alias(f"m{c}_{d:g}") for c in (0, 1) for d in discounts]
        self.total = self.words.agg(F.count("*").alias("v"), *[F.coalesce(F.sum(f"c{c}"), F.lit(0)).alias(f"s{c}") for c in (0, 1)], *cut).first().asDict()

    def _of_words(self, d: float) -> list:
        """The probability of w under each class: discounted counts, and what was discounted by the shared backoff."""
        t = self.total
        shared = (F.col("c0") + F.col("c1") + 1.0) / float(t["s0"] + t["s1"] + t["v"] + 1)
        out = []
        for c in (0, 1):
            s = float(t[f"s{c}"])
            out.append(F.greatest(F.col(f"c{c}") - d, F.lit(0.0)) / s + (t[f"m{c}_{d:g}"] / s) * shared if s else shared)
        return out

    def unknown(self, d: float) -> float:
        """Log ratio of the classes for a word with no count left: that of what they discount."""
        t = self.total
        share = [t[f"m{c}_{d:g}"] / t[f"s{c}"] if t[f"s{c}"] else 1.0 for c in (0, 1)]
        return float(np.log(share[1] / share[0]))

    def word_ratios(self, d: float) -> DataFrame:
        """w, b, a: log ratio of the classes for w, and for the backoff after w. Words without any count left are left out."""
        p = self._of_words(d)
        left = [F.when(F.col(f"s{c}") > 0, F.col(f"m{c}_{d:g}") / F.col(f"s{c}")).otherwise(1.0) for c in (0, 1)]
        heads = self.heads.select(F.col("h").alias("w"), (F.ln(left[1]) - F.ln(left[0])).alias("a"))
        words = self.words.where(f"c0 > {d} or c1 > {d}").select("w", (F.ln(p[1]) - F.ln(p[0])).alias("b"))
        return words.join(heads, "w", "full").select("w", F.coalesce("b", F.lit(self.unknown(d))).cast("float").alias("b"), F.coalesce("a", F.lit(0.0)).cast("float").alias("a"))

    def pair_ratios(self, d: float) -> DataFrame:
        """pair, r: log ratio of the classes for w after h, where a count is left; all others have a(h) + b(w)."""
        x = self.pairs.where(f"k0 > {d} or k1 > {d}").withColumns({"w": _w(), "h": _h()}).join(self.heads, "h").join(self.words, "w")
        q = []
        for c, p in enumerate(self._of_words(d)):
            s = F.col(f"s{c}")
            q.append(F.when(s > 0, (F.greatest(F.col(f"k{c}") - d, F.lit(0.0)) + F.col(f"m{c}_{d:g}") * p) / s).otherwise(p))
        return x.select("pair", (F.ln(q[1]) - F.ln(q[0])).cast("float").alias("r"))


class Ratios:
    """word_ratios() and pair_ratios() as sorted arrays for lookups in tasks."""

    def __init__(self, words: DataFrame, pairs: DataFrame, unknown: float) -> None:
        w, p = words.orderBy("w").toArrow(), pairs.orderBy("pair").toArrow()
        get = lambda t, c: t.column(c).to_numpy()
        self.w, self.a, self.b = get(w, "w"), np.append(get(w, "a"), np.float32(0)), np.append(get(w, "b"), np.float32(unknown))
        self.pair, self.r = get(p, "pair"), get(p, "r")

    @staticmethod
    def _find(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Places of x in keys; len(keys) for those not there."""
        if not len(keys):
            return np.zeros(len(x), np.int64)
        at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
        return np.where(keys[at] == x, at, len(keys))

    def sums(self, texts: list[bytes], powers: Powers, shares: list[float]) -> tuple[np.ndarray, np.ndarray]:
        """Of each text, the summed log ratios for each share, and its number of words."""
        w, h, doc = _word_ids(texts, powers)
        at = self._find(self.w, w.view(np.int64))
        b, a = self.b[at], np.zeros(len(w), np.float32)
        a[1:] = np.where(h[1:] != 0, self.a[at[:-1]], 0)
        at = self._find(self.pair, _pairs(h, w))
        ratio = np.where(at < len(self.pair), np.append(self.r, np.float32(0))[at], a + b).astype(float)
        return np.stack([np.bincount(doc, np.log1p(s * np.expm1(ratio)), len(texts)) for s in shares], 1), np.bincount(doc, minlength=len(texts))


def normalised(total, words):
    """The difference of log-likelihoods per word; a few ordinary words are added, so that a short text proves little."""
    return total / (words + 5.0)


def fit_line(f: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Logistic regression of y on the feature (Newton steps, a small ridge; the slope isn't negative): (intercept, slope)."""
    m, s = f.mean(), f.std() + 1e-9
    x, w = np.stack([np.ones(len(f)), (f - m) / s], 1), np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(2), x.T @ (p - y) + 0.05 * w)
        w = w - step / max(1.0, np.abs(step).max())
    slope = max(w[1], 0.0) / s
    return float(w[0] - slope * m), float(slope)


def held_out(doc_id):
    """Rows kept from learning: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Trained:
    """Counts, the chosen discount and share, and the line from the feature to a probability."""

    def __init__(self, counts: Counts, discount: float, share: float, line: tuple[float, float]) -> None:
        self.counts, self.discount, self.share, self.line = counts, discount, share, line


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000, broadcast_rows: int = 2_000_000, most_rows: int = MOST_ROWS) -> Trained:
    """The model from the labelled rows that aren't held out.

    The line and the choice of discount and share are fitted on at most sample of these rows
    (those with the smallest hashes of a quarter); all others are counted. labels is broadcast
    up to broadcast_rows rows (checked), else joined by shuffle. Of several labels of an id the
    largest counts, of repeated rows each copy (contexts are counted once); null ids and null
    labels teach nothing, nor do null or empty texts; very long texts count whole; other
    columns, whatever their names, aren't read. Without labels of both classes, scores are low.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(~held_out(F.col("doc_id")))
    known = stage(known, "labels", labels.count())
    n = known.count()
    few = known.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(4)) == 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    few = stage(few, "sample", sample)
    counted = known.join(F.broadcast(few), "doc_id", "left_anti")
    text = docs.select("doc_id", "text")
    counts = Counts(text.join(F.broadcast(counted) if n <= broadcast_rows else counted, "doc_id"))
    rows = stage(text.join(F.broadcast(few), "doc_id").select("text", "toxic"), "fitted")
    best = None
    for d in sorted({d for d, _ in CHOICES}):
        shares = [s for e, s in CHOICES if e == d]
        got = _features(rows, counts, d, shares, most_rows).select("f", "toxic").limit(4 * sample).toPandas()
        if got["toxic"].nunique() < 2:
            return Trained(counts, *CHOICES[0], (-3.0, 1.0))
        f, y = np.stack(got["f"].to_list()), got["toxic"].to_numpy(float)
        for j, s in enumerate(shares):
            a, b = fit_line(f[:, j], y)
            loss = float(np.mean(np.logaddexp(0, np.where(y > 0, -1, 1) * (a + b * f[:, j]))))
            if best is None or loss < best[0]:
                best = loss, d, s, (a, b)
    return Trained(counts, *best[1:])


def _features(docs: DataFrame, counts: Counts, d: float, shares: list[float], most_rows: int, name: str = "f") -> DataFrame:
    """docs (with text) and a column name: for each share the normalised difference of the classes' log-likelihoods.

    A toxic text takes each word with probability share from the toxic model and else from the
    ordinary one, an ordinary text takes all words from the ordinary model; the difference per
    word is log(1 - share + share * p1 / p0).
    """
    words, pairs = counts.word_ratios(d), counts.pair_ratios(d)
    if counts.size > most_rows:
        return _features_by_join(docs, stage(words, "wordratios"), stage(pairs, "pairratios"), counts.unknown(d), shares, name)
    shared = docs.sparkSession.sparkContext.broadcast(Ratios(words, pairs, counts.unknown(d)))

    def rate(batches):
        powers = Powers()
        for batch in slices(batches):
            f = [np.zeros((0, len(shares)))]
            for part in batches_of_bytes([(t,) for t in _bytes(batch.column("text"))]):
                total, n = shared.value.sums([x[0] for x in part], powers, shares)
                f.append(normalised(total, n[:, None]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(np.concatenate(f)), pa.list_(pa.float64()))], [*batch.schema.names, name])

    return docs.mapInArrow(rate, extend(docs.schema, f"`{name}` array<double>"))


def _features_by_join(docs: DataFrame, words: DataFrame, pairs: DataFrame, unknown: float, shares: list[float], name: str) -> DataFrame:
    """As _features(), for tables too large to broadcast: words of different texts are joined to them by shuffle."""
    key, key2 = spare(docs.columns, "key", "key2")
    text = F.coalesce("text", F.lit(""))
    keys = F.struct(F.xxhash64(text).alias("x"), F.crc32(text.cast("binary")).alias("y"), F.length(text).alias("n"))

    def split(batches):
        powers = Powers()
        for batch in slices(batches):
            for part in batches_of_bytes(list(zip(_bytes(batch.column("text")), range(batch.num_rows)))):
                w, h, doc = _word_ids([x[0] for x in part], powers)
                at = pa.array(np.array([x[1] for x in part], np.int64)[doc])
                yield pa.RecordBatch.from_arrays([batch.column("k").take(at), pa.array(w.view(np.int64)), pa.array(h.view(np.int64)), pa.array(_pairs(h, w))], ["k", "w", "h", "pair"])

    one = docs.select(keys.alias("k"), "text").dropDuplicates(["k"])
    said = one.mapInArrow(split, extend(one.select("k").schema, "w long, h long, pair long"))
    x = said.join(pairs, "pair", "left").join(words.select("w", "b"), "w", "left").join(words.select(F.col("w").alias("h"), "a"), "h", "left")
    ratio = F.coalesce(F.col("r"), (F.coalesce("b", F.lit(unknown).cast("float")) + F.coalesce("a", F.lit(0.0).cast("float"))).cast("float")).cast("double")
    sums = [F.sum(F.log1p(s * F.expm1(ratio))).alias(f"f{j}") for j, s in enumerate(shares)]
    f = x.groupBy("k").agg(F.count("*").alias("words"), *sums)
    f = f.select(F.col("k").alias(key2), F.array(*[normalised(F.col(f"f{j}"), F.col("words")) for j in range(len(shares))]).alias(name))
    zero = F.array(*[F.lit(0.0)] * len(shares))
    return docs.withColumn(key, keys).join(f, F.col(key) == F.col(key2), "left").select(*docs.columns, F.coalesce(name, zero).alias(name))


def score(docs: DataFrame, trained: Trained, column: str = "score", most_rows: int = MOST_ROWS) -> DataFrame:
    """docs with a column score (0 to 1) and none of its rows lost; only the text is looked at.

    Null and empty texts have the score of a text without any evidence; equal texts score
    equally; very long texts are read whole. A column of docs with that name gives way to the
    score (choose another name to keep it); other names don't matter. An empty table stays empty.
    """
    given = docs.drop(column)
    (name,) = spare([*given.columns, column], "feature")
    a, b = trained.line
    x = _features(given, trained.counts, trained.discount, [trained.share], most_rows, name)
    logit = F.greatest(F.least(a + b * F.get(name, 0), F.lit(30.0)), F.lit(-30.0))
    return x.select(*given.columns, F.round(1 / (1 + F.exp(-logit)), 9).alias(column))
