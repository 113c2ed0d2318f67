import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from brute import components, contamination as plain_contamination, near
from pyspark.sql import functions as F
from test_native import ODD, SF, by_id, docs

from locusmill.llm import decontaminate, ngram_join, telephony, toxicity
from locusmill.llm.common import Powers, connected_components

WORDS = [f"w{i}" for i in range(400)]


def near_copies(seed=3, n=90):
    """Texts with exact copies and near copies around the similarity of 0.9, small and large."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        t = [r.choice(WORDS) for _ in range(r.choice([1, 2, 3, 5, 11, 12, 25, 60, 300]))]
        out.append(" ".join(t))
        for _ in range(r.choice([0, 1, 2, 4])):
            u = list(t)
            for _ in range(r.choice([0, 1, 1, 2, 4])):
                k = r.randrange(len(u) + 1)
                u[k : k + 1] = r.choice([[], ["x%d" % r.randrange(9)], [*u[k : k + 1], "extra"]])
            out.append("\t".join(u).upper())
    return out + ["", " ", None]


def same_components(got, want):
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80)])
@pytest.mark.parametrize("block", [2_000_000, 400])
def test_ngram_join_loses_no_link(spark, block, n, percent):
    texts = near_copies()
    passage = " ".join(WORDS[:60])
    texts += [passage + " " + t for t in texts[::7] if t]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = near(list(enumerate(texts)), n, percent)
    want = {i: (n, c if n else i) for i, (n, c) in want.items()}
    got = ngram_join.link_components(d, n, percent, block).collect()
    same_components(got, want)
    assert sum(r.component_id != r.doc_id for r in got) > 25


def test_chains_of_versions_in_small_blocks_and_chunks(spark):
    r, rows, links = random.Random(4), [], []
    for c in range(60):
        n = r.choice([4, 5, 6, 12])
        keys = r.sample(range(10**9), n)
        if c % 2:
            keys.sort()
        for i, k in enumerate(keys):  # neighbours link at 95 of 105, others don't
            rows.append((c, k, 100, list(range(1000 * c + 5 * i, 1000 * c + 5 * i + 100))))
            links += [(k, keys[i - 1])] if i else []
    ids = [k for _, k, *_ in rows]
    want = components(ids, links)
    d = spark.createDataFrame(rows, "cluster long, key long, n long, s array<long>")
    for chunk in (1000, 3):
        got = {x.node: x.component for x in ngram_join.exact_components(d, 90, 200, chunk=chunk).collect()}
        assert components(ids, [(k, got.get(k, k)) for k in ids]) == want


def test_queries_among_other_sets_are_not_passed_over():
    q0, q1, y = (np.arange(a, a + 100) for a in (0, 5, 10))
    assert sorted(ngram_join.linked_in_block([q0, q1, y], [0, 1], 90)) == [(0, 1), (1, 2)]


def test_ngram_join_on_a_table(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    same_components(ngram_join.link_components(d).collect(), near([tuple(r) for r in d.select("doc_id", "text").collect()]))


def test_ngram_join_odd_rows(spark):
    d = docs(spark)
    d = d.union(d)
    got = ngram_join.link_components(d).collect()
    assert len(got) == 2 * len(ODD) and all(r.component_id == r.doc_id for r in got if r.n_shingles == 0)
    assert ngram_join.link_components(d.limit(0)).count() == 0


def test_ngram_join_takes_one_worker_a_task_and_short_batches(spark, monkeypatch):
    r = random.Random(6)
    d = spark.createDataFrame([(i, " ".join(r.choices(WORDS, k=1000))) for i in range(2500)], "doc_id long, text string").coalesce(1)
    wanted = d.where("doc_id < 9").select("doc_id", F.lit(0).cast("long").alias("key"))
    sets = ngram_join._sets_of(d, wanted, 3)
    assert sets._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert 9 <= sets.count() < 100
    cut = ngram_join.slices

    def watched(batches, rows=1024):
        for batch in batches:
            assert batch.nbytes < 4_000_000, "a batch of any number of bytes came to the worker"
            yield from cut([batch], rows)

    monkeypatch.setattr(ngram_join, "slices", watched)
    assert d.select(F.sum(F.length("text"))).first()[0] > 8_000_000
    ours = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    assert {x.component_id for x in ngram_join.link_components(d).collect()} == set(range(2500))
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) == ours


def test_t_occurrence_is_a_count():
    r = random.Random(1)
    for _ in range(200):
        lists = [np.array(sorted(r.sample(range(60), r.randrange(0, 50))), np.int64) for _ in range(r.randrange(1, 20))]
        t = r.randrange(1, len(lists) + 1)
        n = np.bincount(np.concatenate(lists), minlength=60)
        ids, count = ngram_join.t_occurrence(lists, t)
        assert ids.tolist() == np.flatnonzero(n >= t).tolist() and count.tolist() == n[n >= t].tolist()


@pytest.mark.parametrize("percent", [90, 80])
def test_sets_of_any_linked_sizes_share_a_signature(percent):
    rng, classes = np.random.default_rng(5), ngram_join.size_classes(percent)
    for n in [*range(1, 40), 75, 76, 77, 200, 505, 506, 3000]:
        for _ in range(6):
            x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
            drop = rng.integers(0, n * (100 - percent) // percent + 1)
            y = np.concatenate([x[drop:], rng.integers(0, 1 << 63, rng.integers(0, 3)).astype(np.uint64)])
            y = np.unique(y)
            o = len(np.intersect1d(x, y))
            if len(y) and 100 * o >= percent * (len(x) + len(y) - o):
                assert np.intersect1d(ngram_join.signatures(x, percent, classes), ngram_join.signatures(y, percent, classes)).size


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (7, 7), (30, 3), (8, 20)], "a long, b long")
    assert {r.node: r.component for r in connected_components(e).collect()} == {1: 1, 2: 1, 3: 1, 30: 1, 8: 8, 9: 8, 20: 8}


ITEMS = [(1, "the rare words stand here in a row of more than ten words indeed"), (2, "short one"), (3, ""), (4, None), (5, "mit license"), (10, "SHORT one"), (6, "a a a a a a a a a a a a"), (2, "short one")]


def test_decontamination(spark):
    texts = [*ODD, "so short one short one", "a " * 15, "b " + "a " * 9, "x the rare words stand here in a row of more than ten words", "The RARE words, stand here in a row: of more!", "a short", None]
    d = docs(spark, texts)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    ids = [r.doc_id for r in d.select("doc_id").collect()]
    want = [(i, *x) for i, x in zip(ids, plain_contamination(texts, [x for x in ITEMS]))]
    assert by_id(decontaminate.contamination(d, items).collect()) == by_id(want)
    assert by_id(decontaminate.contamination(d, items, bits=15).collect()) == by_id(want)
    assert {r.n_items for r in decontaminate.contamination(d, items.limit(0)).collect()} == {0}
    assert decontaminate.contamination(d.limit(0), items).count() == 0


def test_decontamination_on_a_table(spark):
    d, b = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    rows = d.select("doc_id", "text").collect()
    want = [(r.doc_id, *x) for r, x in zip(rows, plain_contamination([r.text for r in rows], [tuple(x) for x in b.select("item_id", "text").collect()]))]
    got = decontaminate.contamination(d, b).collect()
    assert by_id(got) == by_id(want) and any(r.contaminated for r in got)


def test_media_report(spark):
    d = docs(spark, [*ODD, "Grüße" * 3000, "x" * 64])
    rows = {r.doc_id: r for r in telephony.media_report(d).collect() if r.doc_id is not None}
    for i, t in d.select("doc_id", "text").collect():
        if i is not None:
            b = (t or "").encode()
            p = b + bytes(max(64, -(-len(b) // 64) * 64) - len(b))
            r = rows[i]
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
            media = telephony.to_wav(p, telephony.MULAW)
            assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
            assert telephony.from_wav(media)[3] == p
    assert telephony.media_report(d.limit(0)).count() == 0


def plain_feature(p):
    """The feature string of a payload, sample by sample."""
    x = [int(v) for v in telephony.MULAW_TABLE[list(p)]]
    wide = [y for i, v in enumerate(x) for y in (v, round((v + x[min(i + 1, len(x) - 1)]) / 2))]
    rms = lambda v: int((sum(y * y for y in v) / len(v)) ** 0.5)
    flips = sum((a < 0) != (b < 0) for a, b in zip(wide, wide[1:]))
    ima = []
    for at in range(0, len(p), 64):
        block = p[at : at + 64]
        value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
        ima.append(value)
        for byte in block[4:]:
            for code in (byte & 15, byte >> 4):
                step = int(telephony.STEPS[index])
                diff = ((2 * (code & 7) + 1) * step) >> 3
                value = max(-32768, min(32767, value - diff if code & 8 else value + diff))
                index = max(0, min(88, index + int(telephony.INDEX_STEP[code])))
                ima.append(value)
    crc = zlib.crc32(b"".join(y.to_bytes(2, "little", signed=True) for y in wide))
    return f"pcm16000:{rms(wide)}:{flips}:{crc:08x};alaw:{rms([int(v) for v in telephony.ALAW_TABLE[list(p)]])};ima:{rms(ima)}"


def test_features_are_of_the_stored_sound(spark):
    texts = ["", "a", "Grüße" * 40, "x" * 64, "plain words " * 30]
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, pcm int, media int")
    for r in telephony.media_report(d).collect():
        b = texts[r.doc_id].encode()
        assert r.feature == plain_feature(b + bytes(max(64, -(-len(b) // 64) * 64) - len(b))), r.doc_id
    one = telephony.store_pcm(telephony.store_text_audio(d.where("doc_id = 2"))).collect()[0]
    rate, x = telephony.decode(bytes(one.pcm))
    assert rate == 16000 and len(x) == 2 * one.payload_bytes


def test_codecs(spark):
    assert telephony.MULAW_TABLE[[0xFF, 0x80, 0x00, 0x7F]].tolist() == [0, 32124, -32124, 0]
    assert telephony.ALAW_TABLE[[0xD5, 0x55, 0xAA, 0x2A]].tolist() == [8, -8, 32256, -32256]
    x = (np.sin(np.arange(4000) / 9) * 9000).astype(np.int16)
    y = telephony.decode_ima(telephony.encode_ima(x)).ravel()[: len(x)]
    assert np.corrcoef(x, y)[0, 1] > 0.99
    one = telephony.encode_ima(x)[3:4]
    assert (telephony.decode_ima(telephony.encode_ima(x))[3] == telephony.decode_ima(one)[0]).all()
    assert telephony.resample(x, 8000, 16000).size == 8000 and (telephony.resample(x, 8000, 16000)[::2] == x).all()
    files = [telephony.to_wav(telephony.encode_ima(x).tobytes(), telephony.IMA, 8000, 64, 4), telephony.to_wav(bytes(64), telephony.ALAW), None]
    m = spark.createDataFrame([(i, bytearray(f) if f else None) for i, f in enumerate(files)], "id long, media binary")
    out = [r.pcm for r in telephony.to_pcm(m).orderBy("id").collect()]
    assert telephony.decode(bytes(out[0]))[0] == 16000 and out[2] is None
    with pytest.raises(ValueError):
        telephony.from_wav(b"no")


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    d, l = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    t = toxicity.train(d, l)
    s = toxicity.score(d, t)
    assert s.columns == [*d.columns, "score"]
    rows = s.join(l, "doc_id").where(toxicity.held_out(s["doc_id"])).select("score", "toxic").collect()
    bad, good = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    auc = np.mean([(b > g) + (b == g) / 2 for b in bad for g in good])
    assert auc > 0.8 and np.mean([g < 0.7 for g in good]) > 0.97
    odd = toxicity.score(docs(spark, extra=True).withColumnRenamed("rid", "score"), t)
    assert odd.count() == len(ODD) and odd.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.score(d.limit(0), t).count() == 0
    # the way for models too large to broadcast gives the same
    few = d.where("doc_id < 60").union(d.where("doc_id < 3")).unionByName(docs(spark))
    one = by_id([tuple(r) for r in toxicity.score(few, t).select("doc_id", "score").collect()])
    two = by_id([tuple(r) for r in toxicity.score(few, t, most_rows=0).select("doc_id", "score").collect()])
    assert [x[0] for x in one] == [x[0] for x in two] and np.allclose([x[1] for x in one], [x[1] for x in two], atol=1e-5)


def test_toxicity_of_any_columns(spark):
    d = docs(spark, ["a b", None, "idiot you"]).withColumn("feature", F.lit(7)).withColumn("score", F.lit(8)).withColumn("key", F.lit(9))
    l = spark.createDataFrame([(0, 1, 5), (2, None, 5), (None, 1, 5)], "doc_id long, toxic int, text int")
    for most in (0, 100):
        out = toxicity.score(d, toxicity.train(d, l), "toxic", most).collect()
        assert all((r.feature, r.score, r.key) == (7, 8, 9) and 0 <= r.toxic < 0.7 for r in out) and len(out) == 3


def test_toxicity_without_labels(spark):
    d = docs(spark, ["a b", None])
    l = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score < 0.7 for r in toxicity.score(d, toxicity.train(d, l)).collect()} == {True}


def plain_kneser_ney(rows, d):
    """(p of w after h under class 0 and 1, counts): counts are different words before, as sets; words as they stand."""
    tri = {(c, u, h, w) for text, c in rows for x in [["", "", *text.split()]] for u, h, w in zip(x, x[1:], x[2:])}
    k, heads, words, first = Counter((c, h, w) for c, u, h, w in tri), {}, {}, Counter()
    for (c, h, w), n in k.items():
        heads.setdefault((c, h), []).append(n)
        words.setdefault((c, w), set()).add(h)
    first = Counter({x: len(v) for x, v in words.items()})
    vocabulary = {w for _, w in first}
    s = [sum(n for (c, _), n in first.items() if c == i) for i in (0, 1)]

    def p(c, h, w):
        shared = (first[0, w] + first[1, w] + 1) / (s[0] + s[1] + len(vocabulary) + 1)
        one = max(first[c, w] - d, 0) / s[c] + sum(min(n, d) for (x, _), n in first.items() if x == c) / s[c] * shared
        after = heads.get((c, h), [])
        return (max(k[c, h, w] - d, 0) + sum(min(n, d) for n in after) * one) / sum(after) if after else one

    return p


def test_toxicity_is_kneser_ney(spark):
    r = random.Random(6)
    common = ["the", "of", "and", "bad", "good", "day"]
    rows = [(" ".join(r.choice(common if r.random() < 0.7 else WORDS) for _ in range(40)) + (" bad word" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(60)]
    rows += rows[:3] * 5  # copies count once
    counts = toxicity.Counts(spark.createDataFrame(rows, "text string, toxic int"))
    texts = ["the bad word of the day", "w1 w2 unseen words", "unseen", "and and and of the good bad", ""]
    for d, s in ((2.0, 0.1), (4.0, 0.01)):
        p = plain_kneser_ney(rows, d)
        x = toxicity._features(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1), counts, d, [s], 10**6)
        for t, f in zip(texts, [row.f[0] for row in x.collect()]):
            w = ["", *t.split()]
            want = sum(np.log(1 - s + s * p(1, h, v) / p(0, h, v)) for h, v in zip(w, w[1:])) / (len(w) - 1 + 5)
            assert abs(f - want) < 1e-5, (t, d)
