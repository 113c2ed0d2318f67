import re
import shutil

import pyarrow as pa
import pyarrow.parquet as pq
from brute import SPACE, contamination, mix_targets, near
from pyspark.sql import functions as F
from test_native import SF

import corpus_pipeline
from locusmill.llm import mixing, pii, toxicity


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = corpus_pipeline.drop_toxic(spark, docs, SF)
    scored = toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet")))
    assert sorted(r.doc_id for r in one.collect()) == sorted(r.doc_id for r in scored.collect() if r.score < 0.7)
    two = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    want = near([(r.doc_id, r.text) for r in docs.collect()], 5, 80)
    assert sorted(r.doc_id for r in two.collect()) == sorted(i for i, (n, c) in want.items() if i == c or not n)
    three = corpus_pipeline.drop_contaminated(spark, docs, SF)
    items = rows(spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text"))
    have = docs.collect()
    assert sorted(r.doc_id for r in three.collect()) == sorted(r.doc_id for r, x in zip(have, contamination([r.text for r in have], items)) if not x[4])
    four = {r.doc_id: r for r in corpus_pipeline.redact_pii(spark, docs, SF).collect()}
    for r in have:
        spans = [s.split(":") for s in pii_spans(spark, docs)[r.doc_id].split(",") if s]
        text, at = "", 0
        for k, a, b in sorted(((k, int(a), int(b)) for k, a, b in spans), key=lambda x: (x[1], x[2], x[0])):
            if a >= at:
                text, at = text + r.text[at:a] + f"[{k}]", b
        assert four[r.doc_id].text == text + r.text[at:] and four[r.doc_id].n_chars == len(four[r.doc_id].text)
    five = corpus_pipeline.mix_sources(spark, docs, SF).collect()
    sizes = {}
    for r in have:
        sizes[r.source] = sizes.get(r.source, 0) + len(SPACE.findall(r.text or ""))
    target, copies = mix_targets(sizes), {r.doc_id: r["copies"] for r in mixing.mix_counts(docs).collect()}
    for r in have:
        n = sum(x.doc_id == r.doc_id for x in five)
        assert n == copies[r.doc_id] and abs(n - target[r.source] / sizes[r.source]) < 1
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, docs, SF).columns == docs.columns


_SPANS = {}


def pii_spans(spark, docs):
    if not _SPANS:
        _SPANS.update({r.doc_id: r.spans for r in pii.report(pii.detect(docs)).collect()})
    return _SPANS


#: Columns that documents may have, named as those that stages use.
CLASHES = ["score", "__id", "me", "gone", "twice", "hit", "key", "key2", "k", "cuts", "r", "s", "rate", "copy", "__copy", "__key", "__r", "feature", "h", "rid", "sig", "component"]


def test_stages_keep_clashing_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 40")
    for c in CLASHES:
        docs = docs.withColumn(c, F.concat(F.lit(c), F.col("doc_id")))
    for name, f in corpus_pipeline.STAGES:
        got = f(spark, docs, SF)
        assert got.columns == docs.columns, name
        rows_ = got.collect()
        assert rows_ and all(r[c] == f"{c}{r.doc_id}" for r in rows_ for c in CLASHES), name


def test_run_on_odd_tables(spark, tmp_path):
    texts = [None, "", " ", "me@x.org " * 3, "w " * 4000, "same text of some words here", "Same TEXT of some words here", "same text of some words here"] * 2
    n = len(texts)
    base = {"doc_id": pa.array([None if i == 5 else i % 12 for i in range(n)], pa.int64()), "text": pa.array(texts, pa.string()), "lang": pa.array([None] * n, pa.string()), "source": pa.array([None, "a"] * (n // 2)), "n_chars": pa.array([0] * n, pa.int64())}
    table = pa.table(base | {c: pa.array([float(k)] * n) for k, c in enumerate(CLASHES)})
    pq.write_table(table, tmp_path / "documents.parquet")
    for t in ("labels", "benchmark"):
        shutil.copy(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and all(not re.search("me@x", r.text or "") for r in out)
    assert all([r[c] for c in CLASHES] == [float(k) for k in range(len(CLASHES))] for r in out)
    groups = {(r.text or "").lower() for r in out if "same" in (r.text or "").lower()}
    assert len(groups) <= 1
    pq.write_table(table.slice(0, 0), tmp_path / "documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_names_are_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "pii", "mixing"]
