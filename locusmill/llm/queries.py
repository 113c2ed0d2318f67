"""The registered queries of the text operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, license_scan, mixing, ngram_join, paragraph_dedup, pii, quality_cascade, spelling_variants, suffix_dedup, telephony, token_alignment, toxicity, url_graph
from .oracles import ORACLES  # noqa: F401


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_columns(spark, sf_dir):
    return suffix_dedup.dedup_report(_table(spark, sf_dir, "documents"))


def op2_url_graph(spark, sf_dir):
    return url_graph.judge_urls(_table(spark, sf_dir, "pages"))


def op3_toxicity_kneser_ney(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    s = toxicity.score(d.select("doc_id", "text"), toxicity.train(d, _table(spark, sf_dir, "labels")))
    return s.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_license_diagonals(spark, sf_dir):
    return license_scan.license_scan(_table(spark, sf_dir, "documents"))


def op5_mix_sources(spark, sf_dir):
    m = mixing.mix_counts(_table(spark, sf_dir, "documents"))
    return m.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op6_paragraph_minhash(spark, sf_dir):
    return paragraph_dedup.paragraph_report(_table(spark, sf_dir, "documents"))


def op7_pii_weak_supervision(spark, sf_dir):
    return pii.report(pii.detect(_table(spark, sf_dir, "documents")))


def op8_telephony_audio(spark, sf_dir):
    return telephony.media_report(_table(spark, sf_dir, "documents"))


def op9_benchmark_windows(spark, sf_dir):
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_ngram_jaccard(spark, sf_dir):
    return ngram_join.link_components(_table(spark, sf_dir, "documents")).drop("class_key")


def op11_quality_cascade(spark, sf_dir):
    return quality_cascade.report(_table(spark, sf_dir, "documents"))


def op12_token_alignment(spark, sf_dir):
    return token_alignment.report(_table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark, sf_dir):
    return spelling_variants.variants(_table(spark, sf_dir, "documents"))


_ALL = (op1_suffix_columns, op2_url_graph, op3_toxicity_kneser_ney, op4_license_diagonals, op5_mix_sources, op6_paragraph_minhash, op7_pii_weak_supervision, op8_telephony_audio, op9_benchmark_windows, op10_ngram_jaccard, op11_quality_cascade, op12_token_alignment, op13_spelling_variants)
QUERIES = {f.__name__: f for f in _ALL}
