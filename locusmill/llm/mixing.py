"""Mixing sources to target weights by repetition rates (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_WORD, spare, stage


def size_of(text: Column) -> Column:
    """Number of words between white space; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORD)), F.lit(0)).cast("long")


def source_plan(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """Per source: its size, target and repetition rate.

    sized has source and size. Sources in code point order, null last, weigh as the cycle of
    weights. Targets share the total of all sizes by weight; no target exceeds cap times its
    source's size: taken in order of size per weight, the capped sources are a prefix, and all
    others share what is left (the fixed point of resharing the excess). Sources are few next
    to documents; both windows run over one row per source.
    """
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    names = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w).cast("long") for w in weights])
    s = s.withColumn("w", F.element_at(cycle, ((F.row_number().over(names) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("k", F.row_number().over(Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())))
    upto = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    s = s.withColumn("left_size", F.sum("source_size").over(whole) - F.coalesce(F.sum(cap * F.col("source_size")).over(upto), zero))
    s = s.withColumn("left_w", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(upto), zero))
    s = s.withColumn("level", F.col("left_size").cast("double") / F.col("left_w").cast("double"))
    s = s.withColumn("open", F.col("level") * F.col("w") <= F.col("source_size") * cap)
    s = s.withColumn("level", F.min_by(F.when(F.col("open"), F.col("level")), F.when(F.col("open"), F.col("k"))).over(whole))
    capped = (F.col("source_size") * cap).cast("double")
    target = F.coalesce(F.least(F.col("level") * F.col("w"), capped), capped)
    s = s.select("source", "source_size", target.alias("target"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return s.withColumn("rate", F.least(rate, F.lit(float(cap))))


def copies(rate: Column, doc_id: Column, seed: str = "mix") -> Column:
    """floor(rate) copies and one more with probability of the fraction, decided by a hash of seed and id."""
    u = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    return (F.floor(rate) + F.when(u < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def mix_counts(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target, rate and copies of each document.

    Texts are read once: sizes are staged as a narrow table. The plan has one row per source
    and joins null-safely; Spark measures it and broadcasts only what is below its threshold.
    Null texts have size 0 (their copies count no words), a null source is a source of its own,
    null ids share one random draw, equal ids share theirs. An empty table gives no rows.
    """
    sized = stage(docs.select("doc_id", "source", size_of(F.col("text")).alias("size")), "sizes")
    plan = stage(source_plan(sized, weights, cap), "mixplan").withColumnRenamed("source", "_s")
    return sized.join(plan, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("copies", copies(F.col("rate"), F.col("doc_id"), seed))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: str = "mix", max_sources: int = 100_000) -> DataFrame:
    """docs with each row emitted as many times as its source's rate asks for; all columns, whatever their names, stay.

    The plan's row count is checked: up to max_sources it is broadcast, so the texts of a hot
    source never meet in one task; beyond, Spark joins by shuffle and splits skewed keys. Nulls,
    repeated rows and an empty table fare as in mix_counts(); long texts are counted whole.
    """
    plan = stage(source_plan(docs.select("source", size_of(F.col("text")).alias("size")), weights, cap), "mixplan")
    few = plan.count() <= max_sources
    s, rate, copy = spare(docs.columns, "s", "rate", "copy")
    plan = plan.select(F.col("source").alias(s), F.col("rate").alias(rate))
    joined = docs.join(F.broadcast(plan) if few else plan, F.col("source").eqNullSafe(F.col(s)))
    n = copies(F.col(rate), F.col("doc_id"), seed).cast("int")
    return joined.select(*docs.columns, F.explode(F.array_repeat(F.lit(1), n)).alias(copy)).select(*docs.columns)
