"""Data frames behind plots: QQ, Manhattan, top lists, locus and component views."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType

from ..functions import special as sp
from ..functions.genotype import neg_log10
from .ranges import range_join


def qq_histogram(df: DataFrame, label: str | None = None, p: str = "pvalue", width: float = 0.01) -> DataFrame:
    """Counts of -log10(p) by label and bin."""
    lab = F.col(label) if label else F.lit("all")
    return df.where(F.col(p).isNotNull()).groupBy(lab.alias("label"), F.floor(neg_log10(F.col(p)) / width).alias("bin")).agg(F.count("*").alias("n"))


def qq_points(hist: DataFrame, width: float = 0.01) -> DataFrame:
    """Observed and expected -log10(p) of each bin from counts cumulated from the smallest p; rank and n for the band."""
    w = Window.partitionBy("label")
    upto = w.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
    x = hist.withColumns({"rank": F.sum("n").over(upto), "total": F.sum("n").over(w)})
    return x.select("label", "bin", "rank", "total", (F.col("bin") * width).alias("observed"), (-F.log10((F.col("rank") - 0.5) / F.col("total"))).alias("expected"))


@pandas_udf(ArrayType(DoubleType()))
def _band(k: pd.Series, n: pd.Series) -> pd.Series:
    k, n = k.to_numpy(float), n.to_numpy(float)
    return pd.Series(list(-np.log10(np.stack([sp.beta_ppf(0.975, k, n + 1 - k), sp.beta_ppf(0.025, k, n + 1 - k)], 1))))


def qq_band(points: DataFrame) -> DataFrame:
    """points with low and high, the 95 % band of the k-th smallest of n uniform p (as -log10)."""
    return points.withColumn("_b", _band(F.col("rank").cast("double"), F.col("total").cast("double"))).select(*points.columns, F.col("_b")[0].alias("low"), F.col("_b")[1].alias("high"))


def manhattan(df: DataFrame, contig: str = "contig", pos: str = "pos", p: str = "pvalue", xbin: int = 3_000_000, ybin: float = 0.1) -> DataFrame:
    """Thinned points: one of each cell of position and -log10(p)."""
    y = neg_log10(F.col(p))
    return df.where(F.col(p).isNotNull()).groupBy(contig, F.floor(F.col(pos) / xbin).alias("xbin"), F.floor(y / ybin).alias("ybin")).agg(F.min(pos).alias(pos))


def top_hits(df: DataFrame, n: int = 5000, p: str = "pvalue", ties: tuple[str, ...] = ("contig", "pos")) -> DataFrame:
    """The n smallest p (a top-k report: no full sort)."""
    return df.where(F.col(p).isNotNull()).orderBy(p, *ties).limit(n)


def significant(df: DataFrame, most: float, p: str = "pvalue") -> DataFrame:
    """Rows with p at most most; without a p a row isn't reported."""
    return df.where(F.col(p) <= most)


def scored(df: DataFrame, least: float, score: str = "score") -> DataFrame:
    """Rows whose score reaches least; without a score a row stays out."""
    return df.where(F.col(score) >= least)


def locus_view(assoc: DataFrame, ld: DataFrame, marker: str | tuple[str, ...] = "marker") -> DataFrame:
    """assoc of a locus with r2 to its index marker (0 where unknown) and its class for colours.

    marker: the column, or columns such as contig and pos, that both have in common.
    """
    on = [marker] if isinstance(marker, str) else list(marker)
    x = assoc.join(ld.select(*on, "r2"), on, "left").withColumn("r2", F.coalesce("r2", F.lit(0.0)))
    return x.withColumn("ld_class", F.when(F.col("r2") >= 0.8, ">=0.8").when(F.col("r2") >= 0.5, ">=0.5").when(F.col("r2") >= 0.1, ">=0.1").otherwise("<0.1"))


def functional_classes(points: DataFrame, exons: DataFrame, states: DataFrame, enhancer: str = r"Enhancer|^[4567]$", promoter: str = r"Promoter|^[123]$", bin_size: int = 100_000) -> DataFrame:
    """points (contig, pos) with place: promoter, enhancer, exon or other.

    exons: contig, beg, end; states: contig, beg, end, label of one cell type (all bounds
    1-based, closed), whose labels or state numbers match enhancer or else promoter. Where several hold a
    point, a promoter goes before an enhancer, and that before an exon. Different positions are
    looked up once each; positions on which nothing lies are other, null ones too.
    """
    is_enhancer, is_promoter = F.coalesce(F.col("label").rlike(enhancer), F.lit(False)), F.coalesce(F.col("label").rlike(promoter), F.lit(False))
    rank = F.when(is_enhancer, 1).when(is_promoter, 0)
    spans = states.select("contig", "beg", "end", rank.alias("_rank")).where("_rank is not null").union(exons.select("contig", "beg", "end", F.lit(2))).where("beg <= end").distinct()
    at = points.select("contig", "pos").where("contig is not null and pos is not null").distinct()
    best = range_join(at, spans, bin_size=bin_size).groupBy("contig", "pos").agg(F.min("_rank").alias("_rank"))
    name = F.when(F.col("_rank") == 0, "promoter").when(F.col("_rank") == 1, "enhancer").when(F.col("_rank") == 2, "exon").otherwise("other")
    return points.join(best, ["contig", "pos"], "left").select(*points.columns, name.alias("place"))


def label_join(df: DataFrame, labels: DataFrame, on: str, label: str, unknown: str | None = "UNKNOWN") -> DataFrame:
    """df with labels joined; rows without one get unknown, or go if that is None."""
    x = df.join(labels.select(on, label), on, "left" if unknown is not None else "inner")
    return x if unknown is None else x.withColumn(label, F.coalesce(label, F.lit(unknown)))


def gene_rows(genes: DataFrame, pad: int = 0) -> DataFrame:
    """genes (gene, tx_start, tx_end) with the first row in which each fits without touching another (greedy, by start)."""

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        ends: list = []
        row = []
        part = part.sort_values(["tx_start", "gene"])
        for s, e in zip(part["tx_start"], part["tx_end"]):
            k = next((i for i, x in enumerate(ends) if x + pad < s), len(ends))
            ends[k : k + 1] = [e]
            row.append(k)
        return part.assign(row=row)

    return genes.groupBy("contig").applyInPandas(pack, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in genes.schema) + ", row int")
