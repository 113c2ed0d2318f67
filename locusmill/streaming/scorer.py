"""Scoring a stream of new calls with what was fitted on a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def score_stream(calls: DataFrame, null: DataFrame, by: list[str], sample: str = "sample", late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Running sums of each marker over a stream of calls (marker, sample, g, ts): ns, u, v.

    null is a static frame with the residual r and weight v of each sample; calls beyond the
    watermark are dropped, repeated calls of a sample count once within it.
    """
    x = calls.withWatermark(ts, late).dropDuplicatesWithinWatermark([*by, sample]).join(null, sample)
    g = F.col("g").cast("double")
    return x.where("g is not null").groupBy(*by).agg(F.count("*").alias("ns"), F.sum(g * F.col("r")).alias("u"), F.sum(g * g * F.col("v")).alias("v"))
