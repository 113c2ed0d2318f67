"""Interval, as-of and sequential operators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Positions of a stretch: scans run within stretches and take over a summary of those before.
STRETCH = 5_000_000


def _carried(x: DataFrame, contig: str, ahead: bool = False, **summary: Column) -> DataFrame:
    """x (with _stretch) and, of each summary, that of all stretches of its contig before x's own (with ahead: after), as a maximum (with ahead: minimum).

    A contig has as many stretches as its length allows, so the window over their summaries is
    over few rows; x meets its stretch's by the key on which it is partitioned already.
    """
    best = F.min if ahead else F.max
    parts = x.groupBy(contig, "_stretch").agg(*[best(c).alias(k) for k, c in summary.items()])
    w = Window.partitionBy(contig).orderBy("_stretch")
    w = w.rowsBetween(1, Window.unboundedFollowing) if ahead else w.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col(contig).alias("_key"), F.col("_stretch").alias("_of"), *[best(k).over(w).alias(k) for k in summary])
    return x.join(parts, F.col(contig).eqNullSafe(F.col("_key")) & (F.col("_stretch") == F.col("_of"))).drop("_key", "_of")


def merge_intervals(df: DataFrame, contig: str = "contig", beg: str = "beg", end: str = "end", stretch: int = STRETCH) -> DataFrame:
    """Overlapping intervals (shared bases, not mere neighbours) merged: contig, beg, end, n.

    Gaps and islands in two passes: within each stretch of a contig, windows over its own
    intervals; from the stretches before, the largest end and where the open island began.
    """
    w = Window.partitionBy(contig, "_stretch").orderBy(beg, end)
    x = df.select(contig, beg, end).withColumn("_stretch", F.floor(F.col(beg) / stretch))
    x = _carried(x, contig, _top=F.col(end))
    top = F.greatest(F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("_top"))
    x = x.withColumn("_fresh", F.when(F.coalesce(F.col(beg) > top, F.lit(True)), F.col(beg)))
    x = _carried(x, contig, _open=F.col("_fresh"))
    x = x.withColumn("_isle", F.coalesce(F.max("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.col("_open")))
    return x.groupBy(contig, "_isle").agg(F.min(beg).alias(beg), F.max(end).alias(end), F.count("*").alias("n")).drop("_isle")


def range_join(points: DataFrame, spans: DataFrame, contig: str = "contig", pos: str = "pos", beg: str = "beg", end: str = "end", bin_size: int = 100_000, how: str = "inner", open_left: bool = False) -> DataFrame:
    """Points with the intervals that hold them (beg <= pos <= end; beg < pos with open_left).

    Both sides meet on (contig, bin): an interval goes to each bin it touches, a point to one.
    Spark then joins by key, with the bounds as a residual. how: inner, left_semi or left_anti.
    """
    s = spans.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(beg) / bin_size), F.floor(F.col(end) / bin_size)))).withColumnRenamed(contig, "_contig")
    p = points.withColumn("_pbin", F.floor(F.col(pos) / bin_size))
    low = F.col(beg) < F.col(pos) if open_left else F.col(beg) <= F.col(pos)
    out = p.join(s, (F.col(contig) == F.col("_contig")) & (F.col("_pbin") == F.col("_bin")) & low & (F.col(pos) <= F.col(end)), how)
    return out.drop("_bin", "_pbin", "_contig")


def overlap_join(left: DataFrame, right: DataFrame, contig: str, lbeg: str, lend: str, rbeg: str, rend: str, bin_size: int = 100_000) -> DataFrame:
    """Pairs of intervals that share a position. Each pair comes once: in the bin of the later of the two starts."""
    a = left.withColumn("_b", F.explode(F.sequence(F.floor(F.col(lbeg) / bin_size), F.floor(F.col(lend) / bin_size))))
    b = right.withColumnRenamed(contig, "_contig").withColumn("_c", F.explode(F.sequence(F.floor(F.col(rbeg) / bin_size), F.floor(F.col(rend) / bin_size))))
    first = F.col("_b") == F.floor(F.greatest(F.col(lbeg), F.col(rbeg)) / bin_size)
    hit = (F.col(contig) == F.col("_contig")) & (F.col("_b") == F.col("_c")) & first & (F.col(lbeg) <= F.col(rend)) & (F.col(rbeg) <= F.col(lend))
    return a.join(b, hit).drop("_b", "_c", "_contig")


def interpolate(points: DataFrame, table: DataFrame, contig: str = "contig", pos: str = "pos", value: str = "cm", at: str = "at", out: str = "cm", stretch: int = STRETCH) -> DataFrame:
    """points with value interpolated between the last entry of table at or before pos and the next one.

    An as-of join by one sorted union per stretch of a contig and two window functions; the last
    entry of the stretches before and the first of those after are taken over. Beyond the last
    entry its value holds, before the first there is none.
    """
    cols = points.columns
    p = points.select(*cols, F.col(pos).alias("_at"), F.lit(None).cast("double").alias("_v"), F.lit(1).alias("_kind"))
    t = table.select(*[F.col(c) if c == contig else F.lit(None).cast(points.schema[c].dataType).alias(c) for c in cols], F.col(at).alias("_at"), F.col(value).cast("double").alias("_v"), F.lit(0).alias("_kind"))
    knot = F.when(F.col("_kind") == 0, F.struct(F.col("_at").alias("x"), F.col("_v").alias("v")))
    x = p.unionByName(t).withColumn("_stretch", F.floor(F.col("_at") / stretch)).withColumn("_knot", knot)
    x = _carried(_carried(x, contig, _from=F.col("_knot")), contig, ahead=True, _to=F.col("_knot"))
    w = Window.partitionBy(contig, "_stretch").orderBy("_at", "_kind")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(1, Window.unboundedFollowing)
    x = x.withColumns({"_lo": F.coalesce(F.last("_knot", True).over(back), F.col("_from")), "_hi": F.coalesce(F.first("_knot", True).over(ahead), F.col("_to"))}).where("_kind = 1")
    step = (F.col("_hi.v") - F.col("_lo.v")) / (F.col("_hi.x") - F.col("_lo.x"))
    return x.select(*cols, F.coalesce(F.col("_lo.v") + (F.col(pos) - F.col("_lo.x")) * step, F.col("_lo.v")).alias(out))


def extend_by_map(regions: DataFrame, table: DataFrame, cm: float, contig: str = "contig", beg: str = "beg", end: str = "end", at: str = "at", value: str = "cm") -> DataFrame:
    """regions (with a key each) with beg and end moved out to the farthest entries of a genetic map less than cm centimorgans away.

    Both ends get their place on the map by interpolate(); the entries nearer than cm are one
    aggregate over a join by contig, in which the map (a few thousand entries a contig) is small.
    """
    cols = regions.columns
    x = interpolate(regions.withColumn("_p", F.col(beg)), table, contig, "_p", value, at, "_c0")
    x = interpolate(x.withColumn("_p", F.col(end)), table, contig, "_p", value, at, "_c1").drop("_p")
    x = x.withColumns({"_c0": F.coalesce("_c0", F.lit(0.0)), "_c1": F.coalesce("_c1", F.lit(0.0))})
    knots = table.groupBy(F.col(contig).alias("_contig")).agg(F.collect_list(F.struct(F.col(at).alias("x"), F.col(value).cast("double").alias("v"))).alias("_map"))
    j = x.join(knots, F.col(contig) == F.col("_contig"), "left")
    lower = F.array_min(F.transform(F.filter("_map", lambda k: k["v"] > F.col("_c0") - cm), lambda k: k["x"]))
    upper = F.array_max(F.transform(F.filter("_map", lambda k: k["v"] < F.col("_c1") + cm), lambda k: k["x"]))
    return j.withColumns({beg: F.least(F.col(beg), F.coalesce(lower, F.col(beg))), end: F.greatest(F.col(end), F.coalesce(upper, F.col(end)))}).select(*cols)


def drop_overlapping(df: DataFrame, part: str, order: list[str], pos: str) -> DataFrame:
    """Rows whose position isn't below the largest before them (chunks that overlap at their ends)."""
    top = F.max(pos).over(Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("_top", top).where(F.col("_top").isNull() | (F.col(pos) >= F.col("_top"))).drop("_top")


def peaks_by_gap(df: DataFrame, contig: str, pos: str, p: str, gap: int, threshold: float = 1e-5) -> DataFrame:
    """Significant rows in islands separated by gaps of gap or more; of each island the smallest p."""
    w = Window.partitionBy(contig).orderBy(pos)
    x = df.where(F.col(p) < threshold).withColumn("_new", F.coalesce((F.col(pos) - F.lag(pos).over(w) >= gap).cast("int"), F.lit(1)))
    x = x.withColumn("_isle", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    best = Window.partitionBy(contig, "_isle").orderBy(p, pos)
    return x.withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k", "_isle", "_new")


def peaks_in_sequence(df: DataFrame, contig: str, pos: str, p: str, gap: int, threshold: float = 1e-5) -> DataFrame:
    """Significant rows clumped one after the other: a hit within gap of the last peak replaces it if its p is smaller.

    Depends on the order of peaks taken so far, hence one sorted group a contig.
    """

    def clump(frame: pd.DataFrame) -> pd.DataFrame:
        keep: list = []
        for r in frame.sort_values([pos, p]).itertuples(index=True):
            if keep and getattr(r, pos) - getattr(keep[-1], pos) < gap:
                if getattr(r, p) < getattr(keep[-1], p):
                    keep[-1] = r
            else:
                keep.append(r)
        return frame.loc[[r.Index for r in keep]]

    return df.where(F.col(p) < threshold).groupBy(contig).applyInPandas(clump, df.schema)
