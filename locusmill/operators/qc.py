"""Marker and sample quality control."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.genotype import derived, long_stats
from ..model import AUTOSOMES, contig_end

_DERIVED = ("callrate", "af", "maf", "mac", "rsq", "var")


def marker_qc(calls: DataFrame, by: list[str], n_samples: Column | None = None) -> DataFrame:
    """One row a marker: counts, call rate, frequencies, imputation quality and genotype counts.

    calls has one row a call (g null: missing). One pre-aggregated shuffle on the marker. With
    n_samples, samples without a row count as missing.
    """
    s = calls.groupBy(*by).agg(*long_stats("g", n_samples))
    d = derived(F.col("ns"), F.col("n"), F.col("ac"), F.col("sumsq"))
    hom = F.when(F.col("ac") > F.col("ns"), F.col("n0")).otherwise(F.col("n2"))
    return s.withColumns({c: d[c] for c in _DERIVED} | {"hom_minor": hom})


def passing(qc: DataFrame, min_maf: float = 1e-6, max_maf: float = 1.0, min_mac: float = 3, max_mac: float = 1e9, min_callrate: float = 0.5, min_rsq: float = 0.0, min_ac: float | None = None, max_ac: float | None = None) -> DataFrame:
    """Markers within all bounds that vary; rsq and the allele count count only where a bound is asked for."""
    ok = F.lit(True)
    ok = ok if min_ac is None else ok & (F.col("ac") >= min_ac)
    ok = ok if max_ac is None else ok & (F.col("ac") <= max_ac)
    ok = ok & F.col("maf").between(min_maf, max_maf) & F.col("mac").between(min_mac, max_mac) & (F.col("callrate") >= min_callrate) & (F.col("var") > 0)
    return qc.where(ok & (F.col("rsq") >= min_rsq) if min_rsq > 0 else ok)


def case_control(calls: DataFrame, by: list[str], status: str = "status") -> DataFrame:
    """Calls, allele frequencies and genotype counts of cases (status 1) and controls (0)."""
    g, out = F.col("g"), []
    for name, v in (("case", 1), ("ctrl", 0)):
        mine = F.when(F.col(status) == v, g)
        out += [F.count(mine).alias(f"ns_{name}"), F.when(F.count(mine) > 0, F.sum(mine).cast("double") / (2.0 * F.count(mine))).alias(f"af_{name}")]
        out += [F.concat_ws("/", F.count_if(mine < 0.5), F.count_if((mine >= 0.5) & (mine < 1.5)), F.count_if(mine >= 1.5)).alias(f"{name}cnt")]
    return calls.groupBy(*by).agg(*out)


def sample_summary(calls: DataFrame, markers: DataFrame, marker: str = "marker", sample: str = "sample") -> DataFrame:
    """Per sample: reference, heterozygous, homozygous and missing calls, singletons, doubletons, rare and common variants, and the smoothed Ts/Tv.

    markers has class (ts, tv, other), maf and mac of each marker.
    """
    x = calls.join(markers.select(marker, "class", "maf", "mac"), marker)
    g = F.col("g")
    carrier = g >= 0.5
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    ts, tv = n(carrier & (F.col("class") == "ts")), n(carrier & (F.col("class") == "tv"))
    return x.groupBy(sample).agg(
        n(carrier).alias("n_snps"), n(carrier & (F.col("mac") == 1)).alias("singletons"), n(carrier & (F.col("mac") == 2)).alias("doubletons"),
        n(carrier & (F.col("maf") < 0.01)).alias("af_lt1"), n(carrier & F.col("maf").between(0.01, 0.05)).alias("af_1to5"), n(carrier & (F.col("maf") > 0.05)).alias("af_gt5"),
        n(g < 0.5).alias("n_ref"), n((g >= 0.5) & (g < 1.5)).alias("n_het"), n(g >= 1.5).alias("n_alt"), F.count_if(g.isNull()).alias("n_miss"), ((ts + 0.1) / (tv + 0.2)).alias("tstv"),
    )


def allele_spectrum(qc: DataFrame, calls: DataFrame, by: str = "marker") -> DataFrame:
    """For each allele count: how many calls of each genotype its markers have."""
    x = calls.join(qc.select(by, "ac"), by)
    return x.groupBy("ac").agg(F.count_if(F.col("g") < 0.5).alias("n0"), F.count_if((F.col("g") >= 0.5) & (F.col("g") < 1.5)).alias("n1"), F.count_if(F.col("g") >= 1.5).alias("n2"))


def in_region(df: DataFrame, region: str, contig: str = "contig", beg: str = "beg") -> DataFrame:
    """Rows within 'chr', 'chr:beg' (up to the contig's end) or 'chr:beg-end'; pushed into the scan as plain comparisons."""
    name, _, span = region.partition(":")
    out = df.where(F.col(contig) == name)
    if span:
        a, _, b = span.partition("-")
        out = out.where((F.col(beg) >= int(a)) & (F.col(beg) <= (F.lit(int(b)) if b else contig_end(F.col(contig)))))
    return out


def autosomes_only(df: DataFrame, contig: str = "contig") -> DataFrame:
    return df.where(F.regexp_replace(F.col(contig).cast("string"), "^chr", "").isin(*AUTOSOMES))


def join_ids(*tables: DataFrame, on: str = "ind_id") -> DataFrame:
    """Inner join of sample tables on their id; a repeated id in any table is an error (raised when rows are read)."""
    w = Window.partitionBy(on)
    out = None
    for t in tables:
        n = F.count(F.lit(1)).over(w)
        one = t.withColumn("_n", n).withColumn(on, F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("repeated id "), F.col(on).cast("string"))).cast(t.schema[on].dataType)).otherwise(F.col(on))).drop("_n")
        out = one if out is None else out.join(one, on)
    return out


def recode_binary(df: DataFrame, y: str) -> DataFrame:
    """y as 1 and 2 where it has exactly two values (in numeric order), unchanged where it has more; one value is an error."""
    s = df.agg(F.min(y), F.max(y), F.count_distinct(y)).first()
    if s[2] == 1:
        raise ValueError("the phenotype has a single value")
    return df if s[2] != 2 else df.withColumn(y, F.when(F.col(y) == s[0], 1.0).when(F.col(y) == s[1], 2.0))


def mean_fill(df: DataFrame, cols: list[str]) -> DataFrame:
    """Missing values of cols replaced by the column's mean."""
    m = df.agg(*[F.avg(c).alias(c) for c in cols]).first()
    return df.fillna({c: float(m[c]) for c in cols if m[c] is not None})


def average_rank(order: str, over: Window | None = None, part: list[str] | None = None) -> Column:
    """Rank of order from 1, ties sharing their mean."""
    w = Window.partitionBy(*(part or []))
    return F.rank().over(w.orderBy(order)) + (F.count(F.lit(1)).over(w.partitionBy(*(part or []), order)) - 1) / 2.0


def running_counts(df: DataFrame, value: str, buckets: int = 64) -> DataFrame:
    """value, k, before, total: of each distinct value (nulls aside) its rows, those with smaller values, and all rows.

    Values are dealt to ranges by approximate quantiles; sums run within each range, and over
    the few totals of ranges. So no task sees more than a range of distinct values.
    """
    k = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("k"))
    shares = [i / buckets for i in range(1, buckets)]
    cuts = sorted(set(k.agg(F.percentile_approx(F.col(value).cast("double"), shares, 8 * buckets)).first()[0] or [])) if shares else []
    at = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<double>")
    k = k.withColumn("_b", F.size(F.filter(at, lambda c: c < F.col(value).cast("double"))))
    upto = Window.partitionBy("_one").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = k.groupBy("_b").agg(F.sum("k").alias("_n")).withColumn("_one", F.lit(1))  # one row a range
    sums = sums.select("_b", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_base"), F.sum("_n").over(Window.partitionBy("_one")).alias("total"))
    mine = Window.partitionBy("_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return k.join(F.broadcast(sums), "_b").select(value, "k", (F.col("_base") + F.coalesce(F.sum("k").over(mine), F.lit(0))).alias("before"), "total")


def with_average_rank(df: DataFrame, value: str, out: str = "rank", buckets: int = 64) -> DataFrame:
    """The rows of df with a value, with its rank from 1 among all rows (ties share their mean), without one task for all."""
    r = running_counts(df, value, buckets).select(F.col(value).alias("_v"), (F.col("before") + (F.col("k") + 1) / 2.0).alias(out))
    return df.join(r, F.col(value) == F.col("_v")).drop("_v")
