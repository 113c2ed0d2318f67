"""Per-marker values as native expressions over dosage arrays (null: missing), and their aggregate twins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column, f) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + F.coalesce(f(x), F.lit(0.0)))


def marker_stats(g: Column) -> dict[str, Column]:
    """ns, ac, an, sumsq, callrate, af, maf, mac, rsq, n0, n1, n2 and hom_minor of an array of dosages."""
    seen = F.filter(g, lambda x: x.isNotNull())
    ns = F.size(seen).cast("long")
    ac, sumsq = _sum(seen, lambda x: x.cast("double")), _sum(seen, lambda x: x.cast("double") * x)
    return derived(ns, F.size(g), ac, sumsq) | {
        "n0": F.size(F.filter(seen, lambda x: x < 0.5)).cast("long"), "n1": F.size(F.filter(seen, lambda x: (x >= 0.5) & (x < 1.5))).cast("long"), "n2": F.size(F.filter(seen, lambda x: x >= 1.5)).cast("long"),
        "hom_minor": F.when(ac > ns, F.size(F.filter(seen, lambda x: x < 0.5))).otherwise(F.size(F.filter(seen, lambda x: x >= 1.5))).cast("long"),
    }


def derived(ns: Column, n: Column, ac: Column, sumsq: Column) -> dict[str, Column]:
    """What follows from the number called, the number of samples, and the sums of dosages and squares."""
    af = F.when(ns > 0, ac / (2.0 * ns))
    hwe = ac - ac * ac / (2.0 * ns)
    return {
        "ns": ns, "ac": ac, "an": 2 * ns, "sumsq": sumsq, "callrate": ns / n.cast("double"), "af": af, "maf": F.least(af, 1 - af),
        "mac": F.floor(F.least(ac, 2.0 * ns - ac) + 0.5), "rsq": F.when((ns > 0) & (hwe > 0), F.least((sumsq - ac * ac / ns) / hwe, F.lit(1.0))), "var": F.when(ns > 0, sumsq / ns - (ac / ns) * (ac / ns)),
    }


def long_stats(g: str = "g", n_samples: Column | None = None) -> list[Column]:
    """The sums behind derived(), as aggregates over one row a call: ns, n, ac, sumsq, n0, n1, n2."""
    x = F.col(g)
    total = n_samples if n_samples is not None else F.count(F.lit(1))
    return [
        F.count(x).alias("ns"), total.alias("n"), F.coalesce(F.sum(x), F.lit(0)).cast("double").alias("ac"), F.coalesce(F.sum(x * x), F.lit(0)).cast("double").alias("sumsq"),
        F.count_if(x < 0.5).alias("n0"), F.count_if((x >= 0.5) & (x < 1.5)).alias("n1"), F.count_if(x >= 1.5).alias("n2"),
    ]


def flip_to_minor(g: Column) -> Column:
    """2 - g for all calls where the counted allele is the more frequent one."""
    s = marker_stats(g)
    return F.when(s["ac"] > s["ns"], F.transform(g, lambda x: 2 - x)).otherwise(g)


def impute_mean(g: Column) -> Column:
    s = marker_stats(g)
    return F.transform(g, lambda x: F.coalesce(x.cast("double"), s["ac"] / s["ns"]))


def substitution_class(ref: Column, alt: Column) -> Column:
    """ts, tv or other."""
    pair = F.concat(F.upper(ref), F.upper(alt))
    return F.when(pair.isin("AG", "GA", "CT", "TC"), "ts").when((F.length(ref) == 1) & (F.length(alt) == 1) & pair.rlike("^[ACGT]{2}$") & (F.upper(ref) != F.upper(alt)), "tv").otherwise("other")


def decode_gt(call: Column) -> Column:
    """Dosage of a GT field: the sum of two single-digit alleles; missing if any part is missing."""
    return F.when(call.rlike(r"^[0-9][/|][0-9]"), F.substring(call, 1, 1).cast("int") + F.substring(call, 3, 1).cast("int")).cast("double")


def phase_of(call: Column) -> Column:
    """0 unphased or missing, 1 homozygous, 2 for 0|1, 3 for 1|0."""
    a, sep, b = F.substring(call, 1, 1), F.substring(call, 2, 1), F.substring(call, 3, 1)
    return F.when(~call.rlike(r"^[0-9][/|][0-9]"), 0).when(a == b, 1).when(sep != "|", 0).when(a < b, 2).otherwise(3)


def likelihoods(pl: Column, keep_floor: bool = True) -> Column:
    """10^(-PL/10) of each phred value (255 at most); 0.75 for 0 and 1 with keep_floor."""
    return F.transform(pl, lambda x: F.when(F.lit(keep_floor) & (x <= 1), 0.75).otherwise(F.pow(F.lit(10.0), -F.least(x, F.lit(255)).cast("double") / 10)))


def posterior_dosage(pl: Column, af: Column) -> Column:
    """Mean allele count of one sample's three likelihoods under Hardy-Weinberg proportions at af."""
    lk = likelihoods(pl)
    p0, p1, p2 = lk[0] * (1 - af) * (1 - af), lk[1] * 2 * af * (1 - af), lk[2] * af * af
    return (p1 + 2 * p2) / (p0 + p1 + p2)


def site_sumsq(ac: Column, an: Column) -> Column:
    """Sum of squared dosages expected of a site without genotypes."""
    p = ac / an
    return F.floor(an * p * (1 + p) + 0.5)


def neg_log10(p: Column) -> Column:
    return -F.log10(F.greatest(p, F.lit(1e-30)))
