"""Group-wise (gene) tests: collapsing, burden, variable thresholds and kernel tests."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import special as sp
from ..model import parse_marker_id
from ..session import written
from .matrixfree import Model, Projected, Whitening, top_eigen
from .mixed import Rotation, mixed_scan
from .qc import running_counts
from .single import counted_wald, fit_logistic, rank_sum, residualise, run_test, with_rank_sum_p


def group_markers(groups: DataFrame, group: str = "grp", ids: str = "ids") -> DataFrame:
    """One row a group and different marker of its list ids (texts CHR:POS_REF/ALT): group, contig, pos, ref, alt.

    A text of another form is an error when read. Repeated and null texts count once and not at all.
    """
    x = groups.select(group, F.explode(F.array_distinct(ids)).alias("_id")).where(F.col("_id").isNotNull()).withColumn("_m", parse_marker_id(F.col("_id")))
    whole = F.col("_m.contig").isNotNull() & F.col("_m.beg").isNotNull() & F.col("_m.ref").isNotNull() & F.col("_m.alt").isNotNull()
    contig = F.when(whole, F.col("_m.contig")).otherwise(F.raise_error(F.concat(F.lit("not a marker: "), F.col("_id"))).cast("string"))
    return x.select(group, contig.alias("contig"), F.col("_m.beg").alias("pos"), F.col("_m.ref").alias("ref"), F.col("_m.alt").alias("alt")).distinct()


def marker_lookup(rows: DataFrame, members: DataFrame, group: str = "grp") -> DataFrame:
    """rows (contig, pos, ref, alt and any others) of the markers in members (group_markers()), once for each group that names them.

    Place and both alleles must be the same: another allele at the place isn't found. An equi-join
    on all four, so the many rows of a marker lie together and Spark may split or broadcast.
    """
    return rows.join(members.select(group, "contig", "pos", "ref", "alt"), ["contig", "pos", "ref", "alt"]).select(group, *rows.columns)


def group_names(members: DataFrame, group: str = "grp") -> DataFrame:
    """group, contig, beg, end and name (CONTIG:BEG-END_GROUP) of each group; one on several contigs is on multichrs, from 0 to 0."""
    x = members.groupBy(group).agg(F.min("contig").alias("a"), F.max("contig").alias("b"), F.min("pos").alias("beg"), F.max("pos").alias("end"))
    one = F.col("a") == F.col("b")
    x = x.select(group, F.when(one, F.col("a")).otherwise("multichrs").alias("contig"), *[F.when(one, F.col(c)).otherwise(0).alias(c) for c in ("beg", "end")])
    return x.withColumn("name", F.concat("contig", F.lit(":"), F.col("beg").cast("string"), F.lit("-"), F.col("end").cast("string"), F.lit("_"), F.col(group).cast("string")))


def collapse(calls: DataFrame, group: str = "grp", sample: str = "sample", min_dosage: float = 0.0) -> DataFrame:
    """Per group and sample: carrier (any g above min_dosage), burden, weighted (1/sqrt(ns maf (1-maf))) and min_mac of its carried markers.

    calls has g (null counts as none), ns, maf and mac of the marker. One pre-aggregated shuffle.
    """
    g = F.coalesce(F.col("g"), F.lit(0)).cast("double")
    w = F.when((F.col("maf") > 0) & (F.col("maf") < 1), 1 / F.sqrt(F.col("ns") * F.col("maf") * (1 - F.col("maf")))).otherwise(0.0)
    return calls.groupBy(group, sample).agg(
        F.max((g > min_dosage).cast("int")).alias("carrier"), F.sum(g).alias("burden"), F.sum(g * w).alias("weighted"), F.min(F.when(g > 0, F.col("mac"))).alias("min_mac"),
    )


def group_shape(calls: DataFrame, qc: DataFrame, group: str = "grp", marker: str = "marker", sample: str = "sample") -> DataFrame:
    """Per group: markers in all, passing, singletons, and the share of samples with a rare allele."""
    m = qc.groupBy(group).agg(F.count("*").alias("num_all_vars"), F.count_if("passes").alias("num_pass_vars"), F.count_if(F.col("passes") & (F.col("mac") == 1)).alias("num_sing_vars"))
    rare = calls.join(qc.where("passes").select(marker, group), [marker, group]).groupBy(group, sample).agg(F.max((F.col("g") > 0.5).cast("int")).alias("c"))
    return m.join(rare.groupBy(group).agg(F.avg("c").alias("frac_with_rare")), group, "left")


def burden_test(collapsed: DataFrame, samples: DataFrame, name: str = "b.collapse", y: str = "status", xs: tuple[str, ...] = (), group: str = "grp", sample: str = "sample") -> DataFrame:
    """b.collapse, b.burden and b.wcnt (logistic Wald on carrier, burden, weighted), b.madsen (rank sum of weighted by status), q.reverse and q.wilcox (by carrier)."""
    col = {"b.collapse": "carrier", "q.reverse": "carrier", "q.wilcox": "carrier", "b.burden": "burden"}.get(name, "weighted")
    x = collapsed.select(group, sample, F.col(col).cast("double").alias("g")).join(samples, sample)
    if name == "b.madsen":
        return with_rank_sum_p(rank_sum(x, [group], "g", F.col(y) == 1))
    if name == "q.wilcox":  # of what covariates leave
        left = residualise(samples, y, list(xs), "_rest").select(sample, "_rest")
        return with_rank_sum_p(rank_sum(x.join(left, sample), [group], "_rest"))
    if name == "q.reverse":
        return run_test(x, name, [group], y, xs)
    return counted_wald(x, [group], y, xs)


def threshold_scan(collapsed: DataFrame, y: str = "y", group: str = "grp") -> DataFrame:
    """Variable thresholds: for each group and each allele-count threshold the squared correlation of y with having a carried marker at or below it.

    A sample carries at threshold t iff the least allele count it carries is at most t, so all
    thresholds come from one running sum over distinct counts. collapsed has y of the sample.
    """
    n = Window.partitionBy(group)
    x = collapsed.groupBy(group, "min_mac").agg(F.count("*").alias("k"), F.sum(y).alias("sy"), F.sum(F.col(y) * F.col(y)).alias("syy"))
    x = x.withColumns({"n": F.sum("k").over(n), "ty": F.sum("sy").over(n), "tyy": F.sum("syy").over(n)}).where("min_mac is not null")
    run = Window.partitionBy(group).orderBy("min_mac").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumns({"c": F.sum("k").over(run), "cy": F.sum("sy").over(run)})
    sxy = F.col("cy") - F.col("c") * F.col("ty") / F.col("n")
    sxx = F.col("c") - F.col("c") * F.col("c") / F.col("n")
    syy = F.col("tyy") - F.col("ty") * F.col("ty") / F.col("n")
    return x.where(sxx > 1e-9).select(group, F.col("min_mac").alias("threshold"), F.col("n").alias("ns"), F.col("c").alias("carriers"), (sxy * sxy / (sxx * syy)).alias("r2"), F.when(sxy >= 0, "+").otherwise("-").alias("direction"))


def best_threshold(scan: DataFrame, group: str = "grp") -> DataFrame:
    """Of each group the threshold with the largest r2 (the smallest of ties); stat is r2 times ns."""
    w = Window.partitionBy(group).orderBy(F.round("r2", 9).desc(), "threshold")
    return scan.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k").withColumn("stat", F.col("r2") * F.col("ns"))


def mixed_burden(collapsed: DataFrame, order: dict, rotation: Rotation, y: np.ndarray, group: str = "grp") -> DataFrame:
    """Collapsing test under a dense mixed model: carriers against y on the whitened scale, by group.

    order gives each sample's row in the rotation and in y; samples of a group without a row
    of calls carry nothing. Groups that nobody or everybody carries have no result. For more
    samples than a Rotation takes, matrixfree.mixed_scan() does the same.
    """
    spots = collapsed.sparkSession.createDataFrame(list(order.items()), ["sample", "i"])
    x = collapsed.where("carrier = 1").join(spots, "sample").groupBy(group).agg(F.collect_set(F.col("i").cast("int")).alias("idx"))
    x = x.withColumn("carriers", F.size("idx")).where((F.col("carriers") > 0) & (F.col("carriers") < len(order)))
    return mixed_scan(x.withColumn("g", F.transform("idx", lambda i: F.lit(1.0))), rotation, y, [group, "carriers"], missing_as_mean=False)


#: Permutations that share a seed: what a block of work is made of.
SEEDED = 100
#: Samples, with those of a group once for each of its blocks, that a group's blocks take along at most (beyond eight blocks).
MOST_COPIED = 1 << 27


def threshold_test(collapsed: DataFrame, y: str = "y", group: str = "grp", least: int = 100, most: int = 10_000_000, seed: int = 1, rotation: Whitening | Rotation | None = None, order: dict | None = None, blocks: int = 256) -> DataFrame:
    """group, ns, r2, pvalue, permutations: permutation p of the best threshold, p = (rank + 1) / (permutations + 1).

    Every round has tenfold permutations and takes only the groups whose rank * 10 <= least. Its
    rows are (group, block of seeds), at most blocks a group, whose counts are summed: a single
    group spreads over all cores. The hundred permutations of a seed depend on the group's name
    and the seed's number alone, so counts are the same for any number of partitions and
    blocks. With a rotation (and order, each sample's row in it; else sample is its
    row), carriers and y are whitened first, and the whitened y is permuted. Groups without a threshold that tells samples apart have no p.
    """
    spark = collapsed.sparkSession
    shared = spark.sparkContext.broadcast((rotation, order))  # narrow: samples x some dozen columns, or a Rotation, whose size is checked
    name = f"{group} {collapsed.schema[group].dataType.simpleString()}"
    base = written(collapsed.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("sample", y, "min_mac"))).alias("s")), "thresholds")
    base = base.select(group, F.col("s.sample").alias("sample"), F.col(f"s.{y}").alias("y"), F.col("s.min_mac").cast("array<double>").alias("min_mac"))
    largest = base.agg(F.max(F.size("sample"))).first()[0] or 1
    blocks = max(min(blocks, MOST_COPIED // largest), min(blocks, 8))  # each block takes a copy of its group along

    def sums(v, label, c):
        """Of each row of v the largest squared correlation with carriers; row by row where c is cumulated labels."""
        if label is None:
            return ((c @ v.T) ** 2).max(0)
        norm, of = c
        return np.array([(((np.bincount(label, r, len(norm) + 1)[:-1].cumsum() - of * r.sum())[norm > 1e-9] / norm[norm > 1e-9]) ** 2).max() for r in v])

    def run(batches):
        for part in batches:
            out = []
            for key, s, v, m, first, last in zip(part[group], part["sample"], part["y"], part["min_mac"], part["first"], part["last"]):
                v, m = np.asarray(v, float), np.asarray(m, float)
                t, label = np.unique(m[np.isfinite(m)]), None
                w, rows = shared.value
                if w is not None:
                    c = (m[None, :] <= t[:, None]).astype(float)  # thresholds x samples
                    full, values = np.zeros((w.samples, len(t))), np.zeros(w.samples)
                    at = np.asarray(s) if rows is None else [rows[r] for r in s]
                    full[at], values[at] = c.T, v
                    c, v = w.rotate(full).T, w.rotate(values)
                    c -= c.mean(1, keepdims=True)
                    norm = np.sqrt((c * c).sum(1))
                    c = c[norm > 1e-9] / norm[norm > 1e-9, None]
                    some = len(c)
                else:  # carriers at a threshold are those of all lower ones and its own: sums by label, then cumulated
                    label = np.where(np.isfinite(m), np.searchsorted(t, m), len(t))
                    of = np.bincount(label, minlength=len(t) + 1)[:-1].cumsum() / len(m)
                    norm = np.sqrt(len(m) * (of - of * of).clip(0))
                    c, some = (norm, of), int((norm > 1e-9).sum())
                v = v - v.mean()
                if not some or v.std() == 0:
                    out.append((len(s), None, 0))
                    continue
                v /= np.sqrt(v @ v)
                have, rank = float(sums(v[None], label, c)[0]), 0
                step = max(1, min(SEEDED, (1 << 21) // len(v)))  # the same draws, whatever the number at a time
                for k in range(first, last):
                    rng = np.random.default_rng([seed, k, *str(key).encode()])
                    for done in range(0, SEEDED, step):
                        drawn = rng.permuted(np.tile(v, (min(step, SEEDED - done), 1)), axis=1)
                        rank += int((sums(drawn, label, c) >= have - 1e-12).sum())
                out.append((len(s), have, rank))
            yield pd.concat([part[[group]].reset_index(drop=True), pd.DataFrame(out, columns=["ns", "r2", "rank"])], axis=1)

    def counted(of: DataFrame, first: int, last: int) -> DataFrame:
        """Ranks among the permutations of the seeds from first on."""
        some = min(blocks, last - first)
        cuts = [first + (last - first) * i // some for i in range(some + 1)]
        rows = of.select(group, "sample", "y", "min_mac", F.explode(F.array(*[F.struct(F.lit(x).alias("first"), F.lit(z).alias("last")) for x, z in zip(cuts[:-1], cuts[1:])])).alias("x")).select(group, "sample", "y", "min_mac", "x.first", "x.last")
        if some > 1:
            rows = rows.repartition(group, "first")
        got = rows.mapInPandas(run, f"{name}, ns long, r2 double, rank long")
        return got.groupBy(group).agg(F.first("ns").alias("ns"), F.first("r2").alias("r2"), F.sum("rank").alias("rank"))

    n = max(1, least // SEEDED)
    state, decided = written(counted(base, 0, n).withColumn("permutations", F.lit(n * SEEDED)), "ranks"), []
    while True:
        more = F.col("r2").isNotNull() & (F.col("rank") * 10 <= least) & F.lit(n * SEEDED < most)
        decided.append(state.where(~more))
        undecided = state.where(more)
        if not undecided.limit(1).count():
            break
        last = min(n * 10, most // SEEDED)
        new = counted(base.join(undecided.select(group), group, "left_semi"), n, last).select(group, F.col("rank").alias("new"))
        state = written(undecided.join(new, group).select(group, "ns", "r2", (F.col("rank") + F.col("new")).alias("rank"), F.lit(last * SEEDED).alias("permutations")), "ranks")
        n = last
    out = decided[0]
    for d in decided[1:]:
        out = out.unionByName(d)
    p = F.when(F.col("r2").isNotNull(), (F.col("rank") + 1) / (F.col("permutations") + 1.0))
    return out.select(group, "ns", "r2", p.alias("pvalue"), F.when(F.col("r2").isNotNull(), F.col("permutations")).otherwise(0).cast("long").alias("permutations"))


def kernel_statistic(calls: DataFrame, resid: str = "resid", group: str = "grp", marker: str = "marker", beta: tuple[float, float] = (1.0, 25.0)) -> DataFrame:
    """Q of the kernel test: sum over markers of w^2 (sum of g times the residual)^2, with w the beta density at the marker's maf."""
    a, b = beta
    const = float(np.exp(sp.lgamma(a + b) - sp.lgamma(a) - sp.lgamma(b)))
    m = calls.where("g is not null").groupBy(group, marker).agg(F.sum(F.col("g") * F.col(resid)).alias("u"), F.first("maf").alias("maf"))
    w = const * F.pow(F.col("maf"), a - 1) * F.pow(1 - F.col("maf"), b - 1)
    return m.groupBy(group).agg(F.count("*").alias("n_vars"), F.sum(F.pow(w * F.col("u"), 2)).alias("q"), F.sum(w * F.col("u")).alias("burden"))


@dataclass
class Projection:
    """What the kernel test needs of a null model: score residuals and the matrix P = diag(d) - sum of s_j b_j b_j'.

    samples: sample, r (so that a marker's score is the sum of g r), d and b (array); signs: s_j. ns: samples.
    """

    samples: DataFrame
    signs: list[float]
    ns: int


def null_model(samples: DataFrame, y: str = "y", xs: tuple[str, ...] = (), binary: bool = False) -> Projection:
    """Least squares or, with binary, logistic regression of y on xs; every fit is aggregates over samples."""
    s = samples.select("sample", *[F.col(c).cast("double").alias(c) for c in (y, *xs)]).dropna()
    cols = [F.lit(1.0), *[F.col(c) for c in xs]]
    n = s.count()
    if binary:
        beta, _ = fit_logistic(s, y, list(xs))
        mu = 1 / (1 + F.exp(-sum((F.lit(float(b)) * c for b, c in zip(beta, cols)), F.lit(0.0))))
        s = s.withColumns({"r": F.col(y) - mu, "d": mu * (1 - mu)})
    else:
        s = residualise(s, y, list(xs), "_e")
        v = s.agg(F.sum(F.col("_e") * F.col("_e"))).first()[0] / (n - len(cols))
        s = s.withColumns({"r": F.col("_e") / F.lit(v), "d": F.lit(1 / v)})
    # b: the covariates times d, orthonormal in the metric of 1 / d
    k = len(cols)
    gram = np.array([float(x) for x in s.agg(*[F.sum(F.col("d") * cols[i] * cols[j]) for i in range(k) for j in range(k)]).first()]).reshape(k, k)
    values, vectors = np.linalg.eigh(gram)
    turn = (vectors / np.sqrt(np.maximum(values, 1e-300)))[:, values > 1e-10 * values.max()]
    b = [F.col("d") * sum((F.lit(float(turn[i, j])) * cols[i] for i in range(k)), F.lit(0.0)) for j in range(turn.shape[1])]
    return Projection(s.select("sample", "r", "d", F.array(*b).alias("b")), [1.0] * turn.shape[1], n)


def mixed_null_model(model: Model, trait: int, spark: SparkSession) -> Projection:
    """The same of a fitted mixed model: exact on covariates and leading eigenvectors, the model's rest elsewhere."""
    rest, delta, n = float(model.rest[trait]), model.delta[trait], model.op.kinship.n
    lead = rest - 1 / (model.values + delta)
    b = np.column_stack([model.op.u * np.sqrt(rest), model.vectors * np.sqrt(np.abs(lead))])
    scale = (n - model.op.u.shape[1]) / model.yy[trait]  # of one unit of the genetic variance
    table = pd.DataFrame({"sample": np.arange(n), "r": model.px[:, trait] * scale, "d": rest * scale, "b": (b * np.sqrt(scale)).tolist()})
    return Projection(spark.createDataFrame(table, "sample long, r double, d double, b array<double>"), [1.0] * model.op.u.shape[1] + np.sign(lead).tolist(), n)


def kernel_tiles(calls: DataFrame, null: Projection, group: str, marker: str, weight: Column, tile: int = 512, most: int = 1 << 30, block: int = 32_768) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scores, tiles, calls) of the weighted markers of each group: tiles of groups of up to most markers, calls (group, k, sample, z) of the others.

    scores: group, marker, k (its place in the group), m (markers of the group), u, b (array). tiles: group, m, ta, tb
    (ta >= tb), v: the sum over samples of d z z' for a tile of markers with another. A task holds
    the calls of two tiles for one block of samples; blocks are summed by key.
    """
    x = calls.where("g is not null and g <> 0").join(null.samples, "sample").withColumn("z", F.col("g").cast("double") * weight)
    wide = len(null.signs)
    s = x.groupBy(group, marker).agg(F.sum(F.col("z") * F.col("r")).alias("u"), *[F.sum(F.col("z") * F.col("b")[j]).alias(f"b{j}") for j in range(wide)])
    own = Window.partitionBy(group)  # a row for each marker of the group
    s = s.select(group, marker, "u", F.array(*[F.col(f"b{j}") for j in range(wide)]).cast("array<double>").alias("b"), (F.row_number().over(own.orderBy(marker)) - 1).alias("k"), F.count("*").over(own).alias("m"))
    scores = written(s, "kernelscores")
    z = x.select(group, marker, F.pmod(F.xxhash64("sample"), F.lit(-(-null.ns // block))).alias("block"), "sample", (F.col("z") * F.sqrt("d")).alias("z")).join(scores.select(group, marker, "k", "m"), [group, marker])
    wide_groups, z = z.where(F.col("m") > most).select(group, F.col("k").cast("int").alias("k"), "sample", "z"), z.where(F.col("m") <= most)
    mine = F.floor(F.col("k") / tile).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.floor((F.col("m") - 1) / tile).cast("int")), lambda t: F.struct(F.greatest(t, mine).alias("ta"), F.least(t, mine).alias("tb")))
    z = z.select(group, "m", "block", "sample", "k", "z", F.explode(pairs).alias("p")).select(group, "m", "block", "sample", "k", "z", "p.ta", "p.tb")

    def product(part: pd.DataFrame) -> pd.DataFrame:
        ta, tb, m = int(part["ta"].iloc[0]), int(part["tb"].iloc[0]), int(part["m"].iloc[0])
        row, k, v = np.unique(part["sample"], return_inverse=True)[1], part["k"].to_numpy(), part["z"].to_numpy()
        out = np.zeros((min(tile, m - ta * tile), min(tile, m - tb * tile)))
        order = np.argsort(row, kind="stable")
        row, k, v = row[order], k[order], v[order]
        for start in range(0, int(row[-1]) + 1, 4096):  # few samples at a time are dense
            here = slice(*np.searchsorted(row, [start, start + 4096]))
            sides = []
            for t, size in ((ta, out.shape[0]), (tb, out.shape[1])):
                some = k[here] // tile == t
                d = np.zeros((4096, size))
                d[row[here][some] - start, k[here][some] - t * tile] = v[here][some]
                sides.append(d)
            out += sides[0].T @ sides[1]
        return part[[group, "m", "ta", "tb"]].iloc[:1].assign(v=[out.tobytes()])

    def add(part: pd.DataFrame) -> pd.DataFrame:
        return part[[group, "m", "ta", "tb"]].iloc[:1].assign(v=[np.sum([np.frombuffer(x) for x in part["v"]], axis=0).tobytes()])

    schema = f"{group} {calls.schema[group].dataType.simpleString()}, m long, ta int, tb int, v binary"
    return scores, z.groupBy(group, "ta", "tb", "block").applyInPandas(product, schema).groupBy(group, "ta", "tb").applyInPandas(add, schema), wide_groups


def kernel_test(calls: DataFrame, null: Projection, group: str = "grp", marker: str = "marker", optimal: bool = False, beta: tuple[float, float] | None = (1.0, 25.0), weight: str | None = None, tile: int = 512, dense: int = 4096, leading: int = 64) -> DataFrame:
    """SKAT (or SKAT-O with optimal): group, ns, n_vars, q, pvalue, rho.

    calls: group, marker, sample, g (missing ones count as 0), maf. Markers weigh by the beta density at maf, all alike with
    beta None, or as the column weight says. The covariance of a group's scores is made of tiles
    (kernel_tiles()). Up to dense markers a group's tiles meet in one task (dense^2 numbers);
    of larger groups a task holds the calls and not the covariance: the leading eigenvalues come by
    products with them, and the rest counts as equal weights of the same sum and sum of squares. The optimal test needs
    all of them: more than dense markers are an error there.
    """
    if weight is not None:
        w = F.col(weight).cast("double")
    elif beta is None:
        w = F.lit(1.0)
    else:
        a, b = beta
        w = F.lit(float(np.exp(sp.lgamma(a + b) - sp.lgamma(a) - sp.lgamma(b)))) * F.pow(F.col("maf"), a - 1) * F.pow(1 - F.col("maf"), b - 1)
    scores, tiles, wide = kernel_tiles(calls, null, group, marker, w, tile, dense)
    signs, ns = np.array(null.signs), null.ns
    kind = calls.schema[group].dataType.simpleString()
    out_schema = f"{group} {kind}, ns long, n_vars long, q double, pvalue double, rho double"
    low = scores.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("k", "u", "b"))).alias("s"))

    def one(key: tuple, part: pd.DataFrame, of: pd.DataFrame) -> pd.DataFrame:
        s = of["s"].iloc[0]
        m = len(s)
        k, u, b = np.zeros((m, m)), np.array([r["u"] for r in s]), np.array([r["b"] for r in s]).reshape(m, -1)
        for ta, tb, v in zip(part["ta"], part["tb"], part["v"]):
            ra, rb = slice(ta * tile, min((ta + 1) * tile, m)), slice(tb * tile, min((tb + 1) * tile, m))
            k[ra, rb] = np.frombuffer(v).reshape(ra.stop - ra.start, rb.stop - rb.start)
            k[rb, ra] = k[ra, rb].T
        k -= (b * signs) @ b.T
        p, rho = skat_p(u, (k + k.T) / 2, optimal)
        return pd.DataFrame({group: [key[0]], "ns": [ns], "n_vars": [m], "q": [float(u @ u)], "pvalue": [p], "rho": [rho]})

    large = [r[0] for r in scores.where(F.col("m") > dense).select(group).distinct().collect()]  # groups of thousands of markers
    if not large:
        return tiles.groupBy(group).cogroup(low.groupBy(group)).applyInPandas(one, out_schema)
    if optimal:
        raise ValueError(f"groups of more than {dense} markers: {large[:3]}")
    small = tiles.groupBy(group).cogroup(low.where(~F.col(group).isin(large)).groupBy(group)).applyInPandas(one, out_schema)

    def many(key: tuple, part: pd.DataFrame, of: pd.DataFrame) -> pd.DataFrame:
        s = of["s"].iloc[0]
        u, b = np.array([r["u"] for r in s]), np.array([r["b"] for r in s]).reshape(len(s), -1)
        p = _large_p(part["k"].to_numpy(), part["sample"].to_numpy(), part["z"].to_numpy(), u, b, signs, leading)
        return pd.DataFrame({group: [key[0]], "ns": [ns], "n_vars": [len(u)], "q": [float(u @ u)], "pvalue": [p], "rho": [0.0]})

    parts = min(8 * len(large), 400)  # fixed: few bytes, but much work a group
    wide, of_wide = wide.repartition(parts, group), low.where(F.col(group).isin(large)).repartition(parts, group)
    return small.unionByName(wide.groupBy(group).cogroup(of_wide.groupBy(group)).applyInPandas(many, out_schema))


class CallCovariance:
    """Z'Z - b diag(signs) b' of the m markers k of calls (k, sample, z), by its calls: products, trace, and the trace of its square."""

    def __init__(self, k: np.ndarray, sample: np.ndarray, z: np.ndarray, b: np.ndarray, signs: np.ndarray) -> None:
        row = np.unique(sample, return_inverse=True)[1]
        by_row, by_k = np.lexsort((k, row)), np.lexsort((row, k))
        self.n, self.b, self.signs = len(b), b, signs
        self.rows = row[by_row], k[by_row], z[by_row]
        self.marks = k[by_k], row[by_k], z[by_k]

    @staticmethod
    def _sum(by: tuple, x: np.ndarray) -> np.ndarray:
        to, of, z = by
        first = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
        step = max(1, (1 << 22) // len(z))  # columns at a time
        return np.concatenate([np.add.reduceat(z[:, None] * x[of, c : c + step], first, axis=0) for c in range(0, x.shape[1], step)], axis=1)

    def plain(self, x: np.ndarray) -> np.ndarray:
        return self._sum(self.marks, self._sum(self.rows, x))

    def times(self, x: np.ndarray) -> np.ndarray:
        return self.plain(x) - self.b @ (self.signs[:, None] * (self.b.T @ x))

    def moments(self) -> tuple[float, float]:
        """The traces of the covariance and of its square: all pairs of calls of a sample, for some markers at a time."""
        (row, of, z), (k, rows, v) = self.rows, self.marks
        first, size = np.searchsorted(row, np.arange(row[-1] + 1)), np.bincount(row)
        pairs, square = np.concatenate([[0], np.cumsum(size[rows])]), 0.0
        at = np.searchsorted(k, np.arange(self.n + 1))
        a = 0
        while a < self.n:
            e = int(np.searchsorted(pairs[at], pairs[at[a]] + (1 << 21), "right")) - 1
            e = min(max(a + 1, e), a + max(1, (1 << 22) // self.n), self.n)
            here = slice(at[a], at[e])
            n = size[rows[here]]
            to = np.repeat(first[rows[here]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            square += float((np.bincount(np.repeat((k[here] - a) * self.n, n) + of[to], np.repeat(v[here], n) * z[to]) ** 2).sum())
            a = e
        gram = self.b.T @ self.b
        cross = float((self.signs * (self.b * self.plain(self.b)).sum(0)).sum())
        return float((z * z).sum() - (self.signs * np.diag(gram)).sum()), square - 2 * cross + float(((self.signs[:, None] * gram) * (self.signs[:, None] * gram).T).sum())


def _large_p(k: np.ndarray, sample: np.ndarray, z: np.ndarray, u: np.ndarray, b: np.ndarray, signs: np.ndarray, leading: int) -> float:
    """The kernel test's p of one group from its calls: the place of a marker, the sample, and the weighted dosage times the root of d."""
    c = CallCovariance(k.astype(np.int64), sample, z, b, signs)
    values, _ = top_eigen(Projected(c, np.zeros((len(u), 1))), leading, tolerance=1e-3)  # values are off by its square
    return sp.mixture_sf(float(u @ u), *sp.with_rest(values, *c.moments()))


#: Shares of the burden statistic that the optimal test tries.
RHOS = (0.0, 0.01, 0.04, 0.09, 0.25, 0.5, 1.0)


def skat_p(u: np.ndarray, k: np.ndarray, optimal: bool = False) -> tuple[float, float]:
    """(p, rho) from the weighted scores and their covariance: the kernel test, or the best of burden mixtures.

    All tails, those inside the optimal test's integral too, are exact (special.mixture_sf), at
    any depth; no other method takes over for small values.
    """
    if not optimal or len(u) == 1:
        return sp.mixture_sf(float(u @ u), np.linalg.eigvalsh(k)), 0.0
    values, vectors = np.linalg.eigh(k)
    root = vectors * np.sqrt(np.maximum(values, 0))  # u is root times independent normals
    rho, m = np.minimum(RHOS, 0.999), len(u)
    gram, total = root.T @ root, root.sum(0)
    spectra = [np.linalg.eigvalsh((1 - r) * gram + r * np.outer(total, total)) for r in rho]
    ps = np.array([sp.mixture_sf((1 - r) * float(u @ u) + r * float(u.sum()) ** 2, l) for r, l in zip(rho, spectra)])
    best, low = int(np.argmin(ps)), float(max(ps.min(), 1e-300))
    # all statistics share the part along the mean score; what is left of the kernel is integrated over it
    mean = total / m
    along = float(mean @ mean)
    if along <= 1e-12 * np.trace(gram):
        return low, float(RHOS[best])
    load = root @ mean
    rest = root - np.outer(load / along, mean)
    left = np.linalg.eigvalsh(rest @ rest.T)
    tau = m * m * rho * along + (1 - rho) * float(load @ load) / along
    quantile = np.array([sp.mixture_ppf_upper(low, l) for l in spectra])
    shared = 4 * float(np.sum((rest.T @ load) ** 2)) / along
    centre, spread = left.sum(), 2 * float(np.sum(left**2))
    scale = np.sqrt(spread / (spread + shared)) if spread > 0 else 1.0
    edge = np.sqrt(np.min(quantile / tau))  # from here on the common part alone exceeds
    nodes, weights = np.polynomial.legendre.leggauss(48)
    cuts = np.linspace(0, edge, 6)
    z = np.concatenate([(y - x) / 2 * nodes + (x + y) / 2 for x, y in zip(cuts[:-1], cuts[1:])])
    w = np.concatenate([(y - x) / 2 * weights for x, y in zip(cuts[:-1], cuts[1:])])
    level = np.min((quantile - tau * z[:, None] ** 2) / (1 - rho), axis=1)
    tail = _smooth_tail((level - centre) * scale + centre, left) if left.max() > 1e-12 * values.max() else (level < 0).astype(float)
    p = float(np.sum(w * np.sqrt(2 / np.pi) * np.exp(-z * z / 2) * tail) + 2 * sp.norm_sf(edge))
    return float(min(1.0, max(p, low), low * len(rho))), float(RHOS[best])


def _smooth_tail(q: np.ndarray, lam: np.ndarray, nodes: int = 48) -> np.ndarray:
    """mixture_sf() of many q: the logarithm of the tail at Chebyshev nodes, and the polynomial through them."""
    high = q.max()
    if len(q) <= nodes or high <= 0:
        return sp.mixture_sf(q, lam)
    low = max(float(q[q > 0].min()), 1e-3 * high)
    x = np.cos(np.pi * (np.arange(nodes) + 0.5) / nodes)
    at = sp.mixture_sf((high + low) / 2 + (high - low) / 2 * x, lam)
    poly = np.polynomial.chebyshev.chebfit(x, np.log(np.maximum(at, 1e-320)), nodes - 1)
    out = np.exp(np.polynomial.chebyshev.chebval(np.clip((2 * q - high - low) / (high - low), -1, 1), poly))
    return np.where(q <= 0, 1.0, np.minimum(out, 1.0))


def phenotype_table(calls: DataFrame, y: str = "y", bins: int = 4, few: int = 10, marker: str = "marker") -> DataFrame:
    """Genotype by phenotype-bin counts: values themselves where fewer than few are distinct, else bins of equal mass."""
    v = running_counts(calls.select("sample", y).distinct(), y)
    if v.count() < few:
        v = v.withColumn("bin", F.dense_rank().over(Window.orderBy(y)) - 1)  # over fewer than few rows
    else:
        v = v.withColumn("bin", F.floor(F.col("before") * bins / F.col("total")))
    v = v.select(y, F.col("bin").cast("long").alias("bin"))
    x = calls.join(v, y)
    return x.groupBy(marker, "bin").agg(F.count_if(F.col("g") < 0.5).alias("n0"), F.count_if((F.col("g") >= 0.5) & (F.col("g") < 1.5)).alias("n1"), F.count_if(F.col("g") >= 1.5).alias("n2"), F.count_if(F.col("g").isNull()).alias("n_miss"))
