"""Kinship and the linear mixed model."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import special as sp

#: Dense n x n work on the driver stops here.
MOST_SAMPLES = 20_000


def kinship(variants: DataFrame, n: int, method: str = "bn", tile: int = 512) -> DataFrame:
    """(i, j, k, w) with i >= j: the raw sum of products of standardised dosages and the markers' weight, from kinship_tiles()."""

    def flat(batches):
        for part in batches:
            for a, b, w, k in zip(part["a"], part["b"], part["w"], part["k"]):
                k = np.asarray(k).reshape(min(tile, n - a), -1)
                i, j = np.meshgrid(a + np.arange(k.shape[0]), b + np.arange(k.shape[1]), indexing="ij")
                keep = i >= j
                yield pd.DataFrame({"i": i[keep], "j": j[keep], "k": k[keep], "w": w})

    return kinship_tiles(variants, n, method, tile).mapInPandas(flat, "i long, j long, k double, w double")


def kinship_tiles(variants: DataFrame, n: int, method: str = "bn", tile: int = 512) -> DataFrame:
    """(a, b, w, k) with a >= b: of each tile of samples (first row, first column) the raw sums, row by row, and the markers' weight.

    variants has idx (sample positions) and g of each marker's calls. A task takes the rows of a
    tile of samples (tile x n numbers) over its share of the markers, a few hundred at a time;
    every marker goes to each of the n / tile rows once, and tiles are summed by key, so no
    task or driver holds n x n.
    bn: (g - 2p) / sqrt(2pq), missing 0. ibs: g - 1, missing 2p - 1, half of the weight on all pairs.
    """
    rows = -(-n // tile)

    def dense(part: pd.DataFrame) -> np.ndarray:
        m, ok = np.zeros((len(part), n)), np.zeros(len(part), bool)
        for r, (idx, g) in enumerate(zip(part["idx"], part["g"])):
            idx, g = np.asarray(idx, int), np.asarray(g, float)
            p = g.mean() / 2 if len(g) else 0
            if 0 < p < 1:
                ok[r] = True
                if method == "bn":
                    m[r, idx] = (g - 2 * p) / np.sqrt(2 * p * (1 - p))
                else:
                    m[r] = 2 * p - 1
                    m[r, idx] = g - 1
        return m[ok]

    def run(batches):
        row, acc, w = -1, None, 0

        def done():
            for b in range(0, (row + 1) * tile, tile):
                yield pd.DataFrame({"a": [row * tile], "b": [b], "w": [float(w)], "k": [acc[:, b : b + tile].ravel().tolist()]})

        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.iloc[start : start + 256]
                for a, mine in part.groupby("row", sort=True):
                    if a != row:
                        if row >= 0:
                            yield from done()
                        row, w = int(a), 0
                        acc = np.zeros((min(tile, n - row * tile), min(n, (row + 1) * tile)))
                    m = dense(mine)
                    acc += m[:, row * tile : (row + 1) * tile].T @ m[:, : acc.shape[1]] + (len(m) if method == "ibs" else 0)
                    w += len(m) * (2 if method == "ibs" else 1)
        if row >= 0:
            yield from done()

    def add(part: pd.DataFrame) -> pd.DataFrame:
        a, b = int(part["a"].iloc[0]), int(part["b"].iloc[0])
        return pd.DataFrame({"a": [a], "b": [b], "w": [float(part["w"].sum())], "k": [np.sum([np.asarray(x) for x in part["k"]], axis=0)]})

    every = variants.select("idx", "g", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("row"))
    if rows > 1:
        every = every.withColumn("share", F.pmod(F.xxhash64("idx", "g"), F.lit(16))).repartition("row", "share").sortWithinPartitions("row").drop("share")
    tiles = every.mapInPandas(run, "a int, b int, w double, k array<double>")
    return tiles.groupBy("a", "b").applyInPandas(add, "a int, b int, w double, k array<double>")


def packed(calls: DataFrame, marker: str = "marker", sample: str = "sample") -> DataFrame:
    """marker, idx (samples, ascending) and g of each marker's calls, from rows of calls (a marker and sample once): rows are sorted, and lists cut in Arrow."""

    def lists(m, i, g):
        first = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
        ends = pa.array(np.append(first, len(m)).astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(m[first]), pa.ListArray.from_arrays(ends, pa.array(i)), pa.ListArray.from_arrays(ends, pa.array(g))], names=[marker, "idx", "g"])

    def run(batches):
        rest = None
        for batch in batches:
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(3)]
            now = now if rest is None else [np.concatenate(x) for x in zip(rest, now)]
            cut = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0  # the last marker may go on
            if cut:
                yield lists(*(x[:cut] for x in now))
            rest = [x[cut:] for x in now]
        if rest is not None and len(rest[0]):
            yield lists(*rest)

    x = calls.where("g is not null").select(F.col(marker).cast("long").alias(marker), F.col(sample).cast("int").alias("i"), F.col("g").cast("double").alias("g"))
    return x.repartition(marker).sortWithinPartitions(marker, "i").mapInArrow(run, f"{marker} long, idx array<int>, g array<double>")


def pair_sums(variants: DataFrame, tile: int = 1024, limit: int = 1 << 21) -> DataFrame:
    """(i, j, k) with i >= j: the raw sums of products of standardised dosages (bn) of all pairs of samples that some marker calls together.

    variants has idx and g of each marker's calls. Pairs are made marker by marker, so the work is that of
    the pairs that occur and not of samples squared. A task takes a tile of samples as i, for which only markers
    with calls there come to it, and hands its sums on whenever it holds limit of them; those of a pair are added by key.
    """
    mean = F.aggregate("g", F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size("g"), F.lit(0))
    v = variants.select("idx", "g", (mean / 2).alias("p")).where("p > 0 and p < 1")
    v = v.withColumn("row", F.explode(F.array_distinct(F.transform("idx", lambda i: F.floor(i / tile).cast("int"))))).repartition("row", F.pmod(F.xxhash64("idx"), F.lit(4))).sortWithinPartitions("row")

    def added(codes: list, sums: list) -> tuple[np.ndarray, np.ndarray]:
        c, s = np.concatenate(codes), np.concatenate(sums)
        if not len(c):
            return c, s
        order = np.argsort(c, kind="stable")
        c, s = c[order], s[order]
        first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        return c[first], np.add.reduceat(s, first)

    def rows(code: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(code >> np.int64(32)), pa.array(code & np.int64(0xFFFFFFFF)), pa.array(s)], names=["i", "j", "k"])

    def run(batches):
        codes, sums, fresh, now = [], [], 0, None
        for batch in batches:
            row = batch.column("row").to_numpy()
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                idx, size = part.column("idx").flatten().to_numpy().astype(np.int64), pc.list_value_length(part.column("idx")).to_numpy().astype(np.int64)
                p = np.repeat(part.column("p").to_numpy(), size)
                z = (part.column("g").flatten().to_numpy() - 2 * p) / np.sqrt(2 * p * (1 - p))
                of = np.repeat(np.arange(len(size)), size)
                order = np.lexsort((idx, of))
                idx, z = idx[order], z[order]
                mine = np.flatnonzero(idx // tile == row[start : start + 256][of])
                first = np.cumsum(size) - size
                for lo in range(0, len(mine), max(1, int(limit // max(size.max(), 1)))):
                    a = mine[lo : lo + max(1, int(limit // max(size.max(), 1)))]
                    n = a - first[of[a]] + 1  # of each call those of its marker up to itself
                    b = np.repeat(first[of[a]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    codes.append(np.repeat(idx[a] << np.int64(32), n) | idx[b])
                    sums.append(np.repeat(z[a], n) * z[b])
                    fresh += len(b)
                    if fresh >= limit:
                        c, s = added(codes, sums)
                        if len(c) > limit or now is not None and int(row[start]) != now:
                            yield rows(c, s)
                            c, s = c[:0], s[:0]
                        codes, sums, fresh, now = [c], [s], 0, int(row[start])
        if codes:
            yield rows(*added(codes, sums))

    return v.mapInArrow(run, "i long, j long, k double").groupBy("i", "j").agg(F.sum("k").alias("k"))


def informative(variants: DataFrame) -> int:
    """How many markers vary, which is the weight of pair_sums()."""
    mean = F.aggregate("g", F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size("g"), F.lit(0))
    return variants.where((mean > 0) & (mean < 2)).count()


def every_pair(sums: DataFrame, n: int, absent: DataFrame | None = None) -> DataFrame:
    """sums (i, j, k) and, with k 0, all other pairs i >= j of n samples: as each sample has its own list of partners, the zeros need no join.

    absent: samples (column i) that take no part; their numbers, eight bytes each, go to every task.
    """
    had = sums.groupBy("i").agg(F.collect_list(F.struct("j", "k")).alias("s"))
    all_ = sums.sparkSession.range(n).withColumnRenamed("id", "i").join(had, "i", "left")
    taken = F.coalesce("s.j", F.array().cast("array<bigint>"))
    if absent is not None:
        all_ = all_.join(absent.select("i"), "i", "left_anti").crossJoin(absent.agg(F.collect_list("i").alias("gone")))
        taken = F.concat(taken, "gone")
    zero = F.transform(F.array_except(F.sequence(F.lit(0).cast("long"), F.col("i")), taken), lambda j: F.struct(j.alias("j"), F.lit(0.0).alias("k")))
    both = F.concat(F.coalesce("s", F.array().cast("array<struct<j:bigint,k:double>>")), zero)
    return all_.select("i", F.explode(both).alias("p")).select("i", "p.j", "p.k")


def merge_kinship(*parts: DataFrame, raw: bool = False, correlation: bool = False) -> DataFrame:
    """Sum of raw kinships over their summed weights (raw: both sums kept); correlation scales to a unit diagonal."""
    x = parts[0]
    for p in parts[1:]:
        x = x.unionByName(p)
    s = x.groupBy("i", "j").agg(F.sum("k").alias("k"), F.sum("w").alias("w"))
    if raw:
        return s
    s = s.select("i", "j", (F.col("k") / F.col("w")).alias("k"))
    if correlation:
        d = s.where("i = j")
        s = s.join(d.select("i", F.col("k").alias("ki")), "i").join(d.select(F.col("i").alias("j"), F.col("k").alias("kj")), "j").select("i", "j", (F.col("k") / F.sqrt(F.col("ki") * F.col("kj"))).alias("k"))
    return s


def related_pairs(k: DataFrame, threshold: float) -> DataFrame:
    """Pairs of different samples with a kinship above threshold."""
    return k.where((F.col("i") != F.col("j")) & (F.col("k") > threshold))


def closest(k: DataFrame) -> DataFrame:
    """Of each sample the partner with the largest positive kinship (ties: the first): i, partner, k."""
    sides = F.array(F.struct(F.col("i").alias("i"), F.col("j").alias("j")), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))
    both = k.where("i <> j and k > 0").select(F.explode(sides).alias("p"), "k").select("p.i", "p.j", "k")
    w = Window.partitionBy("i").orderBy(F.col("k").desc(), "j")
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("i", F.col("j").alias("partner"), "k")


def to_matrix(k: DataFrame, n: int) -> np.ndarray:
    """The dense kinship, for the eigen decomposition (n is checked)."""
    if n > MOST_SAMPLES:
        raise ValueError(f"at most {MOST_SAMPLES} samples for a dense decomposition")
    p = k.select("i", "j", "k").toPandas()
    out = np.zeros((n, n))
    out[p["i"], p["j"]] = out[p["j"], p["i"]] = p["k"]
    return out


def principal_components(k: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest eigenvalues and vectors of a kinship, signs fixed by the largest entry."""
    w, v = np.linalg.eigh(k)
    w, v = w[::-1][:count], v[:, ::-1][:, :count]
    return w, v * np.sign(v[np.abs(v).argmax(0), np.arange(v.shape[1])])


@dataclass
class Rotation:
    """Restricted eigen decomposition of a kinship with the REML variance ratio; whitens vectors and matrices."""

    values: np.ndarray
    vectors: np.ndarray
    trace: float
    delta: float = 1.0
    vg: float = 0.0
    ve: float = 0.0
    h2: float = 0.0
    llk0: float = 0.0
    llk1: float = 0.0

    @property
    def samples(self) -> int:
        return self.vectors.shape[0]

    def rotate(self, x: np.ndarray) -> np.ndarray:
        t = self.vectors.T @ x
        d = 1 / np.sqrt(self.values + self.delta)
        return t * (d if t.ndim == 1 else d[:, None])


def restricted_eigen(k: np.ndarray, x: np.ndarray) -> Rotation:
    """Of S (K + I) S, S off the covariates' span: without its p smallest values, less 1."""
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    u = u[:, s > 1e-10 * s.max()]
    proj = np.eye(len(k)) - u @ u.T
    m = proj @ (k + np.eye(len(k))) @ proj
    w, v = np.linalg.eigh((m + m.T) / 2)
    p = u.shape[1]
    return Rotation(w[p:] - 1, v[:, p:], float(np.trace(m)))


def likelihood_fit(y_nodes: np.ndarray, y_weights: np.ndarray, nodes: np.ndarray, weights: np.ndarray, c: int, trace: float, edge: bool = False) -> dict:
    """The variance ratio of largest restricted likelihood: delta, v_g, v_e, llk0, llk1, h2.

    Squares of the rotated trait are y_weights at y_nodes, eigenvalues are nodes with weights
    (counts). A grid of log10(delta) in [-5, 5], the derivative's roots by bisection; edge keeps
    the grid point below each root instead.
    """

    def ll(ld):
        return 0.5 * (c * (np.log(c / (2 * np.pi)) - 1 - np.log(np.sum(y_weights / (y_nodes + 10.0**ld)))) - np.sum(weights * np.log(nodes + 10.0**ld)))

    def slope(ld):
        d = y_nodes + 10.0**ld
        return c * np.sum(y_weights / d**2) / np.sum(y_weights / d) - np.sum(weights / (nodes + 10.0**ld))

    grid = np.linspace(-5, 5, 101)
    with np.errstate(invalid="ignore"):
        f = [slope(g) for g in grid]
        best = (ll(5.0), 5.0)
        for a, b, fa, fb in zip(grid[:-1], grid[1:], f[:-1], f[1:]):
            if fa > 0 >= fb:
                lo, hi = a, b
                while not edge and hi - lo > 1e-7:
                    mid = (lo + hi) / 2
                    lo, hi = (mid, hi) if slope(mid) > 0 else (lo, mid)
                best = max(best, (ll(lo), lo))
    delta = 10.0 ** best[1]
    vg = float(np.sum(y_weights / (y_nodes + delta)) / c)
    return {"delta": float(delta), "v_g": vg, "v_e": vg * float(delta), "llk0": float(ll(5.0)), "llk1": float(best[0]), "h2": float(trace / (c * delta + trace))}


def reml(rot: Rotation, y: np.ndarray, edge: bool = False) -> Rotation:
    """The decomposition with the variance ratio of y, see likelihood_fit()."""
    r = likelihood_fit(rot.values, (rot.vectors.T @ y) ** 2, rot.values, np.ones(len(rot.values)), len(rot.values), rot.trace, edge)
    return Rotation(rot.values, rot.vectors, rot.trace, r["delta"], r["v_g"], r["v_e"], r["h2"], r["llk0"], r["llk1"])


def reml_traits(rot: Rotation, y: np.ndarray, edge: bool = False) -> list[Rotation]:
    """reml() of each column of y: one decomposition, and each trait's own variance ratio."""
    return [reml(rot, y[:, k], edge) for k in range(y.shape[1])]


def mixed_scan(variants: DataFrame, rot: Rotation | list[Rotation], y: np.ndarray, by: list[str], missing_as_mean: bool = True) -> DataFrame:
    """Association on the whitened scale: by, ns, stat, pvalue, beta, sebeta, r2 (q.mixed).

    y may have several columns (traits); rot then has the fit of each trait, and markers are
    whitened with each trait's own variance ratio. variants has idx and g of each marker's
    calls; missing ones have the mean (else 0). Markers go through in batches as one matrix product.
    """
    several = y.ndim == 2
    rots = list(rot) if isinstance(rot, list) else [rot]
    if several and len(rots) != y.shape[1]:
        raise ValueError("each trait needs its own fit")
    n = rots[0].vectors.shape[0]
    ys = y if several else y[:, None]
    shared = variants.sparkSession.sparkContext.broadcast((rots[0].vectors, [1 / np.sqrt(r.values + r.delta) for r in rots], [r.rotate(ys[:, k]) for k, r in enumerate(rots)]))

    def run(batches):
        vectors, scales, tys = shared.value
        for part in batches:
            g = np.empty((len(part), n))
            for r, (idx, v) in enumerate(zip(part["idx"], part["g"])):
                v = np.asarray(v, float)
                g[r] = v.mean() if len(v) and missing_as_mean else 0
                g[r, np.asarray(idx, int)] = v
            turned, head = vectors.T @ g.T, part[by].reset_index(drop=True)
            for k, (scale, ty) in enumerate(zip(scales, tys)):
                tx, c = turned * scale[:, None], len(scale)
                cx, cy = tx - tx.sum(0) / (c + 1), ty - ty.sum() / (c + 1)  # an intercept over c + 1 rows
                sxx, syy, sxy = (tx * cx).sum(0), float(ty @ cy), tx.T @ cy
                with np.errstate(all="ignore"):
                    beta = sxy / sxx
                    r2 = sxy**2 / (sxx * syy)
                    se = np.sqrt(np.maximum(syy / sxx * (1 - r2), 1e-300) / (c - 1))
                    t = np.where(sxx > 1e-9, beta / se, np.nan)
                extra = {"trait": k} if several else {}
                yield head.assign(**extra, ns=[len(x) if missing_as_mean else n for x in part["g"]], stat=t, pvalue=sp.t_two_sided(t, c - 1), beta=beta, sebeta=se, r2=r2)

    keys = ", ".join(f"{c} {variants.schema[c].dataType.simpleString()}" for c in by)
    return variants.select(*by, "idx", "g").mapInPandas(run, f"{keys}, {'trait int, ' if several else ''}ns long, stat double, pvalue double, beta double, sebeta double, r2 double")


def simulate(k: np.ndarray, h2: float, count: int = 1, binary: bool = False, seed: int = 1) -> np.ndarray:
    """Phenotypes of heritability h2 under a kinship; halved at their median with binary."""
    rng = np.random.default_rng(seed)
    w, v = np.linalg.eigh(k)
    out = np.sqrt(h2) * (v * np.sqrt(np.maximum(w, 0))) @ rng.standard_normal((len(k), count)) + np.sqrt(1 - h2) * rng.standard_normal((len(k), count))
    return (out > np.median(out, 0)).astype(float) if binary else out


def simulated_trait(calls: DataFrame, samples: DataFrame, h2: float, seed: int = 1, binary: bool = False, marker: str = "marker", sample: str = "sample") -> DataFrame:
    """sample, y: a trait of heritability h2 under the kinship of calls, halved at its median with binary.

    Each marker has a normal effect by a hash of its name, each sample a normal rest by one of its own; the sum of
    standardised dosages times effects has the kinship as its covariance, so no decomposition is needed.
    """

    def normal(*key):
        u = [(F.pmod(F.xxhash64(*key, F.lit(f"{seed}:{k}")), F.lit(1 << 40)) + 0.5) / float(1 << 40) for k in range(2)]
        return F.sqrt(-2 * F.log(u[0])) * F.cos(2 * np.pi * u[1])

    called = calls.where("g is not null")
    m = called.groupBy(marker).agg((F.avg("g") / 2).alias("_p")).where("_p > 0 and _p < 1")
    count = m.count()
    z = (F.col("g") - 2 * F.col("_p")) / F.sqrt(2 * F.col("_p") * (1 - F.col("_p")))
    bred = called.join(m, marker).groupBy(sample).agg((F.sum(z * normal(marker)) / float(max(count, 1)) ** 0.5).alias("_a"))
    y = samples.select(sample).join(bred, sample, "left").withColumn("y", F.coalesce("_a", F.lit(0.0)) * h2**0.5 + normal(sample, F.lit("rest")) * (1 - h2) ** 0.5).select(sample, "y")
    if not binary:
        return y
    half = y.agg(F.percentile("y", F.lit(0.5))).first()[0]
    return y.withColumn("y", (F.col("y") > F.lit(half)).cast("double"))
