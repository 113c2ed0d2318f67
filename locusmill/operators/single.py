"""Single-variant association: closed forms as aggregates, iterative tests in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window  # noqa: F401
from pyspark.sql import functions as F

from ..functions import special as sp
from ..functions import tails
from .qc import average_rank, with_average_rank

#: Iterative tests by name: f(g, y, x) of one marker's complete cases -> dict of results.
TESTS: dict[str, tuple[Callable, str]] = {}


def single_test(name: str, columns: str):
    """Registers a kernel under a name with its result columns (DDL)."""

    def add(f):
        TESTS[name] = (f, columns)
        return f

    return add


# ---------------------------------------------------------------- closed forms


def with_conditions(samples: DataFrame, calls: DataFrame, markers: list, sample: str = "sample", marker: str = "marker") -> tuple[DataFrame, list[str]]:
    """samples with the dosages of the given markers as covariates, and those columns' names.

    Tests of other markers are then conditional on them. markers is a short literal list; a
    missing call has its marker's mean, a marker without calls is left out.
    """
    own = calls.where(F.col(marker).isin(list(markers)))
    means = own.groupBy(marker).agg(F.avg("g").alias("mean")).where("mean is not null").collect()  # one row a condition
    names = {r[marker]: f"cond{i}" for i, r in enumerate(sorted(means, key=lambda r: str(r[marker])))}
    at = own.groupBy(sample).agg(*[F.max(F.when(F.col(marker) == F.lit(m), F.col("g"))).cast("double").alias(c) for m, c in names.items()]) if names else own.select(sample).distinct()
    out = samples.join(at, sample, "left")
    return out.fillna({names[r[marker]]: float(r["mean"]) for r in means}) if names else out, list(names.values())


def linear_scan(calls: DataFrame, by: list[str], y: str = "y") -> DataFrame:
    """Simple regression of y on g over complete cases: ns, beta, sebeta, tstat, r2 (sums pre-aggregated in the scan)."""
    g, v = F.when(F.col(y).isNotNull(), F.col("g")).cast("double"), F.when(F.col("g").isNotNull(), F.col(y))
    s = calls.groupBy(*by).agg(F.count(g * v).alias("ns"), F.sum(g).alias("sg"), F.sum(v).alias("sy"), F.sum(g * g).alias("sgg"), F.sum(g * v).alias("sgy"), F.sum(v * v).alias("syy_raw"))
    n = F.col("ns")
    s = s.withColumns({"sxx": F.col("sgg") - F.col("sg") * F.col("sg") / n, "sxy": F.col("sgy") - F.col("sg") * F.col("sy") / n, "syy": F.col("syy_raw") - F.col("sy") * F.col("sy") / n}).where((F.col("sxx") > 1e-9) & (F.col("syy") > 1e-9) & (n > 2))
    r = F.col("sxy") / F.sqrt(F.col("sxx") * F.col("syy"))
    se = F.sqrt(F.col("syy") / F.col("sxx")) * F.sqrt((1 - r * r + 1e-20) / (n - 2))
    return s.select(*by, "ns", (F.col("sxy") / F.col("sxx")).alias("beta"), se.alias("sebeta"), (F.col("sxy") / F.col("sxx") / se).alias("tstat"), (r * r).alias("r2"))


def with_p_from_t(df: DataFrame, t: str = "tstat", df_col: Column | None = None) -> DataFrame:
    """df with pvalue, two-sided, of Student's t with ns - 2 degrees of freedom."""
    return df.withColumn("pvalue", tails.t_two_sided_col(F.col(t), (F.col("ns") - 2).cast("double") if df_col is None else df_col))


def multi_trait_scan(calls: DataFrame, by: list[str], traits: list[str]) -> DataFrame:
    """linear_scan of several traits in long form: by, trait, ns, beta, sebeta, tstat, r2."""
    long = calls.unpivot([*by, "g"], traits, "trait", "y")
    return linear_scan(long, [*by, "trait"])


def fit_logistic(samples: DataFrame, y: str, xs: list[str], rounds: int = 25, tol: float = 1e-10) -> tuple[list[float], np.ndarray]:
    """Coefficients (intercept first) and information of a logistic model: each Newton step is one aggregate over samples."""
    cols = [F.lit(1.0), *[F.col(x).cast("double") for x in xs]]
    beta = np.zeros(len(cols))
    for _ in range(rounds):
        mu = 1 / (1 + F.exp(-sum((F.lit(float(b)) * c for b, c in zip(beta, cols)), F.lit(0.0))))
        w = samples.select(*[c.alias(f"x{i}") for i, c in enumerate(cols)], (F.col(y) - mu).alias("r"), (mu * (1 - mu)).alias("v"))
        grad = [F.sum(F.col("r") * F.col(f"x{i}")) for i in range(len(cols))]
        info = [F.sum(F.col("v") * F.col(f"x{i}") * F.col(f"x{j}")) for i in range(len(cols)) for j in range(i + 1)]
        row = [float(v or 0.0) for v in w.agg(*[c.alias(f"a{i}") for i, c in enumerate(grad + info)]).first()]
        h, k = np.zeros((len(cols), len(cols))), len(cols)
        for i in range(len(cols)):
            for j in range(i + 1):
                h[i, j] = h[j, i] = row[k]
                k += 1
        step = np.linalg.solve(h + 1e-12 * np.eye(len(cols)), row[: len(cols)])
        beta = beta + step
        if np.abs(step).max() < tol:
            break
    return beta.tolist(), h


def score_scan(calls: DataFrame, samples: DataFrame, by: list[str], y: str = "status", xs: tuple[str, ...] = (), sample: str = "sample") -> DataFrame:
    """Logistic score test of each marker: ns, u, v, score. Missing calls have the marker's mean.

    The null model is fitted once; each sample carries its residual and weights, so a marker
    needs only pre-aggregated sums. Totals over all samples stand in for those of missing calls.
    """
    beta, info = fit_logistic(samples, y, list(xs))
    inv = np.linalg.inv(info + 1e-12 * np.eye(len(info)))
    cols = [F.lit(1.0), *[F.col(x).cast("double") for x in xs]]
    mu = 1 / (1 + F.exp(-sum((F.lit(b) * c for b, c in zip(beta, cols)), F.lit(0.0))))
    null = samples.select(sample, (F.col(y) - mu).alias("_r"), (mu * (1 - mu)).alias("_v"), *[(mu * (1 - mu) * c).alias(f"_w{i}") for i, c in enumerate(cols)])
    names = ["_r", "_v", *[f"_w{i}" for i in range(len(cols))]]
    total = null.agg(*[F.sum(c).alias(c) for c in names]).first()
    x = calls.where("g is not null").join(null, sample)
    g = F.col("g").cast("double")
    s = x.groupBy(*by).agg(F.count("*").alias("ns"), F.avg(g).alias("m"), F.sum(F.col("_v") * g * g).alias("vgg"), *[F.sum(F.col(c) * g).alias(f"g{c}") for c in names], *[F.sum(c).alias(f"s{c}") for c in names])
    full = lambda c: F.col(f"g{c}") + F.col("m") * (F.lit(float(total[c])) - F.col(f"s{c}"))
    vgg = F.col("vgg") + F.col("m") * F.col("m") * (F.lit(float(total["_v"])) - F.col("s_v"))
    fit = sum((F.lit(float(inv[i, j])) * full(f"_w{i}") * full(f"_w{j}") for i in range(len(cols)) for j in range(len(cols))), F.lit(0.0))
    s = s.select(*by, "ns", full("_r").alias("u"), (vgg - fit).alias("v")).where("v > 1e-9")
    return s.withColumn("score", F.col("u") / F.sqrt(F.col("v") + 1e-10))


def flipped(calls: DataFrame, by: list[str]) -> DataFrame:
    """calls with g counting the rarer allele: 2 - g for markers whose called alleles are mostly the counted one."""
    m = calls.groupBy(*by).agg((F.sum("g") > F.count("g")).alias("_flip"))
    x = calls.join(m, by)
    return x.withColumn("g", F.when(F.col("_flip"), 2 - F.col("g")).otherwise(F.col("g"))).select(calls.columns)


def rank_sum(calls: DataFrame, by: list[str], y: str = "y", carrier: Column | None = None) -> DataFrame:
    """Wilcoxon's W of y for carriers against others: n1, n0, w, z, ties, stat.

    stat is the W of the others, the first of both groups; ties the sum of t^3 - t over equal
    values of y; z has no correction. with_rank_sum_p() adds p. Carriers have g > 0, so call
    flipped() first where g may count the common allele.
    """
    c = (F.col("g") > 0 if carrier is None else carrier).cast("int")
    same = F.count(F.lit(1)).over(Window.partitionBy(*by, y))
    x = calls.where(F.col("g").isNotNull() & F.col(y).isNotNull()).withColumn("_c", c).withColumn("_k", average_rank(y, part=by)).withColumn("_t", same * same - 1)
    s = x.groupBy(*by).agg(F.sum("_c").alias("n1"), F.sum(1 - F.col("_c")).alias("n0"), F.sum(F.col("_c") * F.col("_k")).alias("ranks"), F.sum("_t").alias("ties"))
    s = s.where("n1 > 0 and n0 > 0").withColumn("w", F.col("ranks") - F.col("n1") * (F.col("n1") + 1) / 2.0)
    z = (F.col("w") - F.col("n1") * F.col("n0") / 2.0) / F.sqrt(F.col("n1") * F.col("n0") * (F.col("n1") + F.col("n0") + 1) / 12.0)
    return s.withColumn("z", z).withColumn("stat", F.col("n1") * F.col("n0") - F.col("w")).select(*by, "n1", "n0", "w", "z", "ties", "stat")


def with_rank_sum_p(ranked: DataFrame, small: int = 50) -> DataFrame:
    """rank_sum()'s rows with exact (whether p is the exact distribution's) and pvalue, two-sided.

    Exact where both groups are smaller than small and nothing is tied; else normal, with the
    variance corrected for ties and the difference for continuity.
    """

    @F.pandas_udf("double")
    def p(n1: pd.Series, n0: pd.Series, ties: pd.Series, stat: pd.Series) -> pd.Series:
        return pd.Series(sp.rank_sum_p(*(x.to_numpy(float) for x in (n1, n0, ties, stat)), small))

    exact = (F.col("n1") < small) & (F.col("n0") < small) & (F.col("ties") == 0)
    return ranked.withColumn("exact", exact).withColumn("pvalue", p("n1", "n0", "ties", "stat"))


def residualise(samples: DataFrame, y: str, xs: list[str], out: str = "resid") -> DataFrame:
    """samples with y's residual of a least-squares fit on an intercept and xs (normal equations by one aggregate)."""
    cols = [F.lit(1.0), *[F.col(x).cast("double") for x in xs]]
    k = len(cols)
    row = [float(v) for v in samples.agg(*[F.sum(cols[i] * cols[j]).alias(f"a{i}_{j}") for i in range(k) for j in range(k)], *[F.sum(cols[i] * F.col(y)).alias(f"b{i}") for i in range(k)]).first()]
    b = np.linalg.lstsq(np.array(row[: k * k]).reshape(k, k), np.array(row[k * k :]), rcond=None)[0]
    return samples.withColumn(out, F.col(y) - sum((F.lit(float(v)) * c for v, c in zip(b, cols)), F.lit(0.0)))


def inverse_normal(samples: DataFrame, y: str, out: str = "inv") -> DataFrame:
    """samples with y's normal score: the quantile at (average rank - 0.5) / n."""
    n = samples.where(F.col(y).isNotNull()).count()
    r = with_average_rank(samples, y, "_rank").withColumn("_q", (F.col("_rank") - 0.5) / F.lit(float(max(n, 1)))).drop("_rank")
    return r.withColumn(out, tails.norm_ppf_col("_q")).drop("_q")


# ---------------------------------------------------------------- iterative tests


def irls(x: np.ndarray, y: np.ndarray, rounds: int = 25, n: np.ndarray | float = 1.0):
    """(beta, covariance, deviance, converged) of a logistic regression; n: how often each row stands there."""
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        mu = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (n * mu * (1 - mu))[:, None]).T @ x
        step = np.linalg.lstsq(h, x.T @ (n * (y - mu)), rcond=None)[0]
        b = b + step
        if np.abs(step).max() < 1e-9:
            break
    mu = np.clip(1 / (1 + np.exp(-np.clip(x @ b, -30, 30))), 1e-12, 1 - 1e-12)
    dev = -2 * np.sum(n * (y * np.log(mu) + (1 - y) * np.log(1 - mu)))
    return b, np.linalg.pinv((x * (n * mu * (1 - mu))[:, None]).T @ x), float(dev), bool(np.abs(step).max() < 1e-4 and np.abs(x @ b).max() < 25)


def firth(x: np.ndarray, y: np.ndarray, fixed: tuple[int, ...] = (), rounds: int = 50, halvings: int = 15, most: float = 15.0, tol: float = 1e-5):
    """(beta, covariance, penalised log-likelihood): Jeffreys-penalised logistic regression, coefficients of fixed held at 0."""
    free = [i for i in range(x.shape[1]) if i not in fixed]

    def at(b):
        mu = np.clip(1 / (1 + np.exp(-np.clip(x @ b, -30, 30))), 1e-12, 1 - 1e-12)
        w = mu * (1 - mu)
        info = (x * w[:, None]).T @ x
        return mu, w, info, float(np.sum(y * np.log(mu) + (1 - y) * np.log(1 - mu)) + 0.5 * np.linalg.slogdet(info)[1])

    b = np.zeros(x.shape[1])
    mu, w, info, ll = at(b)
    for _ in range(rounds):
        cov = np.linalg.pinv(info)
        hat = np.einsum("ij,jk,ik->i", x, cov, x) * w
        u = x.T @ (y - mu + hat * (0.5 - mu))
        step = np.zeros_like(b)
        step[free] = np.linalg.pinv(info[np.ix_(free, free)]) @ u[free]
        step *= min(1.0, most / max(np.abs(step).max(), 1e-300))
        for _ in range(halvings):
            new = at(b + step)
            if new[3] >= ll - 1e-12:
                break
            step /= 2
        b, (mu, w, info, ll) = b + step, new
        if np.abs(step).max() < tol:
            break
    return b, np.linalg.pinv(info), ll


def _ols(x, y):
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    r = y - x @ b
    df = len(y) - x.shape[1]
    return b, np.linalg.pinv(x.T @ x) * (r @ r) / max(df, 1), df, r


_NONE = float("nan")


@single_test("b.wald", "beta double, sebeta double, zstat double, pvalue double")
def wald(g, y, x, n=1.0):
    b, cov, _, ok = irls(np.column_stack([x, g]), y, n=n)
    se = np.sqrt(cov[-1, -1])
    if not ok or se <= 0:
        return dict(beta=_NONE, sebeta=_NONE, zstat=_NONE, pvalue=_NONE)
    return dict(beta=b[-1], sebeta=se, zstat=b[-1] / se, pvalue=float(2 * sp.norm_sf(abs(b[-1] / se))))


@single_test("b.lrt", "null_deviance double, full_deviance double, chisq double, pvalue double")
def lrt(g, y, x):
    d0, d1 = irls(x, y)[2], irls(np.column_stack([x, g]), y)[2]
    return dict(null_deviance=d0, full_deviance=d1, chisq=max(d0 - d1, 0.0), pvalue=float(sp.chi2_sf(max(d0 - d1, 0.0), 1)))


@single_test("b.firth", "beta double, sebeta double, chisq double, pvalue double")
def firth_test(g, y, x):
    full = np.column_stack([x, g])
    b, cov, l1 = firth(full, y)
    c = max(2 * (l1 - firth(full, y, (full.shape[1] - 1,))[2]), 0.0)
    return dict(beta=b[-1], sebeta=float(np.sqrt(cov[-1, -1])), chisq=c, pvalue=float(sp.chi2_sf(c, 1)))


@single_test("b.firthCov", "beta double, sebeta double, chisq double, pvalue double, cov_beta array<double>, cov_sebeta array<double>, cov_pvalue array<double>")
def firth_cov(g, y, x):
    full = np.column_stack([x, g])
    b, cov, l1 = firth(full, y)
    p = [float(sp.chi2_sf(max(2 * (l1 - firth(full, y, (i,))[2]), 0.0), 1)) for i in range(1, x.shape[1])]
    return firth_test(g, y, x) | dict(cov_beta=b[1:-1].tolist(), cov_sebeta=np.sqrt(np.diag(cov))[1:-1].tolist(), cov_pvalue=p)


def saddle_p(g, y, x, cutoff: float = 2.0, zero_normal: bool = False):
    """(p by saddle point, p by normal, converged) of the logistic score test; zeros of g enter as a normal with zero_normal."""
    b = irls(x, y)[0]
    mu = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
    w = mu * (1 - mu)
    adj = g - x @ np.linalg.lstsq((x * w[:, None]).T @ x, (x * w[:, None]).T @ g, rcond=None)[0]
    s, v = float(adj @ (y - mu)), float(np.sum(w * adj * adj))
    if v <= 1e-12:
        return _NONE, _NONE, False
    p_na = float(2 * sp.norm_sf(abs(s) / np.sqrt(v)))
    if abs(s) < cutoff * np.sqrt(v):
        return p_na, p_na, True
    far = (g != 0) if zero_normal and np.mean(g == 0) >= 0.5 else np.ones(len(g), bool)
    a, m = adj[far], mu[far]
    rest = float(np.sum(w[~far] * adj[~far] ** 2))

    def k(t):
        e = np.exp(np.clip(a * t, -500, 500))
        q = m * e / (1 - m + m * e)
        return np.sum(np.log(1 - m + m * e)) - t * np.sum(a * m) + rest * t * t / 2, np.sum(a * q) - np.sum(a * m) + rest * t, np.sum(a * a * q * (1 - q)) + rest

    total, good = 0.0, True
    for q in (abs(s), -abs(s)):
        lo, hi = (0.0, 1.0) if q > 0 else (-1.0, 0.0)
        for _ in range(40):  # widen, then bisect the monotone derivative
            if (k(hi)[1] < q) if q > 0 else (k(lo)[1] > q):
                lo, hi = lo * 2 if q < 0 else hi, hi * 2 if q > 0 else lo
            else:
                break
        for _ in range(80):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if k(mid)[1] < q else (lo, mid)
        t = (lo + hi) / 2
        k0, k1, k2 = k(t)
        if abs(k1 - q) > 1e-3 * max(1.0, abs(q)):  # beyond the largest value the score can take
            good = False
            continue
        r = np.sign(t) * np.sqrt(max(2 * (t * q - k0), 0))
        u = t * np.sqrt(k2)
        z = r + np.log(u / r) / r if r and u / r > 0 else r
        total += float(sp.norm_sf(abs(z)))
    return (min(total, 1.0) if good or total > 0 else p_na), p_na, good


def _saddle(name: str, cutoff: float, zero_normal: bool) -> None:
    @single_test(name, "pvalue double, pval_na double, converge boolean")
    def run(g, y, x):
        p, na, ok = saddle_p(g, y, x, cutoff, zero_normal)
        return dict(pvalue=p, pval_na=na, converge=ok)


_saddle("b.spa2", 2.0, False)
_saddle("b.sna0", 0.1, True)
_saddle("b.sna2", 2.0, True)


@single_test("q.lm", "beta double, sebeta double, tstat double, pvalue double")
def lm(g, y, x):
    b, cov, df, _ = _ols(np.column_stack([x, g]), y)
    se = np.sqrt(cov[-1, -1])
    if df < 1 or se <= 0:
        return dict(beta=_NONE, sebeta=_NONE, tstat=_NONE, pvalue=_NONE)
    return dict(beta=b[-1], sebeta=se, tstat=b[-1] / se, pvalue=float(sp.t_two_sided(b[-1] / se, df)))


@single_test("q.reverse", "beta double, sebeta double, zstat double, pvalue double")
def reverse(g, y, x):
    carrier = ((2 - g if g.mean() > 1 else g) > 0).astype(float)
    if carrier.min() == carrier.max():
        return dict(beta=_NONE, sebeta=_NONE, zstat=_NONE, pvalue=_NONE)
    sd = y.std() or 1.0
    r = wald((y - y.mean()) / sd, carrier, x)
    return r | dict(beta=r["beta"] / sd, sebeta=r["sebeta"] / sd)


def ragged(calls: DataFrame, by: list[str], y: str, xs: list[str]) -> DataFrame:
    """One row a marker with the arrays g, y and x of its complete cases (as long as there are samples)."""
    whole = [F.col(c).cast("double").alias(c) for c in ("g", y, *xs)]
    x = calls.select(*by, *whole).dropna(subset=["g", y, *xs])
    return x.groupBy(*by).agg(F.collect_list("g").alias("g"), F.collect_list(y).alias("y"), F.collect_list(F.array(F.lit(1.0), *xs)).alias("x"))


def linear_covariates(calls: DataFrame, by: list[str], y: str, xs: list[str]) -> DataFrame:
    """q.lm as a closed form: by, ns, beta, sebeta, tstat, pvalue of y on g and xs over complete cases.

    Tasks only send sums and sums of products of each marker, pre-aggregated; the small normal
    equations are then solved for whole batches of markers at once.
    """
    cols = ["g", *xs, y]
    whole = F.lit(True)
    for c in cols:
        whole = whole & F.col(c).isNotNull()
    v = [F.when(whole, F.col(c).cast("double")) for c in cols]
    k = len(cols)
    upper = [(i, j) for i in range(k) for j in range(i, k)]
    s = calls.groupBy(*by).agg(F.count(v[0]).alias("ns"), F.array(*[F.sum(x) for x in v]).alias("_s"), F.array(*[F.sum(v[i] * v[j]) for i, j in upper]).alias("_p"))

    def run(batches):
        for part in batches:
            n = part["ns"].to_numpy(float)
            none = np.full(len(part), np.nan)
            sums = np.array([np.full(k, np.nan) if c == 0 else np.asarray(x, float) for c, x in zip(n, part["_s"])]).reshape(len(part), k)
            prod = np.array([np.full(len(upper), np.nan) if c == 0 else np.asarray(x, float) for c, x in zip(n, part["_p"])]).reshape(len(part), len(upper))
            m = np.empty((len(part), k, k))
            for t, (i, j) in enumerate(upper):
                m[:, i, j] = m[:, j, i] = prod[:, t] - sums[:, i] * sums[:, j] / np.maximum(n, 1)
            df = n - k
            ok = (df >= 1) & (m[:, 0, 0] > 1e-9) & (m[:, -1, -1] > 1e-9)
            beta, se = none.copy(), none.copy()
            if ok.any():
                a, c = m[ok, :-1, :-1], m[ok, :-1, -1]
                inv = np.linalg.pinv(a, hermitian=True)
                b = np.einsum("mij,mj->mi", inv, c)
                rss = np.maximum(m[ok, -1, -1] - np.einsum("mi,mi->m", b, c), 0)
                beta[ok], se[ok] = b[:, 0], np.sqrt(rss / df[ok] * inv[:, 0, 0])
            good = se > 0
            with np.errstate(all="ignore"):
                t = np.where(good, beta / se, np.nan)
            p = np.array([sp.t_two_sided(x, d) if g else np.nan for x, d, g in zip(t, df, good)], float)
            out = pd.DataFrame({"ns": part["ns"], "beta": np.where(good, beta, np.nan), "sebeta": np.where(good, se, np.nan), "tstat": t, "pvalue": p})
            yield pd.concat([part[by].reset_index(drop=True), out.astype({c: object for c in ("beta", "sebeta", "tstat", "pvalue")}).where(out.notna(), None)], axis=1)

    keys = ", ".join(f"{c} {calls.schema[c].dataType.simpleString()}" for c in by)
    return s.mapInPandas(run, f"{keys}, ns long, beta double, sebeta double, tstat double, pvalue double")


def run_test(calls: DataFrame, name: str, by: list[str], y: str, xs: tuple[str, ...] = ()) -> DataFrame:
    """Results of a registered test for each marker: by, ns, and the test's columns (null where it has none)."""
    if name == "q.lm":
        return linear_covariates(calls, by, y, list(xs))
    f, ddl = TESTS[name]
    frame = ragged(calls, by, y, list(xs))
    names = [c.split()[0] for c in ddl.split(", ")]

    def run(batches):
        for part in batches:
            out = []
            for g, v, x in zip(part["g"], part["y"], part["x"]):
                g, v, x = np.asarray(g, float), np.asarray(v, float), np.array([np.asarray(r, float) for r in x])
                blank = {c: None for c in names}
                usable = len(g) > x.shape[1] + 1 and g.min() < g.max() and v.min() < v.max()
                out.append({"ns": len(g)} | (f(g, v, x) if usable else blank))
            yield pd.concat([part[by].reset_index(drop=True), pd.DataFrame(out, columns=["ns", *names])], axis=1)

    keys = ", ".join(f"{c} {frame.schema[c].dataType.simpleString()}" for c in by)
    return frame.mapInPandas(run, f"{keys}, ns long, {ddl}")


def counted_wald(calls: DataFrame, by: list[str], y: str, xs: tuple[str, ...] = ()) -> DataFrame:
    """b.wald as run_test() has it, from how often each combination of g, y and xs occurs: a task holds as many rows as there are different ones, not samples."""
    cols = ["g", y, *xs]
    x = calls.select(*by, *[F.col(c).cast("double").alias(c) for c in cols]).dropna(subset=cols)
    x = x.groupBy(*by, *cols).agg(F.count("*").alias("_n"))
    frame = x.groupBy(*by).agg(*[F.collect_list(c).alias(f"_{k}") for k, c in enumerate(["g", y])], F.collect_list(F.array(F.lit(1.0), *xs)).alias("_x"), F.collect_list("_n").alias("_n"))
    names = ["beta", "sebeta", "zstat", "pvalue"]

    def run(batches):
        for part in batches:
            out = []
            for g, v, x, n in zip(part["_0"], part["_1"], part["_x"], part["_n"]):
                x, n = np.array([np.asarray(r, float) for r in x]), np.asarray(n, float)
                usable = n.sum() > x.shape[1] + 1 and g.min() < g.max() and v.min() < v.max()
                out.append({"ns": int(n.sum())} | (wald(g, v, x, n) if usable else {c: None for c in names}))
            yield pd.concat([part[by].reset_index(drop=True), pd.DataFrame(out, columns=["ns", *names])], axis=1)

    keys = ", ".join(f"{c} {frame.schema[c].dataType.simpleString()}" for c in by)
    return frame.mapInPandas(run, f"{keys}, ns long, {TESTS['b.wald'][1]}")


def em_frequency(lk: np.ndarray, rounds: int = 100, tol: float = 1e-6) -> tuple[float, float]:
    """(allele frequency, log-likelihood) of rows of three genotype likelihoods under Hardy-Weinberg, by EM."""
    f = 0.65
    for _ in range(rounds):
        pri = np.array([(1 - f) ** 2, 2 * f * (1 - f), f * f])
        post = lk * pri
        post /= post.sum(1, keepdims=True)
        new = float((post[:, 1] + 2 * post[:, 2]).sum() / (2 * len(lk)))
        if abs(new - f) < tol:
            f = new
            break
        f = new
    pri = np.array([(1 - f) ** 2, 2 * f * (1 - f), f * f])
    return f, float(np.log((lk * pri).sum(1)).sum())


def likelihood_ratio(lk: DataFrame, by: list[str], status: str = "status") -> DataFrame:
    """Genotype-likelihood ratio test: by, ns, llr, pvalue, af, af1, af0 from rows with likelihoods l0, l1, l2."""
    x = lk.groupBy(*by).agg(F.collect_list(F.array("l0", "l1", "l2")).alias("l"), F.collect_list(status).alias("s"))

    def run(batches):
        for part in batches:
            out = []
            for l, s in zip(part["l"], part["s"]):
                l, s = np.array([np.asarray(r, float) for r in l]), np.asarray(s)
                f, ll = em_frequency(l)
                f1, l1 = em_frequency(l[s == 1]) if (s == 1).any() else (None, 0.0)
                f0, l0 = em_frequency(l[s == 0]) if (s == 0).any() else (None, 0.0)
                r = max(2 * (l1 + l0 - ll), 0.0)
                out.append((len(l), r, float(sp.chi2_sf(r, 1)), f, f1, f0))
            yield pd.concat([part[by].reset_index(drop=True), pd.DataFrame(out, columns=["ns", "llr", "pvalue", "af", "af1", "af0"])], axis=1)

    keys = ", ".join(f"{c} {lk.schema[c].dataType.simpleString()}" for c in by)
    return x.mapInPandas(run, f"{keys}, ns long, llr double, pvalue double, af double, af1 double, af0 double")
