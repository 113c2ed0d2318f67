"""Tails of quadratic forms, and the kernel tests that rest on them."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from locusmill.functions import special as sp
from locusmill.operators import group


@pytest.mark.parametrize("q,p", [(30, 8.4e-8), (40, 4.9e-10), (60, 1.8e-14)])
def test_known_tails(q, p):
    assert sp.mixture_sf(q, np.array([1, 0.5, 0.3, 0.2])) == pytest.approx(p, rel=0.015)  # given to two digits


def hypo(q, rates):
    """Tail of a sum of exponentials of different rates, by partial fractions."""
    return sum(np.exp(-r * q) * np.prod([o / (o - r) for o in rates if o != r]) for r in rates)


@pytest.mark.parametrize("lam", [(1.0, 0.3), (1.0, 0.6, 0.1), (5.0, 0.5)])
def test_pairs_of_equal_weights_are_sums_of_exponentials(lam):
    w = np.repeat(lam, 2)  # two halves of a chi-squared(2), which is exponential with rate 1 / (2 w)
    for q in np.array([0.5, 2, 10, 40, 70]) * max(lam):
        want = hypo(q, [1 / (2 * x) for x in lam])
        assert sp.mixture_sf(q, w) == pytest.approx(want, rel=1e-6)
        assert sp.mixture_sf(q, np.array(lam), 2 * np.ones(len(lam))) == pytest.approx(want, rel=1e-6)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 400), st.floats(-4, 30))
def test_equal_weights_are_chi_squared(df, z):
    q = max(df + z * np.sqrt(2 * df), 0.05 * df)
    want = float(sp.chi2_sf(q, df))
    if 1e-250 < want < 0.999:
        assert sp.mixture_sf(q, np.ones(df)) == pytest.approx(want, rel=1e-6)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.floats(0.01, 1), min_size=2, max_size=8))
def test_tail_falls_smoothly_and_its_quantile_comes_back(lam):
    lam = np.array(lam)
    q = np.linspace(0.2, 60, 80) * lam.max()
    p = sp.mixture_sf(q, lam)
    assert (np.diff(p) < 0).all() and (np.abs(np.diff(np.log(p), 2)) < 0.5).all()  # no seam between methods
    for want in (0.3, 1e-4, 1e-12):
        assert sp.mixture_sf(sp.mixture_ppf_upper(want, lam), lam) == pytest.approx(want, rel=1e-6)


def test_edges():
    assert np.isnan(sp.mixture_sf(1.0, np.zeros(3))) and sp.mixture_sf(0.0, np.ones(2)) == 1 and sp.mixture_sf(np.inf, np.ones(2)) == 0
    assert np.isnan(sp.mixture_sf(np.nan, np.ones(2)))


def plain_kernel(calls, samples, binary=False, beta=(1, 25), xs=("x",)):
    """Dense, from the definition: Q, and the eigenvalues of the scores' covariance."""
    names = sorted({c[1] for c in calls})
    order = {s[0]: i for i, s in enumerate(samples)}
    g = np.zeros((len(order), len(names)))
    maf = {}
    for s, m, v, f in calls:
        g[order[s], names.index(m)] = v or 0
        maf[m] = f
    w = np.array([beta[1] * (1 - maf[m]) ** (beta[1] - 1) if beta else 1.0 for m in names])  # beta(1, b)
    x, y = np.array([[1, s[2]] for s in samples], float), np.array([s[1] for s in samples], float)
    if binary:
        b = np.zeros(2)
        for _ in range(50):
            mu = 1 / (1 + np.exp(-x @ b))
            b += np.linalg.solve((x * (mu * (1 - mu))[:, None]).T @ x, x.T @ (y - mu))
        r, v = y - mu, mu * (1 - mu)
    else:
        r = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
        v = np.full(len(y), (r @ r) / (len(y) - 2))
        r, v = r / v, 1 / v
    z = g * w
    p = np.diag(v) - (v[:, None] * x) @ np.linalg.inv(x.T @ (x * v[:, None])) @ (v[:, None] * x).T
    return z.T @ r, z.T @ p @ z


@pytest.fixture(scope="module")
def cohort(spark):
    rng = np.random.default_rng(4)
    n, m = 150, 40
    maf = rng.uniform(0.02, 0.3, m)
    g = rng.binomial(2, maf, (n, m)).astype(float)
    x = rng.standard_normal(n)
    y = 0.5 * x + 0.8 * g[:, 1] + rng.standard_normal(n)
    calls = [(i, j, None if rng.random() < 0.02 else float(g[i, j]), float(maf[j])) for i in range(n) for j in range(m)]
    samples = [(i, float(y[i]), float(x[i]), int(y[i] > 0.3)) for i in range(n)]
    c = spark.createDataFrame([("a" if j < 25 else "b", i, j, v, f) for i, j, v, f in calls], "grp string, sample long, marker long, g double, maf double")
    return calls, samples, c, spark.createDataFrame(samples, "sample long, y double, x double, status int")


@pytest.mark.parametrize("tile,block", [(512, 32_768), (7, 40)])
@pytest.mark.parametrize("binary", [False, True])
def test_kernel_test_against_plain_version(cohort, binary, tile, block, monkeypatch):
    calls, samples, c, s = cohort
    whole = group.kernel_tiles
    monkeypatch.setattr(group, "kernel_tiles", lambda *a: whole(*a, block=block))
    for beta in ((1, 25), None):
        got = {r.grp: r for r in group.kernel_test(c, group.null_model(s, "status" if binary else "y", ("x",), binary), beta=beta, tile=tile).collect()}
        for name, keep in (("a", lambda j: j < 25), ("b", lambda j: j >= 25)):
            u, k = plain_kernel([x for x in calls if keep(x[1])], [(a, d if binary else b, e) for a, b, e, d in samples], binary, beta)
            assert got[name].q == pytest.approx(u @ u, rel=1e-6) and got[name].n_vars == len(u)
            assert got[name].pvalue == pytest.approx(sp.mixture_sf(u @ u, np.linalg.eigvalsh(k)), rel=1e-5)


def test_large_groups_agree_with_dense_ones(cohort):
    *_, c, s = cohort
    null = group.null_model(s, "y", ("x",))
    want = {r.grp: r.pvalue for r in group.kernel_test(c, null).collect()}
    got = {r.grp: r.pvalue for r in group.kernel_test(c, null, tile=8, dense=10, leading=12).collect()}
    assert got == pytest.approx(want, rel=0.02)
    assert {r.grp: r.pvalue for r in group.kernel_test(c, null, tile=8, dense=10, leading=25).collect()} == pytest.approx(want, rel=1e-4)
    with pytest.raises(ValueError):
        group.kernel_test(c, null, dense=10, optimal=True)


def test_optimal_test_is_calibrated():
    rng = np.random.default_rng(1)
    a = rng.standard_normal((6, 6))
    k = a @ a.T + np.eye(6)
    root = np.linalg.cholesky(k)
    p = np.array([group.skat_p(root @ rng.standard_normal(6), k, True)[0] for _ in range(250)])
    assert abs((p < 0.1).mean() - 0.1) < 0.06 and abs((p < 0.5).mean() - 0.5) < 0.11
    u = root @ np.ones(6) * 5
    assert group.skat_p(u, k, True)[0] < 1e-6


def test_covariance_by_calls():
    """Products and both traces of the covariance of a large group's scores, from its calls alone."""
    rng = np.random.default_rng(4)
    z = rng.standard_normal((30, 70)) * (rng.random((30, 70)) < 0.15)
    z[0] += 0.1
    sample, k = np.nonzero(z)
    b, signs = rng.standard_normal((70, 3)) * 0.1, np.array([1.0, -1.0, 1.0])
    mix = rng.permutation(len(k))
    c = group.CallCovariance(k[mix], 7 * sample[mix], z[sample, k][mix], b, signs)
    want, x = z.T @ z - (b * signs) @ b.T, rng.standard_normal((70, 4))
    assert np.allclose(c.times(x), want @ x)
    assert c.moments() == pytest.approx((np.trace(want), (want**2).sum()))
