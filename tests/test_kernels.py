import itertools
import math

import numpy as np
import pytest

from locusmill.functions import special as sp
from locusmill.operators import group, mixed, single


def data(n=60, seed=3):
    r = np.random.default_rng(seed)
    g = r.binomial(2, 0.3, n).astype(float)
    x = np.column_stack([np.ones(n), r.standard_normal(n)])
    y = (r.random(n) < 1 / (1 + np.exp(-(0.6 * g + 0.4 * x[:, 1] - 0.5)))).astype(float)
    return g, y, x


def test_special_functions_against_known_values():
    assert sp.norm_sf(1.959963984540054) == pytest.approx(0.025, abs=1e-12)
    assert sp.norm_ppf([0.975, 0.5, 1e-10]) == pytest.approx([1.959963984540054, 0.0, -6.361340902404056], abs=1e-9)
    assert sp.chi2_sf([3.841458820694124, 18.307038053275146, 0.0], [1, 10, 3]) == pytest.approx([0.05, 0.05, 1.0], abs=1e-10)
    assert sp.t_two_sided([2.2281388519649385, 0.0, np.nan, 12.706204736432095], [10, 5, 5, 1]) == pytest.approx([0.05, 1.0, 1.0, 0.05], abs=1e-10)
    assert sp.beta_inc(2, 3, 0.5) == pytest.approx(0.6875) and sp.beta_ppf(0.6875, 2, 3) == pytest.approx(0.5, abs=1e-9)
    assert sp.p_to_z([0.05, 0.0]) == pytest.approx([1.959963984540054, 38.06579])


def test_mixture_tail_reduces_to_chi_squared():
    for k, q in ((1, 3.0), (4, 9.487729036781154), (6, 2.0)):
        assert sp.mixture_sf(q, np.ones(k)) == pytest.approx(float(sp.chi2_sf(q, k)), abs=2e-4)
    z = np.random.default_rng(1).standard_normal((400_000, 3)) ** 2 @ np.array([3.0, 1.0, 0.2])
    assert sp.mixture_sf(10.0, np.array([3.0, 1.0, 0.2])) == pytest.approx((z > 10).mean(), abs=3e-3)
    assert sp.mixture_sf(10.0, np.array([3.0, 1.0, 0.2])) == pytest.approx((z > 10).mean(), abs=1e-2)


def test_wald_lrt_and_score_agree_in_large_samples():
    g, y, x = data(3000)
    w, l = single.wald(g, y, x), single.lrt(g, y, x)
    assert w["zstat"] ** 2 == pytest.approx(l["chisq"], rel=0.1)
    assert single.saddle_p(g, y, x)[1] == pytest.approx(w["pvalue"], rel=0.8)


def test_logistic_solves_its_equations():
    g, y, x = data()
    b, _, _, ok = single.irls(np.column_stack([x, g]), y)
    mu = 1 / (1 + np.exp(-np.column_stack([x, g]) @ b))
    assert ok and np.abs(np.column_stack([x, g]).T @ (y - mu)).max() < 1e-6


def test_separation():
    g = np.array([0.0] * 8 + [2.0] * 8)
    y, x = (g > 0).astype(float), np.ones((16, 1))
    assert math.isnan(single.wald(g, y, x)["pvalue"])
    f = single.firth_test(g, y, x)
    assert np.isfinite(f["beta"]) and 0 < f["pvalue"] < 0.01


def test_firth_of_a_balanced_table_is_the_half_corrected_log_odds():
    g = np.array([0.0] * 10 + [1.0] * 10)
    y = np.array([1.0] * 3 + [0.0] * 7 + [1.0] * 8 + [0.0] * 2)
    b, _, _ = single.firth(np.column_stack([np.ones(20), g]), y)
    assert b[1] == pytest.approx(math.log((8.5 / 2.5) / (3.5 / 7.5)), abs=1e-4)


def test_saddle_point_against_enumeration():
    n = 12
    g, x = np.array([0.0] * 8 + [1, 1, 2, 2]), np.ones((n, 1))
    y = np.array([0.0] * 8 + [1.0, 0.0, 1.0, 1.0])
    y[0] = 1.0
    p, p_na, _ = single.saddle_p(g, y, x, cutoff=0.1)
    mu = y.mean()
    s = abs((g - g.mean()) @ y)
    total = sum(mu ** sum(v) * (1 - mu) ** (n - sum(v)) for v in itertools.product((0, 1), repeat=n) if abs((g - g.mean()) @ np.array(v) - mu * 0) >= s - 1e-9)
    assert abs(p - total) < 0.08 and 0 < p <= 1
    assert single.saddle_p(2 - g, y, x, cutoff=0.1)[0] == pytest.approx(p, abs=1e-6)  # which allele is counted doesn't matter
    a, b = single.saddle_p(g, y, x, 0.1, True), single.saddle_p(g, y, x, 0.1, False)
    assert a[0] == pytest.approx(b[0], abs=0.05)


def test_exact_regression_equals_closed_form():
    g, _, _ = data()
    y = 0.3 * g + np.random.default_rng(2).standard_normal(len(g))
    r = single.lm(g, y, np.ones((len(g), 1)))
    b = np.cov(g, y)[0, 1] / g.var(ddof=1)
    assert r["beta"] == pytest.approx(b) and r["pvalue"] == pytest.approx(float(sp.t_two_sided(r["tstat"], len(g) - 2)))


def test_em_frequency_of_sharp_calls_is_the_count():
    g = [0, 1, 2, 1, 0, 0]
    lk = np.full((6, 3), 1e-9)
    lk[range(6), g] = 1
    assert single.em_frequency(lk)[0] == pytest.approx(sum(g) / 12, abs=1e-4)


def test_mixed_model_without_relatedness_is_regression():
    r = np.random.default_rng(5)
    n = 80
    y, x = r.standard_normal(n), np.ones((n, 1))
    rot = mixed.reml(mixed.restricted_eigen(np.eye(n), x), y)
    assert np.allclose(rot.values, 1) and rot.vectors.shape == (n, n - 1)
    ty = rot.rotate(y)
    assert ty @ ty * (1 + rot.delta) == pytest.approx(((y - y.mean()) ** 2).sum())


def test_reml_finds_the_simulated_heritability():
    r = np.random.default_rng(7)
    m = r.standard_normal((400, 150))
    k = m @ m.T / 150
    y = mixed.simulate(k, 0.6, 1, seed=3)[:, 0]
    fit = mixed.reml(mixed.restricted_eigen(k, np.ones((400, 1))), y)
    assert 0.35 < fit.vg / (fit.vg + fit.ve) < 0.85
    d, best = np.log10(fit.delta), fit.llk1
    grid = mixed.reml(mixed.restricted_eigen(k, np.ones((400, 1))), y, edge=True)
    assert abs(np.log10(grid.delta) - d) <= 0.1 and best >= grid.llk1 - 1e-9


def test_kernel_p_is_uniform_under_the_null():
    r = np.random.default_rng(11)
    g = r.binomial(2, 0.1, (100, 6)).astype(float)
    c = np.eye(100) - 1 / 100
    for optimal in (False, True):
        ps = []
        for _ in range(60):
            y = c @ r.standard_normal(100)
            ps.append(group.skat_p(g.T @ y, g.T @ c @ g, optimal)[0])
        assert all(0 <= p <= 1 for p in ps) and 0.25 < np.mean(ps) < 0.75
    y = c @ (g.sum(1) + 0.3 * r.standard_normal(100))
    assert group.skat_p(g.T @ y, g.T @ c @ g, True)[0] < 1e-3


def test_kinship_is_a_block_product(spark):
    r = np.random.default_rng(3)
    n, m = 23, 40
    g = r.binomial(2, 0.4, (m, n)).astype(float)
    rows = [(k, list(range(n)), g[k].tolist()) for k in range(m) if 0 < g[k].mean() < 2]
    v = spark.createDataFrame(rows, "marker int, idx array<int>, g array<double>").repartition(3)
    p = g.mean(1, keepdims=True) / 2
    z = ((g - 2 * p) / np.sqrt(2 * p * (1 - p)))[(p[:, 0] > 0) & (p[:, 0] < 1)]
    want = z.T @ z / len(z)
    assert np.allclose(mixed.to_matrix(mixed.merge_kinship(mixed.kinship(v, n, tile=7)), n), want)
    ibs = mixed.to_matrix(mixed.merge_kinship(mixed.kinship(v, n, "ibs", tile=7)), n)
    d = g[(p[:, 0] > 0) & (p[:, 0] < 1)] - 1
    assert np.allclose(ibs, (d.T @ d / len(d) + 1) / 2)
    c = mixed.to_matrix(mixed.merge_kinship(mixed.kinship(v, n), correlation=True), n)
    assert np.allclose(np.diag(c), 1) and np.allclose(c, c.T)


def test_permutations_do_not_depend_on_partitions(spark):
    rows = [(f"g{i % 3}", j, float(((i + 1) * j) % 7), float(1 + (i + j) % 4) if (i + j) % 2 else None) for i in range(3) for j in range(40)]
    d = spark.createDataFrame(rows, "grp string, sample int, y double, min_mac double")
    a = sorted(map(tuple, group.threshold_test(d, most=1000).collect()))
    assert a == sorted(map(tuple, group.threshold_test(d.repartition(4), most=1000).collect())) and all(0 < r[3] <= 1 for r in a)
    best = {r.grp: r.r2 for r in group.best_threshold(group.threshold_scan(d)).collect()}
    assert all(best[r[0]] == pytest.approx(r[2]) for r in a)
