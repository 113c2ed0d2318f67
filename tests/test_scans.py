"""Rank sums, pruning, null minima, permutations and annotation by gene, each against a plain version."""

import itertools
import math

import numpy as np
import pytest

from pyspark.sql import functions as F

from locusmill.functions import special as sp
from locusmill.operators import annotate, enrich, group, ld, ranges, single


def plain_rank_sum(y, carrier):
    """W of the others, and the two-sided p by going through all ways to pick the carriers."""
    order = sorted(range(len(y)), key=lambda i: y[i])
    rank = {i: k + 1 for k, i in enumerate(order)}
    n0 = [i for i in range(len(y)) if not carrier[i]]
    w = sum(rank[i] for i in n0) - len(n0) * (len(n0) + 1) / 2
    ways = [sum(c) - len(n0) * (len(n0) - 1) / 2 for c in itertools.combinations(range(len(y)), len(n0))]
    low, high = np.mean([x <= w for x in ways]), np.mean([x >= w for x in ways])
    return w, min(1.0, 2 * min(low, high))


def test_rank_sum_against_enumeration(spark):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for m in range(12):
        n = int(rng.integers(4, 12))
        g = rng.binomial(2, 0.8 if m % 2 else 0.2, n)
        y = rng.permutation(n) + rng.random()
        flip = 2 - g if g.sum() > n else g
        if 0 < (flip > 0).sum() < n:
            want[m] = plain_rank_sum(y, flip > 0)
        rows += [(m, int(a), float(b)) for a, b in zip(g, y)]
    d = single.flipped(spark.createDataFrame(rows, "marker int, g int, y double"), ["marker"])
    got = {r.marker: r for r in single.with_rank_sum_p(single.rank_sum(d, ["marker"])).collect()}
    assert got.keys() == want.keys() and all(r.exact for r in got.values())
    for m, (w, p) in want.items():
        assert got[m].stat == w and got[m].pvalue == pytest.approx(p, rel=1e-12)


def test_rank_sum_with_ties_and_large_groups():
    # by hand: 60 against 80, no ties, and the tie-corrected variance
    sd = math.sqrt(60 * 80 * 141 / 12)
    assert sp.rank_sum_p(60, 80, 0, 2000)[()] == pytest.approx(math.erfc((400 - 0.5) / sd / math.sqrt(2)), rel=1e-12)
    sd = math.sqrt(6 * 7 / 12 * (14 - 30 / (13 * 12)))
    assert sp.rank_sum_p(6, 7, 30, 30)[()] == pytest.approx(math.erfc((9 - 0.5) / sd / math.sqrt(2)), rel=1e-12)
    assert sp.rank_sum_p(6, 7, 6, 21)[()] == 1.0
    ways = sp._rank_sum_ways(9, 7)
    assert ways.sum() == math.comb(16, 9) and (ways == ways[::-1]).all()


def test_flipped_counts_the_rarer_allele(spark):
    d = spark.createDataFrame([(1, 2), (1, 2), (1, None), (1, 1), (2, 0), (2, 2)], "marker int, g int")
    assert sorted(map(tuple, single.flipped(d, ["marker"]).collect()), key=repr) == sorted([(1, 0), (1, 0), (1, None), (1, 1), (2, 0), (2, 2)], key=repr)


def plain_prune(g, window, max_r2):
    ring, out = [], []
    for k, v in enumerate(g):
        v = v - v.mean()
        if v @ v < 1e-9:
            continue
        v = v / np.sqrt(v @ v)
        near = [u for u in ring[-(window - 1) :] if u is not None] if window > 1 else []
        stays = all((v @ u) ** 2 < max_r2 for u in near)
        ring.append(v if stays else None)
        if stays:
            out.append(k)
    return out


@pytest.mark.parametrize("window", [1, 2, 4, 30])
def test_pruning_looks_at_candidates(spark, window):
    rng = np.random.default_rng(2)
    g = [rng.binomial(2, 0.4, 40).astype(float)]
    for _ in range(59):
        g.append(np.where(rng.random(40) < 0.3, rng.binomial(2, 0.4, 40), g[-1]).astype(float))
    g[7] = np.zeros(40)
    d = spark.createDataFrame([("1", k, k, list(range(40)), v.tolist()) for k, v in enumerate(g)], "contig string, pos long, marker long, idx array<int>, g array<double>")
    assert sorted(r.marker for r in ld.prune(d, 40, window, 0.3).collect()) == plain_prune(g, window, 0.3)


def test_null_minima_against_all_draws(spark):
    genes, bins = ["a", "b", "c"], {("1", 0): {"a": 0.01, "b": 0.2}, ("1", 1): {"a": 0.3, "c": 0.011, "b": 0.5}, ("2", 0): {"c": 0.04}}
    rows = [(g, "bin", c, b, p) for (c, b), ps in bins.items() for g, p in ps.items()]
    rows += [("a", "cis", None, None, 0.02), ("a", "trans", None, None, 0.01), ("b", "trans", None, None, 0.2), ("c", "trans", None, None, 0.011)]
    minima = spark.createDataFrame(rows, "gene string, kind string, contig string, bin long, p double")
    # every way to draw a gene for each bin
    draws = [min(ps.get(g, 1.0) for g, ps in zip(pick, bins.values())) for pick in itertools.product(genes, repeat=3)]
    got = {float(r.pvalue): r.chance for r in enrich.null_minima(minima.where("kind = 'bin'"), 3).collect()}
    assert got == pytest.approx({k: np.mean([d <= k + 1e-12 for d in draws]) for k in (0.01, 0.2, 0.3, 0.011, 0.5, 0.04)})
    fdr = {float(r.pvalue): r for r in enrich.approximate_fdr(minima, 3).collect()}
    for k, r in fdr.items():
        assert r.fdr == pytest.approx((30 * np.mean([d <= k + 1e-12 for d in draws]) + 1) / 31)
        assert r.n_cis == (k >= 0.02) + 2 * (k >= 1) and r.n_trans == (k >= 0.01) + (k >= 0.011) + (k >= 0.2)
    assert fdr[0.02].fdr == fdr[0.011].fdr  # no null value in between


def test_permutations_dont_depend_on_blocks(spark):
    rng = np.random.default_rng(3)
    rows = [(f"g{k}", i, float(rng.standard_normal() + (2.5 if k == 0 and i < 12 else 0)), None if i >= 12 else int(rng.integers(1, 4))) for k in range(3) for i in range(60)]
    d = spark.createDataFrame(rows, "grp string, sample int, y double, min_mac int")
    one, many = (sorted(map(tuple, group.threshold_test(x, most=20_000, blocks=b).collect())) for x, b in ((d, 1), (d.repartition(5), 64)))
    assert one == many
    strong = one[0]
    assert strong[4] == 20_000 and strong[3] < 0.001 and all(r[4] < 20_000 for r in one[1:])
    flat = spark.createDataFrame([("g", i, 1.0, None) for i in range(5)], "grp string, sample int, y double, min_mac int")
    assert tuple(group.threshold_test(flat).first()) == ("g", 5, None, None, 0)


def test_each_gene_has_its_own_codon(spark):
    """One base in two genes, one on each strand: TAC -> TAA is a stop forwards, the reverse reads GTA -> TTA."""
    exons = "array<struct<beg:long,end:long>>"
    genes = spark.createDataFrame(
        [("P", "P.1", "1", 101, 112, 101, 112, [(101, 112)], "+"), ("P", "P.2", "1", 101, 112, 101, 112, [(101, 106), (107, 112)], "+"), ("M", "M.1", "1", 98, 115, 101, 112, [(98, 115)], "-")],
        f"gene string, transcript string, contig string, tx_start long, tx_end long, cds_start long, cds_end long, exons {exons}, strand string",
    )
    ref = dict(zip(range(95, 120), "CCCCCC" + "ATGTACGGATGA" + "CCCCCCC"))
    bases = spark.createDataFrame([("1", p, b) for p, b in ref.items()], "contig string, pos long, base string")
    v = spark.createDataFrame([(1, "1", 106, "C", "A"), (2, "1", 109, "A", "T"), (3, "1", 101, "A", "G"), (4, "1", 112, "A", "C"), (5, "1", 109, "A", "<DEL>")], "marker int, contig string, pos long, ref string, alt string")
    rows = annotate.annotate(v, genes, 2, bases=bases).collect()
    got = {(r.marker, r.transcript): (r.type, r.detail) for r in rows if r.detail}
    # + : ATG TAC GGA TGA; - (reverse complement): TCA TCC GTA CAT
    assert got[1, "P.1"] == got[1, "P.2"] == ("Stop_Gain", "TAC->TAA:Y2*") and got[1, "M.1"] == ("Nonsynonymous", "GTA->TTA:V3L")
    assert got[2, "P.1"] == ("Synonymous", "GGA->GGT:G3G") and got[2, "M.1"] == ("Nonsynonymous", "TCC->ACC:S2T")
    assert got[3, "P.1"] == ("Start_Loss", "ATG->GTG:M1V") and got[3, "M.1"] == ("Nonsynonymous", "CAT->CAC:H4H") or got[3, "M.1"] == ("Synonymous", "CAT->CAC:H4H")
    assert got[4, "P.1"] == ("Stop_Loss", "TGA->TGC:*4C") and got[4, "M.1"] == ("Nonsynonymous", "TCA->GCA:S1A")
    assert (5, "P.1") not in got and sum(r.type == "StructuralVariation" for r in rows if r.marker == 5) == 3
    top = {r.marker: r for r in annotate.top_annotation(annotate.annotate(v, genes, 2, bases=bases)).collect()}
    assert top[1].anno == "Stop_Gain:P" and top[2].anno == "Nonsynonymous:M"
    parts = top[1].by_transcript.split("|")
    # equal types: more exons first
    assert [p.split(":")[0] for p in parts] == ["P/P.2", "P/P.1", "M/M.1"] and parts[2].startswith("M/M.1:-:Nonsynonymous(GTA->TTA:V3L)")
    same = annotate.annotate(annotate.with_codons(v, genes.where("transcript <> 'P.2'"), bases), genes.where("transcript <> 'P.2'"), 2)
    assert {(r.marker, r.gene, r.type) for r in same.collect() if r.marker == 1} == {(1, "P", "Stop_Gain"), (1, "M", "Nonsynonymous")} | {(1, r.gene, r.type) for r in rows if r.marker == 1 and not r.detail and r.transcript != "P.2"}


@pytest.mark.parametrize("window,tile,block", [(7, 1024, 32_768), (7, 3, 11), (30, 8, 9), (1, 4, 50)])
def test_pairwise_ld_for_any_tiles_and_blocks(spark, window, tile, block):
    rng = np.random.default_rng(6)
    g = rng.binomial(2, 0.4, (35, 26)).astype(float)
    g[rng.random(g.shape) < 0.15] = np.nan
    g[:, 4] = 1.0
    contig = ["1"] * 20 + ["2"] * 6
    calls = spark.createDataFrame([(f"m{j}", i, None if np.isnan(g[i, j]) else float(g[i, j])) for j in range(26) for i in range(35)], "marker string, sample long, g double")
    order = spark.createDataFrame([(c, 10 * (40 - j), f"m{j}") for j, c in enumerate(contig)], "contig string, pos long, marker string")
    want = {}
    for a, b in itertools.combinations(range(25, -1, -1), 2):  # positions fall with the number
        ok = ~np.isnan(g[:, a]) & ~np.isnan(g[:, b])
        if contig[a] == contig[b] and a - b <= window and np.ptp(g[ok, a]) and np.ptp(g[ok, b]):
            want[f"m{a}", f"m{b}"] = (ok.sum(), np.corrcoef(g[ok, a], g[ok, b])[0, 1])
    got = {(r.m1, r.m2): (r.n, r.r) for r in ld.pair_ld(calls, order, window, tile=tile, block=block).collect()}
    assert got.keys() == want.keys()
    for k, (n, r) in want.items():
        assert got[k][0] == n and got[k][1] == pytest.approx(r, abs=1e-9)


@pytest.mark.parametrize("n", [1, 2, 3, 17, 100, 101])
def test_best_paths_in_stretches_are_whole_ones(n):
    rng = np.random.default_rng(n)
    l = rng.dirichlet([0.3] * 3, (5, n))
    l[1, n // 3 :] = l[0, n // 3 :]
    pos, af = np.cumsum(rng.integers(1, 1000, n)).astype(float), rng.uniform(0.1, 0.9, n)
    i, j = np.triu_indices(5, 1)
    joint, step = ld._joint(af), np.log(np.clip((np.diff(pos) + 0.01) * 1e-4, 1e-12, 0.3))
    for a, b, got in zip(i, j, ld._segments(l, i, j, pos, af, 1e-4)):
        e = np.log(np.einsum("msab,ma,mb->ms", joint, l[a], l[b]) + 1e-300)
        score, back = np.log([0.949, 0.05, 0.001]) + e[0], []
        for t in range(1, n):
            move = np.full((3, 3), step[t - 1])
            np.fill_diagonal(move, np.log1p(-2 * np.exp(step[t - 1])))
            back.append((score[:, None] + move).argmax(0))
            score = (score[:, None] + move).max(0) + e[t]
        path = [int(score.argmax())]
        for c in reversed(back):
            path.append(int(c[path[-1]]))
        runs = [(s, [k for k, _ in g]) for s, g in itertools.groupby(enumerate(path[::-1]), key=lambda x: x[1])]
        assert got == [(int(pos[ks[0]]), int(pos[ks[-1]]), s) for s, ks in runs]


@pytest.mark.parametrize("stretch", [3, 17, 10**9])
def test_scans_are_the_same_for_any_stretches(spark, stretch):
    rng = np.random.default_rng(8)
    spans = [(c, int(a), int(a + rng.integers(0, 12))) for c in "12" for a in rng.integers(0, 400, 60)] + [("1", 90, 200), ("3", 5, 5)]
    want = []
    for c in "123":
        for a, b in sorted((a, b) for x, a, b in spans if x == c):
            if want and want[-1][0] == c and a <= want[-1][2]:
                want[-1][2], want[-1][3] = max(want[-1][2], b), want[-1][3] + 1
            else:
                want.append([c, a, b, 1])
    got = ranges.merge_intervals(spark.createDataFrame(spans, "contig string, beg long, end long"), stretch=stretch).collect()
    assert sorted(map(list, got)) == want
    knots = [(c, int(x), float(v)) for c in "12" for x, v in zip(np.sort(rng.choice(300, 15, False)), np.cumsum(rng.random(15)))]
    points = [(k, c, int(x)) for k, (c, x) in enumerate((c, x) for c in "123" for x in rng.integers(0, 320, 40))]
    out = {r.id: r.cm for r in ranges.interpolate(spark.createDataFrame(points, "id int, contig string, pos long"), spark.createDataFrame(knots, "contig string, at long, cm double"), stretch=stretch).collect()}
    for k, c, x in points:
        mine = [(a, v) for d, a, v in knots if d == c]
        low = [m for m in mine if m[0] <= x]
        assert (out[k] is None) if not low else out[k] == pytest.approx(np.interp(x, *zip(*mine)))


def test_burden_counts_equal_samples(spark):
    """The Wald test of a group from counts is that from its samples, and a group of many samples reaches Python as a few rows."""
    rng = np.random.default_rng(5)
    rows = [(f"G{k % 3}", int(rng.binomial(3, 0.2)), int(rng.random() < 0.4), int(rng.integers(0, 5)) if k % 50 else None) for k in range(3000)]
    c = spark.createDataFrame(rows + [("G9", 0, 1, 2)] * 9, "grp string, g int, status int, x1 int")
    a = {r.grp: r for r in single.run_test(c, "b.wald", ["grp"], "status", ("x1",)).collect()}
    b = {r.grp: r for r in single.counted_wald(c, ["grp"], "status", ("x1",)).collect()}
    assert a.keys() == b.keys() == {"G0", "G1", "G2", "G9"} and b["G9"].beta is None
    for k in ("G0", "G1", "G2"):
        assert b[k].ns == a[k].ns and [*b[k]][2:] == pytest.approx([*a[k]][2:], rel=1e-7)
    col = c.where("x1 is not null").withColumn("sample", F.monotonically_increasing_id())
    d = group.burden_test(col.select("grp", "sample", F.col("g").alias("burden"), "g", F.lit(1).alias("carrier"), F.lit(1.0).alias("weighted")), col.select("sample", "status", "x1"), "b.burden", "status", ("x1",))
    assert "_n" in d._jdf.queryExecution().analyzed().toString()
    assert {r.grp: r.ns for r in d.collect()} == {k: r.ns for k, r in b.items()}


def test_permutations_of_large_groups_are_those_of_the_dense_form(spark, monkeypatch):
    """Sums by label give the ranks that the matrix of thresholds and samples gives, drawn a few permutations at a time; blocks carry no more copies of a group than allowed."""
    rng = np.random.default_rng(8)
    n = 30_000  # fewer than SEEDED permutations at a time
    mac, y = rng.integers(1, 9, n), rng.standard_normal(n)
    y = y + 0.008 * (mac <= 3)
    d = spark.createDataFrame([("g", k, float(v), int(m) if m < 7 else None) for k, (m, v) in enumerate(zip(mac, y))], "grp string, sample int, y double, min_mac int").repartition(3)
    c = np.array([mac <= t for t in range(1, 7)], float)
    c -= c.mean(1, keepdims=True)
    c /= np.sqrt((c * c).sum(1))[:, None]
    v = (y - y.mean()) / np.sqrt(((y - y.mean()) ** 2).sum())
    have = ((c @ v) ** 2).max()
    rank = sum(int((((c @ np.random.default_rng([1, k, *b"g"]).permuted(np.tile(v, (100, 1)), axis=1).T) ** 2).max(0) >= have - 1e-12).sum()) for k in range(1))
    got = group.threshold_test(d, most=100).first()
    assert (got.ns, got.permutations) == (n, 100) and got.r2 == pytest.approx(have, rel=1e-9) and got.pvalue == pytest.approx((rank + 1) / 101)
    monkeypatch.setattr(group, "MOST_COPIED", n)
    assert group.threshold_test(d, most=1000, least=10_000).first().r2 == pytest.approx(have, rel=1e-9)
