import pytest
from pyspark.sql import functions as F

from locusmill import model
from locusmill.functions import genotype, rules
from locusmill.operators import annotate, enrich, ld, qc, ranges, report, single


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first().v


def test_rules(spark):
    info = F.lit("AC=1;AAAB;DP=9")
    for text, want in (("AAB", True), ("AC && ! DP", False), ("( AC && ! XX ) || YY", True), ("XX || AC && YY", False), ("! ( XX || YY )", True), ("AC && DP=9", True)):
        assert one(spark, rules.rule(text, info)) is want
    assert one(spark, rules.rule("A", F.lit(None).cast("string"))) is False
    for bad in ("", "A &&", "( A", "A B", "&& A"):
        with pytest.raises(ValueError):
            rules.rule(bad, info)


def test_genotypes(spark):
    cases = {"0/1": 1.0, "1|1": 2.0, "0|0": 0.0, "./.": None, "1/.": None, ".": None, "0/1:9": 1.0}
    for text, want in cases.items():
        assert one(spark, genotype.decode_gt(F.lit(text))) == want
    assert [one(spark, genotype.phase_of(F.lit(t))) for t in ("0/1", "1|1", "0|1", "1|0", "./.")] == [0, 1, 2, 3, 0]
    g = F.array(*[F.lit(x).cast("double") for x in (0, 1, 2, 2, 2, None)])
    s = genotype.marker_stats(g)
    assert one(spark, s["ns"]) == 5 and one(spark, s["ac"]) == 7 and one(spark, s["maf"]) == pytest.approx(0.3) and one(spark, s["hom_minor"]) == 1 and one(spark, s["mac"]) == 3
    assert one(spark, genotype.flip_to_minor(g)) == [2, 1, 0, 0, 0, None]
    assert one(spark, genotype.impute_mean(g))[5] == pytest.approx(1.4)
    pl = F.array(F.lit(0), F.lit(30), F.lit(300))
    assert one(spark, genotype.likelihoods(pl)) == pytest.approx([0.75, 1e-3, 10**-25.5])
    assert one(spark, genotype.likelihoods(pl, False))[0] == 1.0
    assert 0 < one(spark, genotype.posterior_dosage(pl, F.lit(0.2))) < 0.01
    assert [one(spark, genotype.substitution_class(F.lit(a), F.lit(b))) for a, b in ("AG", "CA", ("A", "AT"))] == ["ts", "tv", "other"]


def test_marker_names(spark):
    p = one(spark, model.parse_marker_id(F.lit("chr20:100-102_GAT/A_rs1_MISS")))
    assert (p.contig, p.beg, p.end, p.ref, p.alt, p.rest) == ("20", 100, 102, "GAT", "A", "rs1_MISS")
    assert one(spark, model.marker_id(F.lit("20"), F.lit(100), F.lit("GAT"), F.lit("A"))) == "20:100-102_GAT/A"
    assert one(spark, model.contig_number(F.lit("chrX"))) == 23 and one(spark, model.linear_position(F.lit("2"), F.lit(5))) == 249250626


def test_interval_edges(spark):
    p = spark.createDataFrame([("1", x) for x in (10, 11, 20, 21, 30)], "contig string, pos long")
    s = spark.createDataFrame([("1", 10, 20, "a"), ("1", 21, 25, "b"), ("1", 12, 15, "n"), ("2", 1, 99, "z")], "contig string, beg long, end long, label string")
    got = lambda **k: sorted((r.pos, r.label) for r in ranges.range_join(p, s, bin_size=7, **k).collect())
    assert got() == [(10, "a"), (11, "a"), (20, "a"), (21, "b")]
    assert got(open_left=True) == [(11, "a"), (20, "a")]
    assert sorted(r.pos for r in ranges.range_join(p, s, bin_size=7, how="left_anti").collect()) == [30]
    m = sorted((r.contig, r.beg, r.end, r.n) for r in ranges.merge_intervals(s).collect())
    assert m == [("1", 10, 20, 2), ("1", 21, 25, 1), ("2", 1, 99, 1)]  # neighbours don't overlap
    o = ranges.overlap_join(s, s.toDF("contig", "b2", "e2", "l2"), "contig", "beg", "end", "b2", "e2", 5)
    assert sorted((r.label, r.l2) for r in o.collect()) == [("a", "a"), ("a", "n"), ("b", "b"), ("n", "a"), ("n", "n"), ("z", "z")]
    assert ranges.range_join(p.limit(0), s).count() == 0


def test_clumps(spark):
    d = spark.createDataFrame([("1", 100, 1e-6), ("1", 150, 1e-9), ("1", 240, 1e-7), ("1", 1000, 1e-6), ("1", 1001, 0.5), ("2", 5, 1e-8)], "contig string, pos long, p double")
    key = lambda x: sorted((r.contig, r.pos) for r in x.collect())
    assert key(ranges.peaks_by_gap(d, "contig", "pos", "p", 100)) == [("1", 150), ("1", 1000), ("2", 5)]
    assert key(ranges.peaks_in_sequence(d, "contig", "pos", "p", 95)) == [("1", 150), ("1", 1000), ("2", 5)]
    assert key(ranges.peaks_in_sequence(d, "contig", "pos", "p", 60)) == [("1", 150), ("1", 240), ("1", 1000), ("2", 5)]


def test_interpolation(spark):
    t = spark.createDataFrame([("1", 10, 0.0), ("1", 20, 5.0), ("1", 30, 6.0)], "contig string, at long, cm double")
    p = spark.createDataFrame([("1", x) for x in (5, 10, 14, 20, 25, 40)], "contig string, pos long")
    assert [r.cm for r in ranges.interpolate(p, t).orderBy("pos").collect()] == [None, 0.0, 2.0, 5.0, 5.5, 6.0]


def test_repeated_ids_are_an_error(spark):
    a = spark.createDataFrame([(1, 2.0), (1, 3.0)], "ind_id int, y double")
    with pytest.raises(Exception, match="repeated id"):
        qc.join_ids(a, spark.createDataFrame([(1,)], "ind_id int")).collect()


def test_regions(spark):
    d = spark.createDataFrame([("20", 5), ("20", 50), ("X", 7)], "contig string, beg long")
    n = lambda r: [x.beg for x in qc.in_region(d, r).collect()]
    assert n("20") == [5, 50] and n("20:6") == [50] and n("20:1-5") == [5] and n("21") == []
    assert qc.autosomes_only(d).count() == 2


def gene(spark, strand):
    return spark.createDataFrame([("G", "1", 100, 400, 150, 350, [(100, 200), (300, 400)], strand)], "gene string, contig string, tx_start long, tx_end long, cds_start long, cds_end long, exons array<struct<beg:long,end:long>>, strand string")


def test_gene_regions_on_both_strands(spark):
    at = [90, 120, 160, 199, 201, 205, 220, 250, 295, 310, 380, 420, 900]
    for strand, up, five, three, down in (("+", "Upstream", "Utr5", "Utr3", "Downstream"), ("-", "Downstream", "Utr3", "Utr5", "Upstream")):
        v = spark.createDataFrame([(p, "1", p, "A", "G", "AAA", "TAA") for p in at], "marker long, contig string, pos long, ref string, alt string, codon string, codon_alt string")
        got = {}
        for r in annotate.annotate(v, gene(spark, strand)).collect():
            got.setdefault(r.pos, set()).add(r.type)
        assert got[90] == {up} and got[120] == {five} and got[160] == {"Stop_Gain"} and got[199] == {"Stop_Gain", "Normal_Splice_Site"} and got[201] == {"Intron", "Essential_Splice_Site"}
        assert got[205] == {"Intron", "Normal_Splice_Site"} and got[220] == got[250] == {"Intron"} and got[295] == {"Intron", "Normal_Splice_Site"} and got[310] == {"Stop_Gain"} and got[380] == {three} and got[420] == {down} and got[900] == {"Intergenic"}
        off = {r.pos: r.o for r in v.crossJoin(annotate.derive_parts(gene(spark, strand)).drop("contig")).select("pos", annotate.coding_offset(F.col("pos")).alias("o")).collect()}
        assert (off[160], off[310]) == ((10, 61) if strand == "+" else (91, 40)) and off[250] is None


def test_indels_and_types(spark):
    for r, a, t in (("A", "G", "SNP"), ("A", "AT", "INS"), ("AT", "A", "DEL"), ("A", "<DEL>", "SV"), ("A", "G,T", "MIXED"), ("A", ".", "MONO"), ("AT", "GC", "UNKNOWN")):
        assert one(spark, annotate.variant_type(F.lit(r), F.lit(a))) == t
    v = spark.createDataFrame([(1, "1", 160, "A", "ATGC"), (2, "1", 160, "A", "AT"), (3, "1", 160, "ATGC", "A"), (4, "1", 160, "AT", "A"), (5, "1", 160, "A", "."), (6, "1", 160, "A", "<X>")], "marker long, contig string, pos long, ref string, alt string")
    got = {}
    for r in annotate.annotate(v, gene(spark, "+")).collect():
        got.setdefault(r.marker, set()).add(r.type)
    assert got == {1: {"CodonGain"}, 2: {"Frameshift"}, 3: {"CodonLoss"}, 4: {"Frameshift"}, 5: {"Monomorphic"}, 6: {"StructuralVariation", "CodonRegion"}}
    top = annotate.top_annotation(spark.createDataFrame([(1, "A", "Intron"), (1, "B", "Stop_Gain"), (1, "C", "Stop_Gain")], "marker int, gene string, type string")).first()
    assert (top.anno, top.annofull) == ("Stop_Gain:B|C", "Stop_Gain:B|C,Intron:A")
    assert one(spark, annotate.reverse_complement(F.lit("aacG"))) == "CGTT"
    assert [one(spark, annotate.consequence(F.lit(a), F.lit(b), F.lit(n))) for a, b, n in (("TAA", "CAA", 5), ("ATG", "ACG", 1), ("ACG", "ATG", 1), ("AAA", "AAG", 2), ("AAA", "ACA", 2), ("NNN", "AAA", 2))] == ["Stop_Loss", "Start_Loss", "Start_Gain", "Synonymous", "Nonsynonymous", "SNV"]
    assert annotate.codon_table(spark).count() == 64


def test_pruning_and_sharing(spark):
    rows = [("1", 1, 1, [0, 1, 2, 3], [0.0, 1.0, 2.0, 0.0]), ("1", 2, 2, [0, 1, 2, 3], [0.0, 1.0, 2.0, 0.0]), ("1", 3, 3, [0, 1, 2, 3], [2.0, 0.0, 0.0, 1.0]), ("2", 1, 4, [0, 1, 2, 3], [0.0, 1.0, 2.0, 0.0])]
    v = spark.createDataFrame(rows, "contig string, pos long, marker int, idx array<int>, g array<double>")
    assert sorted(r.marker for r in ld.prune(v, 4, 10, 0.9).collect()) == [1, 3, 4]
    s = spark.createDataFrame([(1, 2, 10, 20, 1), (1, 3, 15, 30, 2), (1, 4, 1, 5, 0)], "i int, j int, beg long, end long, state int")
    assert [tuple(r) for r in ld.sharing_blocks(s).where("sample = 1").orderBy("beg").collect()] == [(1, 10, 14, 1), (1, 15, 20, 2), (1, 21, 30, 1)]
    assert {(r.i, r.j): r.shared for r in ld.sharing_graph(s).collect()} == {(1, 2): 5.5, (1, 3): 16.0}


def test_identical_samples_share_both_alleles(spark):
    af = [0.3] * 200
    calls = [(i * 7) % 3 for i in range(200)]
    other = [(i * 7 + 2) % 3 for i in range(200)]
    lk = lambda g: [[0.98 if k == c else 0.01 for k in range(3)] for c in g]
    likes = spark.createDataFrame([(1, lk(calls)), (2, lk(calls)), (3, lk(other))], "sample int, l array<array<double>>")
    m = spark.createDataFrame([(i * 1000, a) for i, a in enumerate(af)], "pos long, af double")
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "i int, j int")
    got = {}
    for r in ld.pair_states(likes, m, pairs, 1e-6).collect():
        got.setdefault((r.i, r.j), []).append((r.state, r.end - r.beg))
    assert max(got[1, 2], key=lambda x: x[1])[0] == 2 and max(got[1, 3], key=lambda x: x[1])[0] == 0


def test_posteriors_sum_to_one(spark):
    z = spark.createDataFrame([("1", i * 1000, float(i % 7)) for i in range(50)], "contig string, pos long, z double")
    assert enrich.posterior_weights(z).agg(F.sum("share")).first()[0] == pytest.approx(1)
    assert enrich.shifts(5, 100) == enrich.shifts(5, 100) and enrich.shifts(3, 10)[0] == 0


def test_gene_packing(spark):
    g = spark.createDataFrame([("a", "1", 1, 10), ("b", "1", 5, 20), ("c", "1", 12, 15), ("d", "2", 1, 2)], "gene string, contig string, tx_start long, tx_end long")
    assert {r.gene: r.row for r in report.gene_rows(g).collect()} == {"a": 0, "b": 1, "c": 0, "d": 0}


def test_fixed_order_of_types(spark):
    # highest first, as documented for the annotation types
    assert annotate.PRIORITY[:15] == ["StructuralVariation", "Stop_Gain", "Stop_Loss", "Start_Gain", "Start_Loss", "Frameshift", "CodonGain", "CodonLoss", "CodonRegion", "Insertion", "Deletion", "Nonsynonymous", "Synonymous", "Essential_Splice_Site", "Normal_Splice_Site"]
    assert annotate.PRIORITY[15:24] == ["Utr5", "Utr3", "Exon", "Intron", "Upstream", "Downstream", "SNV", "Noncoding", "Intergenic"]
    a = spark.createDataFrame([(1, "G1", "Synonymous"), (1, "G2", "Insertion"), (1, "G3", "Insertion"), (2, "G1", "Normal_Splice_Site"), (2, "G1", "Nonsynonymous"), (3, "", "Intergenic")], "marker int, gene string, type string")
    got = {r.marker: (r.anno, r.annofull) for r in annotate.top_annotation(a).collect()}
    assert got == {1: ("Insertion:G2|G3", "Insertion:G2|G3,Synonymous:G1"), 2: ("Nonsynonymous:G1", "Nonsynonymous:G1,Normal_Splice_Site:G1"), 3: ("Intergenic", "Intergenic")}


def test_groups_by_preset(spark):
    rows = [(1, "1", 5, "ANNO=Nonsynonymous:G1"), (2, "1", 6, "ANNO=Synonymous:G1"), (3, "1", 7, "ANNO=Stop_Gain:G1|G2"), (4, "1", 8, "ANNO=Frameshift:G1"), (5, "1", 9, "ANNO=Normal_Splice_Site:G2")]
    d = spark.createDataFrame(rows, "marker int, contig string, pos int, info string")
    assert {r.grp: r.markers for r in annotate.make_groups(d).collect()} == {"G1": "1 3", "G2": "3 5"}
    typed = spark.createDataFrame([(1, "1", 5, ";TYPE=MISSENSE;GENE=A"), (2, "1", 5, ";TYPE=SYNONYMOUS;GENE=A")], "marker int, contig string, pos int, info string")
    assert [r.markers for r in annotate.make_groups(typed, form="typed").collect()] == ["1"]


def test_codons_of_both_strands(spark):
    bases = "CCATGAAACCCGGGTAACC"  # ATG AAA | CCC GGG TAA in two exons from the third base on
    b = spark.createDataFrame([("1", i + 1, c) for i, c in enumerate(bases)], "contig string, pos long, base string")
    exons = [{"beg": 3, "end": 8}, {"beg": 9, "end": 17}]
    g = spark.createDataFrame([("P", "1", 3, 17, 3, 17, exons, "+"), ("M", "1", 3, 17, 3, 17, exons, "-")], "gene string, contig string, tx_start long, tx_end long, cds_start long, cds_end long, exons array<struct<beg:long,end:long>>, strand string")
    v = spark.createDataFrame([(1, "1", 6, "A", "T"), (2, "1", 17, "A", "C"), (3, "1", 1, "C", "T"), (4, "1", 6, "AA", "A")], "marker int, contig string, pos long, ref string, alt string")
    got = {(r.marker, r.gene): (r.codon, r.codon_alt) for r in annotate.with_codons(v, g, b).collect()}
    assert got == {(1, "P"): ("AAA", "TAA"), (1, "M"): ("TTT", "TTA"), (2, "P"): ("TAA", "TAC"), (2, "M"): ("TTA", "GTA"), (3, None): (None, None), (4, None): (None, None)}


def test_annotated_lines(spark):
    d = spark.createDataFrame([("1", "5", "x", "1:5_A/C_old", "C", ".", "PASS", "AC=1", "S:G", "S:G,T:H")], "a string, b string, c string, d string, e string, f string, g string, h string, anno string, annofull string")
    line = lambda form: annotate.annotated_lines(d, form, list("abcdefgh")).first().line.split("\t")
    assert line("vcf")[7] == "AC=1;ANNO=S:G;ANNOFULL=S:G,T:H" and line("plain")[8:] == ["S:G", "S:G,T:H"] and line("results")[3] == "1:5_A/C_S:G"
    with pytest.raises(ValueError):
        line("other")


def test_frequencies_split_at_a_twentieth(spark):
    m = spark.createDataFrame([(1, "ts", 0.005, 1.0), (2, "tv", 0.01, 2.0), (3, "ts", 0.03, 9.0), (4, "tv", 0.05, 9.0), (5, "ts", 0.051, 9.0)], "marker int, class string, maf double, mac double")
    c = spark.createDataFrame([(k, 1, 1.0) for k in range(1, 6)], "marker int, sample int, g double")
    r = qc.sample_summary(c, m).first()
    assert (r.af_lt1, r.af_1to5, r.af_gt5, r.singletons, r.doubletons) == (1, 3, 1, 1, 1)


def test_shifts_by_running_sums(spark):
    import random

    r = random.Random(5)
    length, scores = 1000, [(str(r.randrange(1, 3)), r.randrange(0, 1000), float(r.randrange(9))) for _ in range(200)]
    regions = [(r.choice("ab"), str(r.randrange(1, 3)), x, x + r.randrange(1, 120)) for x in (r.randrange(-20, 990) for _ in range(14))]
    offsets = [0, 17, -430, 999, 500, 3]
    s = spark.createDataFrame(scores, "contig string, pos long, score double")
    g = spark.createDataFrame(regions, "key string, contig string, beg long, end long")
    got = {x.key: x for x in enrich.peak_shift(s, g, length, offsets, bin_size=64).collect()}
    for key in "ab":
        sums = [sum(v for c, p, v in scores if any(k == key and c == d and a <= (p + o) % length <= b for k, d, a, b in regions)) for o in offsets]
        above, same = sum(x > sums[0] for x in sums[1:]), sum(x == sums[0] for x in sums[1:])
        assert got[key].score == sums[0] and got[key].midp == pytest.approx((above + 0.5 * same + 0.5) / 6) and got[key].maxp == pytest.approx((above + same + 1) / 6)


def test_all_pairs_as_one_by_one(spark):
    import random

    r, m = random.Random(2), 40
    af = [0.1 + 0.02 * (k % 20) for k in range(m)]
    lk = {i: [[r.random() + 0.01 for _ in range(3)] for _ in range(m)] for i in range(7)}
    lk[6] = lk[2]
    long = [("1", i, k * 1000, lk[i][k]) for i in lk for k in range(m) if (i, k) != (1, 3)]
    likes = spark.createDataFrame(long, "contig string, sample int, pos long, l array<double>")
    line = spark.createDataFrame([("1", k * 1000, a) for k, a in enumerate(af)], "contig string, pos long, af double")
    lk[1][3] = [1 / 3] * 3
    one = ld.pair_states(spark.createDataFrame(list(lk.items()), "sample int, l array<array<double>>"), line.drop("contig"), spark.createDataFrame([(i, j) for i in range(7) for j in range(i + 1, 7)], "i int, j int"), 1e-4)
    want = sorted(map(tuple, one.collect()))
    for block in (2, 100):
        assert sorted(tuple(x)[1:] for x in ld.all_pair_states(likes, line, 1e-4, block).collect()) == want


def test_conditions_and_cuts(spark):
    c = spark.createDataFrame([(1, 1, 2.0), (1, 2, None), (1, 3, 1.0), (2, 1, 0.0), (3, 1, None)], "marker int, sample int, g double")
    s, names = single.with_conditions(spark.createDataFrame([(1,), (2,), (4,)], "sample int"), c, [1, 3])
    assert names == ["cond0"] and {x.sample: x.cond0 for x in s.collect()} == {1: 2.0, 2: 1.5, 4: 1.5}
    d = spark.createDataFrame([(1, 0.01, 3.0), (2, 0.2, None), (3, None, 1.0)], "k int, pvalue double, score double")
    assert [x.k for x in report.significant(d, 0.05).collect()] == [1] and [x.k for x in report.scored(d, 2.0).collect()] == [1]


def test_each_trait_has_its_own_ratio(spark):
    import numpy as np

    from locusmill.operators import mixed

    rng, n = np.random.default_rng(1), 40
    z = rng.standard_normal((n, 60))
    k = z @ z.T / 60
    y = np.column_stack([np.linalg.cholesky(k + 1e-6 * np.eye(n)) @ rng.standard_normal(n) * 3 + rng.standard_normal(n), rng.standard_normal(n)])
    rot = mixed.restricted_eigen(k, np.ones((n, 1)))
    fits = mixed.reml_traits(rot, y)
    assert fits[0].delta != fits[1].delta
    v = spark.createDataFrame([(m, list(range(n)), [float(x) for x in rng.integers(0, 3, n)]) for m in range(5)], "marker int, idx array<int>, g array<double>")
    both = {(r.marker, r.trait): r.stat for r in mixed.mixed_scan(v, fits, y, ["marker"]).collect()}
    for t in (0, 1):
        for r in mixed.mixed_scan(v, fits[t], y[:, t], ["marker"]).collect():
            assert both[r.marker, t] == pytest.approx(r.stat)


def test_mixed_groups_without_kinship_are_plain(spark):
    import numpy as np

    from locusmill.operators import group, mixed

    rng, n = np.random.default_rng(3), 60
    y = rng.standard_normal(n)
    rot = mixed.restricted_eigen(np.zeros((n, n)), np.ones((n, 1)))
    rot.delta = 1.0
    carrier = rng.integers(0, 2, n)
    y += carrier
    c = spark.createDataFrame([("A", i, int(carrier[i]), float(carrier[i] and 1 + i % 3) or None) for i in range(n)], "grp string, sample int, carrier int, min_mac double")
    got = group.mixed_burden(c, {i: i for i in range(n)}, rot, y).first()
    assert got.carriers == carrier.sum() and got.r2 == pytest.approx(np.corrcoef(carrier, y)[0, 1] ** 2, rel=0.05)
    v = group.threshold_test(c.join(spark.createDataFrame(list(enumerate(map(float, y))), "sample int, y double"), "sample"), rotation=rot, order={i: i for i in range(n)}, most=100).first()
    assert v.ns == n and 0 < v.pvalue <= 1 and v.r2 >= got.r2 * 0.9


def test_covariate_scan_from_sums(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    rows = []
    for m in range(6):
        for i in range(12 if m else 3):
            rows.append((m, None if rng.random() < 0.1 else float(rng.integers(0, 3)) if m != 5 else 1.0, float(rng.standard_normal() + 50), float(rng.integers(0, 9)), float(rng.standard_normal())))
    d = spark.createDataFrame(rows, "marker int, g double, y double, a double, b double")
    got = {r.marker: r for r in single.run_test(d, "q.lm", ["marker"], "y", ("a", "b")).collect()}
    for m in range(6):
        use = np.array([r[1:] for r in rows if r[0] == m and r[1] is not None], float)
        assert got[m].ns == len(use)
        if m in (0, 5):
            assert got[m].beta is None and got[m].pvalue is None
            continue
        want = single.lm(use[:, 0], use[:, 1], np.column_stack([np.ones(len(use)), use[:, 2:]]))
        for c in ("beta", "sebeta", "tstat", "pvalue"):
            assert got[m][c] == pytest.approx(want[c], rel=1e-6), (m, c)


def test_kinship_does_not_depend_on_tiles(spark):
    import numpy as np

    from locusmill.operators import mixed

    rng, n = np.random.default_rng(2), 11
    rows = []
    for m in range(40):
        idx = sorted(rng.choice(n, rng.integers(2, n + 1), replace=False).tolist())
        rows.append((m, idx, [float(x) for x in rng.integers(0, 3, len(idx))]))
    v = spark.createDataFrame(rows, "marker int, idx array<int>, g array<double>")
    for method in ("bn", "ibs"):
        a, b = ({(r.i, r.j): (round(r.k, 9), r.w) for r in mixed.kinship(v, n, method, tile).collect()} for tile in (512, 4))
        assert a == b and len(a) == n * (n + 1) // 2


def test_ranks_over_ranges(spark):
    import random

    r = random.Random(9)
    y = [None if r.random() < 0.1 else float(r.randrange(40)) for _ in range(300)]
    d = spark.createDataFrame(list(enumerate(y)), "i int, y double")
    have = sorted(v for v in y if v is not None)
    want = {i: have.index(v) + (have.count(v) + 1) / 2 for i, v in enumerate(y) if v is not None}
    for buckets in (1, 7, 64):
        assert {x.i: x["rank"] for x in qc.with_average_rank(d, "y", buckets=buckets).collect()} == want
    assert qc.with_average_rank(d.where("y is null"), "y").count() == 0
