import random

import numpy as np
import pytest
from brute import repeats
from test_native import ODD, SF, by_id, docs

from locusmill.llm import suffix_dedup
from locusmill.llm.common import Powers


def test_columns_find_all_repeats():
    r = random.Random(2)
    for trial in range(40):
        word = "".join(r.choice("ab") for _ in range(5))
        pieces = []
        for _ in range(r.randrange(1, 9)):
            a, b = r.randrange(0, 8), r.randrange(3, 8)
            pieces.append((r.randrange(2), a, ("".join(r.choice("ab") for _ in range(a)) + word + "".join(r.choice("ab") for _ in range(b))).encode()))
        pieces.sort(key=lambda x: x[0])
        flags, begin = suffix_dedup.repeated_windows([p for _, _, p in pieces], np.array([a for _, a, _ in pieces]), np.array([g for g, _, _ in pieces]), 7)
        for i, (g, a, p) in enumerate(pieces):
            for o in range(len(p) - 6):
                want = any(j != i and h == g and 0 <= o - a + b and q[o - a + b : o - a + b + 7] == p[o : o + 7] for j, (h, b, q) in enumerate(pieces))
                assert bool(flags[begin[i] + o, i]) == want, (trial, i, o)


def test_cut_holds_each_window_once():
    r = np.random.default_rng(1)
    parts = [r.integers(97, 100, n).astype(np.uint8).tobytes() for n in (0, 50, 199, 200, 201, 777, 1500)]
    c = suffix_dedup.cut(parts, Powers())
    assert c["windows"].sum() == sum(max(0, len(p) - 199) for p in parts)
    for i in range(len(c["part"])):
        assert 0 <= c["off"][i] and c["off"][i] + 32 <= 200 + 0 * i or c["windows"][i] > 1
        assert c["windows"][i] - 1 <= c["off"][i] <= 200 - 32


def planted(seed=1):
    r = random.Random(seed)
    text = lambda n, a="abcdeé ": "".join(r.choice(a) for _ in range(n))
    passage, long = text(260), text(900)
    out = [text(r.choice([0, 30, 199, 200, 400, 1200])) for _ in range(12)]
    out += [text(40) + passage + text(90), text(300) + passage, passage[:230] + text(50), long, long, long[:500] + "X" + long[500:], long[100:400], "z" * 450, text(20) + "z" * 230, text(300) * 2, None, "", text(10) + passage[20:215]]
    return out


@pytest.mark.parametrize("options", [{}, {"hot": 1, "batch": 3}, {"chunk": 300}, {"k": 16}])
def test_report_against_brute_force(spark, options):
    texts = planted() + ODD
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = [(i, *x) for i, x in enumerate(repeats(texts))]
    got = suffix_dedup.dedup_report(d, **options).collect()
    assert by_id(got) == by_id(want) and sum(x[2] for x in want) > 3000


def test_on_a_table(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    rows = d.select("doc_id", "text").collect()
    want = [(r.doc_id, *x) for r, x in zip(rows, repeats([r.text for r in rows]))]
    assert by_id(suffix_dedup.dedup_report(d).collect()) == by_id(want)


def test_odd_rows(spark):
    d = docs(spark)
    assert suffix_dedup.dedup_report(d.union(d)).count() == 2 * len(ODD)
    assert suffix_dedup.dedup_report(d.limit(0)).count() == 0
    out = suffix_dedup.remove_repeats(docs(spark, extra=True))
    assert out.columns == docs(spark, extra=True).columns and out.count() == len(ODD)
