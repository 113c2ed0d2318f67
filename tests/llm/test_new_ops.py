"""Quality cascade, token alignment and spelling variants against plain versions."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from locusmill.llm import quality_cascade as q
from locusmill.llm import spelling_variants as v
from locusmill.llm import token_alignment as a

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n\n", "a", "  two  spaces  ", "\tx\r\n y", "<|endoftext|> <s> </s> <unk> <0x41>", "▁ changed", "naïve Ünïcode É à", "日本語 text ﬁ \x00 end", "don't they'll", "x" * 3000, "word " * 4000,
       "same line\nsame line\n\nother same line\n  \n  \n", "#* $% &| <>", "STOP NOW!! " * 30, "a b c a b c d", "tail  ", "tail  "]


def docs(spark, texts=ODD):
    rows = [(None if k == 3 else k % 17, t, k, True) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words int, kept boolean")


def key(rows):
    return sorted(map(tuple, rows), key=repr)


# ---------------------------------------------------------------- quality


def plain_quality(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = collections.Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    chars, symbols, dup = sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines))
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    upper, small, marks = (len(re.findall(p, t)) for p in ("[A-Z]", "[a-z]", "[!?]"))
    good = not (failed or 10 * symbols > len(w) or 2 * dup > len(lines) or not 2 * len(w) <= chars <= 15 * len(w) or upper > small or 10 * marks > 3 * len(w))
    return len(w), chars, symbols, dup, len(covered), failed, good


@pytest.mark.parametrize("odd", [True, False])
def test_quality_against_plain_version(spark, odd):
    d = docs(spark) if odd else spark.read.parquet(f"{SF}/documents.parquet")
    want = [(r.doc_id, *plain_quality(r.text)) for r in d.select("doc_id", "text").collect()]
    assert key(q.report(d).collect()) == key(want)


def test_quality_keeps_columns_and_order_doesnt_matter(spark):
    d = docs(spark, ODD + [" ".join(f"word{k}" for k in range(80))] * 2)
    kept = q.good(d).collect()
    assert q.good(d).columns == d.columns and len(kept) == 2 and kept[0].kept is True
    m = q.measured(d)
    assert m.columns[:3] == ["doc_id", "n_words", "kept"] and {"n_words_", "kept_"} <= set(m.columns)
    for rules in (q.RULES, q.RULES[::-1]):
        assert [q.passes({"data": (t or "").encode()}, rules) for t in ODD] == [plain_quality(t)[-1] for t in ODD]
    none = d.where("doc_id < 0")
    assert q.report(none).count() == 0 and q.good(none).count() == 0 and q.good(d, ()).count() == d.count()


def test_cascade_orders_by_rejections_per_cost():
    rules = q.RULES[:3]  # few_words, repeated_words, symbols
    cost = {"n_words": 1.0, "n_repeat_words": 9.0, "n_symbols": 0.5}
    # bits: 1 few_words, 2 repeated_words, 4 symbols; what symbols rejects few_words rejects too
    got = q.order_rules(rules, cost, {0: 50, 5: 20, 1: 20, 2: 10})
    assert [r.name for r in got] == ["few_words", "repeated_words", "symbols"]
    assert [r.name for r in q.order_rules(rules, cost, {4: 80, 1: 5, 0: 15})][0] == "symbols"
    assert [r.name for r in q.order_rules(rules, cost, {})] == ["few_words", "symbols", "repeated_words"]


def test_cascade_stops_at_the_first_rejection():
    t = {"data": b"few words"}
    assert not q.passes(t, q.RULES) and "n_repeat_words" not in t and "n_lines" not in t


def test_quality_sample_finds_costs(spark):
    cost, sets = q.sample_costs(spark.read.parquet(f"{SF}/documents.parquet"))
    assert sum(sets.values()) == 200 and all(cost[x] > 0 for x in q.FEATURES)
    assert {r.name for r in q.plan(spark.read.parquet(f"{SF}/documents.parquet"))} == {r.name for r in q.RULES}


# ---------------------------------------------------------------- tokens


def plain_tokens(texts):
    """Whole texts by the libraries themselves."""
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(f"{a.TOKENIZERS}/{a.BYTE_FILE}")
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=f"{a.TOKENIZERS}/{a.PIECE_FILE}")
    of = {c: b for c, b in a._byte_level().items()}
    out = []
    for t in texts:
        x, y = (one.encode(" " + t, add_special_tokens=False).ids, two.encode(t)) if t else ([], [])
        bx = [bytes(of[c] for c in one.id_to_token(i)) for i in x]
        by = [bytes([int(p[3:5], 16)]) if two.is_byte(i) else p.replace("▁", " ").encode() for i in y for p in [two.id_to_piece(i)]]
        if not b"".join(bx) == b"".join(by) == (" " + (t or "")).encode():
            x, y, bx, by = [], [], [], []
        out.append((x, y, np.cumsum([len(b) for b in bx]).tolist(), np.cumsum([len(b) for b in by]).tolist()))
    return out


def plain_alignment(rows):
    tokens = plain_tokens([t for _, t in rows])
    links, said = [], []
    for x, y, ex, ey in tokens:
        both = sorted(set(ex) & set(ey))
        links.append([(x[ex.index(e)], y[ey.index(e)]) for e in both])
        groups, i, j = [], 0, 0
        for e in both:
            p, r = ex.index(e) + 1, ey.index(e) + 1
            groups.append(",".join(map(str, x[i:p])) + "|" + ",".join(map(str, y[j:r])))
            i, j = p, r
        said.append(";".join(groups))
    n = collections.Counter(p for ps in links for p in ps)
    most = collections.defaultdict(int)
    for (_, b), c in n.items():
        most[b] = max(most[b], c)
    return [
        (i, len(x), len(y), len(ps), len(ps), sum(n[p] == most[p[1]] for p in ps), sum(n[p] for p in ps), hashlib.sha256(s.encode()).hexdigest() if x else "")
        for (i, _), (x, y, *_), ps, s in zip(rows, tokens, links, said)
    ]


@pytest.mark.parametrize("limit", [1_000_000, 0])
@pytest.mark.parametrize("odd", [True, False])
def test_alignment_against_the_libraries(spark, odd, limit):
    d = docs(spark) if odd else spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 80")
    want = plain_alignment([(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()])
    assert key(a.report(d, max_sent=limit).collect()) == key(want)


def test_alignment_of_nothing(spark):
    assert a.report(docs(spark).where("doc_id < 0")).count() == 0
    r = a.align(docs(spark, ["one two"])).first()
    assert r.groups.count(";") + 1 == r.n_groups == sum(r.times) and "|" in r.groups


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8", exclude_categories=["Cs"]), max_size=40) | st.text("ab é'\n .<>|0", max_size=40), max_size=6))
def test_encoder_equals_the_libraries(texts):
    with open(f"{a.TOKENIZERS}/{a.BYTE_FILE}", "rb") as f, open(f"{a.TOKENIZERS}/{a.PIECE_FILE}", "rb") as g:
        e = _ENCODER or _ENCODER.append(a.Encoder(f.read(), g.read())) or _ENCODER
    got = [(x.tolist(), y.tolist()) for x, y in e[0].encode(texts)]
    assert got == [(x, y) for x, y, *_ in plain_tokens(texts)]


_ENCODER = []


@given(st.sets(st.integers(0, 300)), st.sets(st.integers(0, 3000)))
def test_gallop(x, y):
    x, y = np.array(sorted(x), np.int64), np.array(sorted(y), np.int64)
    for p, r in ((x, y), (y, x)):
        i, j = a.gallop(p, r, 4)
        assert p[i].tolist() == r[j].tolist() == np.intersect1d(p, r).tolist()


# ---------------------------------------------------------------- spelling


def near(x, y):
    if abs(len(x) - len(y)) > 1 or x == y:
        return False
    if len(x) == len(y):
        return sum(p != r for p, r in zip(x, y)) == 1
    x, y = sorted((x, y), key=len)
    return any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def plain_variants(rows):
    n = collections.Counter()
    for i, t in rows:
        for r in re.findall("[a-zÀ-ÿ]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))):
            h = zlib.crc32(f"{'' if i is None else i}:{r}".encode())
            n[r[: h % len(r)] + r[h % len(r) + 1 :] if h % 199 == 0 else r] += 1
    words = {w: c for w, c in n.items() if c >= 5 and len(w) >= 6}
    out, form = [], {}
    for w, c in words.items():
        of = [x for x in words if near(w, x)]
        best = min(of, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 5 * c else None
        out.append((w, form[w], c, len(of), words[best] if form[w] else None))
    for w, f, c, k, m in out:
        root = w
        while form[root]:
            root = form[root]
        yield w, f, root, c, k, m


@pytest.mark.parametrize("symbols", [16, 2])
def test_variants_against_plain_version(spark, symbols):
    rng = np.random.default_rng(3)
    texts = [" ".join(["spelling"] * 130 + ["speling", "Spellin"] * 25 + ["spelin"] * 5), "ÉTUDEÀ étudeà " * 40 + "etudeà " * 9 + "étudea× " * 6, "short " * 9 + "longer " * 9 + "x" * 4000, None, ""]
    texts += [" ".join("".join(rng.choice(list("abÀ"), rng.integers(5, 9))) for _ in range(400)) for _ in range(8)]
    d = docs(spark, texts * 2)
    assert key(v.variants(d, symbols=symbols).collect()) == key(plain_variants([(r.doc_id, r.text) for r in d.collect()]))


def test_variants_of_documents_and_nothing(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = key(v.variants(d).collect())
    assert got and got == key(plain_variants([(r.doc_id, r.text) for r in d.collect()]))
    assert v.variants(docs(spark)).collect() == [] and v.variants(d.where("doc_id < 0")).collect() == []


def test_variants_count_in_pieces(spark, monkeypatch):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    want = key(v.vocabulary(d).collect())
    monkeypatch.setattr(v, "COUNTED", 50)
    assert key(v.vocabulary(d).collect()) == want


@given(st.text("abcdéè", min_size=1, max_size=25), st.integers(0, 25), st.sampled_from("abcdéèx"), st.sampled_from(["put", "cut", "change"]))
def test_neighbourhoods_hold_every_edit(word, k, c, how):
    k %= len(word)
    other = {"put": word[:k] + c + word[k:], "cut": word[:k] + word[k + 1 :], "change": word[:k] + c + word[k + 1 :]}[how]
    if other:
        (code,) = v.word_codes([other])
        assert any(code in codes for _, codes in v.word_neighbours([word]))


def test_spelling_joins_send_no_table_through_the_driver(spark):
    """Staged vocabularies are small as files, so that Spark would broadcast them, and several times larger in memory."""
    import contextlib
    import io

    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, "colour color colours favour favor " * (1 + i % 3)) for i in range(20)], "doc_id long, text string")
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) > 1 << 20
    vocab = spark.createDataFrame([("colour", 9), ("colours", 50), ("favour", 7)], "word string, n long")
    for df in (v.variants(docs, 5), v.near_pairs(vocab), v.roots(vocab.select("word", F.lit(None).cast("string").alias("form")))):
        df.collect()
        with contextlib.redirect_stdout(io.StringIO()) as plan:
            df.explain()
        assert "Broadcast" not in plan.getvalue()
