"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier trained on the result decides (DataFrame functions only)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import spare, stage

# Possessive forms of the base patterns: the same matches in time linear in the text, without recursion.
_L = r"A-Za-z0-9._%+-"
EMAIL = rf"(?:\G|(?<![{_L}]))[{_L}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: What the method looks for besides: kind, pattern, what the text must hold.
# How keys of common services begin, and how long they are.
_KEYS = (
    r"(?:AKIA|ASIA)[0-9A-Z]{16}", r"gh[pousr]_[A-Za-z0-9]{36,255}+", r"xox[abprs]-[A-Za-z0-9-]{10,}+", r"AIza[0-9A-Za-z_-]{35}", r"[sr]k[_-](?:live_|test_|proj-)?[A-Za-z0-9_-]{20,}+",
    r"eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+", r"-----BEGIN [A-Z0-9\x20]*?PRIVATE KEY-----[A-Za-z0-9+/=\s:,.-]*?-----END [A-Z0-9\x20]*?PRIVATE KEY-----",
)
KEY = r"(?<![A-Za-z0-9_])(?:" + "|".join(_KEYS) + r")(?![A-Za-z0-9])"
KEY_BEGINS = r"AKIA|ASIA|gh[pousr]_|xox[abprs]-|AIza|[sr]k[_-]|eyJ|PRIVATE KEY"
#: The value goes to white space or, if quoted, to its quote: no character ends it before. Only commas, semicolons and full stops at its very end belong to the sentence.
_VALUE = r"(?=\S{8})[\"']?[,;.]*+[^\s,;.]++(?:[,;.]++[^\s,;.]++)*+"
SECRET = rf"(?i)(?<![A-Za-z])(?:password|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key|client[_-]?secret|private[_-]?key)[\"']?[\x20]?[=:][\x20]?(?:\"[^\"\n]{{8,}}+\"|'[^'\n]{{8,}}+'|{_VALUE})"
SPOKEN = r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++[\x20](?:\(at\)|\[at\])[\x20][A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
# Lengths of the listed countries' IBANs; of others any from 15 on, in groups of four and a last one of 1 to 4.
IBAN_LENGTHS = {
    "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26,
    "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}
_GROUP = r"(?:[\x20]?[0-9A-Z]{4})"
_LISTED = "|".join(rf"{c}[0-9]{{2}}{_GROUP}{{{n // 4 - 1}}}" + (rf"[\x20]?[0-9A-Z]{{{n % 4}}}" if n % 4 else "") for c, n in IBAN_LENGTHS.items())
_OTHER = rf"[A-Z]{{2}}[0-9]{{2}}(?:{_GROUP}{{3,7}}(?:[\x20]?[0-9A-Z]{{1,3}})?|{_GROUP}{{2}}[\x20]?[0-9A-Z]{{3}})"
IBAN = rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:(?:{_LISTED})(?![A-Za-z0-9])|{_OTHER}(?![A-Za-z0-9]))"

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("key", "secret", "iban", "spoken_email")
# Fixed values, the gazetteers: ends of domains, first digits of card numbers, country codes of phones.
DOMAIN_ENDS = "com org net edu gov mil int info biz io ai app dev me tv co at au be br ca ch cn cz de dk es eu fi fr gr hu ie in it jp kr mx nl no nz pl pt ro ru se sk tr ua uk us za"
CARD_STARTS = "34 35 36 37 38 4 51 52 53 54 55 60 62 64 65 67"
CALLING_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 21 22 23 24 25 26 29 35 37 38 42 50 59 67 68 69 80 85 87 88 96 97 99"
#: Words before a match that speak for it.
CUES = {
    "email": "mail|contact|write|address", "ip": "ip|host|server|address|login", "card": "card|visa|credit|pay", "phone": "phone|call|tel|mobile|fax",
    "key": "key|aws|access|credential", "secret": "login|user|config|password|auth", "iban": "iban|bank|account|transfer", "spoken_email": "mail|contact|write|address",
}


def _digits(m: Column) -> Column:
    return F.translate(m, " ().+-", "")


def _luhn(m: Column) -> Column:
    """Whether the digits of m pass the check sum."""
    d = F.split(F.reverse(_digits(m)), "")
    twice = lambda x: F.when(x * 2 > 9, x * 2 - 9).otherwise(x * 2)
    return F.aggregate(F.transform(d, lambda x, i: F.when(i % 2 == 1, twice(x.cast("int"))).otherwise(x.cast("int"))), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _candidates(text: Column, kind: str, pattern: str, guard: Column) -> Column:
    """Of all matches of one kind: kind, i (from 0), plen and mlen (lengths before and of the match), m, ctx (up to 24 characters before)."""
    kept = F.when(guard, F.regexp_extract_all(text, F.lit(pattern), 0))
    before = F.when(guard, F.split(text, pattern, -1))
    # all votes and checks are on whole matches; only runs too long for a card (37 characters at most) are dropped
    kept_whole = lambda m: F.when(F.length(m) <= 160, m).otherwise(F.lit("")) if kind == "card" else m
    row = lambda m, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(F.get(before, i)).alias("plen"), F.length(m).alias("mlen"), kept_whole(m).alias("m"), F.lower(F.right(F.get(before, i), F.lit(24))).alias("ctx"))
    return F.coalesce(F.transform(kept, row), F.array())


def candidates(docs: DataFrame) -> DataFrame:
    """rid, doc_id, kind, i, plen, mlen, m, ctx: one row per match that its kind's check passes or not (valid), or one with null kind for a text without."""
    t = F.coalesce("text", F.lit(""))
    digit = t.rlike("[0-9]")
    parts = [
        _candidates(t, "email", EMAIL, F.contains(t, F.lit("@"))), _candidates(t, "ip", IP, digit & t.rlike(r"[0-9]\.[0-9]")), _candidates(t, "card", CARD, digit),
        _candidates(t, "phone", PHONE, t.rlike(r"\+[0-9]")), _candidates(t, "key", KEY, t.rlike(KEY_BEGINS)), _candidates(t, "secret", SECRET, t.rlike(r"[=:]")),
        _candidates(t, "iban", IBAN, t.rlike(r"[A-Z]{2}[0-9]{2}")), _candidates(t, "spoken_email", SPOKEN, t.rlike(r"[(\[]at[)\]]")),
    ]
    found = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.flatten(F.array(*parts)).alias("all"))
    found = found.select("rid", "doc_id", F.explode_outer("all").alias("c")).select("rid", "doc_id", "c.*")
    n = F.length(_digits(F.col("m")))
    valid = (
        F.when(F.col("kind") == "ip", F.forall(F.split("m", r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(F.split("m", r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(999)) <= 255))
        .when(F.col("kind") == "card", n.between(13, 19) & _luhn(F.col("m")))
        .when(F.col("kind") == "phone", n.between(9, 15))
        .otherwise(F.lit(True))
    )
    return found.withColumn("valid", valid)


def placed(found: DataFrame) -> DataFrame:
    """The valid rows of candidates() with start and end, and one with null kind for each text.

    Start positions come from running sums of the lengths between matches within each row and kind.
    """
    before = Window.partitionBy("rid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    start = (F.coalesce(F.sum(F.col("plen") + F.col("mlen")).over(before), F.lit(0)) + F.col("plen")).cast("long")
    spans = found.where("kind is not null").withColumn("start", start).withColumn("end", F.col("start") + F.col("mlen")).where("valid")
    rest = found.groupBy("rid", "doc_id").agg(F.lit(None).cast("string").alias("kind"))
    return spans.unionByName(rest, allowMissingColumns=True)


def votes(spans: DataFrame) -> DataFrame:
    """Adds v0..v3, the votes (1, 0, or -1 for none) of the format, gazetteer, context and shape labelers, and x0..x5, features of the span besides."""
    m, kind, ctx = F.col("m"), F.col("kind"), F.col("ctx")
    strict = (
        F.when(kind == "email", m.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"))
        .when(kind == "ip", ~m.rlike(r"^0|\.0[0-9]"))
        .when(kind == "card", m.rlike(r"^(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7})$"))
        .when(kind == "phone", m.rlike(r"^\+[0-9]{1,3}[ -]"))
        .when(kind == "secret", m.rlike(r"[0-9]"))
        .when(kind == "iban", m.rlike(r"[0-9]{6}"))
        .otherwise(F.lit(True))
    )
    listed = (
        F.when(kind.isin("email", "spoken_email"), F.lower(m).rlike(r"\.(?:" + DOMAIN_ENDS.replace(" ", "|") + ")$"))
        .when(kind == "ip", ~m.rlike(r"^(?:0|255)\."))
        .when(kind == "card", m.rlike("^(?:" + CARD_STARTS.replace(" ", "|") + ")"))
        .when(kind == "phone", m.rlike(r"^\+(?:" + CALLING_CODES.replace(" ", "|") + ")"))
        .when(kind == "key", F.lit(True))
        .when(kind == "iban", m.rlike("^(?:" + "|".join(IBAN_LENGTHS) + ")"))
    )
    cue = F.lit(None)
    for k, words in CUES.items():
        cue = F.when(kind == k, ctx.rlike(words)).otherwise(cue)
    shape = F.when(kind.isin("card", "phone"), F.size(F.array_distinct(F.split(_digits(m), ""))) >= 3).when(kind.isin("key", "secret"), F.size(F.array_distinct(F.split(m, ""))) >= 8).when(kind == "ip", F.length(m) >= 9)
    vote = lambda c: F.when(c, 1).when(~c, 0).otherwise(-1)
    flag = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    n = F.length(m)
    seen = {  # what no labeler looks at: what stands right before, length, make-up
        "x0": flag(ctx.rlike(r"[0-9a-z]$")), "x1": flag(ctx.rlike(r"[:=#(\[\"']\s*$")), "x2": flag(n >= 16), "x3": flag(2 * F.length(_digits(m)) > n), "x4": flag(m.rlike("[a-z]") & m.rlike("[A-Z]")), "x5": flag(m.rlike("[0-9]{4}")),
    }
    spans = spans.withColumns(seen)
    return spans.withColumns({"v0": vote(strict), "v1": vote(listed), "v2": F.when(cue, 1).otherwise(-1), "v3": vote(shape)})


VOTES, SEEN = ("v0", "v1", "v2", "v3"), ("x0", "x1", "x2", "x3", "x4", "x5")


def fit_votes(counts: list, rounds: int = 30) -> dict[str, tuple[float, list[tuple[float, float]]]]:
    """The label model by EM over vote patterns: per kind a bias and, per labeler, the weights of a vote for and against.

    counts: (kind, v0..v3, n), at most 8 kinds x 81 patterns whatever the corpus. Reliabilities
    (true and false positive rate of each labeler) and the prior are estimated from the votes alone.
    """
    out = {}
    for kind in sorted({r[0] for r in counts}):
        rows = [(tuple(r[1:5]), float(r[5])) for r in counts if r[0] == kind]
        prior, rate = 0.7, [(0.9, 0.3)] * 4

        def weights(prior=prior, rate=rate):
            return math.log(prior / (1 - prior)), [(math.log(a / b), math.log((1 - a) / (1 - b))) for a, b in rate]

        for _ in range(rounds):
            bias, w = weights(prior, rate)
            post = [posterior((bias, w), v) for v, _ in rows]
            total = sum(n for _, n in rows)
            prior = min(0.99, max(0.01, (sum(p * n for p, (_, n) in zip(post, rows)) + 1.4) / (total + 2)))
            rate = []
            for j in range(4):
                cast = [(v[j], n, p) for p, (v, n) in zip(post, rows) if v[j] >= 0]
                # smoothed towards useful labelers, so that the two classes keep their sides
                a = (sum(n * p for x, n, p in cast if x == 1) + 4.5) / (sum(n * p for _, n, p in cast) + 5)
                b = (sum(n * (1 - p) for x, n, p in cast if x == 1) + 1.5) / (sum(n * (1 - p) for _, n, p in cast) + 5)
                rate.append((min(0.99, max(0.01, a)), min(0.99, max(0.01, b))))
        out[kind] = weights(prior, rate)
    return out


def posterior(model: tuple, v: tuple) -> float:
    """The label model's probability for one pattern of votes."""
    bias, w = model
    return 1 / (1 + math.exp(-max(-30, min(30, bias + sum(w[j][1 - x] for j, x in enumerate(v) if x >= 0)))))


def _design(pattern: tuple) -> list[float]:
    """1, votes for and against of each labeler, and the features."""
    v, x = pattern[:4], pattern[4:]
    return [1.0, *(float(y == k) for y in v for k in (1, 0)), *map(float, x)]


def fit_classifier(counts: list, rounds: int = 40, ridge: float = 1.0) -> dict[str, list[float]]:
    """The span classifier: per kind a logistic regression on votes and features, trained on the label model's posteriors.

    counts: (kind, v0..v3, x0..x5, n), at most 8 x 81 x 64 patterns whatever the corpus, so it is
    trained on all spans. Weights as in _design().
    """
    votes = {}
    for r in counts:
        votes[r[:5]] = votes.get(r[:5], 0) + r[-1]
    labels, out = fit_votes([(*k, n) for k, n in votes.items()]), {}
    for kind, model in labels.items():
        rows = [r for r in counts if r[0] == kind]
        x = np.array([_design(r[1:-1]) for r in rows])
        n = np.array([float(r[-1]) for r in rows])
        t = np.array([posterior(model, r[1:5]) for r in rows])
        pull = ridge * np.r_[0.01, np.ones(x.shape[1] - 1)]
        w = np.zeros(x.shape[1])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (n * p * (1 - p))[:, None]).T @ x + np.diag(pull)
            step = np.linalg.solve(h, x.T @ (n * (p - t)) + pull * w)
            w -= step / max(1.0, np.abs(step).max())
        out[kind] = w.tolist()
    return out


def detect(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """rid, doc_id, kind, start, end, p, base: spans found, and one row with null kind for each document.

    Base kinds always stay; other kinds stay where the classifier's probability reaches threshold.
    Null texts count as empty and have no span; rows are told apart by position, so null or
    repeated ids and repeated texts are fine; very long texts and matches are taken whole; other
    columns, whatever their names, aren't read; empty tables give no rows. Positions are code points.
    """
    # what is written down holds no text: neither matches nor what stands before them
    found = stage(votes(candidates(docs)).drop("m", "ctx"), "votes")
    counts = [tuple(r) for r in found.where("kind is not null and valid").groupBy("kind", *VOTES, *SEEN).count().collect()]  # 8 x 81 x 64 rows at most
    score = F.lit(None).cast("double")
    for kind, w in fit_classifier(counts).items():
        terms = F.lit(w[0])
        for j, c in enumerate(VOTES):
            terms = terms + F.when(F.col(c) == 1, w[1 + 2 * j]).when(F.col(c) == 0, w[2 + 2 * j]).otherwise(0.0)
        for c, y in zip(SEEN, w[1 + 2 * len(VOTES) :]):
            terms = terms + F.col(c) * y
        score = F.when(F.col("kind") == kind, 1 / (1 + F.exp(-terms))).otherwise(score)
    out = placed(found).select("rid", "doc_id", "kind", "start", "end", score.alias("p"), F.col("kind").isin(*BASE_KINDS).alias("base"))
    return out.where(F.col("kind").isNull() | F.col("base") | (F.col("p") >= threshold))


def report(spans: DataFrame) -> DataFrame:
    """Per document the counts of the base kinds, base_sha256 and spans, from detect()'s rows."""
    order = F.coalesce(*[F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(BASE_KINDS + MORE_KINDS)])
    item = F.struct(order.alias("o"), "start", F.concat_ws(":", "kind", "start", "end").alias("s"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, item))), lambda x: x["s"]), ",")
    count = lambda k: F.sum(F.when(F.col("kind") == k, 1).otherwise(0)).cast("long").alias(f"n_{k}")
    out = spans.groupBy("rid", "doc_id").agg(*[count(k) for k in BASE_KINDS], F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("kind").isNotNull()).alias("spans"))
    return out.drop("rid")


def redact(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs with every span found replaced by [kind] in text; all columns, whatever their names, and rows stay.

    Spans are found per row and joined to texts by their hash; null, empty and other texts
    without a span don't change, equal texts change alike; an empty table stays empty.
    """
    key, k, cuts, r = spare(docs.columns, "key", "k", "cuts", "r")
    text = F.coalesce("text", F.lit(""))
    same = F.struct(F.xxhash64(text).alias("x"), F.crc32(text.cast("binary")).alias("y"))
    spans = detect(docs.select(same.alias("doc_id"), "text"), threshold).where("kind is not null")
    found = spans.groupBy(F.col("doc_id").alias(k)).agg(F.array_sort(F.collect_set(F.struct("start", "end", "kind"))).alias(cuts))
    # Of overlapping spans the first stays; pieces between them are kept.
    step = lambda a, x: F.when(x["start"] >= a["at"], F.struct(F.concat(a["out"], F.array(F.struct(a["at"].alias("a"), x["start"].alias("b"), F.concat(F.lit("["), x["kind"], F.lit("]")).alias("t")))).alias("out"), x["end"].alias("at"))).otherwise(a)
    start = F.struct(F.array().cast("array<struct<a:bigint,b:bigint,t:string>>").alias("out"), F.lit(0).cast("bigint").alias("at"))
    done = docs.withColumn(key, same).join(found, F.col(key) == F.col(k), "left").withColumn(r, F.when(F.col(cuts).isNotNull(), F.aggregate(cuts, start, step)))
    piece = lambda p: F.concat(F.substring(F.col("text"), (p["a"] + 1).cast("int"), (p["b"] - p["a"]).cast("int")), p["t"])
    rest = F.substring(F.col("text"), (F.col(r)["at"] + 1).cast("int"), F.length("text"))
    new = F.when(F.col(r).isNotNull(), F.concat(F.array_join(F.transform(F.col(r)["out"], piece), ""), rest)).otherwise(F.col("text"))
    return done.withColumn("text", new).select(*docs.columns)
