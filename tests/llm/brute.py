"""Plain single-machine versions of the contracts, to hold the Spark queries against."""

import hashlib
import re
from collections import defaultdict

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower(t):
    return (t or "").translate(LOW)


def sha(s):
    return hashlib.sha256(s.encode() if isinstance(s, str) else s).hexdigest()


def repeats(texts, n=200):
    """Per text: (bytes, removed, spans, sha of what stays)."""
    seen = defaultdict(int)
    data = [(t or "").encode() for t in texts]
    for b in data:
        for i in range(len(b) - n + 1):
            seen[b[i : i + n]] += 1
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def url(u):
    if u is None or "://" not in u:
        return "", ""
    rest = u.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(LOW), re.match(r"[^?#]*", rest[len(host) :])[0]


def licenses(text, base):
    w = ALNUM.findall(lower(text))
    found = [(i, label) for phrase, label in base for p in [phrase.split()] for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    at = [i for i, _ in found]
    return len(w), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def mix_targets(sizes):
    """sizes: {source: words}. Repeats the resharing until none is above."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: 1 + i % 3 for i, s in enumerate(names)}
    left, open_, out = float(sum(sizes.values())), set(names), {}
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > 3 * sizes[s]}
        if not over:
            return out | {s: left * w[s] / total for s in open_}
        for s in over:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def pii(text):
    t = text or ""
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    ]
    spans = [[f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, t) if ok(m[0])] for k, p, ok in kinds]
    return [len(x) for x in spans], sha(",".join(y for x in spans for y in x))


def contamination(texts, items, n=10):
    """items: [(id, text)]. Per text: (words, hit, items, sha, contaminated)."""
    windows = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall(lower(t))
        for k in range(max(1, len(w) - n + 1) if w else 0):
            windows[tuple(w[k : k + n])].add(str(i))
    sizes = sorted({len(x) for x in windows})
    out = []
    for t in texts:
        w = ALNUM.findall(lower(t))
        hit, who = set(), set()
        for s in sizes:
            for k in range(len(w) - s + 1):
                if (x := tuple(w[k : k + s])) in windows:
                    hit.update(range(k, k + s))
                    who |= windows[x]
        out.append((len(w), len(hit), len(who), sha(",".join(sorted(who))), bool(hit)))
    return out


def shingles(text, n=3):
    w = SPACE.findall(lower(text))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def components(ids, linked):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def near(rows, n=3, num=90):
    """rows: [(id, text)]. Per id (set size, component)."""
    sets = [(i, shingles(t, n)) for i, t in rows]
    post = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for x in s:
            post[x].append(k)
    links = []
    for k, (i, s) in enumerate(sets):
        count = defaultdict(int)
        for x in s:
            for j in post[x]:
                if j < k:
                    count[j] += 1
        links += [(i, sets[j][0]) for j, c in count.items() if 100 * c >= num * (len(s) + len(sets[j][1]) - c)]
    comp = components([i for i, _ in rows], links)
    return {i: (len(s), comp[i]) for i, s in sets}
