"""Quality rules as a cascade: a sample gives each rule's cost and rejections, rules run in order of rejections per cost, a rejected text runs no further."""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of_bytes, extend, slices, spare

SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOL = bytes(set(range(256)) - set(SYMBOLS))
#: First bytes of code points, that is, all but continuation bytes.
_CONTINUED = bytes(range(0x80, 0xC0))
_NOT_UPPER, _NOT_LOWER = bytes(set(range(256)) - set(range(65, 91))), bytes(set(range(256)) - set(range(97, 123)))
_ENDS = re.compile(rb"[.!?:;\"')\]]\s*$")


def n_words(t: dict) -> int:
    t["words"] = t["data"].split()  # ASCII white space: 0x20, 0x09 to 0x0D
    return len(t["words"])


def word_chars(t: dict) -> int:
    return sum(map(len, t["words"])) - len(t["data"]) + len(t["data"].translate(None, _CONTINUED))


def n_symbols(t: dict) -> int:
    return len(t["data"].translate(None, _NOT_SYMBOL))


def n_lines(t: dict) -> int:
    t["lines"] = [x for x in t["data"].split(b"\n") if x and not x.isspace()]
    return len(t["lines"])


def n_dup_lines(t: dict) -> int:
    return len(t["lines"]) - len(set(t["lines"]))


def n_repeat_words(t: dict) -> int:
    """Words that a 3-word window covers which the text has twice or more."""
    w = t["words"]
    if len(w) < 4:
        return 0
    known: dict[bytes, int] = {}
    x = np.fromiter((known.setdefault(a, len(known)) for a in w), np.int64, len(w))
    pair = np.unique(x[:-1] * len(known) + x[1:], return_inverse=True)[1]
    _, which, times = np.unique(pair[:-1] * len(known) + x[2:], return_inverse=True, return_counts=True)
    twice = times[which] > 1
    covered = np.zeros(len(w), bool)
    for k in range(3):
        covered[k : k + len(twice)] |= twice
    return int(covered.sum())


def n_shouted(t: dict) -> int:
    """ASCII capitals, of which a text that isn't shouted has few."""
    return len(t["data"].translate(None, _NOT_UPPER))


def n_small(t: dict) -> int:
    return len(t["data"].translate(None, _NOT_LOWER))


def n_marks(t: dict) -> int:
    """Exclamation and question marks."""
    return t["data"].count(b"!") + t["data"].count(b"?")


#: What rules look at: a function of the features before it, which it may find in the text's dict.
FEATURES: dict[str, tuple[Callable[[dict], int], tuple[str, ...]]] = {
    "n_words": (n_words, ()), "word_chars": (word_chars, ("n_words",)), "n_symbols": (n_symbols, ()), "n_lines": (n_lines, ()), "n_dup_lines": (n_dup_lines, ("n_lines",)),
    "n_repeat_words": (n_repeat_words, ("n_words",)), "n_shouted": (n_shouted, ()), "n_small": (n_small, ()), "n_marks": (n_marks, ()),
}


@dataclass(frozen=True)
class Rule:
    """rejects: whether a text with these features goes; needs: the features it looks at; base: one of the contract's own."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[[dict], bool]
    base: bool = False


RULES = (
    Rule("few_words", ("n_words",), lambda t: t["n_words"] < 50, True),
    Rule("repeated_words", ("n_words", "n_repeat_words"), lambda t: 100 * t["n_repeat_words"] > 50 * t["n_words"], True),
    Rule("symbols", ("n_words", "n_symbols"), lambda t: 10 * t["n_symbols"] > t["n_words"]),
    Rule("repeated_lines", ("n_lines", "n_dup_lines"), lambda t: 2 * t["n_dup_lines"] > t["n_lines"]),
    Rule("word_length", ("n_words", "word_chars"), lambda t: not 2 * t["n_words"] <= t["word_chars"] <= 15 * t["n_words"]),
    Rule("shouting", ("n_shouted", "n_small"), lambda t: t["n_shouted"] > t["n_small"]),
    Rule("marks", ("n_words", "n_marks"), lambda t: 10 * t["n_marks"] > 3 * t["n_words"]),
)


def feature(t: dict, name: str) -> int:
    """The feature of a text (a dict with data, its bytes), computed once."""
    if name not in t:
        how, first = FEATURES[name]
        for x in first:
            feature(t, x)
        t[name] = how(t)
    return t[name]


def passes(t: dict, rules: tuple[Rule, ...]) -> bool:
    """Whether no rule rejects the text; rules after the first that does don't run, nor are their features made."""
    for r in rules:
        for x in r.needs:
            feature(t, x)
        if r.rejects(t):
            return False
    return True


def _texts(batch: pa.RecordBatch, column: int = 0):
    """Dicts of the texts of a batch; null counts as empty."""
    return ({"data": (x or "").encode("utf-8", "surrogatepass")} for x in batch.column(column).to_pylist())


def sample_costs(docs: DataFrame, rules: tuple[Rule, ...] = RULES, rows: int = 2_000, seed: int = 7) -> tuple[dict[str, float], dict[int, int]]:
    """Seconds a text of each feature and rule, and how many sampled texts each set of rules (bits, in order) rejects.

    The sample has about rows texts, each drawn with the same probability; its times and counts
    are summed in the tasks, so the driver gets one row a task and at most 2**len(rules) counts.
    """
    n = docs.count()
    names = [*FEATURES, *(f"rule {r.name}" for r in rules)]

    def run(batches):
        spent, sets = dict.fromkeys(names, 0.0), {}
        for batch in batches:
            for part in slices([batch], 64):
                for t in _texts(part):
                    for x, (how, _) in FEATURES.items():
                        at = time.perf_counter()
                        t[x] = how(t)
                        spent[x] += time.perf_counter() - at
                    bits = 0
                    for k, r in enumerate(rules):
                        at = time.perf_counter()
                        bits |= bool(r.rejects(t)) << k
                        spent[f"rule {r.name}"] += time.perf_counter() - at
                    sets[bits] = sets.get(bits, 0) + 1
        yield pa.RecordBatch.from_pydict({"what": [*spent, *map(str, sets)], "cost": [*spent.values(), *[0.0] * len(sets)], "n": [0] * len(spent) + list(sets.values())}, pa.schema([("what", pa.string()), ("cost", pa.float64()), ("n", pa.int64())]))

    some = docs.select("text").sample(min(1.0, rows / n) if n else 1.0, seed)
    got = some.mapInArrow(run, "what string, cost double, n long").groupBy("what").agg(F.sum("cost").alias("cost"), F.sum("n").alias("n")).collect()
    sets = {int(r.what): r.n for r in got if r.n}
    total = max(1, sum(sets.values()))
    return {r.what: r.cost / total for r in got if r.what in names}, sets


def order_rules(rules: tuple[Rule, ...], cost: dict[str, float], sets: dict[int, int]) -> tuple[Rule, ...]:
    """Rules by rejections per cost: the next is always the best on the texts that those before it leave.

    A feature's cost counts only where no rule before has paid for it. Rules that reject none of
    the sample come last, cheapest first; ties keep the given order.
    """
    left, paid, out = dict(sets), set(), []

    def price(r: Rule) -> float:
        need, todo = set(), list(r.needs)
        while todo:
            x = todo.pop()
            need.add(x)
            todo += FEATURES[x][1]
        return cost.get(f"rule {r.name}", 0.0) + sum(cost.get(x, 0.0) for x in need - paid) + 1e-12

    def gain(k: int) -> tuple[float, float]:
        hit = sum(n for bits, n in left.items() if bits >> k & 1)
        return -hit / price(rules[k]), price(rules[k])

    rest = list(range(len(rules)))
    while rest:
        k = min(rest, key=gain)
        rest.remove(k)
        out.append(rules[k])
        left = {bits: n for bits, n in left.items() if not bits >> k & 1}
        for x in rules[k].needs:
            paid |= {x, *FEATURES[x][1]}
    return tuple(out)


def plan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, rows: int = 2_000, seed: int = 7) -> tuple[Rule, ...]:
    """The rules in the order in which the cascade runs them, from a sample of about rows texts."""
    return order_rules(rules, *sample_costs(docs, rules, rows, seed))


def good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = 2_000) -> DataFrame:
    """The rows of docs that no rule rejects, with all their columns, whatever their names.

    The order of rules is a matter of time alone: a row goes if any rule rejects it. Null texts
    count as empty and go where few_words is among rules; equal texts and repeated rows fare
    alike; very long texts are read whole; without rules all rows stay; an empty table stays empty.
    """
    ordered, at = plan(docs, rules, sample), docs.columns.index("text")

    def run(batches):
        for batch in slices(batches):
            yield batch.filter(pa.array([passes(t, ordered) for t in _texts(batch, at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = 2_000) -> DataFrame:
    """docs (all columns but text) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and kept (boolean), the cascade's verdict.

    Counts are of every text, those included that an early rule rejects; the rest of the
    features is made only as far as the cascade comes. Names that docs has already get
    underscores. Null texts count as empty; otherwise as in good().
    """
    ordered, at = plan(docs, rules, sample), docs.columns.index("text")
    names = spare([c for c in docs.columns if c != "text"], *COUNTS, "kept")
    schema = extend(docs.drop("text").schema, ", ".join(f"`{c}` {'boolean' if k == len(COUNTS) else 'long'}" for k, c in enumerate(names)))

    def run(batches):
        for batch in slices(batches):
            rest = [c for k, c in enumerate(batch.columns) if k != at]
            counts, kept = [], []
            for part in batches_of_bytes([(t["data"],) for t in _texts(batch, at)]):
                for (data,) in part:
                    t = {"data": data}
                    kept.append(passes(t, ordered))
                    counts.append([feature(t, x) for x in COUNTS])
            cols = np.array(counts, np.int64).reshape(-1, len(COUNTS)).T
            yield pa.RecordBatch.from_arrays([*rest, *map(pa.array, cols), pa.array(kept, pa.bool_())], names=[*(n for k, n in enumerate(batch.schema.names) if k != at), *names])

    return docs.mapInArrow(run, schema)


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = 2_000) -> DataFrame:
    """Per document doc_id, n_words, the four counts, base_failed and kept, from measured()'s rows."""
    m = measured(docs.select("doc_id", "text"), rules, sample)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return m.select("doc_id", *COUNTS, failed.alias("base_failed"), (F.col("kept") & ~failed).alias("kept"))
