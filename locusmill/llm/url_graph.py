"""URL filters: rules, and trust and distrust propagated over the graph of hosts (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stage, unstage

#: (verdict, host, path); a rule holds for its host and all subdomains, for paths that begin with its path.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host (A-Z lower-cased) and path of a url; both empty without '://' or for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return ascii_lower(raw), path


def best_rule(host: Column, path: Column, rules=RULES, max_rules: int = 10_000) -> Column:
    """The longest rule that fits, as struct(n, rule, verdict), or null. The policy is a literal of bounded size."""
    if len(rules) > max_rules:
        raise ValueError(f"at most {max_rules} rules")
    if not rules:
        return F.lit(None).cast("struct<n:int,rule:string,verdict:string>")
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in rules]
    return F.array_max(F.array(*fits))


def host_edges(pages: DataFrame, host: str = "host", html: str = "html") -> DataFrame:
    """Distinct edges (src, dst) between hosts: absolute links of the pages, and each host with its parent domain.

    Relative links stay on their host and give no edge. The parent is the host without its
    first label, if at least three labels are there.
    """
    links = F.regexp_extract_all(F.col(html), F.lit(r"(?i)href\s*+=\s*+[\"']?+((?:https?:)?//[^\"'\s>/?#]++)"), 1)
    linked = pages.select(F.col(host).alias("src"), F.explode(links).alias("u")).select("src", ascii_lower(F.regexp_replace("u", r"\A(?i:https?:)?//", "")).alias("dst"))
    parents = pages.select(F.col(host).alias("src")).distinct().where(F.size(F.split("src", r"\.")) >= 4).select("src", F.regexp_extract("src", r"\A[^.]*\.(.*)", 1).alias("dst"))
    both = parents.union(parents.select("dst", "src"))
    return linked.union(both).where("src <> dst and src <> '' and dst <> ''").distinct()


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 1e-3, max_rounds: int = 600, together: int = 6) -> DataFrame:
    """(host, trust, distrust): personalised PageRank from seeds along edges, and of distrust against them.

    seeds: host, trust, distrust (weights). Both walks are one loop over edges keyed by
    (kind, src); each round is one join, in which Spark splits hosts with very many links, and
    one pre-aggregated sum; every few rounds are written down together. A host without edges
    keeps its mass, as if linked to itself: so a score doesn't depend on how many other seeds
    there are, and all scores add up to the seeds' weights. Rounds end when no score changes by
    tolerance * (1 - damping) in one of them; if max_rounds don't suffice, that is an error.
    Repeated edges count once; without edges scores are the seeds' own; no seeds, no rows.
    """
    pairs = edges.select("src", "dst").distinct()
    e = pairs.select(F.lit(0).alias("kind"), "src", "dst").union(pairs.select(F.lit(1).alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst")))
    degree = e.groupBy("kind", "src").agg(F.count("*").alias("n"))
    e = stage(e.join(degree, ["kind", "src"]).select("kind", "src", "dst", (F.lit(damping) / F.col("n")).alias("w")), "hostedges")
    both = F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("trust").alias("s")), F.struct(F.lit(1).alias("kind"), F.col("distrust").alias("s")))).alias("x")
    seed = seeds.select(F.col("host").alias("src"), both).groupBy("x.kind", "src").agg((F.sum("x.s") * (1 - damping)).alias("s")).where("s > 0")
    seed = rank = stage(seed, "seeds")
    none = F.lit(0.0)
    for k in range(1, max_rounds + 1):
        last = k % together == 0 or k == max_rounds
        if last:
            rank = stage(rank, "rank")  # read twice in this round
        there = rank.join(e, ["kind", "src"], "left")
        moved = there.select("kind", F.coalesce("dst", "src").alias("src"), (F.col("s") * F.coalesce("w", F.lit(damping))).alias("s"), none.alias("was"))
        parts = moved.union(seed.select("kind", "src", "s", none.alias("was")))
        if last:
            parts = parts.union(rank.select("kind", "src", none.alias("s"), F.col("s").alias("was")))
        new = parts.groupBy("kind", "src").agg(F.sum("s").alias("s"), F.sum("was").alias("was"))
        if last:
            before, new = rank, stage(new, "rank")
            unstage(before)
            change = new.agg(F.max(F.abs(F.col("s") - F.col("was")))).first()[0] or 0.0
            if change <= tolerance * (1 - damping):
                rank = new
                break
        rank = new.select("kind", "src", "s")
    else:
        raise RuntimeError(f"scores still change after {max_rounds} rounds")
    score = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("s")).otherwise(0.0))
    return rank.groupBy(F.col("src").alias("host")).agg(score(0).alias("trust"), score(1).alias("distrust"))


def judge_urls(pages: DataFrame, rules=RULES, margin: float = 0.05, damping: float = 0.85, tolerance: float = 1e-3) -> DataFrame:
    """pages' page_id, host, path, rule, verdict, trust, distrust.

    A page that a rule fits has the rule's verdict. A host's seed weights are the shares of its
    pages that rules allow and block. Any other page is blocked if its host's distrust exceeds
    its trust by margin or more, and allowed else. Null urls and urls without '://' have
    neither host nor path, fit no rule and are allowed; equal urls are judged alike, repeated
    rows each for itself; null html has no links; very long pages are read whole; other columns,
    whatever their names, aren't read; an empty table gives no rows.
    """
    host, path = host_and_path(F.col("url"))
    judged = pages.select("page_id", "url", "html").withColumns({"host": host, "path": path})
    slim = stage(judged.select("page_id", "host", "path").withColumn("r", best_rule(F.col("host"), F.col("path"), rules)), "pages")
    share = lambda v: F.avg(F.when(F.col("r.verdict") == v, 1.0).otherwise(0.0))
    seeds = slim.where("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    scores = stage(propagate(host_edges(judged), seeds, damping, tolerance), "hostscores")
    method = F.when(F.coalesce(F.round(F.col("distrust") - F.col("trust"), 9) >= margin, F.lit(False)), "block").otherwise("allow")
    return slim.join(scores, "host", "left").select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", method).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
