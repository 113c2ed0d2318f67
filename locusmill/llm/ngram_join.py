"""N-gram Jaccard join: exact candidates by set parts, T-occurrence search (DivideSkip), linked components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER_BYTES, Powers, RangeHash, arrow_batches, batch_filter, batches_of_bytes, byte_table, connected_components, extend, join_bytes, mix64, slices, spare, stage, unstage, words_of

N = 3
#: Two sets link when 100 * overlap >= PERCENT * union.
PERCENT = 90
#: Shingles in one block of a candidate cluster, on average.
BLOCK = 2_000_000
_C = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def distinct_runs(values: np.ndarray, owner: np.ndarray, owners: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values of each owner in one array, and where each owner's begin (one more than owners)."""
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    return v[new], np.searchsorted(o[new], np.arange(owners + 1))


def runs_of_shingles(h: np.ndarray, first: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Sets of n-word shingles of consecutive runs of words: distinct_runs() of their hashes.

    h: hashes of all words; first: where each run begins, and the end. A run of fewer than n
    words, but not none, has its whole sequence as one shingle.
    """
    size = np.diff(first)
    many = np.zeros(max(len(h) - n + 1, 0), np.uint64)
    for k in range(n):
        many += h[k : k + len(many)] * _C[k % 5] * np.uint64(2 * k + 1)
    many = mix64(many)
    own = np.repeat(np.arange(len(size)), size)
    whole = np.flatnonzero(np.arange(len(h)) + n <= first[1:][own])  # words that begin a shingle inside their run
    few = np.flatnonzero((size > 0) & (size < n))
    x = size[few].astype(np.uint64) << np.uint64(7)
    for k in range(n - 1):
        on = size[few] > k
        x[on] = mix64(x[on] ^ h[first[few[on]] + k] * _C[4])
    return distinct_runs(np.concatenate([many[whole], x]), np.concatenate([own[whole], few]), len(size))


def _shingles_of(texts: list[bytes], powers: Powers, n: int, words: str) -> tuple[np.ndarray, np.ndarray]:
    data, at = join_bytes(texts)
    data = LOWER_BYTES[data]
    lo, hi = words_of(data, byte_table(words))
    return runs_of_shingles(RangeHash(data, powers)(lo, hi), np.searchsorted(lo, at), n)


def shingle_sets(texts: list[bytes], powers: Powers, n: int = N, words: str = "space") -> list[np.ndarray]:
    """Sorted distinct hashes of each text's n-word shingles; with fewer words, of the whole sequence; none without words."""
    flat, at = _shingles_of(texts, powers, n, words)
    return [flat[a:b] for a, b in zip(at[:-1], at[1:])]


def set_keys(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One 64-bit value for each whole set of distinct_runs(); equal sets, equal keys. Empty sets have 0."""
    some = np.flatnonzero(np.diff(at))
    out = np.zeros(len(at) - 1, np.uint64)
    if len(some):
        start = at[some]
        total, both = np.add.reduceat(flat, start), np.bitwise_xor.reduceat(flat, start)
        out[some] = mix64(total + np.diff(at)[some].astype(np.uint64) * _C[0]) + mix64(both)
    return out.view(np.int64)


def size_classes(percent: int, top: int = 1 << 34) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower bounds of the classes of set sizes; for each, the number of parts and the slack for empty ones.

    A set of size x and a linked one of size y >= x differ by at most x * (1/t - 1) elements, so
    with that many parts and one more they agree on a part. slack more parts allow as many empty
    parts to be passed over; it is what sets of the class have at most, but for rare cases.
    """
    low = [1]
    while low[-1] < top:
        low.append(max(low[-1] + 1, low[-1] * 3 // 2))
    low = np.array(low, np.int64)
    d = ((100 - percent) * (low[1:] - 1)) // percent
    empty = (d + 1) * np.exp(-low[:-1] / (d + 1.0))
    slack = np.where(d == 0, 0, np.ceil(empty + 2 * np.sqrt(empty) + 0.5)).astype(np.int64)
    return low, d + 1 + slack, slack


def signatures(s: np.ndarray, percent: int, classes) -> np.ndarray:
    """Hashes of the parts of a set, for its size class and that of the smallest set it may link with."""
    low, parts, slack = classes
    n, out = len(s), []
    own = int(np.searchsorted(low, n, "right")) - 1
    least = int(np.searchsorted(low, max(1, -(-n * percent // 100)), "right")) - 1
    mixed = mix64(s + _C[1])
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)])
    for c in {own, least}:
        m = int(parts[c])
        part = ((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)  # rises with the hash, so parts are runs
        cut = np.searchsorted(part, np.arange(m + 1, dtype=np.uint64))
        empty = cut[1:] == cut[:-1]
        tag = np.arange(m, dtype=np.uint64) * _C[2] + np.array([c], np.uint64) * _C[3]
        sig = mix64(sums[cut[1:]] - sums[cut[:-1]] + tag)
        out.append(sig if empty.sum() > slack[c] else sig[~empty])
    return np.concatenate(out).view(np.int64)


def local_stars(sigs: np.ndarray, owner: np.ndarray, keys: np.ndarray, owners: int) -> tuple[pa.Array, pa.Array]:
    """What a run of records has to tell about its signatures: each once, and the links within the run.

    For each owner: the signatures that it is the first to have, and the keys of those who had
    its other ones before (its own key, where a record was there already). A signature that
    many records share thus leaves the run in one row.
    """
    order = np.lexsort((owner, sigs))
    s, o = sigs[order], owner[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    head = o[np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))] if len(s) else o
    mine = np.lexsort((s[new], o[new]))
    kept = s[new][mine]
    at = np.searchsorted(o[new][mine], np.arange(owners + 1))
    near, near_at = distinct_runs(keys[head[~new]].view(np.uint64), o[~new], owners)
    lists = lambda v, a: pa.ListArray.from_arrays(pa.array(a.astype(np.int32)), pa.array(v.view(np.int64)))
    return lists(kept, at), lists(near, near_at)


def _bytes_of(batch) -> list[bytes]:
    return [b"" if t is None else t.encode() for t in batch.column("text").to_pylist()]


def _describe(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, key (null for an empty set) of each document, and sigs and near (see local_stars)."""

    def run(batches):
        powers, classes = Powers(), size_classes(percent)
        for batch in slices(batches):
            for part in batches_of_bytes(list(zip(_bytes_of(batch), range(batch.num_rows)))):
                flat, at = _shingles_of([x[0] for x in part], powers, n, "space")
                size, keys = np.diff(at), set_keys(flat, at)
                sigs = [signatures(flat[a:b], percent, classes) if b > a else flat[:0].view(np.int64) for a, b in zip(at[:-1], at[1:])]
                owner = np.repeat(np.arange(len(part)), [len(x) for x in sigs])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array([x[1] for x in part])), pa.array(size, pa.int64()), pa.array(keys, mask=size == 0), *local_stars(np.concatenate(sigs), owner, keys, len(part))],
                    ["doc_id", "n_shingles", "key", "sigs", "near"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, extend(docs.select("doc_id").schema, "n_shingles long, key long, sigs array<long>, near array<long>"))


def _sets_of(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """key, n, s (the shingles) of the documents of wanted (doc_id, key), perhaps more than once or with others: join on key.

    Texts are read again, but only those of candidates go further than the scan.
    """
    kept = batch_filter("h", wanted.select(F.xxhash64("doc_id").alias("h")))

    def run(batches):
        powers = Powers()
        for batch in map(kept, slices(batches)):
            for part in batches_of_bytes([(t,) for t in _bytes_of(batch)]):
                flat, at = _shingles_of([x[0] for x in part], powers, n, "space")
                some = np.flatnonzero(np.diff(at))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(set_keys(flat, at)[some]), pa.array(np.diff(at)[some]), pa.ListArray.from_arrays(pa.array(np.append(at[some], at[-1]).astype(np.int32)), pa.array(flat.view(np.int64)))], ["key", "n", "s"]
                )

    return docs.select(F.xxhash64("doc_id").alias("h"), "text").mapInArrow(run, "key long, n long, s array<long>")


def _described_sets(sets: DataFrame, percent: int) -> DataFrame:
    """key, sigs and near of sets (key, s)."""

    def run(batches):
        classes = size_classes(percent)
        for batch in slices(batches):
            keys = batch.column("key").to_numpy()
            sigs = [signatures(np.asarray(s, np.int64).view(np.uint64), percent, classes) for s in batch.column("s").to_pylist()]
            owner = np.repeat(np.arange(len(keys)), [len(x) for x in sigs])
            yield pa.RecordBatch.from_arrays([batch.column("key"), *local_stars(np.concatenate(sigs), owner, keys, len(keys))], ["key", "sigs", "near"])

    return sets.select("key", "s").mapInArrow(run, "key long, sigs array<long>, near array<long>")


def with_enough_shared(shingles: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """key of the sets that have enough shingles in common with any others to be linked with one.

    shingles: key, h (repeated rows don't matter); sizes: key, n. A linked set holds at least
    percent of a set's shingles, so one with fewer shingles that occur elsewhere has no link.
    """
    alone = shingles.groupBy("h").agg(F.min("key").alias("key"), F.max("key").alias("z")).where("key = z").groupBy("key").agg(F.count("*").alias("alone"))
    return sizes.join(alone, "key", "left").where(100 * (F.col("n") - F.coalesce("alone", F.lit(0))) >= percent * F.col("n")).select("key")


def t_occurrence(lists: list[np.ndarray], t: int, mu: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """Records in at least t of the sorted lists, and how often: DivideSkip.

    The longest lists are set aside; the others are merged, and what they hold often enough is
    looked up in the long ones by binary search.
    """
    lists = sorted((x for x in lists if len(x)), key=len)
    if len(lists) < t:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    aside = min(t - 1, int(t / (mu * np.log2(len(lists[-1]) + 1) + 1)))
    # setting lists aside pays only where they are longer than those merged
    long = [x for x in lists[len(lists) - aside :] if len(x) > 8] if aside else []
    short = lists[: len(lists) - len(long)]
    merged = np.sort(np.concatenate(short), kind="stable") if short else np.zeros(0, np.int64)
    start = np.flatnonzero(np.concatenate([[True], merged[1:] != merged[:-1]])) if len(merged) else np.zeros(0, np.int64)
    count = np.diff(np.append(start, len(merged)))
    keep = count >= t - len(long)
    ids, count = merged[start[keep]], count[keep]
    for left, x in zip(range(len(long), 0, -1), reversed(long)):
        keep = count >= t - left
        ids, count = ids[keep], count[keep]
        at = np.minimum(np.searchsorted(x, ids), len(x) - 1)
        count = count + (x[at] == ids)
    keep = count >= t
    return ids[keep], count[keep]


class _Roots:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x


def linked_in_block(sets: list[np.ndarray], queries: list[int], percent: int, cluster: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links between sets (of the same cluster, where these are given) that connect all that the queries' links connect.

    Where every set is a query, the first one's component is the main one: queries already in it
    are passed over, as a link between two of its members connects nothing new and sets outside
    search for themselves. Every other query searches all sets, and so do all queries where some
    sets are only searched.
    """
    passing = len(queries) == len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    all_s = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(all_s, kind="stable")
    values, posts = all_s[order], owner[order]
    uniq, start = np.unique(values, return_index=True)
    stop = np.append(start[1:], len(values))
    roots, out = _Roots(len(sets)), []
    for q in queries:
        if passing and q != queries[0] and roots.find(q) == roots.find(queries[0]):
            continue
        at = np.searchsorted(uniq, sets[q])
        t = -(-percent * len(sets[q]) // 100)
        ids, count = t_occurrence([posts[a:b] for a, b in zip(start[at], stop[at])], t)
        good = 100 * count >= percent * (size[q] + size[ids] - count)
        if cluster is not None:
            good &= cluster[ids] == cluster[q]
        for y in ids[good]:
            a, b = roots.find(q), roots.find(int(y))
            if a != b:
                roots.up[b] = a
                out.append((q, int(y)))
    return out


#: Groups of fewer shingles are searched together.
SMALL = 50_000


def _search(blocks: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) between keys, from rows cluster, block, key, s, first (order of search, null: only searched).

    The rows of a (cluster, block) lie together; tasks read group after group. Small ones share
    an index; links between different clusters don't count, so none depends on which share a task.
    """

    def links(groups):
        small, out = [], []
        for rows in groups:
            (small.extend if sum(len(r[1]) for r in rows) < SMALL else out.append)(rows)
        for rows in [*out, *([small] if small else [])]:
            first = np.array([np.nan if r[2] is None else r[2] for r in rows], float)
            queries = [int(i) for i in np.argsort(first, kind="stable") if not np.isnan(first[i])]
            for i, j in linked_in_block([r[1] for r in rows], queries, percent, np.array([r[3] for r in rows])) if queries else []:
                yield rows[i][0], rows[j][0]

    def batch_of(found):
        found = np.array(list(found), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_pydict({"a": pa.array(found[:, 0]), "b": pa.array(found[:, 1])})

    def run(batches):
        groups, held, last = [], 0, None
        for batch in slices(batches):
            flat, at = batch.column("s").flatten().to_numpy(), batch.column("s").offsets.to_numpy()
            at = at - at[0]
            for i, (c, b, k, f) in enumerate(zip(*(batch.column(x).to_pylist() for x in ("cluster", "block", "key", "first")))):
                if (c, b) != last:
                    if held > 4 * SMALL:
                        yield batch_of(links(groups))
                        groups, held = [], 0
                    groups.append([])
                    last = c, b
                if not groups[-1] or groups[-1][-1][0] != k:
                    groups[-1].append((k, flat[at[i] : at[i + 1]].copy(), f, c))
                    held += int(at[i + 1] - at[i])
        if groups:
            yield batch_of(links(groups))

    near = blocks.select("cluster", "block", "key", "s", "first").repartition("cluster", "block").sortWithinPartitions("cluster", "block", "key", F.col("first").asc_nulls_last())
    return near.mapInArrow(run, "a long, b long")


def candidate_edges(described: DataFrame) -> DataFrame:
    """Stars (a, b) over all keys that have a signature in common, from rows key, sigs, near (see local_stars); a = b for a key that repeats.

    All rows of a signature meet sorted in one shuffle, and each is tied to the least key. Runs
    of records have sent each of their signatures once, so a signature of very many records
    has few rows; the window over them is read in order and spills.
    """
    rows = described.where("key is not null")
    least = F.first("key").over(Window.partitionBy("sig").orderBy("key"))
    far = rows.select(F.explode("sigs").alias("sig"), "key").select(least.alias("a"), F.col("key").alias("b"), F.row_number().over(Window.partitionBy("sig").orderBy("key")).alias("k")).where("k > 1").select("a", "b")
    return far.union(rows.select(F.explode("near").alias("a"), F.col("key").alias("b"))).distinct()


def exact_components(sets: DataFrame, percent: int, block: int = BLOCK, rows: int | None = None, chunk: int = 1000) -> DataFrame:
    """(node, component) of the exact links within candidate clusters, from rows cluster, key, n, s (keys once).

    Each cluster's inverted lists are built in blocks of about block shingles and searched by
    DivideSkip. In a cluster of several blocks every block first searches for one common record;
    what isn't connected to it afterwards searches all blocks, in chunks of about chunk. rows: a
    bound of the number of sets, if known.
    """
    n_rows = rows
    shape = sets.groupBy("cluster").agg(F.ceil(F.sum("n") / block).cast("int").alias("blocks"), F.min("key").alias("root"))
    members = stage(sets.select("cluster", "key").join(shape, "cluster"), "shape", n_rows)
    every = sets.join(members.select("key", "blocks", "root"), "key")
    rank = F.when(F.col("key") == F.col("root"), 0).otherwise(1).cast("double")
    mine = every.select("cluster", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("block"), "key", "s", rank.alias("first"))
    hub = every.where("key = root and blocks > 1").select("cluster", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "key", "s", F.lit(0.0).alias("first"))
    links = stage(_search(mine.union(hub), percent), "links")
    comps = stage(connected_components(links, rows=n_rows), "linked", n_rows)
    # clusters of several blocks: what isn't connected to the common record searches all blocks
    many = members.where("blocks > 1").join(comps.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    main = many.where("key = root").select("cluster", F.col("component").alias("main"))
    rest = stage(many.join(main, "cluster").where("component <> main").select("cluster", "key", "blocks"), "rest", n_rows)
    if not rest.isEmpty():
        chunks = rest.groupBy("cluster").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"))
        q = rest.join(chunks, "cluster").withColumn("chunk", F.pmod(F.xxhash64("key", F.lit(1)), F.col("chunks")).cast("int"))
        ask = sets.join(q.select("key", "blocks", "chunk", "chunks"), "key").select("cluster", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"), "chunk", "chunks", "key", "s", F.lit(1.0).alias("first"))
        ask = ask.select("cluster", (F.col("b") * F.col("chunks") + F.col("chunk")).alias("block"), "key", "s", "first")
        held = every.join(chunks, "cluster").select("cluster", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("b"), "key", "s", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "chunks")
        held = held.select("cluster", (F.col("b") * F.col("chunks") + F.col("chunk")).alias("block"), "key", "s", F.lit(None).cast("double").alias("first"))
        more = stage(_search(ask.union(held), percent), "links")
        comps = stage(connected_components(links.union(more), rows=n_rows), "linked", n_rows)
    return comps


def _clusters(edges: DataFrame, name: str, rows: int) -> DataFrame:
    """(key, cluster) of the components of candidate edges."""
    e = stage(edges, "candidates", rows)
    out = stage(connected_components(e, rows=rows).select(F.col("node").alias("key"), F.col("component").alias("cluster")), name, rows)
    unstage(e)
    return out


def link_components(docs: DataFrame, n: int = N, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, class_key of each document; no link between different texts is lost.

    Equal sets are one record. Records that share a part of their set (see size_classes) are
    joined to candidate clusters. Passages that many texts share make large clusters without
    links: in clusters of more than block shingles, sets with too few shingles that occur
    elsewhere (fewer than the overlap T that a link takes) are left out, and the others are
    clustered anew. Each cluster's inverted lists are then built in blocks of bounded size and
    searched by DivideSkip. In a cluster of several blocks every block first searches for one
    common record; what isn't connected to it afterwards searches all blocks.
    Null and empty texts and texts without words have no set and are linked with nothing; their
    component is their own id. Rows with null ids take part, and a component of null ids only
    is null. Ties go to the smallest id; repeated rows are one record; very long texts are cut
    nowhere. Other columns of docs aren't read. An empty table gives no rows.
    """
    with arrow_batches(docs.sparkSession):
        return _link_components(docs, n, percent, block)


def _link_components(docs: DataFrame, n: int, percent: int, block: int) -> DataFrame:
    d = stage(_describe(docs, n, percent), "sets")
    slim = stage(d.select("doc_id", "n_shingles", "key"), "slim")
    total = slim.count()
    clusters = _clusters(candidate_edges(d), "clusters", total)
    unstage(d)
    reps = slim.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"))
    wanted = stage(reps.join(clusters, "key"), "wanted", total)
    large = wanted.groupBy("cluster").agg(F.sum("n").alias("all")).where(F.col("all") > block).select("cluster")
    crowd = stage(wanted.join(large, "cluster", "left_semi"), "crowd", total)
    if crowd.isEmpty():
        sets = _sets_of(docs, wanted, n).join(wanted.select("key", "cluster"), "key")
    else:
        rest = stage(wanted.join(large, "cluster", "left_anti"), "rest", total)
        shingles = _sets_of(docs, crowd, n).select("key", F.explode("s").alias("h"))
        alive = stage(crowd.join(with_enough_shared(shingles, crowd, percent), "key"), "alive", total)
        again = stage(_sets_of(docs, alive, n).join(alive.select("key"), "key").dropDuplicates(["key"]), "again")
        anew = _clusters(candidate_edges(_described_sets(again, percent)), "anew", total)
        sets = _sets_of(docs, rest, n).join(rest.select("key", "cluster"), "key").unionByName(again.join(anew, "key"))
    sets = stage(sets.select("cluster", "key", "n", "s").dropDuplicates(["key"]), "members")
    comps = exact_components(sets, percent, block, total)
    unstage(sets)
    narrow = slim.join(comps.select(F.col("node").alias("key"), "component"), "key", "left").withColumn("class_key", F.coalesce("component", "key"))
    narrow = stage(narrow.select("doc_id", "n_shingles", "class_key"), "classes", total)
    least = narrow.where("class_key is not null").groupBy("class_key").agg(F.min("doc_id").alias("component_id"))
    least = stage(least, "least", total)  # read from files, so that Spark can split a hot class in the join
    out = narrow.join(least, "class_key", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("class_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "class_key")


def one_of_each(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component of near duplicates: that of the smallest doc_id; all columns stay.

    Rows with neither text nor words are linked with nothing and stay. Of rows with equal id
    and text one stays (any, where other columns differ). Columns may have any names; an empty
    table gives no rows.
    """
    me, gone, twice = spare(docs.columns, "me", "gone", "twice")
    tagged = docs.withColumn(me, F.struct("doc_id", F.xxhash64("text").alias("t")))
    c = stage(link_components(tagged.select(F.col(me).alias("doc_id"), "text"), n, percent), "components", docs.count())
    others = c.where("class_key is not null and not (doc_id <=> component_id)").select(F.col("doc_id").alias(gone)).distinct()
    kept = tagged.join(others, F.col(me).eqNullSafe(F.col(gone)), "left_anti")
    again = stage(c.where("class_key is not null and doc_id <=> component_id").groupBy(F.col("doc_id").alias(twice)).count().where("count > 1").select(twice), "repeated", 1)
    if not again.isEmpty():
        same = F.col(me).eqNullSafe(F.col(twice))
        kept = kept.join(again, same, "left_anti").union(kept.join(again, same, "left_semi").dropDuplicates([me]))
    return kept.select(*docs.columns)
