"""N-gram Jaccard join with prefix trees.

A document's set holds the 64-bit hashes of its distinct word shingles. Two sets can only reach the similarity if their prefixes share a
shingle: the first ``n - ceil(similarity * n) + 1`` of n in one global order. That order is by rarity, so most documents have a prefix
of shingles that nobody else has, and drop out exactly:

1. Every document emits its shingles of the lowest LOW_SHARE of hashes (or twice the share that a prefix takes, if that is more). Which of those stand in one set only is then known exactly, and
   a set with a whole prefix of them can have no partner.
2. The others are read again and emit all shingles; those shared with another such set are ranked by rarity, and only sets that still
   have shared shingles in their prefix stay. Sets that share one there fall into one cluster.
3. The sets of a cluster meet as a trie, most frequent shingles first, so that near copies share long paths. Each set walks the trie,
   adding up its overlap once for a whole subtree, and leaves a subtree whose remaining length cannot reach the needed overlap.

Equal sets count as one throughout. A task holds BLOCK_SETS sets and BLOCK_SHINGLES shingles of a cluster at most, or one set that has more:
a larger cluster is joined in blocks, its blocks' components through one set of each. What can still be linked then is a set outside the
cluster's largest component, and such sets meet others only where they share a shingle of both prefixes, in blocks again. So the work of a
cluster that a common passage chains together grows with its sets and not with their pairs. Nothing is dropped or capped.

A shingle set is known by 128 bits of hashes: a 64-bit key, and a 64-bit check by which sets that share a key are told apart.

Defined cases: a null text or one without words has an empty set and is linked with nothing; fewer words than a shingle make one
shingle; repeated rows and rows with one doc_id each get a row of the result; the component of rows that have only null ids is null,
else null ids are passed over; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latticework.llm.common import give_back, joined_by, small, stored
from latticework.llm.components import components

SHINGLE = 3
#: The similarity in per cent.
PERCENT = 90
LOW_SHARE = 0.2
BLOCK_SETS, BLOCK_SHINGLES = 2000, 4_000_000
#: Ids that are broadcast at most (16 MB of numbers).
BROADCAST_IDS = 1_000_000
#: Words that a task remembers; it forgets them when there are more, and at its end.
CACHED_WORDS = 200_000


# ---- shingles -------------------------------------------------------------------------------------------------------------------


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_hashes = _Hashes()
_MUL = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MUL[2]
    x = (x ^ (x >> np.uint64(33))) * _MUL[3]
    return x ^ (x >> np.uint64(33))


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of the shingles of a text, A-Z lower-cased."""
    if len(_hashes) > CACHED_WORDS:
        _hashes.clear()
    words = text.lower().split()  # of bytes: ASCII letters, ASCII white space
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    width = min(size, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        out = _mixed(out * _MUL[0] + h[k : k + len(out)])
    return np.unique(out)


def set_key(hashes: np.ndarray, seed: int = 0) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), seed) - (1 << 63)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=ends[1:])
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64)))


def sets_of(docs: DataFrame, size: int = SHINGLE, share: float = 1.0) -> DataFrame:
    """doc_id, n_shingles, key and check (null for the empty set) and hashes, those below the share of all hashes, one row per row."""
    schema = T.StructType([docs.select("doc_id").schema[0], *T.StructType.fromDDL("n_shingles long, key long, check long, hashes array<long>")])
    most = np.uint64(min(int(share * 2**64), 2**64 - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                found = [shingles(t.as_py() or b"", size) for t in batch.column(1).cast(pa.binary())]
                keys, checks = (pa.array([set_key(s, seed) if len(s) else None for s in found], pa.int64()) for seed in (0, 1))
                low = _lists([s[: np.searchsorted(s, most, "right")] for s in found])
                counts = pa.array([len(s) for s in found], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), counts, keys, checks, low], names=["doc_id", "n_shingles", "key", "check", "hashes"])
        _hashes.clear()
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


# ---- candidate clusters ---------------------------------------------------------------------------------------------------------


def _prefix(percent: int):
    """Length of the prefix of a set of n_shingles."""
    return F.col("n_shingles") - F.ceil(F.col("n_shingles") * percent / 100) + 1


def keys_of(base: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """base, with a key for each set; key, n_shingles, doc_id (the smallest) and n (rows) of each set; and the keys that had several sets, if any."""

    def counted(rows: DataFrame) -> DataFrame:
        aggregates = F.first("n_shingles").alias("n_shingles"), F.min("doc_id").alias("doc_id"), F.count("*").alias("n"), (F.min("check") < F.max("check")).alias("several")
        return stored(rows.where("key is not null").groupBy("key").agg(*aggregates), "join-keys")

    keys = counted(base)
    several = keys.where("several").select(F.col("key").alias("several_key"))
    n = several.count()
    if not n:
        return base, keys, None
    several = small(several, n)
    base = told_apart(base, several)
    return base, counted(base), several


def told_apart(sets: DataFrame, several: DataFrame | None) -> DataFrame:
    """sets, in which a key that several sets have is replaced by one made with the check."""
    if several is None:
        return sets
    met = sets.join(several, F.col("key") == F.col("several_key"), "left")
    return met.withColumn("key", F.when(F.col("several_key").isNotNull(), F.xxhash64("key", "check")).otherwise(F.col("key"))).drop("several_key")


def _survivors(base: DataFrame, keys: DataFrame, percent: int) -> DataFrame:
    """key, n_shingles and a doc_id of the sets without a whole prefix of shingles that stand in no other set."""
    tokens = base.select("key", F.explode("hashes").alias("token"))
    alone = tokens.groupBy("token").agg(F.min("key").alias("key"), F.max("key").alias("other")).where("key = other")
    own = alone.groupBy("key").agg(F.count("*").alias("n_own"))
    return keys.select("key", "n_shingles", "doc_id").join(own, "key", "left").where(F.coalesce("n_own", F.lit(0)) < _prefix(percent)).drop("n_own")


def candidate_sets(docs: DataFrame, base: DataFrame, keys: DataFrame, several: DataFrame | None, size: int, percent: int) -> DataFrame:
    """key, n_shingles, ranked (the shingles shared with other candidates, rarest first) and n_prefix, how many of those are in its prefix."""
    left = stored(_survivors(base, keys, percent), "join-survivors")
    n_left = left.count()
    ids = left.select(F.col("doc_id").alias("left_id")).distinct()
    again = docs.select("doc_id", "text").join(small(ids, n_left, BROADCAST_IDS), F.col("doc_id").eqNullSafe(F.col("left_id")), "left_semi")
    again = told_apart(sets_of(again, size), several)
    tokens = again.join(small(left.select("key"), n_left, BROADCAST_IDS), "key", "left_semi").select("key", "n_shingles", F.explode("hashes").alias("token"))
    tokens = stored(tokens, "join-tokens")
    shared = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    ranked = (
        tokens.join(shared, "token")
        .groupBy("key")
        .agg(F.first("n_shingles").alias("n_shingles"), F.array_sort(F.collect_set(F.struct("df", "token"))).alias("ranked"))  # one set's shingles
        .withColumn("n_prefix", _prefix(percent) - (F.col("n_shingles") - F.size("ranked")))
        .where("n_prefix > 0")
    )
    return ranked.select("key", "n_shingles", F.transform("ranked", lambda x: x["token"]).alias("ranked"), F.col("n_prefix").cast("int").alias("n_prefix"))


def clusters_of(sets: DataFrame) -> DataFrame:
    """key and cluster: sets that share a shingle of their prefixes are in one cluster; those that share none have no row."""
    tokens = sets.select("key", F.explode(F.slice("ranked", F.lit(1), F.col("n_prefix"))).alias("token"))
    centre = tokens.groupBy("token").agg(F.min("key").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    return components(tokens.join(centre, "token").select(F.col("key").alias("a"), "b")).select(F.col("node").alias("key"), F.col("root").alias("cluster"))


# ---- the trie join --------------------------------------------------------------------------------------------------------------


class _Node:
    """A path of shingles (as local ranks), what hangs below it, and bounds over all sets that end in its subtree."""

    __slots__ = ("path", "kids", "ends", "least", "most", "rest")

    def __init__(self, path: np.ndarray):
        self.path, self.kids, self.ends = path, [], []
        self.least, self.most, self.rest = 1 << 60, 0, 0


def build_trie(sequences: list[np.ndarray], sizes: list[int]) -> _Node:
    """A radix tree of increasing sequences."""
    order = sorted(range(len(sequences)), key=lambda i: sequences[i].astype(">i4").tobytes())
    root = _Node(np.zeros(0, np.int32))
    made, todo = [root], [(root, 0, len(order), 0)]  # a node, the sequences below it, and how much of them is above
    while todo:
        node, lo, hi, depth = todo.pop()
        while lo < hi and len(sequences[order[lo]]) == depth:
            node.ends.append(order[lo])
            lo += 1
        while lo < hi:
            token = sequences[order[lo]][depth]
            end = lo + 1
            while end < hi and sequences[order[end]][depth] == token:
                end += 1
            first, last = sequences[order[lo]], sequences[order[end - 1]]
            both = min(len(first), len(last))
            differ = np.flatnonzero(first[depth:both] != last[depth:both])
            stop = depth + int(differ[0]) if len(differ) else both
            kid = _Node(first[depth:stop])
            node.kids.append(kid)
            made.append(kid)
            todo.append((kid, lo, end, stop))
            lo = end
    for node in reversed(made):  # kids come after their parents
        for i in node.ends:
            node.least, node.most = min(node.least, sizes[i]), max(node.most, sizes[i])
        for kid in node.kids:
            node.least, node.most = min(node.least, kid.least), max(node.most, kid.most)
            node.rest = max(node.rest, len(kid.path) + kid.rest)
    return root


class Forest:
    """Disjoint sets of 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, a: int) -> int:
        while self.up[a] != a:
            self.up[a] = a = self.up[self.up[a]]
        return a

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def link(sequences: list[np.ndarray], sizes: list[int], forest: Forest, queries: list[int], percent: int, n_ranks: int) -> None:
    """Joins in the forest every pair of a query and a set of the trie that reach the similarity."""
    root = build_trie(sequences, sizes)
    has = np.zeros(n_ranks, bool)
    find = forest.find
    for q in queries:
        mine, n = sequences[q], sizes[q]
        has[mine] = True
        todo = [(root, 0)]
        while todo:
            node, overlap = todo.pop()
            if len(node.path):
                overlap += int(np.count_nonzero(has[node.path]))
                left = len(mine) - int(np.searchsorted(mine, node.path[-1], "right"))
            else:
                left = len(mine)
            if 100 * node.most < percent * n or percent * node.least > 100 * n:
                continue
            if (100 + percent) * (overlap + min(left, node.rest)) < percent * (n + node.least):
                continue
            for i in node.ends:
                if find(i) != find(q) and (100 + percent) * overlap >= percent * (n + sizes[i]):
                    forest.join(i, q)
            todo += [(kid, overlap) for kid in node.kids]
        has[mine] = False


def _join_group(rows: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Links (a, b) that connect what is similar among rows (key, n_shingles, hashes, component, is a query); a row in a component is linked to its others already."""
    hashes = [np.asarray(r[2], np.int64) for r in rows]
    values, inverse, counts = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
    rank = np.empty(len(values), np.int32)
    rank[np.lexsort((values, -counts))] = np.arange(len(values), dtype=np.int32)  # frequent ones first: long common paths
    ends = np.cumsum([len(h) for h in hashes])
    sequences = [np.sort(part) for part in np.split(rank[inverse.ravel()], ends[:-1])]
    forest, seen = Forest(len(rows)), {}
    for i, r in enumerate(rows):
        if r[3] is not None:
            forest.join(i, seen.setdefault(r[3], i))
    link(sequences, [r[1] for r in rows], forest, [i for i, r in enumerate(rows) if r[4]], percent, len(values))
    return [(rows[i][0], rows[forest.find(i)][0]) for i in range(len(rows)) if forest.find(i) != i]


def linked(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) within each (cluster, part) of members, which has also key, n_shingles, ranked, component and asks.

    The rows of a part reach one task, sorted, and are joined as the part ends; a part is BLOCK_SETS or twice as many sets at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, out = None, {}, []
        for batch in batches:
            for row in zip(*(c.to_pylist() if k != 4 else [x.values.to_numpy() for x in c] for k, c in enumerate(batch.columns)), strict=True):
                if row[:2] != at:
                    out += _join_group(list(rows.values()), percent) if len(rows) > 1 else []
                    at, rows = row[:2], {}
                rows[row[2]] = row[2:] if row[2] not in rows else rows[row[2]][:4] + (rows[row[2]][4] or row[6],)
            if len(out) > 10_000:
                yield _edges(out)
                out = []
        out += _join_group(list(rows.values()), percent) if len(rows) > 1 else []
        yield _edges(out)
        give_back()

    dealt = members.select("cluster", "part", "key", "n_shingles", "ranked", "component", "asks").repartition("cluster", "part").sortWithinPartitions("cluster", "part")
    return dealt.mapInArrow(run, "a long, b long")


def _edges(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], names=["a", "b"])


def _blocks(sets, shingles, block: int):
    """How many blocks hold so many sets of so many shingles."""
    return F.greatest(F.ceil(sets / block), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")


def links(sets: DataFrame, clusters: DataFrame, percent: int = PERCENT, block: int = BLOCK_SETS) -> DataFrame:
    """Links (a, b) between keys that connect exactly the sets that similarity connects."""
    members = clusters.join(sets.withColumn("length", F.size("ranked")), "key")
    counted = clusters.join(sets.select("key", F.size("ranked").alias("length")), "key").groupBy("cluster").agg(F.count("*").alias("n_sets"), F.sum("length").alias("n_shingles"))
    blocks = counted.select("cluster", _blocks(F.col("n_sets"), F.col("n_shingles"), block).alias("blocks"))
    members = members.join(blocks, "cluster").withColumn("part", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("string"))
    members = stored(members.select("cluster", "blocks", "part", "key", "n_shingles", "ranked", "n_prefix", "length"), "join-members")
    none, yes = F.lit(None).cast("long"), F.lit(True)
    found = stored(linked(members.withColumn("component", none).withColumn("asks", yes), percent), "join-links")
    large = members.where("blocks > 1")
    if large.isEmpty():
        return found
    # One set for each component of a block, in blocks again: copies of one text become one component here.
    found = found.union(_between(large, found, percent, block))
    # What is left: sets outside the largest component of their cluster, against those with which they share a shingle of both prefixes.
    comps = _with_components(large, found)
    sizes = comps.groupBy("cluster", "component").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("cluster").agg(F.max(F.struct("n", "component"))["component"].alias("largest"))
    comps = stored(comps.join(largest, "cluster"), "join-comps")
    token = F.explode(F.slice("ranked", F.lit(1), F.col("n_prefix"))).alias("token")
    ends = stored(comps.select("key", "length", (F.col("component") != F.col("largest")).alias("asks"), token), "join-prefixes")
    groups = ends.groupBy("token").agg(F.count("*").alias("n"), F.sum("length").alias("n_all"), F.count_if("asks").alias("n_asks"), F.sum(F.when(F.col("asks"), F.col("length"))).alias("n_asked"))
    groups = groups.where("n > 1 and n_asks > 0").select("token", _blocks(F.col("n"), F.col("n_all"), block).alias("blocks"), _blocks(F.col("n_asks"), F.col("n_asked"), block).alias("groups"))
    met = ends.select("key", "token", "asks").join(groups, "token")
    at, group = (F.pmod(F.xxhash64("key", F.lit(k)), F.col(c)).cast("int") for k, c in ((2, "blocks"), (3, "groups")))
    asked = met.withColumn("block", at).withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    asking = met.where("asks").withColumn("group", group).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    both = asked.select("key", "token", "block", "group", F.lit(False).alias("asks")).union(asking.select("key", "token", "block", "group", yes.alias("asks")))
    part = F.concat_ws("/", "block", "group").alias("part")
    rows = both.join(comps.select("key", "n_shingles", "ranked", "component"), "key").select(F.col("token").alias("cluster"), part, "key", "n_shingles", "ranked", "component", "asks")
    return found.union(stored(linked(rows, percent), "join-rest"))


def _with_components(members: DataFrame, found: DataFrame) -> DataFrame:
    roots = components(found).select(F.col("node").alias("key"), "root")
    return members.join(roots, "key", "left").withColumn("component", F.coalesce("root", "key")).drop("root")


def _between(large: DataFrame, found: DataFrame, percent: int, block: int) -> DataFrame:
    """Links between one set of each component in each block."""
    comps = _with_components(large, found)
    one = comps.groupBy("cluster", "part", "component").agg(F.min(F.struct("key", "length")).alias("one"))
    counts = one.groupBy("cluster").agg(F.count("*").alias("n_one"), F.sum("one.length").alias("n_shingles"))
    pivots = one.join(counts, "cluster").select("cluster", F.col("one.key").alias("key"), _blocks(F.col("n_one"), F.col("n_shingles"), block).alias("blocks"))
    pivots = pivots.withColumn("part", F.pmod(F.xxhash64("key", F.lit(1)), F.col("blocks")).cast("string")).drop("blocks")
    rows = large.select("key", "n_shingles", "ranked").join(pivots, "key").withColumn("component", F.lit(None).cast("long")).withColumn("asks", F.lit(True))
    return stored(linked(rows, percent), "join-pivots")


# ---- the operator ---------------------------------------------------------------------------------------------------------------


def similar_components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, block: int = BLOCK_SETS) -> DataFrame:
    """doc_id, n_shingles, key (of the set) and component_id, the smallest doc_id that links of the similarity reach, one row per row of docs."""
    share = min(1.0, max(LOW_SHARE, 2 * (100 - percent) / 100))  # below a prefix's share no set would drop out
    base, keys, several = keys_of(stored(sets_of(docs, size, share), "join-sets"))
    sets = stored(candidate_sets(docs, base, keys, several, size, percent), "join-candidates")
    found = links(sets, stored(clusters_of(sets), "join-clusters"), percent, block)
    roots = stored(components(found).select(F.col("node").alias("key"), "root"), "join-roots")
    n_roots = roots.count()
    rooted = stored(keys.join(small(roots, n_roots), "key").select("key", "root", "doc_id", "n"), "join-rooted")
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    linked_keys = joined_by(rooted.withColumnRenamed("n", "rows"), least, "root", n_roots, n_roots).select("key", F.col("found.least").alias("least"), F.col("rows").alias("n"))
    copies = keys.where("n > 1").join(small(roots.select("key"), n_roots), "key", "left_anti").select("key", F.col("doc_id").alias("least"), "n")
    special = stored(linked_keys.unionByName(copies), "join-least")
    out = joined_by(base.select("doc_id", "n_shingles", "key"), special, "key", keys.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], special.count())
    return out.select("doc_id", "n_shingles", "key", F.when(F.col("found").isNull(), F.col("doc_id")).otherwise(F.col("found.least")).alias("component_id"))
