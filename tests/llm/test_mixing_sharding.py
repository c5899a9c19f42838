import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pandas as pd
import pytest

from latticework.llm import mixing, sharding
from latticework.llm.oracles import OP5

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed, n=300):
    rng = random.Random(seed)
    rows = [(k, "w " * int(rng.paretovariate(1.1) * 3), rng.choice(["a", "a", "a", "b", "c", "d", "Z", "é", None])) for k in range(n)]
    return rows + [(None, "null id", "a"), (5, rows[5][1], rows[5][2]), (900, None, "b"), (901, "", "only empty"), (902, None, None)]


@pytest.mark.parametrize("seed,per_bucket", [(1, 20000), (2, 5)])
def test_mix_equals_sql(spark, seed, per_bucket, monkeypatch):
    monkeypatch.setattr(mixing, "PER_BUCKET", per_bucket)
    monkeypatch.setattr(mixing, "CHUNK", 7)
    rows = corpus(seed) + [(None, "one text without an id", "a")] * 40 + [(7, "repeated", "b"), (7, "another text", "b")] * 3 + [(None, " ", "c")] * 20
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})  # noqa: F841  the SQL reads it
    want = duckdb.sql(OP5).fetchall()
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, size int, taken int").repartition(3)
    got = mixing.mixed(df).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    by = defaultdict(list)
    for r in mixing.mixed(df).collect():
        assert r.taken <= 3 * r.size and r.taken == r.copies * r.size
        by[r.src].append(r)
    for rows_of in by.values():
        assert rows_of[0].target <= 3 * rows_of[0].source_size + 1e-6
        assert abs(sum(r.taken for r in rows_of) - rows_of[0].target) <= 2 * max(r.size for r in rows_of) + 1


def test_targets_share_the_budget(spark):
    sizes = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("c", 500, 2), ("d", 0, 1), (None, 50, 1)], "src string, size long, rows long")
    got = {r.src: r for r in mixing.source_targets(sizes).collect()}
    assert got["a"].target == got["b"].target == 3 and got["d"].target == 0
    assert sum(r.target for r in got.values()) == pytest.approx(1052)
    assert got[None].target == pytest.approx(150)


def test_empty_mix(spark):
    assert mixing.mixed(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    assert [tuple(r) for r in mixing.mixed(spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")).select("size", "target", "taken").collect()] == [(0, 0.0, 0)]


def greedy(sizes, capacity):
    n, used = 1, 0
    for s in sizes:
        if s > capacity:
            return 10**9
        if used + s > capacity:
            n, used = n + 1, 0
        used += s
    return n


@pytest.mark.parametrize("seed,per_salt", [(3, 20000), (4, 7)])
def test_shards(spark, seed, per_salt, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_SALT", per_salt)
    monkeypatch.setattr(sharding, "CELLS_PER_SHARD", 2 if per_salt == 7 else 512)
    rng = random.Random(seed)
    rows = [(k, "".join(rng.choice("abcé\n") for _ in range(int(rng.paretovariate(1) * 20)))) for k in range(500)]
    rows += [(1000 + k, "copies of one text " * 20) for k in range(60)] + [(None, None), (2000, None), (2001, ""), (3, rows[3][1])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, size string").repartition(4)
    got = sharding.shard(df).collect()
    data = [(d, (t or "").encode()) for d, t in rows]
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(d), len(t) + 1, zlib.crc32(t)) for d, t in data)
    line = Counter()
    for _, t in data:
        line[hashlib.md5(t).hexdigest()] += len(t) + 1
    sizes = [line[c] for c in sorted(line)]
    capacity = got[0].capacity
    assert greedy(sizes, capacity) <= 8 < greedy(sizes, capacity - 1)
    shard_size, slots, shard_of = Counter(), defaultdict(list), {}
    for r in got:
        shard_size[r.shard] += r.size
        slots[r.shard].append(r.slot)
        assert shard_of.setdefault((r.text_crc32, r.size), r.shard) == r.shard
    assert max(shard_size.values()) <= capacity
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    order = {(zlib.crc32(t), len(t) + 1): hashlib.md5(t).hexdigest() for _, t in data}
    in_order = sorted((order[k], s) for k, s in shard_of.items())
    assert [s for _, s in in_order] == sorted(s for _, s in in_order)


def least_capacity(sizes, shards):
    """The least capacity of a greedy pass in which a group above it fills a shard alone."""

    def needed(c):
        n, used = 1, 0
        for s in (min(s, c) for s in sizes):
            n, used = (n + 1, s) if used + s > c else (n, used + s)
        return n

    low, high = 1, sum(sizes)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if needed(middle) <= shards else (middle + 1, high)
    return high


@pytest.mark.parametrize("seed", range(6))
def test_capacity_is_that_of_single_groups(spark, seed, monkeypatch):
    monkeypatch.setattr(sharding, "CELLS_PER_SHARD", [2, 8, 32][seed % 3])
    rng = random.Random(seed)
    rows = [(k, f"{k} " + "x" * int(rng.paretovariate(1) * 10)) for k in range(700)] + [(None, "one hot text " * 5)] * [0, 30, 2000][seed // 2]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    line = Counter()
    for _, t in rows:
        line[hashlib.md5(t.encode()).hexdigest()] += len(t) + 1
    sizes = [line[c] for c in sorted(line)]
    shards = [5, 8][seed % 2]
    measured = sharding.stored(sharding.measured(df), "rows")
    assert sharding.searched(measured, shards)[1] == least_capacity(sizes, shards)


def test_no_rows_and_one_row(spark):
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert [(r.size, r.slot) for r in sharding.shard(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()] == [(1, 0)]


def test_one_huge_group_leaves_the_others_even(spark):
    rng = random.Random(8)
    rows = [(k, "".join(rng.choice("abcdef ") for _ in range(40))) for k in range(3000)] + [(5000 + k, "the same text again and again and again") for k in range(1500)]
    sizes = Counter()
    for r in sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        sizes[r.shard] += r.size
    huge = 1500 * 40
    assert len(sizes) == 8 and max(sizes.values()) < huge + 2000
    others = sorted(sizes.values())[:-1]
    assert others[-1] < 1.6 * others[1]
