import random
import re

import pytest

from latticework.llm import ngram_join as J
from latticework.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size=3):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def brute(docs, percent=90):
    sets, up = [shingles(t) for _, t in docs], list(range(len(docs)))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for i, x in enumerate(sets):
        for j in range(i):
            if x and 100 * len(x & sets[j]) >= percent * len(x | sets[j]):
                up[find(i)] = find(j)
    low = {}
    for i, (doc_id, _) in enumerate(docs):
        low.setdefault(find(i), []).append(doc_id)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in low.items()}
    return sorted(((d[0], len(sets[i]), least[find(i)]) for i, d in enumerate(docs)), key=str)


def corpus(seed, n):
    rng, docs = random.Random(seed), []
    word = lambda: rng.choice(["the", "É", "of"]) if rng.random() < 0.3 else f"w{rng.randrange(3000)}"
    passage = [word() for _ in range(25)]
    while len(docs) < n:
        text = [word() for _ in range(rng.choice([2, 5, 12, 40, 120]))]
        text += passage if rng.random() < 0.4 else []
        for _ in range(rng.choice([1, 1, 2, 6])):
            near = list(text)
            for _ in range(rng.randrange(3)):
                near[rng.randrange(len(near))] = word()
            docs.append((len(docs), rng.choice([" ", "\n", "\t "]).join(near)))
            text = near
    return docs


ODD = [(None, None), (1000, None), (1001, ""), (1002, " \n"), (1003, "one"), (1004, "ONE"), (1005, "one two"), (None, "null id text is here"), (None, "null id text is here"), (1006, "null ids other text is here"), (7, "again seven with another text")]


@pytest.mark.parametrize("seed,block", [(1, 2000), (2, 5), (3, 2)])
def test_equals_brute_force(spark, seed, block):
    docs = corpus(seed, 150) + ODD
    docs += [docs[3], docs[3], (2000, docs[3][1].upper()), (2001, "long " * 5000 + docs[3][1])]
    long = [f"z{k}" for k in range(300)]
    docs += [(3000 + k, " ".join(long[: k % 7] + ["x%d" % k] + long[k % 7 + 1 :])) for k in range(30)]  # one large group
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, key int").repartition(5)
    got = J.similar_components(frame, block=block).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(docs)


def test_keys_that_several_sets_share(spark, monkeypatch):
    monkeypatch.setattr(J, "set_key", lambda hashes, seed=0: int(hashes[0] % 5) if seed == 0 else J.xxhash.xxh64_intdigest(hashes.tobytes(), seed) - (1 << 63))
    docs = corpus(6, 60) + [(k + 500, f"copy of {k % 5} and more words in it") for k in range(40)]
    rows = [(k, len(s := J.shingles(t.encode())), J.set_key(s), J.set_key(s, 1), s.view("int64").tolist()) for k, t in docs]
    base, keys, several = J.keys_of(spark.createDataFrame(rows, "doc_id long, n_shingles long, key long, check long, hashes array<long>"))
    assert several is not None and keys.count() == len({tuple(r[4]) for r in rows}) and not keys.where("several").count()
    assert base.select("key").distinct().count() == keys.count()


def test_joins_with_hot_keys(spark, monkeypatch):
    from latticework.llm import common

    left = spark.createDataFrame([(k % 3 if k < 50 else k, k) for k in range(80)], "k long, v long")
    right = spark.createDataFrame([(0, "a", 17), (1, None, 17), (60, "c", 1), (999, "d", 0)], "k long, w string, n long")
    want = {(r.k, r.v): {0: "a", 60: "c"}.get(r.k) for r in left.collect()}
    for most in (10, 10**9):
        monkeypatch.setattr(common, "HOT_ROWS", 10)
        got = common.joined_by(left, right, "k", 80, most).collect()
        assert {(r.k, r.v): r.found and r.found.w for r in got} == want and len(got) == 80
        assert all((r.found is not None) == (r.k in (0, 1, 60)) for r in got)


def test_other_similarity_and_size(spark):
    docs = corpus(4, 120)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = J.similar_components(frame, percent=70, block=7).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(docs, 70)


def test_empty(spark):
    assert J.similar_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    rng = random.Random(9)
    edges = [(k, k + 1) for k in range(100, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(50)] + [(300, k) for k in range(301, 400)] + [(5, 5)]
    up = {x: x for e in edges for x in e}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in edges:
        up[max(find(a), find(b))] = min(find(a), find(b))
    want = {(x, find(x)) for x in up if any(x in e and e[0] != e[1] for e in edges)}
    assert {tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == want
