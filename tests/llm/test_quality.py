import math
import re
import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from latticework.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    marked = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked)


def counted(text):
    data = text.encode()
    words = data.split()
    return Q.counts(data, words, Q._numbered(words))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "é", "x#", " ", " ", "\n", "\n", "\t", "\x0b", "\x1c", " ", " ", "😀", "a b a b a b a b ", "<|"]), max_size=60))
def test_counts(parts):
    text = "".join(parts)
    assert counted(text) == brute(text)


def test_counts_of_long_repetition():
    text = "one two three four five six seven eight nine\n" * 2000
    assert counted(text) == brute(text)


FULL = 1 << 64


def plain_mix(x):
    x = (x ^ x >> 33) * 0xFF51AFD7ED558CCD % FULL
    x = (x ^ x >> 33) * 0xC4CEB9FE1A85EC53 % FULL
    return x ^ x >> 33


def plain_buckets(text):
    h = [zlib.crc32(w) | zlib.crc32(w[::-1]) << 32 for w in (x.encode() for x in WORD.findall(text or ""))]
    pairs = [(a * 0x9E3779B97F4A7C15 + b + 1) % FULL for a, b in zip(h, h[1:], strict=False)]
    return [plain_mix(x) % Q.BUCKETS for x in h + pairs]


def plain_verdicts(rows, trusted, held):
    """kept of each (doc_id, text) row, by counters of Python alone."""
    raw, good = Counter(), Counter()
    for i, text in rows:
        raw.update(plain_buckets(text))
        good.update(plain_buckets(text) if i in trusted else [])
    share = good.total() / max(1, raw.total())
    ratio = {b: math.log((good[b] + Q.PRIOR) / (n * share + Q.PRIOR)) for b, n in raw.items()}
    failed = [(m := brute(text or ""))[0] < 20 or 100 * m[4] > 30 * m[0] for _, text in rows]
    scores = [sum(ratio[b] for b in found) / len(found) if (found := plain_buckets(text)) else 0.0 for _, text in rows]
    known = sorted({(i, s) for (i, _), s, f in zip(rows, scores, failed, strict=True) if i in held and not f})
    known = sorted(s for _, s in known)
    at = Q.LOST * (len(known) - 1)
    bound = known[int(at)] + (at % 1) * (known[min(int(at) + 1, len(known) - 1)] - known[int(at)]) if known else -math.inf
    return [not f and s >= bound - 1e-12 for s, f in zip(scores, failed, strict=True)], bound


def test_model_and_cases(spark):
    good = [(i, f"the good clean text of number {i} has many fine words in it " + " ".join(f"w{(i * 7 + k) % 90}" for k in range(40)), "x") for i in range(60)]
    bad = [(100 + i, " ".join(f"Z{(i + k) % 50}!!" for k in range(60)), "x") for i in range(20)]
    rest = [(None, None, "x"), (200, "", "x"), (201, "short", None), (0, good[0][1], "x"), (202, "long words " + " ".join(f"w{k * 7 % 90}" for k in range(9000)), "x")]
    docs = spark.createDataFrame(good + bad + rest, "doc_id long, text string, kept string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(100, 0, 0), (None, 1, 0), (101, None, None), (3, 0, 0)], "doc_id long, quality int, toxic int")
    sides = {r.trusted_id: r.held for r in Q.trusted_ids(labels).collect()}
    assert set(sides) == set(range(30)) - {3} and 5 < sum(sides.values()) < 24
    model = Q.fit(docs, labels)
    rows = [(i, text) for i, text, _ in good + bad + rest]
    want, bound = plain_verdicts(rows, {i for i, held in sides.items() if not held}, {i for i, held in sides.items() if held})
    assert math.isclose(model.bound, bound, abs_tol=1e-9) and any(want) and not all(want)
    found = Q.assess(docs, model).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.doc_id, r.kept) for r in found), key=key) == sorted(((i, k) for (i, _), k in zip(rows, want, strict=True)), key=key)
    assert not any(r.kept for r in found if r.doc_id in range(100, 120))
    assert sum(r.kept for r in found if r.doc_id in range(60)) >= 58
    assert [r.n_words for r in found if r.doc_id is None] == [0]
    left = Q.passing(docs, model)
    assert left.columns == docs.columns and left.count() == sum(want)
    assert Q.assess(docs.limit(0), model).count() == 0
    blank = Q.fit(docs, labels.limit(0))
    assert Q.assess(docs, blank).where("not base_failed and not kept").count() == 0
    assert Q.fit(docs.limit(0), labels.limit(0)).bound == -math.inf


def test_trusted_rows_are_bounded_and_the_lowest(spark):
    labels = spark.range(5000).selectExpr("id as doc_id", "1 as quality", "0 as toxic")
    got = {r.trusted_id for r in Q.trusted_ids(labels, 50).collect()}
    want = {r.doc_id for r in labels.selectExpr("doc_id", "xxhash64(doc_id) as h").orderBy("h").limit(50).collect()}
    assert got == want


def test_all_trusted_documents_count(spark):
    n = 21_000
    rows = [(i, " ".join(f"w{(i * i + 7 * k * k) % 997}" for k in range(22))) for i in range(n)] + [(n + i, " ".join(f"Z{(i + k) % 50}" for k in range(30))) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.range(n).selectExpr("id as doc_id", "1 as quality", "0 as toxic")
    sides = {r.trusted_id: r.held for r in Q.trusted_ids(labels).collect()}
    assert len(sides) == n
    model = Q.fit(docs, labels)
    want, bound = plain_verdicts(rows, {i for i, held in sides.items() if not held}, {i for i, held in sides.items() if held})
    assert math.isclose(model.bound, bound, abs_tol=1e-9)
    assert {r.doc_id: r.kept for r in Q.assess(docs, model).collect()} == {i: k for (i, _), k in zip(rows, want, strict=True)}


def test_trusted_texts_by_shuffle(spark):
    rows = [(i % 40, f"text {i}") for i in range(200)] + [(None, "none"), (None, None), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    trusted = spark.createDataFrame([(i, i % 3 == 0) for i in range(0, 60, 2)] + [(3, True)], "trusted_id long, held boolean")
    want = Counter((i, text, i % 3 == 0) for i, text in rows if i is not None and (i % 2 == 0 or i == 3))
    for most in (0, 1000):
        assert Counter(tuple(r) for r in Q.trusted_texts(docs, trusted, most).collect()) == want


def test_percentile_is_exact(spark):
    for scores in ([], [0.5], [0.0, -0.0, 1.0], [0.1] * 9000 + [0.1 + 2**-56, -3.0], [math.sin(i) ** 9 for i in range(30_000)], [2.0 ** -(i % 1000) for i in range(9000)]):
        df = spark.createDataFrame([(x,) for x in scores], "score double")
        for share in (0.0, Q.LOST, 0.37, 1.0):
            got, at = Q.percentile(df, share), share * (len(scores) - 1)
            if not scores:
                assert got is None
                continue
            s = sorted(scores)
            low, high = s[math.floor(at)], s[math.ceil(at)]
            assert math.isclose(got, low + (at % 1) * (high - low), rel_tol=1e-12, abs_tol=1e-15)
