import random
import re

from latticework.llm import decontam as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    out = []
    for doc_id, text in docs:
        words, hit, ids = low(text), set(), set()
        for item_id, item in items:
            sought = low(item)
            n = min(13, len(sought))
            for s in range(len(sought) - n + 1) if n else ():
                for p in range(len(words) - n + 1):
                    if words[p : p + n] == sought[s : s + n]:
                        hit.update(range(p, p + n))
                        ids |= {str(item_id)} if item_id is not None else set()
        out.append((doc_id, len(words), len(hit), len(ids), tuple(sorted(ids)), len(hit) > 0 and 20 * len(hit) >= len(words)))
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    rng = random.Random(5)
    sample = lambda n: " ".join(rng.choice(["the", "of", "À", "b7", "and", "rare%d" % rng.randrange(60)]) for _ in range(n))
    items = [(k, sample(rng.choice([1, 5, 13, 14, 40]))) for k in range(20)] + [(3, sample(30)), (None, sample(20)), (50, None), (51, "..."), (52, "the of " * 10)]
    docs = []
    for k in range(60):
        item = low(rng.choice(items)[1])
        cut = item[rng.randrange(3) :] + ["x"] + item
        docs.append((k, sample(rng.randrange(60)) + ". " + ", ".join(cut).upper().replace("À", "À") + "\n" + sample(20)))
    docs += [(1, docs[1][1]), (None, docs[2][1]), (70, None), (71, ""), (72, "the of " * 3000), (73, items[5][1])]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, pos int")
    bench = spark.createDataFrame([(*i, "z") for i in items], "item_id long, text string, term string")
    got = D.contamination(df, bench).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, tuple(r.item_ids), r.contaminated) for r in got), key=str) == brute(docs, items)
    assert D.contamination(df.limit(0), bench).count() == 0
    assert D.contamination(df, bench.limit(0)).where("n_hit > 0 or contaminated").count() == 0


def near_by_brute_force(words, sought, window=13, slop=4):
    """'exact', 'near' or None of one item in one document."""
    least = min(window, len(sought))

    def reached(width):
        for band in range(-len(sought), len(words) + 1):
            run = 0
            for q, w in enumerate(sought):
                there = any(0 <= band + j + q < len(words) and words[band + j + q] == w for j in range(width))
                run = run + 1 if there else 0
                if run >= least:
                    return True
        return False

    return "exact" if reached(1) else "near" if reached(slop) else None


def test_proximity(spark, tmp_path):
    rng = random.Random(9)
    item = [f"w{k}" for k in range(30)]
    short = [f"s{k}" for k in range(24)]
    docs = []
    for p in range(9):  # all offsets within the slop, and beyond
        before = [f"b{k}" for k in range(p)]
        docs.append(before + item[:9] + ["x"] + item[9:18] + ["y"] + item[18:])
        docs.append(before + short[:12] + ["x"] + short[12:])
        docs.append(before + item[:9] + ["x"] * 5 + item[9:])
        docs.append(before + short[:6] + short[8:])
    docs += [item, list(reversed(item)), []]
    for _ in range(60):
        text = list(rng.choice([item, short]))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(text))
            text[at : at + rng.randrange(2)] = [rng.choice(["x", "w3", "s5"])] * rng.randrange(3)
        docs.append(text)
    asked = [("i", item), ("s", short), ("two", ["w3", "s5"])]
    frame = spark.createDataFrame([(k, " ".join(d)) for k, d in enumerate(docs)], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in asked], "item_id string, text string")
    index = D.build_index(frame, f"{tmp_path}/index")
    for window in (13, 8):
        want = {(k, i): kind for k, d in enumerate(docs) for i, t in asked if (kind := near_by_brute_force(d, t, window))}
        got = {(r.doc_id, r.item_id): r.kind for r in D.phrases(index, D.Asked(bench), window).join(index.lengths, "doc").collect()}
        assert got == want and {"exact", "near"} <= set(want.values())
    again = D.Index.opened(spark, f"{tmp_path}/index")
    assert again.occurring.count() == sum(map(len, docs))
    assert D.matches(frame, bench).where("kind = 'near' and n_covered >= 13").count() > 0
