import random

from test_ngram_join import shingles

import corpus_pipeline


def kept_by_brute_force(docs, size=5, percent=80):
    sets, up = [shingles(t, size) for _, t in docs], list(range(len(docs)))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for i, x in enumerate(sets):
        for j in range(i):
            a, b = find(i), find(j)
            if a != b and x and 100 * len(x & sets[j]) >= percent * len(x | sets[j]):
                up[max(a, b)] = min(a, b)
    return {docs[i][0] for i in range(len(docs)) if find(i) == i}


def test_near_duplicates_by_five_words_and_four_fifths(spark, tmp_path):
    rng, docs = random.Random(21), []
    for k in range(40):
        text = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([30, 60, 120, 200]))]
        docs.append((len(docs), " ".join(text)))
        more = [f"v{rng.randrange(3000)}" for _ in range(len(text) * rng.choice([5, 12, 15, 22, 30]) // 100)]
        docs.append((len(docs), " ".join(text + more)))
        edited = list(text)
        for _ in range(rng.choice([1, 2, 3, 5])):
            edited[rng.randrange(len(edited))] = "edit"
        docs.append((len(docs), " ".join(edited)))
    want = kept_by_brute_force(docs)
    assert want != kept_by_brute_force(docs, 3, 90) and len(want) > 40
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, other int").repartition(3)
    out = corpus_pipeline.near_duplicates(spark, df, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in out) == sorted(want)
