import hashlib
import random
import zlib
from collections import Counter

import duckdb
import pandas as pd
from test_decontam import brute as contaminated
from test_near_stage import kept_by_brute_force
from test_quality import plain_verdicts

import corpus_pipeline
from latticework.llm import quality
from latticework.llm.oracles import OP5


def test_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(11)
    word = lambda: rng.choice(["the", "of", "and"]) if rng.random() < 0.3 else f"w{rng.randrange(900)}"
    items = [(k, " ".join(word() for _ in range(30))) for k in range(5)]
    rows = []
    for k in range(160):
        text = [word() for _ in range(rng.choice([10, 40, 90]))]
        text += items[k % 5][1].split() if k % 11 == 0 else []
        rows.append((len(rows), " ".join(text), "en", f"s{k % 4}", 0))
        for _ in range(rng.choice([0, 0, 1, 3])):
            near = list(text)
            near[rng.randrange(len(near))] = word() if rng.random() < 0.5 else near[0]
            rows.append((len(rows), " ".join(near), "en", f"s{rng.randrange(4)}", 0))
    rows += [(900 + k, " ".join(f"Z{(k + j) % 40}%%" for j in range(60)), "en", "s1", 0) for k in range(8)] + [(950, None, None, None, None), (951, "", "en", None, 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(60)], "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    sides = {r.trusted_id: r.held for r in quality.trusted_ids(spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()}
    verdicts, _ = plain_verdicts([(r[0], r[1]) for r in rows], {i for i, held in sides.items() if not held}, {i for i, held in sides.items() if held})
    kept = [r for r, v in zip(rows, verdicts, strict=True) if v]
    assert 0 < len(kept) < len(rows)
    left = kept_by_brute_force([(r[0], r[1]) for r in kept])
    single = [r for r in kept if r[0] in left]
    assert len(single) < len(kept)
    bad = {r[0] for r in contaminated([(r[0], r[1]) for r in single], items) if r[5]}
    clean = [r for r in single if r[0] not in bad]
    assert len(clean) < len(single)
    documents = pd.DataFrame(clean, columns=["doc_id", "text", "lang", "source", "n_chars"])  # noqa: F841  the SQL reads it
    copies = {d: taken // size for d, size, _, _, taken in duckdb.sql(OP5).fetchall() if size}
    want = Counter()
    for r in clean:
        data = r[1].encode()
        want[(r[0], len(data) + 1, zlib.crc32(data))] += copies[r[0]]
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == +want
    texts = {r[0]: r[1] for r in clean}
    cells = sorted((hashlib.md5(texts[r.doc_id].encode()).hexdigest(), r.shard) for r in got)
    assert [s for _, s in cells] == sorted(s for _, s in cells) and {s for _, s in cells} <= set(range(8))
    for shard in range(8):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))


def test_odd_rows_and_columns(spark, tmp_path):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(1, text, "en", "a", 1, "x", 7), (1, text, "en", "a", 1, "x", 7), (2, text + " end", "en", None, None, None, None), (None, text.upper(), None, "b", 1, "x", 7), (3, None, None, None, None, None, None), (4, "", "", "", 0, "", 0), (5, "z " * 40000, "en", "a", 1, "x", 7)]
    rows += [(10 + k, " ".join(f"u{k}x{j}" for j in range(40)), "en", "a", 1, "x", 7) for k in range(6)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, copies long"
    spark.createDataFrame([(1, 1, 0), (None, None, None), (10, 1, None)], "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"u0x{j}" for j in range(40))), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, schema).repartition(3)
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), str(tmp_path))
        assert empty.count() == 0
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns or stage is corpus_pipeline.shards
        left[name] = Counter(r.doc_id for r in out.collect())
    assert set(left["quality rules"]) == {1, 2, None, *range(10, 16)}
    assert left["n-gram Jaccard join"] == Counter([1, 3, 4, 5, *range(10, 16)])
    assert 10 not in left["benchmark decontamination"] and left["benchmark decontamination"].total() == len(rows) - 1
    assert set(left["sharding"]) == {r[0] for r in rows} and left["sharding"].total() == len(rows)
    assert max(left["mixing sources to target weights"].values()) <= 6


def test_rows_without_or_with_repeated_ids_are_judged_by_their_texts(spark, tmp_path):
    rng = random.Random(5)
    text = lambda: " ".join(f"w{rng.randrange(5000)}" for _ in range(60))
    item, a, b, c, d = (text() for _ in range(5))
    near = a + " one more"
    rows = [(5, a), (3, near), (5, b), (None, b.upper()), (None, c), (None, c), (7, d), (7, item + " end"), (None, item), (8, ""), (8, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "s", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, source string, n int").repartition(3)
    spark.createDataFrame([("i", item)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()
    same = [(3, near), (5, b), (None, c), (7, d), (7, item + " end"), (8, ""), (8, ""), (None, None)]
    assert Counter((r.doc_id, r.text) for r in left) == Counter(same)
    left = corpus_pipeline.benchmark_decontamination(spark, docs, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.text) for r in left) == Counter((i, t) for i, t in rows if not (t or "").startswith(item))


def test_the_mix_of_alike_rows_is_the_operators(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "ALIKE_ROWS", 7)
    rows = [(None, f"text of {k % 4} " + "w " * (k % 4), f"s{k % 4}") for k in range(40)] + [(k % 3, "w " * (k % 5), f"s{k % 4}") for k in range(60)] + [(90, None, None), (91, "one", None)]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, source string, n int").repartition(3)
    want = Counter()
    for r in corpus_pipeline.mixing.mixed(docs).collect():
        want[(r.doc_id, r.src, r.size)] += r.copies
    got = corpus_pipeline.source_mix(spark, docs, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.source, len((r.text or "").split())) for r in got) == +want
    assert max(Counter(r.n for r in got).values()) <= 3
