import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from latticework.llm import encoding, token_counts, token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)
OTHER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def plain(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


parts = st.lists(st.sampled_from([" ", " ", " ", "\n", "\t", "a", "The", "é", "'s", "'", ".", ",", "12", " ", " ", "\x1c", "\x85", "😀", "<|endoftext|>", "\r\n", "ß", "_", "​", "\x00", "\u2028", "\u3000"]), max_size=25)


@settings(max_examples=500, deadline=None)
@given(parts)
def test_units_encode_like_the_whole_text(p):
    text = "".join(p)
    code = encoding.encoder(PATH)
    assert code.encode(pa.array([text]))[0].tolist() == plain(text)
    assert code.lengths(pa.array([text])).tolist() == [len(plain(text))]


@settings(max_examples=150, deadline=None)
@given(parts)
def test_another_splitter_goes_to_the_library(p):
    path = public_tokenizers.path("word_bpe_49k.json")
    text, code = "".join(p), encoding.encoder(path)
    assert not code.by_units and encoding.encoder(PATH).by_units
    want = OTHER.encode(text, add_special_tokens=False).ids
    assert code.encode(pa.array([text, "a"]))[0].tolist() == want
    assert code.lengths(pa.array(["a", text])).tolist()[1] == len(want)


def test_added_tokens_are_one_id():
    text = "a <|endoftext|> b"
    assert encoding.encoder(PATH).encode(pa.array([text, "x"]))[0].tolist() == plain(text) == [64, 220, 50256, 275]


def test_forgetting(monkeypatch):
    monkeypatch.setattr(encoding, "CACHED_UNITS", 20)
    code = encoding.Encoder(PATH)
    for k in range(30):
        texts = [f"the {k} and word{k % 7} of\nthe {j}" for j in range(5)]
        assert [x.tolist() for x in code.encode(pa.array(texts))] == [plain(t) for t in texts]


ROWS = [(5, "five words of text are here"), (None, "null id"), (2, None), (3, ""), (5, "five words of text are here"), (5, "another five"), (9, "<|endoftext|> a  b\n\n c"), (7, "long " * 60000)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, "s", 1) for r in ROWS] + [(100 + k, f"document number {k} " + "with common words " * (k % 9), None, 2) for k in range(200)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, file int").repartition(4)


def test_round_trip(spark, docs, tmp_path):
    manifest = token_files.write(docs, PATH, f"file://{tmp_path}/out")
    got = token_files.read(manifest, with_ids=True).orderBy("start").collect()
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
    assert [r.doc_id for r in got] == [r.doc_id for r in rows]
    start = 0
    for r, want in zip(got, rows, strict=True):
        ids = plain(want.text) + [0]
        assert (r.ids, r.start, r.n_tokens) == (ids, start, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert {r.dictionary for r in manifest.collect()} != {"0" * 64}
    asked = spark.createDataFrame([(7,), (9,), (150,), (-3,)], "doc_id long")
    assert {r.doc_id: r.ids for r in token_files.fetch(manifest, asked).collect()} == {r.doc_id: plain(r.text) + [0] for r in rows if r.doc_id in (7, 9, 150)}
    (dictionary,) = (tmp_path / "out").glob("dictionary-*")
    dictionary.write_bytes(dictionary.read_bytes()[:-1] + b"x")
    with pytest.raises(ValueError):
        token_files.TokenFile(manifest.first().file)


def test_empty_files(docs):
    assert token_files.round_trip(docs.limit(0), PATH).count() == 0


def test_histogram(spark, docs):
    counted = token_counts.lengths(docs, PATH)
    sums = token_counts.with_sums(token_counts.histogram(counted))
    sizes = {}
    for r in docs.collect():
        sizes.setdefault(r.source, []).append(len(plain(r.text)))
    got = {(r.source, r.limit): r for r in sums.collect()}
    assert set(got) == {(s, n) for s, v in sizes.items() for n in v}
    for (s, limit), r in got.items():
        v = sizes[s]
        assert (r.n_docs, r.docs_over, r.tokens_over) == (v.count(limit), sum(n > limit for n in v), sum(n for n in v if n > limit))
        assert (r.docs, r.tokens, r.docs_up_to, r.tokens_cut) == (len(v), sum(v), sum(n <= limit for n in v), sum(min(n, limit) for n in v))
    for r in token_counts.truncated(sums, [0, 3, 17, 10**6]).collect():
        v = sizes[r.source]
        assert (r.docs_over, r.tokens_cut) == (sum(n > r.limit for n in v), sum(min(n, r.limit) for n in v))
    for r in token_counts.quantiles(sums, [1, 500, 1000]).collect():
        v = sorted(sizes[r.source])
        assert r.length == v[max(0, -(-r.q * len(v) // 1000) - 1)]
    assert token_counts.with_sums(token_counts.histogram(counted.limit(0))).count() == 0
