import gzip

import pytest

from latticework.llm import warc


@pytest.mark.parametrize(
    "url,key",
    [
        ("http://www.Example.com:80/A?b=c#d", "com,example,www)/A?b=c"),
        ("https://example.org", "org,example)/"),
        ("https://u:p@a.b.example.org:8443/x", "org,example,b,a:8443)/x"),
        ("not a url", "not a url"),
        ("http://[bad/", "http://[bad/"),
        (None, "-"),
        ("", "-"),
    ],
)
def test_keys(url, key):
    assert warc.url_key(url) == key


PAGES = [(5, "http://a.com/1", "x"), (3, "http://a.com/2", "x"), (4, "http://b.com/", "x"), (9, None, None), (8, "http://a.com/1", ""), (7, "http://c.com/\r\n", "é" * 200000)]
PAGES += [(3, "http://a.com/2", "x"), (None, "http://a.com/2", "x"), (None, None, "only null"), (None, "u", "only null"), (5, "http://a.com/1", "other payload")]
PAGES += [(100 + k, f"http://h{k % 7}.example.com/{k}", f"page {k % 90}") for k in range(200)]


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    frame = spark.createDataFrame([(*p, "z") for p in PAGES], "page_id long, url string, html string, file string").repartition(5)
    want = []
    for page_id, _, html in PAGES:
        data = (html or "").encode()
        same = sorted(p[0] for p in PAGES if (p[2] or "") == (html or "") and p[0] is not None)
        want.append((page_id, len(data), warc.digest32(data), len(data) >= least, same))
    got = warc.round_trip(frame, least).collect()
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest) for r in got) == sorted((str(w[0]), w[1], w[2]) for w in want)
    by = {}
    for r in got:
        by.setdefault(r.payload_digest, []).append(r)
    for page_id, size, digest, shared, same in want:
        rows = by[digest]
        responses = [r for r in rows if r.record_type == "response"]
        if not shared:
            assert len(responses) == len(rows)
            continue
        first = same[0] if same else None
        assert [r.page_id for r in responses] == [first]
        assert all(r.refers_to == (first if r.record_type == "revisit" else None) for r in rows)


def test_index_blocks(spark, tmp_path):
    frame = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    captures = warc.write(frame, f"file://{tmp_path}/w")
    top = warc.write_index(captures, f"file://{tmp_path}/i", lines=3)
    asked = spark.createDataFrame([("http://a.com/1",), ("https://A.com/2#x",), ("http://nowhere.com/",), (None,)], "url string")
    got = sorted(((r.url_key, str(r.page_id)) for r in warc.lookup(top, asked).collect()))
    assert got == sorted((warc.url_key(u), str(p)) for p, u, _ in PAGES if warc.url_key(u) in ("com,a)/1", "com,a)/2", "-"))
    path = captures.first().file.removeprefix("file://")
    assert gzip.open(path).read().startswith(b"WARC/1.1\r\n")


def test_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_damage_is_found():
    data = warc.record(1, 1, "u", b"payload", warc.digest32(b"payload"), 7, None)
    assert warc.parsed(data)[2:] == (7, warc.digest32(b"payload"), "response", None)
    with pytest.raises(ValueError):
        warc.parsed(data.replace(b"payload", b"paYload"))
