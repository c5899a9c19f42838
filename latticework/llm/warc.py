"""WARC archives with a two-level capture index.

write() makes a record per page, each a gzip member of its own, so that a range read gets one record. Pages of equal payloads (of at least
``least_bytes`` bytes) are one response, that of the smallest page_id, and revisits that refer to it.

write_index() sorts the captures by (reversed-host URL key, capture number) and packs BLOCK_LINES lines at a time into compressed blocks.
Each index file ends in its sparse directory, the first entry of each block, and the top level has a row per index file. lookup() searches
the top level by halving, then a file's directory, then reads only the block; read() gets the records by range reads, in order within
each archive file.

Defined cases: a null html is an empty payload; a null url has the key ``-``; null page_ids come last among equals, and what refers to one
refers to null; of rows that repeat a page_id and payload one is the response; empty tables give empty archives; extra columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import io
import json
import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework.llm.common import new_dir, small, stored
from latticework.llm.files import attempt_name, made_folder, opened, read_range

LEAST_BYTES = 0
BLOCK_LINES = 300
#: Bytes of an archive file that one task reads in one go.
STRETCH = 1 << 20
DATE = "2000-01-01T00:00:00Z"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:capture:"

CAPTURES = "url_key string, page_id long, record_type string, digest string, file string, offset long, size long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def url_key(url: str | None) -> str:
    """The URL with its host reversed, lower-cased, without scheme, user, default port and fragment."""
    if not url:
        return "-"
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return url
    if not host:
        return url
    shown = "" if port in (None, 80, 443) else f":{port}"
    return ",".join(reversed(host.split("."))) + shown + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---- records --------------------------------------------------------------------------------------------------------------------


def _member(data: bytes) -> bytes:
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def record(page_id: int | None, copy: int, url: str | None, payload: bytes, digest: str, size: int, revisits: tuple[int | None] | None) -> bytes:
    """One record. revisits: a tuple of the page_id that a revisit refers to, or None for a response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisits else http + payload
    fields = [("WARC-Type", "revisit" if revisits else "response"), ("WARC-Record-ID", f"<{_ID}{page_id}:{copy}>"), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    fields.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if revisits:
        fields += [("WARC-Refers-To", f"<{_ID}{revisits[0]}:1>"), ("WARC-Profile", IDENTICAL)]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def _page_of(uri: str) -> int | None:
    page = uri.strip("<>")[len(_ID) :].rpartition(":")[0]
    return None if page == "None" else int(page)


def parsed(data: bytes) -> tuple[int | None, str | None, int, str, str, int | None]:
    """A row of RECORDS from a record's bytes; a response's digest must be that of its payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/1."):
        raise ValueError(f"no WARC record: {version[:40]!r}")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or digest32(payload) != digest):
        raise ValueError(f"{fields['WARC-Record-ID']} does not hold the payload of its digest")
    refers = _page_of(fields["WARC-Refers-To"]) if kind == "revisit" else None
    return _page_of(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), size, digest, kind, refers


# ---- archives -------------------------------------------------------------------------------------------------------------------


def planned(pages: DataFrame, least_bytes: int) -> DataFrame:
    """A row per record: page_id, url, html (null for a revisit), sha, size, copy (among rows alike in page_id and payload) and first.

    first is a struct of the page_id that a revisit refers to, null for a response. The plan is made on digests; payloads are shuffled only
    if the list of records that are more than a plain response is too long to broadcast, and then by page, digest and size together, so
    that no payload, however common, is a key of its own. A revisit's payload goes nowhere.
    """
    key = ["page_id", "sha", "size"]
    html = F.coalesce(pages["html"], F.lit("")).cast("binary")
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].alias("url"), html.alias("html"))
    rows = rows.withColumn("sha", F.sha1("html")).withColumn("size", F.octet_length("html"))
    keys = rows.groupBy(*key).agg(F.count("*").alias("n"), F.min("url").alias("url"))
    keys = stored(keys, "warc-keys")
    groups = keys.groupBy("sha", "size").agg(F.min("page_id").alias("first"), F.sum("n").alias("all")).where((F.col("all") > 1) & (F.col("size") >= least_bytes))
    groups = stored(groups.select(F.col("sha").alias("f_sha"), F.col("size").alias("f_size"), "first"), "warc-shared")
    met = keys.join(small(groups, groups.count()), (F.col("sha") == F.col("f_sha")) & (F.col("size") == F.col("f_size")), "left")
    leads = F.col("f_sha").isNull() | F.col("page_id").eqNullSafe(F.col("first"))  # whether the first copy is a response
    special = met.where(~leads | (F.col("n") > 1)).select(*key, "n", "url", "first", F.col("f_sha").isNotNull().alias("shared"), leads.alias("leads"))
    special = stored(special, "warc-special")
    n_special = special.count()

    def alike(other: DataFrame) -> Column:
        return rows["page_id"].eqNullSafe(other["page_id"]) & (rows["sha"] == other["sha"]) & (rows["size"] == other["size"])

    plain = rows.join(small(special, n_special), alike(special), "left_anti")
    response = F.lit(None).cast("struct<page:bigint>")
    plain = plain.select("page_id", "url", "html", "sha", "size", F.lit(1).cast("long").alias("copy"), response.alias("first"))
    revisit = F.struct(F.col("first").alias("page"))
    single = special.where("n = 1").select("page_id", "url", F.lit(None).cast("binary").alias("html"), "sha", "size", F.lit(1).cast("long").alias("copy"), revisit.alias("first"))
    repeated = stored(special.where("n > 1"), "warc-repeated")
    n_repeated = repeated.count()
    if not n_repeated:
        return plain.unionByName(single)
    # Rows alike in page_id and payload: counted by url, numbered, and given a payload where they are responses.
    urls = rows.join(small(repeated, n_repeated), alike(repeated), "left_semi").groupBy(*key, "url").agg(F.count("*").alias("m"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy(*key).orderBy("url").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = urls.withColumn("before", before).withColumn("copy", F.explode(F.expr("sequence(before + 1, before + m)"))).drop("before", "m")
    payloads = rows.join(small(repeated, n_repeated), alike(repeated), "left_semi").groupBy(*key).agg(F.first("html").alias("html"))
    about = repeated.drop("n", "url").join(payloads, [repeated[c].eqNullSafe(payloads[c]) for c in key]).select(*(repeated[c].alias(f"a_{c}") for c in key), "first", "shared", "leads", "html")
    again = each.join(about, [F.col(c).eqNullSafe(F.col(f"a_{c}")) for c in key])
    is_response = ~F.col("shared") | (F.col("leads") & (F.col("copy") == 1))
    again = again.select("page_id", "url", F.when(is_response, F.col("html")).alias("html"), "sha", "size", "copy", F.when(~is_response, revisit).alias("first"))
    return plain.unionByName(single).unionByName(again)


def write(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Writes the pages' records into folder; CAPTURES, a row per record."""
    made_folder(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = path = None
        at = 0
        for batch in batches:
            rows = []
            for page_id, url, html, sha, size, copy, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    path = attempt_name(folder, TaskContext.get().partitionId(), "warc.gz")
                    system, where = opened(path)
                    out = system.open_output_stream(where, compression=None)
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                data = _member(record(page_id, copy, url, html or b"", digest, size, None if first is None else (first["page"],)))
                out.write(data)
                rows.append((url_key(url), page_id, "response" if first is None else "revisit", digest, path, at, len(data)))
                at += len(data)
            if rows:
                yield _rows(rows, CAPTURES)
        if out is not None:
            out.close()

    return stored(planned(pages, least_bytes).select("page_id", "url", "html", "sha", "size", "copy", "first").mapInArrow(run, CAPTURES), "warc-captures")


_ARROW = {"string": pa.string(), "long": pa.int64()}


def _rows(rows: list[tuple], fields: str) -> pa.RecordBatch:
    kinds = [f.split() for f in fields.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(list(c), _ARROW[k]) for c, (_, k) in zip(columns, kinds, strict=True)], names=[n for n, _ in kinds])


# ---- the index ------------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class TopLevel:
    """The first and last entry of each index file, in order, and the file."""

    firsts: list[tuple[str, int]]
    lasts: list[tuple[str, int]]
    files: list[str]


def _number(page_id: int | None) -> int:
    return -(1 << 63) if page_id is None else page_id


def index_files(captures: int) -> int:
    """Index files for so many captures: as their square root, like the entries of a file's directory, so that no level outgrows the others."""
    return max(1, math.isqrt(captures) // 16)


def write_index(captures: DataFrame, folder: str, lines: int = BLOCK_LINES) -> TopLevel:
    """Writes the index files into folder. The top level, a row per file, comes to the driver."""
    made_folder(folder)
    fields = "number long, file string, first_key string, first_id long, last_key string, last_id long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, block, directory, at, ends = None, [], [], 0, []
        path = number = None

        def flush() -> None:
            nonlocal at, block
            data = zlib.compress("\n".join(json.dumps(x) for x in block).encode(), 6)
            out.write(data)
            directory.append([block[0][0], _number(block[0][1]), at, len(data)])
            at, block = at + len(data), []

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    number = TaskContext.get().partitionId()
                    path = attempt_name(folder, number, "idx")
                    system, where = opened(path)
                    out = system.open_output_stream(where, compression=None)
                    ends = [(row[0], _number(row[1]))]
                block.append(row)
                if len(block) == lines:
                    ends[1:] = [(block[-1][0], _number(block[-1][1]))]
                    flush()
        if out is None:
            return
        if block:
            ends[1:] = [(block[-1][0], _number(block[-1][1]))]
            flush()
        data = zlib.compress(json.dumps(directory).encode(), 6)
        out.write(data + struct.pack("<QQ", at, len(data)))
        out.close()
        yield _rows([(number, path, *ends[0], *ends[-1])], fields)

    columns = [c.split()[0] for c in CAPTURES.split(", ")]
    files = index_files(captures.count())
    ordered = captures.select(*columns).repartitionByRange(files, "url_key", "page_id").sortWithinPartitions("url_key", "page_id", "file", "offset")
    top = stored(ordered.mapInArrow(run, fields), "warc-top").orderBy("number").collect()  # a row for each partition
    return TopLevel([(r.first_key, r.first_id) for r in top], [(r.last_key, r.last_id) for r in top], [r.file for r in top])


class IndexReader:
    """Finds captures with two binary searches and reads of single blocks."""

    def __init__(self, top: TopLevel):
        self.top = top
        self.directory = lru_cache(maxsize=4)(self._directory)
        self.block = lru_cache(maxsize=4)(self._block)

    def _directory(self, path: str) -> tuple[list[tuple[str, int]], list[list]]:
        system, where = opened(path)
        size = system.get_file_info(where).size
        at, length = struct.unpack("<QQ", read_range(path, size - 16, 16))
        rows = json.loads(zlib.decompress(read_range(path, at, length)))
        return [(r[0], r[1]) for r in rows], rows

    def _block(self, path: str, at: int, length: int) -> list[list]:
        return [json.loads(x) for x in zlib.decompress(read_range(path, at, length)).split(b"\n")]

    def between(self, low: tuple[str, int], high: tuple[str, int]) -> Iterator[list]:
        """The captures from low to high, both included."""
        for f in range(bisect.bisect_left(self.top.lasts, low), len(self.top.files)):
            if self.top.firsts[f] > high:
                return
            firsts, rows = self.directory(self.top.files[f])
            for b in range(max(0, bisect.bisect_left(firsts, low) - 1), len(rows)):
                if firsts[b] > high:
                    return
                for row in self.block(self.top.files[f], rows[b][2], rows[b][3]):
                    if low <= (row[0], _number(row[1])) <= high:
                        yield row


def lookup(top: TopLevel, wanted: DataFrame) -> DataFrame:
    """CAPTURES of the URLs that wanted lists: column url, and page_id for one capture (without that column, all of the URL's)."""
    single = "page_id" in wanted.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, rows = IndexReader(top), []
        for batch in batches:
            for key, page_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist() if single else [None] * batch.num_rows, strict=True):
                low = (key, _number(page_id)) if single else (key, -(1 << 63))
                for row in index.between(low, low if single else (key, (1 << 63) - 1)):
                    rows.append(tuple(row))
                    if len(rows) >= 5000:
                        yield _rows(rows, CAPTURES)
                        rows = []
        yield _rows(rows, CAPTURES)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = pa.array([url_key(u) for u in batch.column(0).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([keys, *batch.columns[1:]], names=["url_key", "page_id"][: 1 + single])

    keys = wanted.select("url", *([wanted["page_id"].cast("long").alias("page_id")] if single else [])).distinct()
    keys = keys.mapInArrow(keyed, "url_key string" + ", page_id long" * single).distinct()
    order = ["url_key", "page_id"][: 1 + single]
    return keys.repartitionByRange(max(1, len(top.files)), *order).sortWithinPartitions(*order).mapInArrow(run, CAPTURES)


def read(captures: DataFrame, tasks: int | None = None) -> DataFrame:
    """RECORDS of the captures, by range reads. tasks: among how many they are dealt, by stretches of the files; Spark would join rows as small
    as these into few tasks, as it can't know what they make a task read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, stream = None, io.BytesIO()
        for batch in batches:
            rows = []
            for path, at, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if path != last:
                    stream.close()
                    system, where = opened(path)
                    last, stream = path, system.open_input_file(where)
                rows.append(parsed(zlib.decompress(stream.read_at(size, at), 31)))
            yield _rows(rows, RECORDS)
        stream.close()

    places = captures.select("file", "offset", "size")
    by = ["file", F.floor(F.col("offset") / STRETCH)]
    dealt = places.repartition(*by) if tasks is None else places.repartition(tasks, *by)
    return dealt.sortWithinPartitions("file", "offset").mapInArrow(run, RECORDS)


def round_trip(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Archives the pages, indexes the archive, looks every page up and reads its record."""
    spark = pages.sparkSession
    captures = write(pages, new_dir(spark, "warc"), least_bytes)
    top = write_index(captures, new_dir(spark, "warc-index"))
    total = captures.agg(F.sum("size")).first()[0] or 0
    return read(lookup(top, pages.select("url", "page_id")), max(1, -(-total // (4 * STRETCH))))
