"""Token ids in binary files, each document a zstandard frame of its own under one shared dictionary.

A file is: MAGIC, the dictionary's sha256 (zeros without one), the id width in bytes (1 byte), the frames, the index, and at its end the
index's offset and size (8 bytes each, little-endian). The index is an Arrow stream with a row per document, in order: doc_id, offset and
size of its frame, n_tokens. The dictionary lies beside the files in ``dictionary-<sha256>``.

The dictionary is trained on the serialized ids of DICTIONARY_DOCS documents and DICTIONARY_TEXT_BYTES of text at most, those of the
smallest hashes; the data are lossless whatever it holds. Files hold documents in ascending doc_id order, nulls first, and the files follow each other by number.

Defined cases: a null text counts as empty, so it has the end id alone; repeated rows and null doc_ids are each written; ties in doc_id go
by text; an empty table gives no files and an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticework.llm.common import lowest, new_dir, stored
from latticework.llm.encoding import BATCH, encoder, texts_of
from latticework.llm.files import attempt_name, made_folder, opened, write_all

MAGIC = b"LWTOKENS"
END_ID = 0
LEVEL = 3
DICTIONARY_DOCS, DICTIONARY_BYTES = 1000, 64 << 10
#: Bytes of the texts that the dictionary is trained on at most.
DICTIONARY_TEXT_BYTES = 32 << 20
NO_DICTIONARY = bytes(32)

MANIFEST = "file string, number int, n_docs long, n_tokens long, first_id string, last_id string, dictionary string"


def _id_type(width: int) -> np.dtype:
    return np.dtype("<u2" if width == 2 else "<u4")


def train(docs: DataFrame, tokenizer: str) -> bytes:
    """A dictionary from a bounded sample of documents; empty if zstandard finds too little to train on. One task does it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples, code = [], encoder(tokenizer)
        kind = _id_type(_width(code))
        for batch in batches:
            samples += [ids.astype(kind).tobytes() for ids in code.encode(texts_of(batch, 0))]
        try:
            data = zstandard.train_dictionary(DICTIONARY_BYTES, [s for s in samples if s], level=LEVEL).as_bytes() if len(samples) > 7 else b""
        except zstandard.ZstdError:
            data = b""
        yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["dictionary"])

    sized = docs.select(F.xxhash64("doc_id").alias("d"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"))
    first = lowest(sized, "d", DICTIONARY_DOCS)  # DICTIONARY_DOCS rows of two numbers, so the window's single task is bounded
    first = first.withColumn("through", F.sum("n").over(Window.orderBy("d", "n").rowsBetween(Window.unboundedPreceding, 0))).where(F.col("through") <= DICTIONARY_TEXT_BYTES)
    chosen = [(r.d, r.n) for r in first.select("d", "n").collect()]
    wanted = F.broadcast(docs.sparkSession.createDataFrame(sorted(set(chosen)), "c long, m int"))
    rows = docs.select("text", F.xxhash64("doc_id").alias("d"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"))
    sample = rows.join(wanted, (F.col("d") == F.col("c")) & (F.col("n") == F.col("m")), "left_semi").orderBy("d", "n", "text").limit(len(chosen)).select("text")
    found = sample.coalesce(1).mapInArrow(run, "dictionary binary").agg(F.max("dictionary")).first()[0]
    return bytes(found or b"")


def _width(code) -> int:
    return 2 if code.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4


def write(docs: DataFrame, tokenizer: str, folder: str) -> DataFrame:
    """Writes docs into folder and returns the manifest, a row per file."""
    data = train(docs, tokenizer)
    digest = hashlib.sha256(data).digest() if data else NO_DICTIONARY
    made_folder(folder)
    if data:
        write_all(f"{folder}/dictionary-{digest.hex()}", data)
    id_type = pa.field("doc_id", pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, number = encoder(tokenizer), TaskContext.get().partitionId()
        width = _width(code)
        kind, end = _id_type(width), np.array([END_ID], np.uint32)
        shared = zstandard.ZstdCompressionDict(data) if data else None
        if shared:
            shared.precompute_compress(level=LEVEL)  # else it would be taken in again for each document
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared)
        out = path = None
        ids, offsets, sizes, tokens, at = [], [], [], [], 0
        for whole in batches:
            for k in range(0, whole.num_rows, BATCH):
                batch = whole.slice(k, BATCH)
                if out is None:
                    path = attempt_name(folder, number, "tok")
                    system, where = opened(path)
                    out = system.open_output_stream(where, compression=None)
                    out.write(MAGIC + digest + bytes([width]))
                    at = len(MAGIC) + 33
                for found in code.encode(texts_of(batch, 1)):
                    frame = pack.compress(np.concatenate([found, end]).astype(kind).tobytes())
                    out.write(frame)
                    offsets.append(at)
                    sizes.append(len(frame))
                    tokens.append(len(found) + 1)
                    at += len(frame)
                ids.append(batch.column(0))
        if out is None:
            return
        doc_ids = pa.chunked_array(ids, id_type.type) if ids else pa.chunked_array([], id_type.type)
        index = pa.table([doc_ids, pa.array(offsets, pa.int64()), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "offset", "size", "n_tokens"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, index.schema) as w:
            w.write_table(index)
        body = sink.getvalue().to_pybytes()
        out.write(body + struct.pack("<QQ", at, len(body)))
        out.close()
        first, last = str(doc_ids[0].as_py()), str(doc_ids[-1].as_py())
        row = {"file": path, "number": number, "n_docs": len(tokens), "n_tokens": sum(tokens), "first_id": first, "last_id": last, "dictionary": digest.hex()}
        yield pa.RecordBatch.from_pylist([row], pa.schema([("file", pa.string()), ("number", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("first_id", pa.string()), ("last_id", pa.string()), ("dictionary", pa.string())]))

    ordered = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    ordered = ordered.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    return stored(ordered.mapInArrow(run, MANIFEST), "token-manifest")


class TokenFile:
    """Reads one file; each document by itself."""

    def __init__(self, path: str):
        self.path = path
        system, where = opened(path)
        size = system.get_file_info(where).size
        self.stream = system.open_input_file(where)
        head = self.stream.read_at(len(MAGIC) + 33, 0)
        if head[: len(MAGIC)] != MAGIC:
            raise ValueError(f"{path} is no token file")
        self.dictionary, self.kind = head[len(MAGIC) : -1], _id_type(head[-1])
        at, length = struct.unpack("<QQ", self.stream.read_at(16, size - 16))
        self.index = pa.ipc.open_stream(self.stream.read_at(length, at)).read_all()
        shared = None
        if self.dictionary != NO_DICTIONARY:
            system, where = opened(f"{path.rpartition('/')[0]}/dictionary-{self.dictionary.hex()}")
            with system.open_input_file(where) as f:
                data = f.read()
            if hashlib.sha256(data).digest() != self.dictionary:
                raise ValueError(f"the dictionary of {path} is not the one it was written with")
            shared = zstandard.ZstdCompressionDict(data)
        self.unpack = zstandard.ZstdDecompressor(dict_data=shared)

        self.offsets, self.sizes = (self.index[c].to_numpy() for c in ("offset", "size"))

    def __len__(self) -> int:
        return self.index.num_rows

    def ids(self, k: int) -> np.ndarray:
        """The ids of the k-th document, the end id included: one range read."""
        return self.span(k, k + 1)[0]

    def span(self, start: int, stop: int) -> list[np.ndarray]:
        """The ids of the documents from start to stop: one range read."""
        low = int(self.offsets[start])
        data = memoryview(self.stream.read_at(int(self.offsets[stop - 1] + self.sizes[stop - 1]) - low, low))
        frames = (data[a : a + n] for a, n in zip((self.offsets[start:stop] - low).tolist(), self.sizes[start:stop].tolist(), strict=True))
        return [np.frombuffer(self.unpack.decompress(f), self.kind).astype("<u4") for f in frames]

    def close(self) -> None:
        self.stream.close()


def read(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids of every document in the files."""
    before = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    placed = manifest.select("file", "number", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    fields = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = TokenFile(path)
                for at in range(0, len(file), 500):
                    stop = min(at + 500, len(file))
                    found = file.span(at, stop)
                    counts = np.array([len(x) for x in found], np.int64)
                    columns = [file.index["doc_id"][at:stop].combine_chunks(), pa.array(base + np.cumsum(counts) - counts), pa.array(counts), pa.array([zlib.crc32(x.tobytes()) for x in found], pa.int64())]
                    base += int(counts.sum())
                    yield pa.RecordBatch.from_arrays(columns + [pa.array([x.tolist() for x in found], pa.list_(pa.int64()))] * with_ids, names=fields.replace(",", "").split()[::2][: 4 + with_ids])
                file.close()

    files = max(1, manifest.count())  # a task for each; Spark would join so small rows into one
    return placed.repartitionByRange(files, "number").select("file", "base").mapInArrow(run, fields)


def fetch(manifest: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """doc_id and ids of the documents whose ids doc_ids lists (column doc_id): only files whose range may hold one are opened, and only those frames read."""
    ranges = manifest.where("first_id <> 'None' or last_id <> 'None'").select("file", F.coalesce(F.expr("try_cast(first_id as bigint)"), F.lit(-(1 << 63))).alias("low"), F.col("last_id").cast("long").alias("high"))
    wanted = doc_ids.select(doc_ids["doc_id"].cast("long").alias("doc_id")).distinct()
    pairs = wanted.join(ranges, F.col("doc_id").between(F.col("low"), F.col("high"))).groupBy("file").agg(F.collect_list("doc_id").alias("doc_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file, found = TokenFile(path), []
                for k in np.flatnonzero(np.isin(file.index["doc_id"].to_numpy(), ids)):
                    found.append((file.index["doc_id"][int(k)].as_py(), file.ids(int(k)).tolist()))
                file.close()
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return pairs.mapInArrow(run, "doc_id long, ids array<long>")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes docs into a folder of their own and reads them back."""
    return read(write(docs, tokenizer, new_dir(docs.sparkSession, "tokens")))
