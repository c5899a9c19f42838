"""Quality rules: simple counts, and the log-likelihood ratio of hashed n-grams between trusted text and the raw corpus.

Words are what ASCII white space parts. Each word and each pair of neighbours falls into one of BUCKETS buckets. The corpus counts go over
all documents. The trusted text is that of all labelled good documents, dealt by hash into two halves. The first half gives the trusted
counts; a bucket's ratio is ``log((trusted + PRIOR) / (expected + PRIOR))``, expected being what the corpus's share of the bucket gives among as many n-grams. So a
bucket that trusted text should have had and lacks weighs the more the surer that is, and a rare one weighs nothing, at any size of input.

A document's score is the mean ratio of its n-grams. The second half, which the counts have not seen, sets the bound: the score that all
but LOST of its documents reach (those that fail the simple counts aside), found exactly. The same bound holds for every document.

Trusted ids that are few enough are broadcast. Of more, the texts that they name are joined once by shuffle and stored.

Defined cases: a null text has no words (it fails on length); texts are counted whole; repeated rows are judged and counted each on its
own; labels that contradict each other or are null trust nothing; without a second half of trusted text there is no bound, so the simple
counts alone decide; an empty table gives an empty result; extra columns are ignored by assess() and kept by passing().
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latticework.llm.common import BROADCAST_ROWS, give_back, lowest, small, stored

BUCKETS = 1 << 16
PRIOR = 10.0
LOST = 0.01
#: N-grams that a task counts at once.
COUNTED = 1 << 21
#: Cells into which the scores' range is divided at once, and the scores that the driver sorts at most.
CELLS = 4096

#: Words in a window whose repetition counts, fewest words, and the highest percentage of repeated words.
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30

SPACES = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
_CONTINUATION = bytes(range(0x80, 0xC0))
#: Words that a task remembers; then it forgets them all. At its end it does too, as workers stay when their tasks are done.
CACHED_WORDS = 200_000


class _Ids(dict):
    """Numbers words as they come, and keeps a 64-bit hash of each."""

    def __init__(self):
        self.hashes = np.zeros(1024, np.uint64)

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        if n == len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros(n, np.uint64)])
        self.hashes[n] = zlib.crc32(word) | zlib.crc32(word[::-1]) << 32
        return n


_ids = _Ids()


def _forget() -> None:
    global _ids
    _ids = _Ids()
    give_back()


def _numbered(words: list[bytes]) -> np.ndarray:
    if len(_ids) > CACHED_WORDS:
        _forget()
    return np.fromiter(map(_ids.__getitem__, words), np.int64, len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def ngram_buckets(numbers: np.ndarray) -> np.ndarray:
    """Buckets of the words and of the pairs of neighbours."""
    h = _ids.hashes[numbers]
    pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
    return (np.concatenate([_mixed(h), _mixed(pairs + np.uint64(1))]) % np.uint64(BUCKETS)).astype(np.int64)


def repeated_words(numbers: np.ndarray) -> int:
    """Words in windows of WINDOW words that occur more than once, the first occurrence included."""
    n = len(numbers) - WINDOW + 1
    if n < 2:
        return 0
    keys, values = np.zeros(n, np.uint64), _mixed(numbers.astype(np.uint64) + np.uint64(1))
    for k in range(WINDOW):
        keys = keys * np.uint64(0x9E3779B97F4A7C15) + values[k : k + n]
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    at = np.flatnonzero(twice)  # equal keys; now the words themselves
    windows = [numbers[p : p + WINDOW].tobytes() for p in at]
    found = Counter(windows)
    edges = np.zeros(len(numbers) + 1, np.int64)
    starts = at[[found[w] > 1 for w in windows]]
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + WINDOW, -1)
    return int((np.cumsum(edges) > 0).sum())


def counts(text: bytes, words: list[bytes], numbers: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    chars = len(text.translate(None, SPACES + _CONTINUATION))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [line for line in text.split(b"\n") if line.strip(SPACES)] if b"\n" in text else []
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(numbers)


@dataclass(frozen=True)
class Model:
    log_ratio: np.ndarray
    bound: float = -math.inf

    def score(self, buckets: np.ndarray) -> float:
        """The mean log ratio."""
        return float(self.log_ratio[buckets].mean()) if len(buckets) else 0.0


def log_ratio(raw: np.ndarray, trusted: np.ndarray) -> np.ndarray:
    expected = raw * (trusted.sum() / max(1.0, raw.sum()))
    return np.log((trusted + PRIOR) / (expected + PRIOR))


def trusted_ids(labels: DataFrame, limit: int | None = None) -> DataFrame:
    """trusted_id and held (whether it is of the half that sets the bound) of all documents that all their labels call good and none toxic;
    with a limit, which fit() does not set, of so many of the smallest hashes."""
    one = labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    good = one.where("doc_id is not null and q = 1 and t = 0").select("doc_id", F.xxhash64("doc_id").alias("h"))
    if limit is not None:
        good = lowest(good, "h", limit)
    return good.select(F.col("doc_id").alias("trusted_id"), (F.xxhash64("doc_id", F.lit(1)) % 2 == 0).alias("held"))


def trusted_texts(docs: DataFrame, trusted: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, text and held of the rows whose ids are trusted; trusted: a stored table, broadcast up to so many rows."""
    n = trusted.count()
    ids = small(trusted, n, most) if n <= most else trusted.hint("shuffle_hash")  # no task sorts texts
    found = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("trusted_id")).select("doc_id", "text", "held")
    return found if n <= most else stored(found, "quality-texts")


def _texts(batch: pa.RecordBatch, k: int) -> Iterator[tuple[bytes, list[bytes], np.ndarray]]:
    for value in batch.column(k).cast(pa.binary()):
        text = value.as_py() or b""
        yield text, (words := text.split()), _numbered(words)


def ngram_counts(docs: DataFrame) -> np.ndarray:
    """N-grams of all texts in each bucket. What reaches the driver is one row for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part, waiting = np.zeros(BUCKETS, np.int64), [], 0

        def add() -> None:
            nonlocal total
            if part:
                total += np.bincount(np.concatenate(part), minlength=BUCKETS)
            part.clear()

        for batch in batches:
            for _, _, numbers in _texts(batch, 0):
                part.append(found := ngram_buckets(numbers))
                waiting += len(found)
                if waiting > COUNTED:
                    add()
                    waiting = 0
        add()
        _forget()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(BUCKETS)
    for bucket, n in docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Counts n-grams of all documents and of the trusted ones of the first half, and takes the bound from all of the second."""
    texts = trusted_texts(docs, stored(trusted_ids(labels), "quality-trusted"))
    return bounded(texts.where("held"), log_ratio(ngram_counts(docs), ngram_counts(texts.where("not held"))))


def bounded(held: DataFrame, ratios: np.ndarray) -> Model:
    """The model with the bound that all but LOST of the held documents reach."""
    scores = assess(held, Model(ratios)).where("not base_failed").select("doc_id", "score").distinct()  # one for each distinct text of an id
    bound = percentile(stored(scores.select("score"), "quality-scores"), LOST)
    return Model(ratios, -math.inf if bound is None else bound)


def percentile(scores: DataFrame, share: float) -> float | None:
    """The exact percentile of score, between two ranks in proportion; None without scores."""
    n = scores.count()
    if not n:
        return None
    at = share * (n - 1)
    below, above = math.floor(at), math.ceil(at)
    low, high = ranked(scores, below), ranked(scores, above)
    return low if low == high else (above - at) * low + (at - below) * high


def ranked(scores: DataFrame, k: int) -> float:
    """The score with k others before it. The range that holds it is divided into CELLS again and again: the driver gets CELLS rows at a
    time, and tasks that many from each partition at most."""
    n, low, high = scores.agg(F.count("*"), F.min("score"), F.max("score")).first()
    while low < high:
        part = scores.where(F.col("score").between(low, high))
        if n <= CELLS:
            return sorted(r.score for r in part.collect())[k]
        cell = F.floor((F.col("score") - low) / (high - low) * (CELLS - 1))
        cells = part.groupBy(cell.alias("cell")).agg(F.count("*"), F.min("score"), F.max("score")).collect()
        for _, n, low, high in sorted(cells):
            if k < n:
                break
            k -= n
    return low


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"
_NAMES = [x.split()[0] for x in MEASURES.split(", ")]


def measured(text: bytes, words: list[bytes], numbers: np.ndarray, model: Model) -> tuple:
    found = counts(text, words, numbers)
    failed = found[0] < LEAST_WORDS or 100 * found[4] > MOST_REPEATED * found[0]
    score = model.score(ngram_buckets(numbers))
    return *found, failed, not failed and score >= model.bound, score


def assess(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and the MEASURES of each row."""
    doc_id = docs.select("doc_id").schema[0]
    schema = T.StructType([doc_id, *T.StructType.fromDDL(MEASURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measured(*x, model) for x in _texts(batch, 1)]
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, zip(*rows, strict=True))], names=["doc_id", *_NAMES])
        _forget()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def passing(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([measured(*x, model)[6] for x in _texts(batch, at)], pa.bool_()))
        _forget()

    return docs.mapInArrow(run, docs.schema)
