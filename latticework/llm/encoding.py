"""Encoding texts with a public tokenizer of the tokenizers library, by cached units.

Byte-level BPE cuts a text into pieces before it merges bytes. A single space between two characters that are no white space begins a
piece, and so does a single line break. So a text may be cut there, and the ids of a unit are those that the library gives for it alone:
a worker encodes each distinct unit once, as long as it remembers it. Most of the library's time goes into keeping track of offsets while
it cuts and maps bytes; units of plain Latin letters, digits and signs are cut and mapped here, and the library's model encodes the pieces.

That holds for one configuration, plain byte-level BPE, which the tokenizer's file must state (cuts_like_byte_level()). With any other, and
for texts that hold a string of an added token (such as an end mark), the library encodes whole texts, at its defaults but for
add_special_tokens=False.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Units that a worker remembers; then it keeps only those that it met again.
CACHED_UNITS = 800_000
#: Texts that are cut into units at once.
BATCH = 3000
#: Units that the library encodes at once.
ENCODED_UNITS = 10_000
#: Characters of whole texts that the library encodes at once, unless one text has more.
ENCODED_CHARS = 1 << 20

_SPACE = r"[\s\v\x1c-\x1f\x85\p{Z}]"
#: Texts that are not cut by plain replacement: white space next to white space, or the mark of the first unit.
_AMBIGUOUS = rf"{_SPACE}{_SPACE}|\x00"
_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: Units whose pieces can be told here: no white space inside, and only characters of long-settled kinds.
_PLAIN = r"\A[\x00\n]?[!-~\x{a1}-\x{ac}\x{ae}-\x{24f}]+\z"
#: The pieces of byte-level BPE, as the tokenizer's own pattern has them.
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Between pieces: no byte of UTF-8.
_BETWEEN = "\udcff"


def units(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All units of the texts, and the start and end of each text's among them.

    A unit with \\0 in front is a text's first; one that begins with a line break is itself; the others lack the space before them.
    """
    odd = pc.match_substring_regex(texts, _AMBIGUOUS)
    plain = pc.binary_join_element_wise(pa.scalar("\0"), pc.if_else(odd, "", texts), "")
    lists = pc.split_pattern(pc.replace_substring(plain, "\n", " \n"), " ")
    rows, at = np.arange(len(texts)), np.flatnonzero(odd.to_numpy(zero_copy_only=False))
    if len(at):
        cut = [_marked(_LONE_SPACE.split(t)) for t in texts.take(pa.array(at)).to_pylist()]
        rows[at] = len(texts) + np.arange(len(at))
        lists = pa.concat_arrays([lists, pa.array(cut, lists.type)])
    ends = lists.offsets.to_numpy().astype(np.int64)
    return lists.flatten(), ends[rows] - ends[0], ends[rows + 1] - ends[0]


def _marked(parts: list[str]) -> list[str]:
    """Units of one text; those that begin with what marks a kind of unit stay with the one before."""
    out = ["\0" + parts[0]]
    for part in parts[1:]:
        if part[0] == "\0":
            out[-1] += " " + part
        else:
            out.append(part)
    return out


def unit_text(unit: str) -> str:
    return unit[1:] if unit[:1] == "\0" else unit if unit[:1] == "\n" else " " + unit


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself if it prints in Latin-1, else the next from U+0100 on. 255 parts pieces here."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + k) for k, b in enumerate(others)} | {255: "\n"}


_LETTERS = _byte_letters()


def cuts_like_byte_level(config: dict) -> bool:
    """Whether a tokenizer's configuration is the one that units and pieces are cut for."""
    cut, model = config.get("pre_tokenizer") or {}, config.get("model") or {}
    return (
        cut.get("type") == "ByteLevel"
        and not cut.get("add_prefix_space", True)
        and cut.get("use_regex", True)
        and model.get("type") == "BPE"
        and not any(config.get(k) for k in ("normalizer", "truncation", "padding"))
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    )


class Encoder:
    """Remembers units as an Arrow array: known[i] has the ids flat[ends[i]:ends[i + 1]], and was met[i] times."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        config = json.loads(self.tokenizer.to_str())
        self.by_units = cuts_like_byte_level(config)
        self.added = [t["content"] for t in config["added_tokens"]]
        self.pieces = Tokenizer(self.tokenizer.model)
        self.line_break = int(self._ids("\n")[0]) if self.by_units else -1
        self.known = pa.array([], pa.string())
        self.flat, self.ends, self.met = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(0, np.int64)

    def _trim(self) -> None:
        keep = np.flatnonzero(self.met > 1)[: CACHED_UNITS // 2]
        lengths = (self.ends[1:] - self.ends[:-1])[keep]
        self.flat = self._gathered(keep)
        self.ends = np.concatenate([[0], np.cumsum(lengths)])
        self.known, self.met = self.known.take(pa.array(keep)), np.zeros(len(keep), np.int64)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _learn(self, new: pa.Array) -> None:
        """Encodes new units: runs of plain ones at once, each other one by itself."""
        parts, counts, at = [self.flat], [], 0
        others = np.flatnonzero(~pc.match_substring_regex(new, _PLAIN).to_numpy(zero_copy_only=False)).tolist()
        for stop in [*others, len(new)]:
            for k in range(at, stop, ENCODED_UNITS):
                ids, lengths = self._plain(new[k : min(k + ENCODED_UNITS, stop)].to_pylist())
                parts.append(ids)
                counts.append(lengths)
            if stop < len(new):
                parts.append(ids := self._ids(unit_text(new[stop].as_py())))
                counts.append(np.array([len(ids)]))
            at = stop + 1
        self.flat = np.concatenate(parts)
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.concatenate(counts))])
        self.known = pa.concat_arrays([self.known, new])
        self.met = np.concatenate([self.met, np.zeros(len(new), np.int64)])

    def _plain(self, part: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of plain units, and how many of each. They are the lines of one text: a line break, which they don't have inside, follows each."""
        broken = np.fromiter((u[0] == "\n" for u in part), bool, len(part))
        lines = "\n".join([u[1:] if u[0] in "\0\n" else " " + u for u in part]) + "\n"
        joined = _BETWEEN.join(_PIECE.findall(lines)).encode("utf-8", "surrogateescape")
        letters = joined.decode("latin-1").translate(_LETTERS).split("\n")
        ids = np.array(self.pieces.encode_batch_fast([letters], add_special_tokens=False, is_pretokenized=True)[0].ids, np.uint32)
        lengths = np.diff(np.flatnonzero(ids == self.line_break), prepend=-1)
        if len(lengths) != len(part):  # some vocabulary has no id for a line break alone
            found = [self._ids(unit_text(u)) for u in part]
            return np.concatenate(found), np.fromiter(map(len, found), np.int64, len(found))
        # The line break after a unit becomes that before the next; units that have none lose it.
        ids = np.concatenate([ids[-1:], ids[:-1]])
        keep = np.ones(len(ids), bool)
        keep[(np.cumsum(lengths) - lengths)[~broken]] = False
        return ids[keep], lengths - ~broken

    def _numbered(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The place among the known units of each unit, and the start and end of each text's units."""
        if len(self.known) > CACHED_UNITS:
            self._trim()
        values, starts, ends = units(texts)
        coded = values.dictionary_encode()
        at = pc.index_in(coded.dictionary, self.known)
        number = pc.fill_null(at, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = number < 0
        if new.any():
            number[new] = len(self.known) + np.arange(int(new.sum()))
            self._learn(coded.dictionary.filter(pa.array(new)))
        indices = coded.indices.to_numpy()
        self.met[number] += np.bincount(indices, minlength=len(number))
        return number[indices], starts, ends

    def _gathered(self, n: np.ndarray) -> np.ndarray:
        starts, lengths = self.ends[n], self.ends[n + 1] - self.ends[n]
        before = np.cumsum(lengths) - lengths
        return self.flat[np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))]

    def _whole(self, texts: pa.Array) -> list[int]:
        """Places of the texts that the library must see whole."""
        if not self.by_units:
            return list(range(len(texts)))
        holds = np.zeros(len(texts), bool)
        for content in self.added:
            holds |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
        return np.flatnonzero(holds).tolist()

    def _encoded(self, texts: pa.Array, places: list[int]) -> Iterator[tuple[int, np.ndarray]]:
        """The place and the ids of each of these texts, encoded whole."""
        part, size = [], 0
        for k in [*places, None]:
            text = texts[k].as_py() if k is not None else ""
            if part and (k is None or size + len(text) > ENCODED_CHARS):
                found = self.tokenizer.encode_batch_fast([t for _, t in part], add_special_tokens=False)
                yield from ((at, np.array(e.ids, np.uint32)) for (at, _), e in zip(part, found, strict=True))
                part, size = [], 0
            if k is not None:
                part.append((k, text))
                size += len(text)

    def _by_units(self, texts: pa.Array, whole: list[int]) -> pa.Array:
        """The texts, empty where the library sees them whole."""
        if not whole:
            return texts
        blank = np.zeros(len(texts), bool)
        blank[whole] = True
        return pc.if_else(pa.array(blank), "", texts)

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """The number of ids of each text; texts is an Arrow array of strings without nulls."""
        whole = self._whole(texts)
        n, starts, ends = self._numbered(self._by_units(texts, whole))
        through = np.concatenate([[0], np.cumsum((self.ends[1:] - self.ends[:-1])[n])])
        out = through[ends] - through[starts]
        for k, ids in self._encoded(texts, whole):
            out[k] = len(ids)
        return out

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        whole = self._whole(texts)
        n, starts, ends = self._numbered(self._by_units(texts, whole))
        ids = self._gathered(n)
        through = np.concatenate([[0], np.cumsum((self.ends[1:] - self.ends[:-1])[n])])
        out = [ids[a:b] for a, b in zip(through[starts], through[ends], strict=True)]
        for k, found in self._encoded(texts, whole):
            out[k] = found
        return out


def texts_of(batch: pa.RecordBatch, k: int) -> pa.Array:
    """The texts of a column, nulls as empty ones."""
    return pc.fill_null(batch.column(k), "")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
