"""Secret scans with one combined deterministic automaton.

All rules' expressions are compiled together into one minimal automaton, and each text's bytes pass through it once. Only where it
reports the end of a match of some rule does more happen: the rule's mirrored automaton runs back from the last end and marks every byte at
which a match begins, and from the leftmost of them on its own automaton finds each match's full length. So matches of one rule are the
leftmost ones, each the longest from where it begins, and don't overlap; an empty match is none. A rule's ``confirm`` expression must match
a span whole, else it is dropped, but it has still used up its text.

Spans are counted in code points, end exclusive. Defined cases: a null text counts as empty; texts of any length are scanned whole;
repeated rows and null doc_ids give a row each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latticework.llm.automaton import Automaton, compiled, mirrored, parsed


@dataclass(frozen=True)
class Rule:
    kind: str
    expression: str
    confirm: str = ""


_ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]"
# The three base rules.
BASE_RULES = (
    Rule("assign", _ASSIGN + "+", _ASSIGN + "{8,}"),
    Rule("access", r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
#: Further public credential forms.
MORE_RULES = (
    Rule("pem", r"-----BEGIN (RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----"),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]+", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)
RULES = BASE_RULES + MORE_RULES

#: Bytes after which a scan looks whether anything ended.
BLOCK = 4096


class Scanner:
    """Finds the spans of all rules in a text's bytes."""

    def __init__(self, rules: Sequence[Rule]):
        trees = [parsed(r.expression) for r in rules]
        self.all = compiled(trees, anywhere=True)
        self.forward = [compiled([t]) for t in trees]
        self.backward = [compiled([mirrored(t)], anywhere=True) for t in trees]
        self.confirm = [compiled([parsed(r.confirm)]) if r.confirm else None for r in rules]
        # Rows that name the next row itself; a step into an accepting state leads to hit and stays there.
        n = self.all.n_classes
        self.hit: list = []
        self.hit += [self.hit] * n + [-1]
        self.rows: list[list] = [[None] * n + [s] for s in range(self.all.n_states)]
        for s, row in enumerate(self.rows):
            for c in range(n):
                t = self.all.step[s * n + c]
                row[c] = self.hit if self.all.accepts[t] else self.rows[t]

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, in order."""
        last = [0] * len(self.forward)
        rows, hit, step, n, accepts = self.rows, self.hit, self.all.step, self.all.n_classes, self.all.accepts
        state, seen = self.all.start, data.translate(self.all.classes)
        for at in range(0, len(seen), BLOCK):
            block = seen[at : at + BLOCK]
            row = rows[state]
            for c in block:
                row = row[c]
            if row is not hit:
                state = row[n]
                continue
            for end, c in enumerate(block, at + 1):
                state = step[state * n + c]
                if ended := accepts[state]:
                    for k in range(len(last)):
                        if ended >> k & 1:
                            last[k] = end
        return sorted((start, k, end) for k, stop in enumerate(last) if stop for start, end in self._matches(data, k, stop))

    def _matches(self, data: bytes, k: int, stop: int) -> Iterator[tuple[int, int]]:
        """The confirmed matches of a rule, none of which ends after stop."""
        back = self.backward[k]
        state, step, n, accepts = back.start, back.step, back.n_classes, back.accepts
        starts = []
        for at, c in zip(range(stop - 1, -1, -1), reversed(data[:stop].translate(back.classes)), strict=True):
            state = step[state * n + c]
            if accepts[state]:
                starts.append(at)
        used, view, check = 0, memoryview(data), self.confirm[k]
        for start in reversed(starts):
            if start < used:
                continue
            used = start + _longest(self.forward[k], view[start:])
            if used > start and (check is None or _longest(check, view[start:used]) == used - start):
                yield start, used


def _longest(automaton: Automaton, data) -> int:
    """Bytes of the longest match at the start of data."""
    state, best, dead, n = automaton.start, 0, automaton.dead, automaton.n_classes
    for at, byte in enumerate(data, 1):
        state = automaton.step[state * n + automaton.classes[byte]]
        if automaton.accepts[state]:
            best = at
        elif state == dead:
            break
    return best


@lru_cache(maxsize=8)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def found_in(data: bytes, rules: tuple[Rule, ...]) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, text) of each span, in code points, by start and then by rule."""
    out, chars, at = [], 0, 0
    for start, k, end in scanner(rules).spans(data):
        chars, at = chars + len(data[at:start].decode("utf-8", "replace")), start
        text = data[start:end].decode("utf-8", "replace")
        out.append((rules[k].kind, chars, chars + len(text), text))
    return out


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("text", T.StringType())]))
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())]))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and spans, an array of (kind, start, end, text), one row per row of docs. One pass, no shuffle."""
    schema = T.StructType([docs.select("doc_id").schema[0], T.StructField("spans", SPANS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            spans = [[dict(zip(("kind", "start", "end", "text"), s, strict=True)) for s in found_in(t.as_py() or b"", rules)] for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _ARROW_SPANS)], names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _is(kind: str):
    return lambda s: s["kind"] == kind


def digest(scanned: DataFrame, base: Sequence[Rule] = BASE_RULES) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans as one string."""
    kinds = [r.kind for r in base]
    of_base = F.filter("spans", lambda s: s["kind"].isin(kinds))
    return scanned.select(
        "doc_id",
        *(F.size(F.filter("spans", _is(k))).cast("long").alias(f"n_{k}") for k in kinds),
        F.sha2(joined(of_base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
