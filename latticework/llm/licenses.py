"""License scans by sentence rules.

A text is cut into sentences, each is normalised, and those that a licence is known to use become identifiers. Ordered licence rules, each
a sequence of identifiers, are then matched against the sequences that a document has. All of it is done row by row in built-in functions:
no shuffle, and no join, since the sentences and rules are fixed and few. They are made from the texts in license_texts: a text's sentences
are its rule.

A text is read twice: with each line break ending a sentence, as notices stand, and with single line breaks as spaces, as wrapped licences stand.
A rule matches where its identifiers stand next to one another among the known sentences of either reading; unknown sentences may lie
between them. The document's licence is that of the first rule in order that matches.

Defined cases: a null or empty text has no sentences and no licence; texts are read whole; repeated rows are judged each on its own; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.llm.common import ascii_lower
from latticework.llm.license_texts import NOTICES, SPDX, SPDX_MARK

#: A sign that ends a sentence where white space or the text's end follows; within a number or a name it ends nothing.
STOP = r"[.!?;:]+([\x20\x09-\x0D]|\z)"
NOISE = r"[^a-z0-9\x01\x0A]+"
MARK = "\x01"
#: Words that a sentence of a rule has at least; shorter ones, such as numbers, are no sign of a licence.
LEAST_WORDS = 3


def sentences_of(text: str) -> list[str]:
    """The normalised sentences of a text without line breaks."""
    ascii_low = "".join(c.lower() if c.isascii() else c for c in text)
    parts = re.sub(STOP.replace(r"\z", r"\Z"), MARK, ascii_low).split(MARK)
    return [x for x in (re.sub(r"[^a-z0-9]+", " ", part).strip() for part in parts) if x]


def _tables() -> tuple[dict[str, str], tuple[tuple[str, tuple[str, ...]], ...]]:
    """Identifiers with their sentences, and the rules in order. A sentence has the name of the first text that holds it and its place there."""
    names: dict[str, str] = {}
    rules = []
    for mark in sentences_of(SPDX_MARK):
        names[mark] = "spdx"
    for spdx in SPDX:
        (name,) = sentences_of(spdx)
        names[name] = f"id:{spdx}"
        rules.append((spdx.replace("GPL-2.0", "GPL-2.0-only").replace("GPL-3.0", "GPL-3.0-only") if spdx in ("GPL-2.0", "GPL-3.0") else spdx, ("spdx", names[name])))
    for licence, text in NOTICES:
        ids = [names.setdefault(x, f"{licence}:{len(names)}") for x in sentences_of(text) if len(x.split()) >= LEAST_WORDS]
        rules.append((licence, tuple(ids)))
    return {name: x for x, name in names.items()}, tuple(dict.fromkeys(rules))


SENTENCES, RULES = _tables()


#: What parts words within a sentence in the second reading: a space, a single line break, or both.
GAP = r"(?:\x20\x0A?\x20?|\x0A\x20?)"


def cleaned(text: Column) -> Column:
    """A text with ASCII letters in lower case, digits, line breaks, MARK where a sentence ends, and single spaces for all else."""
    stopped = F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), STOP, MARK + "$1")
    return F.regexp_replace(stopped, NOISE, " ")


def known(clean: Column, sentences: dict[str, str], by_line: bool) -> Column:
    """The identifiers of the known sentences of a cleaned text, in order, by one of the two readings.

    One pass looks for all sentences at once where a sentence begins, and takes those that end where a sentence ends.
    """
    names = F.create_map(*(F.lit(x) for name, s in sentences.items() for x in (s, name)))
    if by_line:
        one_of = _any_of([s.split() for s in sentences.values()], r"\x20")
        found = F.regexp_extract_all(clean, F.lit(rf"(?:\A|[\x01\x0A])\x20?({one_of})(?=\x20?(?:[\x01\x0A]|\z))"), F.lit(1))
        return F.transform(found, lambda s: F.element_at(names, s))
    one_of = _any_of([s.split() for s in sentences.values()], GAP)
    found = F.regexp_extract_all(clean, F.lit(rf"(?:\A|\x01|\x0A\x20?\x0A)[\x20\x0A]*({one_of})(?=\x20?(?:\x01|\z|\x0A[\x20\x0A]*(?:\x01|\x0A|\z)))"), F.lit(1))
    return F.transform(found, lambda s: F.element_at(names, F.regexp_replace(s, r"[\x20\x0A]+", " ")))


def _any_of(sentences: Sequence[Sequence[str]], gap: str) -> str:
    """An expression of any of these word sequences, with common beginnings once: the longest that a sentence's end allows."""
    after: dict[str, list] = {}
    for words in sentences:
        after.setdefault(words[0], []).append(words[1:])
    options = []
    for word, rests in sorted(after.items()):
        longer = [r for r in rests if r]
        more = gap + (_any_of(longer, gap) if len(longer) > 1 else gap.join(longer[0])) if longer else ""
        options.append(word + (f"(?:{more})?" if longer and len(longer) < len(rests) else more))
    return options[0] if len(options) == 1 else f"(?:{'|'.join(options)})"


def scan(docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules: tuple = RULES) -> DataFrame:
    """Of each row: doc_id, line_ids and text_ids (the identifiers in both readings), licenses (of all matching rules, in their order) and license, the first."""
    clean = docs.select(docs["doc_id"].alias("doc_id"), cleaned(docs["text"]).alias("clean"))
    found = clean.select("doc_id", known(F.col("clean"), sentences, True).alias("line_ids"), known(F.col("clean"), sentences, False).alias("text_ids"))
    spelled = [F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" ")) for c in ("line_ids", "text_ids")]
    matches = [F.when(spelled[0].contains(s := f" {' '.join(ids)} ") | spelled[1].contains(s), F.lit(name)) for name, ids in rules]
    licenses = F.array_distinct(F.filter(F.array(*matches), lambda x: x.isNotNull()))
    return found.withColumn("licenses", licenses).withColumn("license", F.get("licenses", F.lit(0)))


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, n_known, sentence_ids, licenses and license as plain columns."""
    return scanned.select(
        "doc_id",
        F.size(F.array_union("line_ids", "text_ids")).cast("long").alias("n_known"),
        F.array_join("line_ids", ",").alias("sentence_ids"),
        F.array_join("licenses", ",").alias("licenses"),
        "license",
    )
