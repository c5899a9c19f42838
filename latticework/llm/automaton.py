"""Byte automata: regular expressions compiled by subset construction and minimisation into transition arrays.

Expressions are ASCII: literals, escapes, classes, groups, ``(?i:...)`` for ASCII letters in either case, ``|``, ``?``, ``*``, ``+`` and
``{m}``, ``{m,}``, ``{m,n}``. They match bytes; bytes above 127 only match negated classes and the dot. What else regular expressions may
have (``\\d`` and its like, anchors, lazy repeats, lookarounds, references) is a ValueError.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

ANY = (1 << 256) - 1


# ---- expressions to trees -------------------------------------------------------------------------------------------------------


class _Parser:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self) -> str:
        c = self.peek()
        self.at += 1
        return c

    def alternatives(self, fold: bool):
        options = [self.sequence(fold)]
        while self.peek() == "|":
            self.take()
            options.append(self.sequence(fold))
        return options[0] if len(options) == 1 else ("alt", options)

    def sequence(self, fold: bool):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeated(self.atom(fold)))
        return ("seq", parts)

    def repeated(self, node):
        c = self.peek()
        if not c or c not in "?*+{":
            return node
        self.take()
        if c == "{":
            body, closed, _ = self.text[self.at :].partition("}")
            self.at += len(body) + 1
            low, comma, high = body.partition(",")
            if not closed or not low.isdigit() or (high and not high.isdigit()):
                self.refuse("a repeat without numbers")
            least, most = int(low), (int(high) if high else None) if comma else int(low)
            if most is not None and most < least:
                self.refuse("a repeat of no number")
        else:
            least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
        if self.peek() and self.peek() in "?*+{":
            self.refuse("a repeat of a repeat")
        copies = [node] * least
        copies += [("star", node)] if most is None else [("alt", [node, ("seq", [])])] * (most - least)
        return ("seq", copies)

    def refuse(self, what: str):
        raise ValueError(f"{what} at {self.at} in {self.text!r}")

    def atom(self, fold: bool):
        c = self.take()
        if c == "(":
            if self.text.startswith("?i:", self.at):
                self.at, fold = self.at + 3, True
            elif self.text.startswith("?:", self.at):
                self.at += 2
            elif self.peek() == "?":
                self.refuse("an extension of groups")
            node = self.alternatives(fold)
            if self.take() != ")":
                raise ValueError(f"no end of group in {self.text!r}")
            return node
        if c == "[":
            return ("set", self.char_class(fold))
        if c == ".":
            return ("set", ANY & ~(1 << 10))
        if c in "^$*+?{":
            self.refuse(f"{c!r}, an anchor or nothing to repeat,")
        return ("set", self.folded(1 << (self.escape() if c == "\\" else self.plain(c)), fold))

    def plain(self, c: str) -> int:
        if not c or ord(c) > 127:
            self.refuse("no ASCII character")
        return ord(c)

    def escape(self) -> int:
        c = self.take()
        if c == "x":
            self.at += 2
            try:
                return int(self.text[self.at - 2 : self.at], 16)
            except ValueError:
                self.refuse("an escape without its digits")
        if c.isalnum() and c not in "nrt":
            self.refuse(f"the escape \\{c}")
        return self.plain({"n": "\n", "r": "\r", "t": "\t"}.get(c, c))

    def folded(self, bits: int, fold: bool) -> int:
        if fold:
            for lower in range(97, 123):
                both = 1 << lower | 1 << lower - 32
                bits |= both if bits & both else 0
        return bits

    def char_class(self, fold: bool) -> int:
        negated = self.peek() == "^"
        self.at += negated
        bits, first = 0, True
        while self.peek() != "]" or first:
            first = False
            low = self.escape() if (c := self.take()) == "\\" else self.plain(c)
            high = low
            if self.peek() == "-" and self.text[self.at + 1 : self.at + 2] != "]":
                self.take()
                high = self.escape() if (c := self.take()) == "\\" else self.plain(c)
            if high < low:
                self.refuse("a range that ends before it begins")
            bits |= (1 << high + 1) - (1 << low)
        self.take()
        bits = self.folded(bits, fold)
        return ANY & ~bits if negated else bits


def parsed(expression: str):
    parser = _Parser(expression)
    tree = parser.alternatives(False)
    if parser.at != len(expression):
        raise ValueError(f"unexpected {expression[parser.at :]!r} in {expression!r}")
    return tree


def mirrored(tree):
    """The tree of the reversed language."""
    kind, body = tree
    if kind == "seq":
        return ("seq", [mirrored(x) for x in reversed(body)])
    if kind == "alt":
        return ("alt", [mirrored(x) for x in body])
    return ("star", mirrored(body)) if kind == "star" else tree


# ---- trees to automata ----------------------------------------------------------------------------------------------------------


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.steps: list[tuple[int, int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.steps.append(None)
        return len(self.empty) - 1

    def add(self, tree, at: int) -> int:
        """Adds the tree from the state at; its end state."""
        kind, body = tree
        if kind == "seq":
            for x in body:
                at = self.add(x, at)
            return at
        end = self.state()
        if kind == "set":
            start = self.state()
            self.empty[at].append(start)
            self.steps[start] = (body, end)
        elif kind == "alt":
            for x in body:
                self.empty[self.add(x, at)].append(end)
        else:  # star
            loop = self.state()
            self.empty[at].append(loop)
            self.empty[self.add(body, loop)].append(loop)
            self.empty[loop].append(end)
        return end

    def closure(self, states: Iterable[int]) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for x in self.empty[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)


@dataclass(frozen=True)
class Automaton:
    """classes maps a byte to its class; step[state * n_classes + class] is the next state; accepts[state] has bit i if expression i ends there."""

    classes: bytes
    n_classes: int
    step: array
    accepts: tuple[int, ...]
    start: int
    dead: int  # -1 without one

    @property
    def n_states(self) -> int:
        return len(self.accepts)


def _byte_classes(sets: Iterable[int]) -> tuple[bytes, list[int]]:
    """The class of each byte, and a byte of each class: bytes that all sets treat alike share one."""
    blocks = [ANY]
    for bits in dict.fromkeys(sets):
        blocks = [part for block in blocks for part in (block & bits, block & ~bits) if part]
    classes = bytearray(256)
    for k, block in enumerate(blocks):
        for byte in range(256):
            if block >> byte & 1:
                classes[byte] = k
    return bytes(classes), [(block & -block).bit_length() - 1 for block in blocks]


def _minimised(step: list[list[int]], accepts: list[int], start: int) -> tuple[list[list[int]], list[int], int]:
    """Merges states that no input tells apart, by refining the partition until it is stable."""
    ids = {a: k for k, a in enumerate(dict.fromkeys(accepts))}
    part = [ids[a] for a in accepts]
    count = len(ids)
    while True:
        keys: dict[tuple[int, ...], int] = {}
        part = [keys.setdefault((part[s], *(part[t] for t in row)), len(keys)) for s, row in enumerate(step)]
        if len(keys) == count:
            break
        count = len(keys)
    rows: list[list[int]] = [[] for _ in range(count)]
    ends = [0] * count
    for s, row in enumerate(step):
        if not rows[part[s]]:
            rows[part[s]], ends[part[s]] = [part[t] for t in row], accepts[s]
    return rows, ends, part[start]


def compiled(trees: Sequence, anywhere: bool = False) -> Automaton:
    """The minimal automaton of all trees together; anywhere: matches may begin at any byte."""
    nfa = _Nfa()
    root = nfa.state()
    ends = [nfa.add(tree, root) for tree in trees]
    classes, samples = _byte_classes(step[0] for step in nfa.steps if step)
    begin = nfa.closure([root])
    known, todo, step, accepts = {begin: 0}, [begin], [], []
    for states in todo:
        accepts.append(sum(1 << k for k, end in enumerate(ends) if end in states))
        row = []
        for byte in samples:
            moved = {nfa.steps[s][1] for s in states if nfa.steps[s] and nfa.steps[s][0] >> byte & 1}
            after = nfa.closure(moved | ({root} if anywhere else set()))
            if after not in known:
                known[after] = len(known)
                todo.append(after)
            row.append(known[after])
        step.append(row)
    rows, masks, start = _minimised(step, accepts, 0)
    dead = next((s for s, row in enumerate(rows) if not masks[s] and all(t == s for t in row)), -1)
    return Automaton(classes, len(samples), array("H" if len(rows) < 65536 else "L", [t for row in rows for t in row]), tuple(masks), start, dead)
