"""Regular expressions over bytes as deterministic automata: positions, subsets, minimisation, transition arrays.

The patterns are those that secrets need: letters, classes, groups, alternatives, ``?``,
``*``, ``+``, ``{m}``, ``{m,}``, ``{m,n}``, escapes with a backslash, ``\\xHH``, and
``(?i:...)`` for a group whose ASCII letters match in either case. Anything that stands
for "all but" is left out, as a byte isn't a letter.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

import numpy as np

#: A pattern's tree: ("set", bytes), ("cat", parts), ("alt", parts) or ("rep", part, least, most or None).
Node = tuple


class PatternReader:
    """Reads one pattern into its tree."""

    def __init__(self, pattern: str):
        if not pattern.isascii():
            raise ValueError("patterns are ASCII")
        self.text, self.at = pattern, 0

    def tree(self) -> Node:
        out = self.choice(False)
        if self.at < len(self.text):
            raise ValueError(f"a parenthesis too many in {self.text!r}")
        return out

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self) -> str:
        if self.at >= len(self.text):
            raise ValueError(f"{self.text!r} ends too early")
        self.at += 1
        return self.text[self.at - 1]

    def choice(self, either_case: bool) -> Node:
        parts = [self.sequence(either_case)]
        while self.peek() == "|":
            self.take()
            parts.append(self.sequence(either_case))
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def sequence(self, either_case: bool) -> Node:
        parts: list[Node] = []
        while self.peek() not in ("", "|", ")"):
            part = self.single(either_case)
            while self.peek() in ("?", "*", "+", "{") and self.peek():
                part = ("rep", part, *self.times())
            parts.append(part)
        return ("cat", parts)

    def times(self) -> tuple[int, int | None]:
        c = self.take()
        if c != "{":
            return {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
        end = self.text.index("}", self.at)
        low, comma, high = self.text[self.at : end].partition(",")
        self.at = end + 1
        least = int(low)
        most = least if not comma else int(high) if high else None
        if most is not None and most < max(1, least):
            raise ValueError(f"no such number of times in {self.text!r}")
        return least, most

    def single(self, either_case: bool) -> Node:
        c = self.take()
        if c == "(":
            if self.text.startswith("?i:", self.at):
                self.at, either_case = self.at + 3, True
            elif self.text.startswith("?:", self.at):
                self.at += 2
            inner = self.choice(either_case)
            if self.take() != ")":
                raise ValueError(f"a parenthesis is open in {self.text!r}")
            return inner
        if c in ".^$?*+{":
            raise ValueError(f"{c!r} is not supported at this place of {self.text!r}")
        found = self.members() if c == "[" else {self.byte(c)}
        if either_case:
            found |= {ord(x) for b in found for x in (chr(b).lower(), chr(b).upper()) if ord(x) < 128}
        return ("set", frozenset(found))

    def byte(self, c: str) -> int:
        if c != "\\":
            return ord(c)
        c = self.take()
        if c == "x":
            return int(self.take() + self.take(), 16)
        if c in "ntrfv":
            return ord({"n": "\n", "t": "\t", "r": "\r", "f": "\f", "v": "\v"}[c])
        if c.isalnum():
            raise ValueError(f"\\{c} is not supported")
        return ord(c)

    def members(self) -> set[int]:
        found: set[int] = set()
        if self.peek() == "^":
            raise ValueError("classes of all but some letters are not supported")
        while (c := self.take()) != "]":
            low = high = self.byte(c)
            if self.peek() == "-" and self.text[self.at + 1 : self.at + 2] not in ("]", ""):
                self.take()
                high = self.byte(self.take())
            found |= set(range(low, high + 1))
        return found


def backwards(node: Node) -> Node:
    """The tree of all matches read from their last byte to their first."""
    kind = node[0]
    if kind == "set":
        return node
    if kind == "rep":
        return ("rep", backwards(node[1]), *node[2:])
    parts = [backwards(p) for p in node[1]]
    return (kind, parts[::-1] if kind == "cat" else parts)


@dataclass
class Positions:
    """The places of patterns at which a byte is read, and which may come after which."""

    sets: list[frozenset] = field(default_factory=list)
    follow: list[set[int]] = field(default_factory=list)

    def add(self, node: Node) -> tuple[bool, set[int], set[int]]:
        """Whether the part may be empty, its first and its last places."""
        kind = node[0]
        if kind == "set":
            self.sets.append(node[1])
            self.follow.append(set())
            return False, {len(self.sets) - 1}, {len(self.sets) - 1}
        if kind == "alt":
            found = [self.add(p) for p in node[1]]
            return any(f[0] for f in found), set().union(*(f[1] for f in found)), set().union(*(f[2] for f in found))
        if kind == "rep":
            _, part, least, most = node
            if most is None:
                copies = [self.add(part) for _ in range(max(1, least))]
                self.link(copies[-1][2], copies[-1][1])
                copies[-1] = (copies[-1][0] or least == 0, *copies[-1][1:])
            else:
                copies = [self.add(part) for _ in range(most)]
                copies = [(c[0] or k >= least, c[1], c[2]) for k, c in enumerate(copies)]
            return self.chain(copies)
        return self.chain([self.add(p) for p in node[1]])

    def link(self, before: set[int], after: set[int]) -> None:
        for p in before:
            self.follow[p] |= after

    def chain(self, parts: list[tuple[bool, set[int], set[int]]]) -> tuple[bool, set[int], set[int]]:
        empty, first, last = True, set(), set()
        for e, f, t in parts:
            self.link(last, f)
            first = first | f if empty else first
            last = last | t if e else set(t)
            empty = empty and e
        return empty, first, last


@dataclass
class Automaton:
    """``table[state, class of the byte]`` is the next state; bit r of ``out[state]`` says that pattern r ends there.

    State 0 is the start. States that end a pattern come last, from ``first_out`` on.
    """

    table: np.ndarray
    out: np.ndarray
    byte_class: np.ndarray
    first_out: int
    dead: int

    @cached_property
    def rows(self) -> list[list[int]]:
        """Next states by state and byte, for walks over few bytes."""
        return self.table[:, self.byte_class].tolist()


def compile_patterns(trees: list[Node], anchored: bool) -> Automaton:
    """One automaton for all patterns, least in states.

    ``anchored``: matches begin at the first byte; else at any byte.
    """
    places = Positions()
    firsts, lasts = [], []
    for tree in trees:
        empty, first, last = places.add(tree)
        if empty:
            raise ValueError("a pattern that matches nothing at all has no place in a text")
        firsts.append(first)
        lasts.append(last)
    begin = frozenset().union(*firsts)
    # Bytes that no place tells apart are of one class.
    holds = np.zeros((256, len(places.sets)), bool)
    for p, members in enumerate(places.sets):
        holds[list(members), p] = True
    _, of_byte = np.unique(holds, axis=0, return_inverse=True)
    of_byte = of_byte.ravel()
    sample = [int(np.flatnonzero(of_byte == c)[0]) for c in range(of_byte.max() + 1)]
    matched_by = [frozenset(np.flatnonzero(holds[b]).tolist()) for b in sample]

    # A state is the set of places just read; None is the start of an anchored automaton.
    start = None if anchored else frozenset()
    number: dict = {start: 0}
    order: list = [start]
    table: list[list[int]] = []
    for state in order:
        ahead = set(begin) if state is None or not anchored else set()
        for p in state or ():
            ahead |= places.follow[p]
        row = []
        for members in matched_by:
            after = frozenset(ahead & members)
            if after not in number:
                number[after] = len(order)
                order.append(after)
            row.append(number[after])
        table.append(row)
    out = np.array([sum(1 << r for r, last in enumerate(lasts) if s and s & last) for s in order], np.int64)
    return _minimised(np.array(table, np.int64), out, of_byte.astype(np.uint8), start is None)


def _minimised(table: np.ndarray, out: np.ndarray, byte_class: np.ndarray, anchored: bool) -> Automaton:
    """States with equal outputs are parted until all of a block lead to the same blocks."""
    block = np.unique(out, return_inverse=True)[1].ravel()
    while True:
        finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == block.max():
            break
        block = finer
    kept = np.unique(block, return_index=True)[1]
    small, ends = block[table[kept]], out[kept]
    # The start first, states with output last.
    rank = np.where(kept == np.flatnonzero(block == block[0])[0], -1, np.where(ends != 0, 1, 0))
    order = np.argsort(rank, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    small, ends = place[small[order]], ends[order]
    still = np.flatnonzero((ends == 0) & (small == np.arange(len(small))[:, None]).all(axis=1))
    dead = int(still[0]) if anchored and len(still) else -1
    return Automaton(small, ends, byte_class, int((ends == 0).sum()), dead)
