"""Secrets in text: all rules in one automaton, one pass over the bytes.

The rules' regular expressions, read backwards, become one deterministic automaton
(subset construction, then minimisation). It reads each text once, from its last byte
to its first, and is in a state with output exactly where a match of some rule begins.
From each beginning that counts, the rule's own anchored automaton finds the longest
match. Of one rule's matches the leftmost counts, then the next that begins at its
end or later. Matches whose value has fewer letters than the rule asks for are dropped
after that, so what they cover isn't searched again.

The pass runs on many stretches of a batch at once: each begins as if nothing came
before it; then those stretches whose true first state is another are run again until
they come to the states that they had. So the states are those of one long pass.

Null and empty texts have no spans. Texts are read whole, in blocks, whatever their
length. Repeated rows get equal spans; an empty table gives no rows. Columns of any
name pass through; an output column that the table has already is refused.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import Automaton, PatternReader, backwards, compile_patterns
from .common import add_struct, struct_array, worker_state


@dataclass(frozen=True)
class Rule:
    """A match is ``head`` and then ``value``; ``least`` is the number of letters that the value needs."""

    kind: str
    value: str
    head: str = ""
    least: int = 1


#: Fixed by the query's contract. A run of hex digits is matched whole, so its least length can stand in the pattern.
BASE = (
    Rule("assign", r"[A-Za-z0-9+/_.=-]+", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", 6),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Forms of keys that are published by those who issue them.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("slack", r"xox[abeprs]-[A-Za-z0-9-]+", least=15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", least=39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", least=40),
    Rule("login", r"[a-z]+://[A-Za-z0-9._~%-]+:[A-Za-z0-9._~%!$&*+=-]+@"),
)
RULES = BASE + MORE
#: Parts texts in a batch: no UTF-8 text has this byte, and no rule.
END = 0xFF
#: Bytes of a stretch, and of what is scanned at a time.
STRETCH, BLOCK = 256, 4 << 20
SPANS = "array<struct<kind:string,start:long,end:long>>"
SPANS_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        if len({r.kind for r in rules}) < len(rules) or len(rules) > 62:
            raise ValueError("rules need different kinds, and there may be 62 of them")
        tree = lambda text: PatternReader(text).tree()
        self.rules = rules
        whole = [("cat", [tree(r.head), tree(r.value)]) for r in rules]
        self.starts = compile_patterns([backwards(t) for t in whole], anchored=False)
        self.whole = [compile_patterns([t], anchored=True) for t in whole]
        self.heads = [compile_patterns([tree(r.head)], anchored=True) if r.head else None for r in rules]
        classes = self.starts.table.shape[1]
        # States are numbered by where their row begins, so one addition finds the next.
        self.next = (self.starts.table * classes).ravel().astype(np.intp)
        self.first_out = self.starts.first_out * classes
        self.classes = classes

    def _states(self, classes: np.ndarray, state: int) -> tuple[np.ndarray, int]:
        """States after each byte of ``classes``, a multiple of ``STRETCH`` long, and the last one; ``state`` comes before."""
        lanes = len(classes) // STRETCH
        read = np.ascontiguousarray(classes.reshape(lanes, STRETCH).T)
        states = np.empty((STRETCH, lanes), np.int32)
        used = np.zeros(lanes, np.intp)
        used[0] = state
        now = used.copy()
        for k in range(STRETCH):
            now = self.next[now + read[k]]
            states[k] = now
        while True:
            true = np.concatenate([[state], states[-1, :-1]]).astype(np.intp)
            open_ = np.flatnonzero(true != used)
            if not len(open_):
                return states, int(states[-1, -1])
            used[open_] = true[open_]
            now = true[open_]
            for k in range(STRETCH):
                now = self.next[now + read[k, open_]]
                differ = now != states[k, open_]
                if not differ.all():
                    open_, now = open_[differ], now[differ]
                    if not len(open_):
                        break
                states[k, open_] = now

    def beginnings(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``flat`` matches begin, in order, and bits for the rules whose they are."""
        size = len(flat)
        whole = -(-size // STRETCH) * STRETCH
        places, bits, state = [], [], 0
        for end in range(whole, 0, -BLOCK):
            begin = max(0, end - BLOCK)
            # What lies before the first byte is as good as an END.
            low = begin - (whole - size)
            block = flat[max(0, low) : end - (whole - size)]
            if low < 0:
                block = np.concatenate([np.full(-low, END, np.uint8), block])
            states, state = self._states(self.starts.byte_class[block[::-1]], state)
            step, lane = np.nonzero(states >= self.first_out)
            at = end - 1 - (lane * STRETCH + step) - (whole - size)
            order = np.argsort(at)
            places.append(at[order])
            bits.append(self.starts.out[states[step, lane] // self.classes][order])
        if not places:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(places[::-1]), np.concatenate(bits[::-1])

    @staticmethod
    def _reach(automaton: Automaton, data: bytes, at: int, end: int) -> int:
        """The last place up to ``end`` at which a match from ``at`` on may end, -1 if there is none."""
        state, found, rows = 0, -1, automaton.rows
        first_out, dead = automaton.first_out, automaton.dead
        while at < end:
            state = rows[state][data[at]]
            if state == dead:
                break
            at += 1
            if state >= first_out:
                found = at
        return found

    def spans(self, texts: list[str | None]) -> list[list[tuple[str, int, int]]]:
        """(kind, start, end) of each text, in code points, by start and then in the order of the rules."""
        bodies = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        ends = np.cumsum([len(b) + 1 for b in bodies])
        data = b"\xff".join([*bodies, b""])
        places, bits = self.beginnings(np.frombuffer(data, np.uint8))
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for r, rule in enumerate(self.rules):
            free = 0
            mine = places[(bits >> r & 1).astype(bool)]
            k = 0
            while k < len(mine):
                start = int(mine[k])
                row = int(np.searchsorted(ends, start, side="right"))
                free = self._reach(self.whole[r], data, start, int(ends[row]) - 1)
                value = self._reach(self.heads[r], data, start, free - 1) if rule.head else start
                if sum(c & 0xC0 != 0x80 for c in data[value:free]) >= rule.least:
                    found[row].append((start, r, free))
                k = int(np.searchsorted(mine, free))
        out = []
        for row, spans in enumerate(found):
            body = bodies[row]
            begin = int(ends[row]) - 1 - len(body)
            letter: np.ndarray | None = None
            if spans and not body.isascii():
                letter = np.concatenate([[0], np.cumsum(np.frombuffer(body, np.uint8) & 0xC0 != 0x80)])
            place = (lambda p: p) if letter is None else (lambda p, letter=letter: int(letter[p]))
            out.append([(self.rules[r].kind, place(a - begin), place(e - begin)) for a, r, e in sorted(spans)])
        return out


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each span as its kind in brackets; of spans that overlap the first gives the name."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _factory(rules: tuple[Rule, ...], mask: bool):
    scanner = worker_state(("secrets", rules), lambda: Scanner(rules))

    def run(texts: list[str | None]) -> pa.StructArray:
        spans = scanner.spans(texts)
        rows = [[{"kind": k, "start": a, "end": e} for k, a, e in found] for found in spans]
        columns = {"spans": pa.array(rows, SPANS_TYPE)}
        if mask:
            columns["masked"] = pa.array([None if t is None else masked(t, s) for t, s in zip(texts, spans, strict=True)], pa.string())
        return struct_array(**columns)

    return run


def with_secrets(df: DataFrame, text_col: str = "text", out: str = "secrets", rules: tuple[Rule, ...] = RULES, mask: bool = False) -> DataFrame:
    """``df`` plus a struct: ``spans`` (kind, start, end in code points), and with ``mask`` the text without them (null stays null)."""
    return add_struct(df, [text_col], out, f"spans {SPANS}" + ", masked string" * mask, _factory, rules, mask)


def secret_report(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, spans of each base kind counted and hashed, and all spans as text."""
    narrow = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("body"))
    found = with_secrets(narrow, "body", "s", rules).select("doc_id", F.col("s.spans").alias("every"))
    base = [r.kind for r in BASE]
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("every", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    mine = text(F.filter("every", lambda s: s["kind"].isin(*base)))
    return found.select("doc_id", *map(count, base), F.sha2(mine.cast("binary"), 256).alias("base_sha256"), text(F.col("every")).alias("spans"))
