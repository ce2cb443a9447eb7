"""Exact byte-level BPE token counts by rank-synchronous array merging.

Texts are cut into pre-tokens. The distinct pre-tokens that a batch brings are
held as one ragged numpy array (flat symbols plus row sizes). In each round
every row finds its lowest-rank pair and all rows apply theirs at the same
time; rows without a pair left are done and their surviving symbols counted.
A text's count is the sum over its pre-tokens. A pre-token of thousands of bytes is
merged by itself, with the places of its pairs listed by rank.

Texts are read whole; a very long one takes memory in proportion. An empty table
gives an empty report. Nulls and empty texts have 0 tokens. Repeated rows are counted one by one.
Special tokens written out in a text count as one token each, the default of
the tokenizer library.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BoundedCache, add_struct, struct_array, worker_state
from .ragged import PairTable, merge_long, merge_rows

#: Bytes of a pre-token from which it is merged by itself.
LONG = 2048

#: Unicode white space. Fixed values.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def newer_letters() -> str:
    """Code points, as a set's inside, that the pattern engine here counts as letters or numbers and the tokenizer library doesn't.

    Only characters newer than this Python's tables can differ; the library's own
    splitter is asked about those.
    """
    from tokenizers import Regex, pre_tokenizers

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    asked = [c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn"]
    found = pre_tokenizers.Split(Regex(r"[\p{L}\p{N}]"), "isolated").pre_tokenize_str("\n".join(asked))
    known = {c for c, _ in found}
    odd = sorted(ord(c) for c in asked if c not in known)
    starts = [c for k, c in enumerate(odd) if not k or odd[k - 1] != c - 1]
    ends = [c for k, c in enumerate(odd) if k + 1 == len(odd) or odd[k + 1] != c + 1]
    return "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in zip(starts, ends, strict=True))


@lru_cache(2)
def pretokens(western: bool) -> regex.Pattern:
    """The pre-token pattern of the vocabulary's library; for ``western`` (Latin-1) texts a shorter one that cuts them alike."""
    newer = "" if western else newer_letters()
    letter, number = (rf"[\p{{{c}}}--[{newer}]]" if newer else rf"\p{{{c}}}" for c in "LN")
    return regex.compile(
        rf"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?[^{SPACE}{letter}{number}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+",
        regex.V0 if western else regex.V1,
    )


def is_western(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


#: Where white space is not single blanks or line ends, cutting at them is not safe.
ODD_SPACE = re.compile(r"\s\s|[^\S \n]")


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in set(plain)]
    stand_in = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(moved)}
    return [stand_in[b] for b in range(256)]


class ByteBpeCounter:
    """Counts tokens of texts under a byte-level BPE vocabulary file (.json)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        ids = lambda k: [vocab[m[k]] for m in merges]
        self.pairs = PairTable(ids(0), ids(1), range(len(merges)), [vocab[a + b] for a, b in merges])
        self.start = np.array([vocab[c] for c in byte_symbols()], np.int32)
        self.special = [t["content"] for t in spec.get("added_tokens", []) if t.get("special")]
        self.split = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.cut = pretokens(False).findall
        self.cache = BoundedCache()

    def merged_sizes(self, words: list[str]) -> list[int]:
        """Tokens of each pre-token, by the array method; one over ``LONG`` bytes is an array of its own."""
        raw = [w.encode("utf-8") for w in words]
        if max(map(len, raw), default=0) > LONG:
            short = iter(self.merged_sizes([w for w, b in zip(words, raw, strict=True) if len(b) <= LONG]))
            return [next(short) if len(b) <= LONG else len(merge_long(self.start[np.frombuffer(b, np.uint8)], self.pairs)) for b in raw]
        if not raw:
            return []
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        return merge_rows(self.start[np.frombuffer(b"".join(raw), np.uint8)], sizes, self.pairs)[0].tolist()

    def chunks(self, text: str) -> tuple[int, list[str]]:
        """Cut a text where no pre-token reaches across, and what to add to its chunks' counts.

        A chunk that begins with a line end stands as it is; all others follow a blank.
        Texts with other white space are cut into their pre-tokens, marked with two
        line ends (never side by side in other chunks), of which one counts and is
        taken off again by the first number.
        """
        add, out = 0, []
        parts = [text]
        if self.split and self.split.search(text):
            parts = self.split.split(text)
            add = len(parts) - 1
        for part in parts:
            if ODD_SPACE.search(part):
                found = self.cut(part)
                add -= len(found)
                out += ["\n\n" + p for p in found]
            else:
                add -= 1
                out += ("\n" + part).replace("\n", " \n").split(" ")[1:]
        return add, out

    def learn(self, chunks: list[str]) -> None:
        """Count the chunks that the cache lacks."""
        cut = [["\n", c[2:]] if c[:2] == "\n\n" else self.cut(c if c[:1] == "\n" else " " + c) for c in chunks]
        words = list({p for ps in cut for p in ps})
        n = dict(zip(words, self.merged_sizes(words), strict=True)) if words else {}
        for c, ps in zip(chunks, cut, strict=True):
            self.cache[c] = sum(map(n.__getitem__, ps))

    def count(self, texts: list[str | None], block_chars: int = 1_000_000) -> list[int]:
        counts: list[int] = []
        block, held = [], 0
        for text in texts:
            block.append(text or "")
            held += len(block[-1])
            if held >= block_chars:
                counts += self._count_block(block)
                block, held = [], 0
        return counts + (self._count_block(block) if block else [])

    def _count_block(self, texts: list[str]) -> list[int]:
        cache = self.cache
        cache.make_room()
        self.cut = pretokens(all(map(is_western, texts))).findall
        cut = [self.chunks(t) for t in texts]
        new = cache.missing(chain.from_iterable(chunks for _, chunks in cut))
        self.learn(new)
        counts = [add + sum(map(cache.__getitem__, chunks)) for add, chunks in cut]
        cache.entered(new)
        return counts


def counter(path: str | None) -> ByteBpeCounter:
    """The worker's counter; without a path, the installed 50k byte-level vocabulary."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return worker_state(("byte_bpe", path), lambda: ByteBpeCounter(path))


def _factory(path: str | None):
    c = counter(path)
    return lambda texts: struct_array(n_tokens=pa.array(c.count(texts), pa.int64()))


def with_token_counts(df: DataFrame, text_col: str = "text", out: str = "tokens", path: str | None = None) -> DataFrame:
    """``df`` plus a struct column ``out`` with ``n_tokens`` (long) of each whole text.

    One map over the rows: no shuffle, no driver work. Null text: 0.
    """
    return add_struct(df, [text_col], out, "n_tokens long", _factory, path)


def token_report(df: DataFrame, limit: int = 512, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``df``.

    Null texts have 0 bytes and 0 tokens; repeated rows are each reported; other
    columns of ``df`` play no part; an empty table gives an empty report.
    """
    narrow = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("body"))
    counted = with_token_counts(narrow, "body", "found")
    return counted.select(
        "doc_id",
        F.coalesce(F.octet_length("body"), F.lit(0)).cast("long").alias("n_bytes"),
        F.col("found.n_tokens").alias("n_tokens"),
        (F.col("found.n_tokens") > limit).alias("over_limit"),
    )
