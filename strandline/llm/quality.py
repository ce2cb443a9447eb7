"""Quality rules: base word counts, then zstandard compression bands.

A text that passes the base rules is compressed whole and in fixed chunks. Its
ratio (compressed bytes / bytes) must lie in a band that depends on the length:
short texts compress badly and have a wide band, long ones a narrow one. Below
the band a text repeats itself; above it, it is noise (keys, encoded data). The
same goes for chunks: a text goes if too large a share of its bytes lies in
chunks outside their band.

Chunks are judged in texts of over 5,120 bytes only: shorter ones are a chunk or so
themselves, and have the band of the whole text alone.

Null and empty texts have zero counts and fail the base rules. Everything is
computed row by row over whole texts, however long, so repeated rows get equal
verdicts. An empty table gives no rows; columns of any name pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_struct, free_name, struct_array

FIELDS = {
    "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long",
    "base_failed": "boolean", "kept": "boolean", "ratio": "double", "outside_share": "double",
}
#: What parts words, and what counts as a symbol. Fixed values.
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Bands:
    """Limits by length: (bytes up to which they hold, least ratio, largest ratio).

    ``chunk`` bytes are compressed at a time for the chunk band, and at most
    ``outside`` of a text's bytes may lie in chunks beyond it. A last chunk
    under a quarter of the full size is judged with the one before it.

    Upper limits lie between clean texts and random base64 letters in words of
    five and more, whose ratios fall from 0.84 at 400 bytes to 0.72 at 8 KB.
    """

    level: int = 3
    whole: tuple[tuple[float, float, float], ...] = (
        (400, 0.20, 0.82),
        (512, 0.20, 0.79),
        (1024, 0.16, 0.74),
        (2048, 0.16, 0.71),
        (8192, 0.12, 0.68),
        (float("inf"), 0.08, 0.65),
    )
    chunk: int = 4096
    chunk_band: tuple[float, float] = (0.10, 0.68)
    outside: float = 0.5

    def limits(self, size: int) -> tuple[float, float]:
        return next((low, high) for most, low, high in self.whole if size <= most)


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more, first included."""
    n = len(words)
    if n < 4:
        return 0
    number = dict.fromkeys(words)
    for k, w in enumerate(number):
        number[w] = k
    a = np.fromiter(map(number.__getitem__, words), np.int64, n)
    if len(number) < 1 << 21:
        window = (a[:-2] * len(number) + a[1:-1]) * len(number) + a[2:]
    else:
        _, pair = np.unique(a[:-2] * len(number) + a[1:-1], return_inverse=True)
        window = pair * len(number) + a[2:]
    order = np.argsort(window, kind="stable")
    same = np.diff(window[order]) == 0
    again = np.zeros(n - 2, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= again
    return int(covered.sum())


class QualityRules:
    def __init__(self, bands: Bands, least_words: int, most_repeat: int):
        self.bands, self.least_words, self.most_repeat = bands, least_words, most_repeat
        self.press = zstandard.ZstdCompressor(level=bands.level)

    def compression(self, data: bytes) -> tuple[bool, float, float]:
        """Verdict, whole ratio, share of bytes in chunks outside their band."""
        b, size = self.bands, len(data)
        ratio = len(self.press.compress(data)) / size
        low, high = b.limits(size)
        if size <= b.chunk + b.chunk // 4:
            return low <= ratio <= high, ratio, 0.0
        cuts = list(range(0, size, b.chunk))
        if size - cuts[-1] < b.chunk // 4:
            cuts.pop()
        outside = 0
        for a, e in zip(cuts, [*cuts[1:], size], strict=True):
            part = len(self.press.compress(data[a:e])) / (e - a)
            if not b.chunk_band[0] <= part <= b.chunk_band[1]:
                outside += e - a
        return low <= ratio <= high and outside <= b.outside * size, ratio, outside / size

    def judge(self, text: str | None) -> tuple:
        text = text or ""
        data = text.encode("utf-8")
        words = data.split()
        n = len(words)
        chars = len(text) - sum(map(text.count, BLANKS))
        symbols = sum(map(text.count, SYMBOLS))
        lines = [x for x in data.split(b"\n") if x.strip()]
        repeated = repeat_words(words)
        failed = n < self.least_words or 100 * repeated > self.most_repeat * n
        kept, ratio, outside = (False, None, None) if failed else self.compression(data)
        return n, chars, symbols, len(lines) - len(set(lines)), repeated, failed, kept, ratio, outside


def _factory(bands: Bands, least_words: int, most_repeat: int):
    rules = QualityRules(bands, least_words, most_repeat)
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}

    def run(texts: list[str | None]) -> pa.StructArray:
        columns = zip(*map(rules.judge, texts), strict=True) if texts else [()] * len(FIELDS)
        return struct_array(**{f: pa.array(c, kinds[FIELDS[f]]) for f, c in zip(FIELDS, columns, strict=True)})

    return run


def with_quality(df: DataFrame, text_col: str = "text", out: str = "quality", bands: Bands = Bands(), least_words: int = 50, most_repeat: int = 50) -> DataFrame:
    """``df`` plus a struct with the counts, ``base_failed``, ``kept``, ``ratio`` and ``outside_share``.

    ``ratio`` and ``outside_share`` are null where the base rules have failed.
    """
    return add_struct(df, [text_col], out, ", ".join(f"{f} {t}" for f, t in FIELDS.items()), _factory, bands, least_words, most_repeat)


def keep_good(df: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df`` that pass, with the columns that they came with."""
    name = free_name(df, "quality_verdict")
    return with_quality(df, text_col, name, **options).filter(F.col(f"`{name}`.kept")).drop(name)


def quality_report(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id and all fields of ``with_quality`` for every row."""
    narrow = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("body"))
    return with_quality(narrow, "body", "q").select("doc_id", *[f"q.{f}" for f in FIELDS])
