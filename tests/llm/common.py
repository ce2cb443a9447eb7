"""Small tables with everything that goes wrong in real ones."""

from __future__ import annotations

import random

SYLLABLES = "an ti on re th er is ou ly ed hi mo ka".split()


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(n))


def odd_documents(seed: int = 1) -> list[tuple]:
    """(doc_id, text, lang, source, n_chars): nulls, empty and long texts, copies, repeated rows."""
    rng = random.Random(seed)
    base = [words(rng, n) for n in (60, 80, 120, 55, 400)]
    texts = [*base, base[0], base[1] + ".", None, "", " ", "\n\n", "a", "été naïf ÀÉ 日本語 😀 " + base[2], base[3].upper(), "x" * 5000, words(rng, 30_000), "line one\nline one\n" + base[2], "  two  blanks\t\ttabs \r\n" + base[3]]
    rows = [(k, t, ("en", "fr", None)[k % 3], f"s{k % 2}", len(t or "")) for k, t in enumerate(texts)]
    return [*rows, rows[0], (None, base[4], "en", None, None), (None, None, None, None, None)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows=None):
    return spark.createDataFrame(odd_documents() if rows is None else rows, SCHEMA)
