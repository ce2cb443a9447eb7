"""K-mers of many texts at once, as numbers: what ``kmers`` does inside a task, before anything is a row.

Texts are taken in blocks of bounded size, longer ones in pieces that overlap. All
results are exact: hashes only leave out what can't be wanted, or are compared letter by letter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

from ..functions import bases

#: Letters of a block. Arrays of eight bytes for each letter are held, a dozen at a time.
BLOCK = 1 << 18
FACTOR = 0x9E3779B97F4A7C15


class Block:
    """Pieces of texts side by side, ``gap`` letters apart: their rows, where they start in their text, and where in the block."""

    def __init__(self, pieces: list[tuple[int, int, str]], gap: int):
        self.rows = np.array([p[0] for p in pieces], np.int64)
        self.starts = np.array([p[1] for p in pieces], np.int64)
        self.sizes = np.array([len(p[2]) for p in pieces], np.int64)
        self.at = np.cumsum(self.sizes + gap) - self.sizes - gap
        self.text = ("\0" * gap).join([p[2] for p in pieces])
        self.codes = np.frombuffer(self.text.encode("utf-32-le"), "<u4")

    def places(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Where words of ``k`` letters begin in the block, and the piece of each."""
        n = np.maximum(self.sizes - k + 1, 0)
        piece = np.repeat(np.arange(len(n)), n)
        return np.arange(len(piece)) + np.repeat(self.at - (np.cumsum(n) - n), n), piece

    def words(self, at: np.ndarray, k: int) -> pa.Array:
        """The words of ``k`` letters at some places."""
        if self.text.isascii() and len(at) * k < 1 << 31:
            views = np.lib.stride_tricks.sliding_window_view(np.frombuffer(self.text.encode(), np.uint8), k) if len(at) else np.zeros((0, k), np.uint8)
            offsets = np.arange(len(at) + 1, dtype=np.int32) * k
            return pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(views[at]))])
        return pa.array([self.text[p : p + k] for p in at.tolist()], pa.string())


def blocks(texts: Iterable[str | None], overlap: int, gap: int = 0, most: int | None = None, early: int = 0) -> Iterator[Block]:
    """All texts but nulls and empty ones, in blocks. A piece of a longer text also holds the ``overlap`` letters after it, and ``early`` ones before."""
    most = most or BLOCK
    pieces: list[tuple[int, int, str]] = []
    held = 0
    for row, text in enumerate(texts):
        for start in range(0, max(len(text or "") - overlap, min(len(text or ""), 1)), most):
            first = max(0, start - early)
            piece = text[first : start + most + overlap]
            if pieces and held + len(piece) + gap > most:
                yield Block(pieces, gap)
                pieces, held = [], 0
            pieces.append((row, first, piece))
            held += len(piece) + gap
    if pieces:
        yield Block(pieces, gap)


def folded(one: np.ndarray, k: int, join: Callable[[np.ndarray, np.ndarray, int], np.ndarray]) -> np.ndarray:
    """A value for each run of ``k`` items: ``join`` has the values of runs, of those right behind them, and the length of these."""
    out, done, power, size = None, 0, one, 1
    for bit in bin(k)[:1:-1]:
        if bit == "1":
            # Longer runs stand in front of the shorter ones that are there already.
            out = power if out is None else join(power[: len(one) - done - size + 1], out[size:], done)
            done += size
        if done < k:
            power = join(power[: len(one) - 2 * size + 1], power[size:], size) if len(one) >= 2 * size else power[:0]
            size *= 2
    return out


def hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all runs of ``k`` letters."""
    if len(codes) < k:
        return np.zeros(0, np.uint64)
    one = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(FACTOR)
    one ^= one >> np.uint64(31)
    h = folded(one, k, lambda a, b, n: a * np.uint64(pow(0xD6E8FEB86659FD93, n, 1 << 64)) + b)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(FACTOR)
    return h ^ (h >> np.uint64(29))


class Sieve:
    """A bitmap in which every wanted word has two bits set: what lacks one of them isn't wanted."""

    def __init__(self, bits: int, words: np.ndarray | None = None):
        self.bits = bits
        self.words = np.zeros(bits // 64, np.uint64) if words is None else words

    def places(self, h: np.ndarray) -> list[np.ndarray]:
        return [((h >> np.uint64(s)) & np.uint64(self.bits - 1)).astype(np.int64) for s in (0, 32)]

    def may_hold(self, h: np.ndarray) -> np.ndarray:
        """Places in ``h`` of what may be wanted."""
        at = np.arange(len(h))
        for k in (0, 1):
            p = self.places(h[at])[k]
            at = at[(self.words[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) > 0]
        return at


def rare_numbers(block: Block, k: int, most: int) -> np.ndarray:
    """For each piece of a block, the number of different words that it has ``most`` times at most."""
    at, piece = block.places(k)
    h = hashes(block.codes, k)[at] + piece.astype(np.uint64) * np.uint64(FACTOR)
    order = np.argsort(h)
    h, at, piece = h[order], at[order], piece[order]
    again = np.flatnonzero(h[1:] == h[:-1]) + 1
    # Equal hashes are equal words, or the block is counted word by word.
    same = piece[again] == piece[again - 1]
    for j in range(k):
        same &= block.codes[at[again] + j] == block.codes[at[again - 1] + j]
    if not same.all():
        found = Counter((p, block.text[a : a + k]) for p, a in zip(piece.tolist(), at.tolist(), strict=True))
        return np.bincount(np.array([p for (p, _), n in found.items() if n <= most], np.int64), minlength=len(block.rows))
    new = np.ones(len(h), bool)
    new[again] = False
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(h)))
    return np.bincount(piece[first[counts <= most]], minlength=len(block.rows))


def _in_order(parts: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
    """Numbers from 0 in the same order as the values of all parts, and how many there are."""
    values, number = np.unique(np.concatenate(parts), return_inverse=True)
    return np.split(number.astype(np.int64), np.cumsum([len(p) for p in parts])[:-1]), len(values)


def ordered(codes: np.ndarray, k: int, strands: bool) -> tuple[np.ndarray, int]:
    """A number for each run of ``k`` letters, in the order of the words (with ``strands``, of the lesser of both strands), and a bound of them."""
    sides = [codes]
    if strands:
        table = np.arange(128, dtype=codes.dtype)
        table[[ord(c) for c in bases.FROM_BASES]] = [ord(c) for c in bases.TO_BASES]
        sides.append(np.where(codes < 128, table[np.minimum(codes, 127)], codes))
    one, size = _in_order(sides)
    bound = {1: size}

    def join(a: list[np.ndarray], b: list[np.ndarray], n: int, m: int) -> list[np.ndarray]:
        """Of runs of ``n`` letters and those of ``m`` behind them. On the other strand the last ``n`` letters come first."""
        left = max(0, len(codes) - n - m + 1)
        out = [a[0][:left] * bound[m] + b[0][n : n + left], *[x[m : m + left] * bound[m] + y[:left] for x, y in zip(a[1:], b[1:], strict=True)]]
        bound[n + m] = bound[n] * bound[m]
        if bound[n + m] > 1 << 31:
            out, bound[n + m] = _in_order(out)
        return out

    out, done, power, width = None, 0, one, 1
    for bit in bin(k)[:1:-1]:
        if bit == "1":
            out = power if out is None else join(power, out, width, done)
            done += width
        if done < k:
            power = join(power, power, width, width)
            width *= 2
    return np.minimum(out[0], out[-1]), bound[k]


def minimizers(block: Block, k: int, w: int, strands: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pieces and places in the block of the picked words: the least of each window, leftmost of equals, without repeats in a row.

    Pieces that don't begin their text start a letter early: the window before theirs is
    looked at for what was picked last, and that pick is the earlier piece's.
    """
    at, piece = block.places(k)
    if not len(at):
        return piece, at
    word, size = ordered(block.codes, k, strands)
    shift = len(block.codes).bit_length()
    if size.bit_length() + shift > 62:
        (word,), size = _in_order([word])
    key = np.full(len(block.codes) + w, np.iinfo(np.int64).max)
    key[at] = word[at] << shift | at
    least = folded(key, w, lambda a, b, _: np.minimum(a, b))
    n = np.maximum(block.sizes - k + 1, 0)
    place = at - block.at[piece]
    picked = least[at] & ((1 << shift) - 1)
    full = (place + w <= n[piece]) | ((place == 0) & (n[piece] < w))
    piece, picked = piece[full], picked[full]
    new = np.append(True, (picked[1:] != picked[:-1]) | (piece[1:] != piece[:-1]))
    piece, picked = piece[new], picked[new]
    head = np.append(True, piece[1:] != piece[:-1])
    value = word[picked]
    keep = np.append(True, value[1:] != value[:-1]) | head
    keep &= ~(head & (block.starts[piece] > 0))
    return piece[keep], picked[keep]
