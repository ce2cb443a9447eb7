"""Pair merging over ragged numpy arrays: many short symbol rows at once, or a long one."""

from __future__ import annotations

import heapq

import numpy as np

NO_RANK = np.int64(1 << 40)


class PairTable:
    """Rank and product of each mergeable pair of symbols, looked up for arrays of pairs."""

    def __init__(self, left, right, rank, product):
        keys = (np.asarray(left, np.int64) << 32) | np.asarray(right, np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        # A last entry stands for "no such pair".
        self.rank = np.append(np.asarray(rank, np.int64)[order], NO_RANK)
        self.product = np.append(np.asarray(product, np.int32)[order], 0)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Entry of each pair; the last entry if it can't be merged."""
        none = len(self.keys)
        if not none:
            return np.zeros(len(left), np.int64)
        want = (left.astype(np.int64) << 32) | right
        at = np.searchsorted(self.keys, want)
        return np.where(self.keys[np.minimum(at, none - 1)] == want, at, none)


def merge_rows(symbols: np.ndarray, sizes: np.ndarray, pairs: PairTable, one_at_a_time: bool = False, keep: bool = False):
    """Merge all rows to the end, rank by rank, in step.

    ``symbols`` holds the rows one after the other, ``sizes`` their lengths (1 or
    more). In each round every row finds its lowest-rank pair and applies it: at
    all its places from the left, or with ``one_at_a_time`` at the leftmost only
    (for vocabularies in which a product can outrank what made it). Returns the
    number of surviving symbols of each row and, with ``keep``, those symbols.
    """
    none = len(pairs.keys)
    left = sizes.astype(np.int64).copy()
    rows, size = np.arange(len(sizes)), left.copy()
    entry = np.full(len(symbols), none)
    inner = np.ones(len(symbols), bool)
    inner[np.cumsum(left) - 1] = False
    at = np.flatnonzero(inner)
    entry[at] = pairs.find(symbols[at], symbols[at + 1])
    rank = pairs.rank[entry]
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(rows):
        starts = np.cumsum(size) - size
        lowest = np.minimum.reduceat(rank, starts)
        live = lowest < NO_RANK
        if not live.all():
            left[rows[~live]] = size[~live]
            stay = np.repeat(live, size)
            if keep:
                done.append((rows[~live], size[~live], symbols[~stay]))
            symbols, rank, entry = symbols[stay], rank[stay], entry[stay]
            rows, size, lowest = rows[live], size[live], lowest[live]
            if not len(rows):
                break
        owner = np.repeat(np.arange(len(rows)), size)
        hit = np.flatnonzero(rank == lowest[owner])
        if one_at_a_time:
            hit = hit[np.flatnonzero(np.diff(owner[hit], prepend=-1))]
        else:
            # Overlapping hits (a pair of equal symbols, repeated): every other one, from the left.
            run = np.flatnonzero(np.diff(hit, prepend=-2) != 1)
            within = np.arange(len(hit)) - np.repeat(run, np.diff(run, append=len(hit)))
            hit = hit[within % 2 == 0]
        symbols[hit] = pairs.product[entry[hit]]
        stay = np.ones(len(symbols), bool)
        stay[hit + 1] = False
        size = size - np.bincount(owner[hit], minlength=len(rows))
        new_at = hit - np.arange(len(hit))
        symbols, rank, entry, owner = symbols[stay], rank[stay], entry[stay], owner[stay]
        # A merged symbol's pairs are new, on both sides.
        touched = np.concatenate([new_at, new_at[new_at > 0] - 1])
        after = np.minimum(touched + 1, len(symbols) - 1)
        same = (after > touched) & (owner[touched] == owner[after])
        entry[touched] = np.where(same, pairs.find(symbols[touched], symbols[after]), none)
        rank[touched] = pairs.rank[entry[touched]]
    if not keep:
        return left, None
    out = np.zeros(int(left.sum()), symbols.dtype)
    first = np.cumsum(left) - left
    for r, n, s in done:
        at = np.repeat(first[r] - (np.cumsum(n) - n), n) + np.arange(len(s))
        out[at] = s
    return left, out


def merge_long(symbols: np.ndarray, pairs: PairTable) -> np.ndarray:
    """The surviving symbols of one row of any length: as ``merge_rows``, in n log n steps.

    Places of pairs are listed by rank, and a round looks only at those of the lowest.
    """
    none, n = len(pairs.keys), len(symbols)
    symbols = np.append(symbols.astype(np.int64), -1)
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    live = np.ones(n + 1, bool)
    live[n] = False
    waiting: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def offer(at: np.ndarray) -> None:
        entry = pairs.find(symbols[at], symbols[after[at]])
        at, rank = at[entry < none], pairs.rank[entry[entry < none]]
        if not len(at):
            return
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        starts = np.flatnonzero(np.diff(rank, prepend=-1))
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(rank)], strict=True):
            r = int(rank[a])
            if r not in waiting:
                waiting[r] = []
                heapq.heappush(heap, r)
            waiting[r].append(at[a:b])

    offer(np.arange(n - 1))
    while heap:
        r = heapq.heappop(heap)
        hit = np.unique(np.concatenate(waiting.pop(r)))
        hit = hit[live[hit]]
        entry = pairs.find(symbols[hit], symbols[after[hit]])
        hit, entry = hit[pairs.rank[entry] == r], entry[pairs.rank[entry] == r]
        if not len(hit):
            continue
        # Overlapping hits: every other one, from the left.
        run = np.flatnonzero(np.append(True, after[hit[:-1]] != hit[1:]))
        within = np.arange(len(hit)) - np.repeat(run, np.diff(run, append=len(hit)))
        hit, entry = hit[within % 2 == 0], entry[within % 2 == 0]
        gone = after[hit]
        symbols[hit] = pairs.product[entry]
        live[gone] = False
        symbols[gone] = -1
        after[hit] = after[gone]
        before[after[hit]] = hit
        left = before[hit]
        offer(np.unique(np.concatenate([hit, left[left >= 0]])))
    return symbols[:n][live[:n]]
