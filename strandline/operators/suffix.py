"""Suffix ranks, common prefixes and rare matches of sequence pairs as rows.

Ranks and common prefixes come from ``ranks``. A match is a set of neighbouring ranks
whose suffixes begin with more common letters than either neighbour shares with them: an
interval of the common prefixes. All widths are found in one pass over blocks of ranks.
Ends of sequences sort first, the first side's before the second's, so no sentinel letters
are needed and texts may hold any character.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import WORD, ranked_suffixes

HIT = "pair_id long, w int, m int, n int, clas long, side int, pos long, min_len long, max_len long"
HIT_NAMES = [f.split(" ")[0] for f in HIT.split(", ")]
#: Ranks of a block, at least.
BLOCK = 4096


def suffixes(pairs: DataFrame, word: int = WORD) -> DataFrame:
    """pair_id, side (1, 2), pos, r (rank of the suffix there, from 0 in the pair) and lcp with the next rank (0 at the end)."""
    return ranked_suffixes(pairs, word)


def inverse(ranked: DataFrame) -> DataFrame:
    """The rank of each position: the same rows, keyed by side and pos."""
    return ranked.select("pair_id", "side", "pos", "r")


def prefix_intervals(lcp: list[int], looks_back: bool) -> list[tuple[int, int, int, int]]:
    """(first, last, shared, floor) of maximal sets of neighbours that share more letters than their surroundings.

    ``lcp[k]`` is what ranks k and k + 1 share. A stack holds the smaller values to the left, so
    each interval is closed by the first smaller value behind it. With ``looks_back`` rank 0 is only there
    for what it shares with rank 1; intervals that reach before that aren't known whole and are left out.
    """
    out = []
    stack: list[tuple[int | None, int]] = [(None, -1)]
    if looks_back:
        stack.append((None, lcp[0]))
    for k in range(int(looks_back), len(lcp)):
        here, left = lcp[k], k
        while stack[-1][1] > here:
            left, shared = stack.pop()
            if left is not None and shared > 0:
                out.append((left, k, shared, max(here, stack[-1][1], 0)))
        if stack[-1][1] < here:
            stack.append((left, here))
    return out


def rare_matches(ranked: DataFrame, first_lengths: DataFrame, max_count: int = 50, all_widths: bool = False, block: int | None = None) -> DataFrame:
    """Hits of the least width that has any, for each pair (of every width with ``all_widths``): ``HIT``.

    Widths run from 2 to twice the lesser of the first sequence's length and ``max_count``.
    ``first_lengths`` has pair_id and n_first (null is 0). Ranks are dealt out in blocks; a block also gets as many
    ranks behind it as the widest match takes, and one before, so each interval is whole in the block that
    it begins in, however long the pair is.
    """
    reach = 2 * max_count
    size = block or max(BLOCK, 2 * reach)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        begin = key[1].as_py() * size
        table = table.sort_by("r")
        r, side, pos = (table.column(c).to_numpy() for c in ("r", "side", "pos"))
        widest = min(reach, 2 * table.column("n_first")[0].as_py())
        firsts = np.concatenate([[0], np.cumsum(side == 1)])
        found = []
        for a, b, shared, floor in prefix_intervals(table.column("lcp").to_pylist(), bool(r[0] < begin)):
            w = b - a + 1
            m = int(firsts[b + 1] - firsts[a])
            if begin <= r[a] < begin + size and w <= widest and min(m, w - m) >= 1 and max(m, w - m) <= (w + 1) // 2:
                found.append((a, w, m, shared, floor))
        width = np.array([f[1] for f in found], np.int64)
        each = lambda k: np.repeat(np.array([f[k] for f in found], np.int64), width)
        at = each(0) + np.concatenate([np.arange(w) for w in width] or [np.zeros(0, np.int64)])
        m, w = each(2), np.repeat(width, width)
        columns = [np.full(len(at), key[0].as_py(), np.int64), w.astype(np.int32), m.astype(np.int32), (w - m).astype(np.int32), r[each(0)], side[at].astype(np.int32), pos[at], each(4) + 1, each(3)]
        return pa.Table.from_arrays([pa.array(c) for c in columns], names=HIT_NAMES)

    rows = ranked.select(F.col("pair_id").cast("long"), F.col("side").cast("int"), F.col("pos").cast("long"), F.col("r").cast("long"), F.col("lcp").cast("long"))
    rows = rows.join(first_lengths.select("pair_id", F.coalesce(F.col("n_first"), F.lit(0)).cast("long").alias("n_first")), "pair_id")
    at = lambda r: (r - F.pmod(r, F.lit(size))) / size
    blocks = F.sequence(F.greatest(at(F.col("r") - reach + 1), F.lit(0)).cast("long"), at(F.col("r") + 1).cast("long"))
    found = rows.withColumn("block", F.explode(blocks)).groupBy("pair_id", "block").applyInArrow(run, HIT)
    if all_widths:
        return found
    least = found.groupBy("pair_id").agg(F.min("w").alias("w"))
    return found.join(least, ["pair_id", "w"]).select(*HIT_NAMES)


def shortest_matches(pairs: DataFrame, max_count: int = 50, all_widths: bool = False) -> DataFrame:
    """pair_id, first_freq, second_freq, len, first_starts, second_starts of the rare matches of whole pairs."""
    sizes = pairs.select("pair_id", F.coalesce(F.length("first"), F.lit(0)).alias("n_first"))
    found = anchor_intervals(rare_matches(suffixes(pairs), sizes, max_count, all_widths), sizes)
    return found.select("pair_id", F.col("m").cast("long").alias("first_freq"), F.col("n").cast("long").alias("second_freq"), "len", "first_starts", "second_starts")


def rare_prefixes(found: DataFrame, first_lengths: DataFrame) -> DataFrame:
    """pair_id, m, n, pos, len: the least rare prefix at each place that has one; places run over the first sequence, its end, and the second."""
    at = found.join(first_lengths, "pair_id")
    place = F.when(F.col("side") == 1, F.col("pos")).otherwise(F.col("pos") + F.col("n_first") + 1)
    return at.select("pair_id", F.col("m").cast("long").alias("m"), F.col("n").cast("long").alias("n"), place.alias("pos"), F.col("min_len").alias("len"))


def anchor_intervals(found: DataFrame, first_lengths: DataFrame) -> DataFrame:
    """pair_id, m, n, clas, len, first_starts, second_starts: hits collapsed to intervals.

    Of hits with one least end, the last start counts; of those with one greatest
    end, the first start and the last least end.
    """
    at = found.join(first_lengths, "pair_id").withColumn("p", F.when(F.col("side") == 1, F.col("pos")).otherwise(F.col("pos") + F.col("n_first") + 1))
    ends = at.withColumn("en", F.col("p") + F.col("min_len")).groupBy("pair_id", "n_first", "m", "n", "en").agg(F.max(F.struct("p", "clas", "max_len")).alias("s"))
    wide = ends.groupBy("pair_id", "n_first", "m", "n", (F.col("s.p") + F.col("s.max_len")).alias("max_en"))
    kept = wide.agg(F.min(F.struct("s.p", "s.clas")).alias("s"), F.max("en").alias("en")).select("pair_id", "n_first", "m", "n", "s.p", "s.clas", (F.col("en") - F.col("s.p")).alias("len"))
    first = F.when(F.col("p") < F.col("n_first"), F.col("p"))
    second = F.when(F.col("p") >= F.col("n_first"), F.col("p") - F.col("n_first") - 1)
    out = kept.groupBy("pair_id", "m", "n", "clas").agg(
        F.min_by("len", "p").alias("len"), F.sort_array(F.collect_list(first)).alias("first_starts"), F.sort_array(F.collect_list(second)).alias("second_starts")
    )
    return out


def anchors(intervals: DataFrame) -> DataFrame:
    """pair_id, len, m, n, x, y, score: every pair of starts of a class."""
    rows = intervals.select("pair_id", "len", "m", "n", F.explode("first_starts").alias("x"), "second_starts")
    rows = rows.select("pair_id", "len", "m", "n", "x", F.explode("second_starts").alias("y"))
    return rows.withColumn("score", F.col("len").cast("double") / (F.col("m") * F.col("n")))
