"""Shards of nearly equal bytes by histogram sort.

Documents are ordered by (hash of the text, doc_id), so equal texts lie side by
side. Splitters are found without sorting: candidate boundaries are put into the
key range, every task counts the exact bytes between them in its rows, and only
the ranges that hold a wanted cut are probed again, more finely, until each cut
is within tolerance of its share or lies between two neighbouring keys. Probes
fall between hashes first, so groups of equal texts stay whole where tolerance
allows; only a hash that outweighs it is cut inside, by doc_id.

There are several cuts in a shard: they bound what one task sorts, and the exact
row counts between them give each row its place without a global sort. Rows are
exchanged once. The driver sees boundaries and their counts only: one for some
100,000 rows.

Null texts have no bytes and lie with the empty ones; a missing doc_id sorts first. Rows alike in text and
doc_id share a key and stay in one shard. An empty table gives no rows. Texts travel
with their rows, however long; columns of any name pass through.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop_cut, free_name, struct_array

#: Keys are one number: the hash (made unsigned) in the upper 64 bits, the doc_id in the lower.
LOW = 1 << 63
END = 1 << 128
ROWS_OF_A_CUT = 100_000


def slots(boundaries: list[int], hashes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """How many of the sorted ``boundaries`` are at most each row's key."""
    upper = np.array([(b >> 64) - LOW for b in boundaries], np.int64)
    lower = np.array([(b & (END // (1 << 64) - 1)) - LOW for b in boundaries], np.int64)
    first, last = np.searchsorted(upper, hashes, "left"), np.searchsorted(upper, hashes, "right")
    out = first.copy()
    # Rows whose hash is that of a boundary: the doc_id decides.
    at = np.flatnonzero(last > first)
    if len(at):
        order = np.argsort(first[at], kind="stable")
        at = at[order]
        starts = np.flatnonzero(np.diff(first[at], prepend=-1))
        for s, e in zip(starts, np.append(starts[1:], len(at)), strict=True):
            rows = at[s:e]
            f, t = first[rows[0]], last[rows[0]]
            out[rows] = f + np.searchsorted(lower[f:t], ids[rows], "right")
    return out


def count_below(keys: DataFrame, boundaries: list[int]) -> dict[int, int]:
    """Exact bytes with a key below each boundary. Tasks count, the driver adds up."""

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(len(boundaries) + 1, np.int64)
        for batch in batches:
            h, i, size = (batch.column(k).to_numpy() for k in range(3))
            np.add.at(held, slots(boundaries, h, i), size)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], names=["slot", "bytes"])

    found = keys.select("h", "i", "size").mapInArrow(histogram, "slot long, bytes long").groupBy("slot").agg(F.sum("bytes").alias("bytes")).collect()
    in_slot = np.zeros(len(boundaries) + 1, object)
    for r in found:
        in_slot[r["slot"]] = r["bytes"]
    return dict(zip(boundaries, np.cumsum(in_slot[:-1]).tolist(), strict=True))


def candidates(low: int, high: int, n: int, ids: tuple[int, int]) -> list[int]:
    """At most ``n`` boundaries within (low, high): between hashes while there are any."""
    whole = 1 << 64
    a, b = low // whole + 1, (high - 1) // whole
    if b >= a:
        step = max(1, (b - a + 1) // n)
        return [k * whole for k in range(a, b + 1, step)][: n + 1]
    base = low // whole * whole
    a, b = max(low + 1, base + ids[0]), min(high - 1, base + ids[1])
    return list(range(a, b + 1, max(1, (b - a + 1) // n)))[: n + 1] if b >= a else []


def splitters(keys: DataFrame, total: int, ids: tuple[int, int], parts: int, tolerance: list[float], probes: int = 2048, rounds: int = 60) -> list[int]:
    """``parts`` - 1 boundaries with about the same bytes between any two of them; ``tolerance`` says how many bytes each may miss by.

    A range gets at least two probes for each boundary that is sought in it, so the number of
    rounds doesn't grow with the number of parts.
    """
    goals = [total * k // parts for k in range(1, parts)]
    known = {0: 0, END: total}
    order = [0, END]
    for _ in range(rounds):
        ranges: dict[tuple[int, int], int] = {}
        below = [known[b] for b in order]
        for g, most in zip(goals, tolerance, strict=True):
            at = min(bisect_right(below, g), len(order) - 1)
            low, high = order[at - 1], order[at]
            if min(g - known[low], known[high] - g) > most and high - low > 1:
                ranges[low, high] = ranges.get((low, high), 0) + 1
        sought = max(1, sum(ranges.values()))
        new = {b for (low, high), n in ranges.items() for b in candidates(low, high, max(4, 2 * n + 2, probes * n // sought), ids)} - known.keys()
        if not new:
            break
        known |= count_below(keys, sorted(new))
        order = sorted(known)
    below = [known[b] for b in order]
    out = []
    for g in goals:
        at = min(bisect_right(below, g), len(order) - 1)
        low, high = order[at - 1], order[at]
        out.append(low if g - known[low] <= known[high] - g else high)
    return out


def shard(df: DataFrame, shards: int = 16, text_col: str = "text", id_col: str = "doc_id", tolerance: float = 0.002) -> DataFrame:
    """``df`` plus size (UTF-8 bytes of the text + 1), shard and slot (place in the shard, from 0).

    ``tolerance`` is the share of a shard's bytes by which a cut may miss. New
    columns get a longer name where ``df`` has theirs already.
    """
    names = {n: free_name(df, n) for n in ("size", "shard", "slot")}
    h, i, piece, place = (free_name(df, f"sharding_{n}") for n in ("h", "i", "piece", "place"))
    keyed = df.withColumn(names["size"], (F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0)) + 1).cast("long"))
    keyed = keyed.withColumn(h, F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))).withColumn(i, F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-LOW)))
    keys = cut(keyed.select(F.col(h).alias("h"), F.col(i).alias("i"), F.col(names["size"]).alias("size")), "keys")
    n, total, least, most = keys.agg(F.count("*"), F.sum("size"), F.min("i"), F.max("i")).first()
    fine = max(4, (n or 0) // (shards * ROWS_OF_A_CUT))
    # Shards end where ``tolerance`` lets them; pieces within a shard may miss by a quarter of one, however many there are.
    allowed = tolerance * (total or 0) / shards
    inner = min(allowed, (total or 0) / (shards * fine) / 4)
    misses = [inner if k % fine else allowed for k in range(1, shards * fine)]
    cuts = splitters(keys, total, (least + LOW, most + LOW + 1), shards * fine, misses) if n else [END - 1] * (shards * fine - 1)
    cuts = [min(c, END - 1) for c in cuts]

    def assign(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for hashes, numbers in batches:
            yield pa.array(slots(cuts, hashes.to_numpy(), numbers.to_numpy()), pa.int64())

    put = F.arrow_udf(assign, returnType="long")
    # As many counts as there are pieces: one for some 100,000 rows.
    # Rows before each piece, within its shard.
    rows = np.zeros(shards * fine, np.int64)
    for r in keys.groupBy(put("h", "i").alias("piece")).count().collect():
        rows[r["piece"]] = r["count"]
    before = (np.cumsum(rows) - rows).reshape(shards, fine)
    before = (before - before[:, :1]).ravel()
    drop_cut(keys)

    def locate(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for hashes, numbers in batches:
            at = slots(cuts, hashes.to_numpy(), numbers.to_numpy())
            yield struct_array(piece=pa.array(at, pa.int64()), before=pa.array(before[at], pa.int64()))

    dealt = keyed.withColumn(piece, F.arrow_udf(locate, returnType="piece long, before long")(h, i))
    number = F.col(f"{piece}.piece")
    within = F.row_number().over(Window.partitionBy(number).orderBy(h, i)) - 1
    out = dealt.withColumn(place, within).withColumn(names["shard"], F.floor(number / fine).cast("int"))
    return out.withColumn(names["slot"], (F.col(f"{piece}.before") + F.col(place)).cast("long")).drop(h, i, piece, place)


def shard_report(df: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law ("bytes"), shard, slot and grown_shard (null) for every row."""
    narrow = df.select("doc_id", "text")
    found = shard(narrow.withColumn("text_crc32", F.crc32(F.coalesce(F.col("text"), F.lit(""))).cast("long")), shards)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
