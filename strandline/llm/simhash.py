"""SimHash fingerprints and near-duplicate groups by the general pigeonhole principle.

A fingerprint has 64 bits: over all 3-word shingles of a text (in lower case,
repeats included), a bit is 1 if more than half of the shingles' XXH64 values
have it set. Fingerprints at Hamming distance 3 or less are linked.

The 64 bits are cut into partitions of correlated bits. Partition i gets a
threshold t_i of its own; if these add up to 3 - m + 1 over m partitions, any
two linked fingerprints are within t_i in at least one of them, so no link is
lost. Dynamic programming finds the thresholds (and the number of partitions)
with the least estimated cost: index entries probed plus candidates verified,
from pair distances in a bounded sample. The sample steers cost only.

Every distinct fingerprint is entered once in each partition and probed with
all keys within t_i. Rows that meet under a key are verified in Arrow batches;
each key's links leave as a spanning forest, never as all pairs. A key with
very many rows is dealt into blocks, and each pair of blocks is a task's work.

Null or empty texts have the fingerprint 0 and are linked like any other. Rows
without a doc_id get their group's least doc_id, or null if the group has none.
Repeated rows share a group. An empty table gives no rows; other columns play no
part, whatever their names. A very long text is hashed whole, in memory that is a
few times its size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut, few_files, slices, table_rows_of
from .components import connected_components, local_components

DISTANCE = 3
SAMPLE = 2000
#: Keys that one fingerprint may probe in a partition; larger thresholds aren't considered.
MOST_KEYS = 1024
#: Rows under one key that a single task compares.
BLOCK = 4096


def simhash(text: str | None, width: int = 3) -> int:
    """Unsigned 64-bit fingerprint of a whole text."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    else:
        joined = b" ".join(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        first = (ends - sizes)[: len(words) - width + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], 42) for a, b in zip(first, ends[width - 1 :].tolist(), strict=True)]
    n = len(hashes)
    # One byte lane of all hashes at a time: unpacked bits, summed.
    lanes = np.array(hashes, np.uint64).view(np.uint8).reshape(n, 8)
    counts = np.zeros(64, np.int64)
    for k in range(0, n, 65_536):
        bits = np.unpackbits(lanes[k : k + 65_536], axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", *also: Column) -> DataFrame:
    """doc_id, ``fp`` (the fingerprint as a signed long) and the columns ``also`` for every row."""
    narrow = df.select(F.col(f"`{text_col}`").alias("body"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), *also)
    kept = [f for f in narrow.schema.fields if f.name != "body"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = batch.column(0), []
            for a, b in slices([texts]):
                found += [simhash(t) for t in texts.slice(a, b - a).to_pylist()]
            fp = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], fp], names=[*batch.schema.names[1:], "fp"])

    return narrow.mapInArrow(run, ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in kept], "fp long"]))


@dataclass(frozen=True)
class Partitioning:
    bits: tuple[tuple[int, ...], ...]
    thresholds: tuple[int, ...]
    cost: float


def correlated_groups(sample: np.ndarray, m: int) -> tuple[tuple[int, ...], ...]:
    """``m`` groups of bits: each grows from a free bit by the free bit most correlated with it so far."""
    planes = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    planes -= planes.mean(0)
    norm = np.sqrt((planes**2).sum(0)) + 1e-9
    strength = np.abs(planes.T @ planes / np.outer(norm, norm))
    np.fill_diagonal(strength, 0)
    free, groups = set(range(64)), []
    for k in range(m):
        size = 64 // m + (k < 64 % m)
        left = sorted(free)
        group = [left[int(strength[np.ix_(left, left)].sum(1).argmax())]]
        free.discard(group[0])
        while len(group) < size:
            left = sorted(free)
            group.append(left[int(strength[np.ix_(left, group)].sum(1).argmax())])
            free.discard(group[-1])
        groups.append(tuple(sorted(group)))
    return tuple(groups)


def allocate(sample: np.ndarray, total: int, distance: int = DISTANCE, most: int = 6) -> Partitioning:
    """Partitions and thresholds with the least estimated cost for ``total`` distinct fingerprints.

    Cost counts a shuffled probe or index row as 40 verified candidates. For each
    partition and threshold, the candidates are the share of sample pairs that
    meet there (at least that of even bits, where the sample shows none), times
    all pairs.
    """
    rng = np.random.default_rng(7)
    n = len(sample)
    i, j = rng.integers(0, max(1, n), 200_000), rng.integers(0, max(1, n), 200_000)
    apart = sample[i] != sample[j] if n else np.zeros(0, bool)
    x = sample[i[apart]] ^ sample[j[apart]] if n else np.zeros(0, np.uint64)
    best = None
    for m in range(2, most + 1):
        groups = correlated_groups(sample, m) if n > 1 else tuple(tuple(range(k, 64, m)) for k in range(m))
        budget = distance - m + 1
        cost: list[dict[int, float]] = []
        for g in groups:
            mask = np.uint64(sum(1 << b for b in g))
            near = np.bitwise_count(x & mask)
            of: dict[int, float] = {-1: 0.0}
            for t in range(distance + 1):
                even = sum(comb(len(g), k) for k in range(t + 1))
                if even > MOST_KEYS:
                    break
                share = max(float((near <= t).mean()) if len(x) else 0.0, even / 2.0 ** len(g))
                of[t] = 40.0 * total * (even + (t > 0)) + share * total * total
            cost.append(of)
        # Least cost of the first partitions for each sum of thresholds.
        table: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for of in cost:
            step: dict[int, tuple[float, tuple[int, ...]]] = {}
            for s, (c, ts) in table.items():
                for t, more in of.items():
                    if s + t not in step or c + more < step[s + t][0]:
                        step[s + t] = (c + more, (*ts, t))
            table = step
        if budget in table and (best is None or table[budget][0] < best.cost):
            best = Partitioning(groups, table[budget][1], table[budget][0])
    return best


def key_masks(group: tuple[int, ...], threshold: int) -> list[int]:
    """What to flip for each key within ``threshold`` of a row's own, itself first."""
    return [sum(1 << b for b in flips) for k in range(threshold + 1) for flips in combinations(group, k)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def probes(distinct: DataFrame, plan: Partitioning) -> DataFrame:
    """part, key, fp, home: every fingerprint under its own key and, as a visitor, under those it probes."""
    parts = []
    for p, (group, t) in enumerate(zip(plan.bits, plan.thresholds, strict=True)):
        if t < 0:
            continue
        mask = F.lit(signed(sum(1 << b for b in group)))
        own = F.col("fp").bitwiseAND(mask)
        flips = F.array(*[F.lit(signed(f)) for f in key_masks(group, t)])
        each = distinct.select("fp", F.explode(flips).alias("flip"))
        parts.append(each.select(F.lit(p).alias("part"), own.bitwiseXOR(F.col("flip")).alias("key"), (F.col("flip") == 0).alias("home"), "fp"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def spanning_links(fp: np.ndarray, home: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among rows under one key (visitors link with residents only)."""
    left = np.arange(len(fp))
    a, b = [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            k = queue.pop()
            near = np.bitwise_count(fp[left] ^ fp[k]) <= distance
            if not home[k]:
                near &= home[left]
            if near.any():
                new = left[near]
                a.append(np.full(len(new), fp[k]))
                b.append(fp[new])
                queue.extend(new)
                left = left[~near]
    none = np.zeros(0, fp.dtype)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def verify_sorted(starts: np.ndarray, fp: np.ndarray, home: np.ndarray, distance: int, small: int = 48) -> tuple[np.ndarray, np.ndarray]:
    """Links in rows sorted by key; ``starts`` has each key's first row."""
    sizes = np.diff(np.append(starts, len(fp)))
    out_a, out_b = [], []
    for s, n in zip(starts[sizes > small].tolist(), sizes[sizes > small].tolist(), strict=True):
        x, y = spanning_links(fp[s : s + n], home[s : s + n], distance)
        out_a.append(x)
        out_b.append(y)
    few = sizes <= small
    first = np.repeat(starts[few], sizes[few])
    size = np.repeat(sizes[few], sizes[few])
    at = np.arange(len(first)) - np.repeat(np.cumsum(sizes[few]) - sizes[few], sizes[few])
    for step in range(1, small):
        ok = at + step < size
        if not ok.any():
            break
        i = (first + at)[ok]
        j = i + step
        near = (np.bitwise_count(fp[i] ^ fp[j]) <= distance) & (home[i] | home[j])
        out_a.append(fp[i[near]])
        out_b.append(fp[j[near]])
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *out_a]), np.concatenate([none, *out_b])


def links(distinct: DataFrame, plan: Partitioning, distance: int = DISTANCE, block: int = BLOCK, files: int | None = None) -> DataFrame:
    """a, b: links whose components are those of all fingerprints within ``distance``."""
    rows = probes(distinct, plan)
    crowded = rows.groupBy("part", "key").count().filter(F.col("count") > block)
    crowded = crowded.select("part", "key", F.ceil(F.col("count") / block).alias("blocks"))
    # As a written table its size is known: when small, as it mostly is, the join needs no shuffle.
    joined = rows.join(cut(crowded, "crowded", files=files), ["part", "key"], "left")
    mine = F.pmod(F.xxhash64(F.lit(23), "fp"), F.col("blocks"))
    meets = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda x: F.least(x, mine) * F.lit(1 << 31) + F.greatest(x, mine))
    dealt = joined.select("part", "key", "home", "fp", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(meets)).alias("cell"))
    order = ["part", "key", "cell"]
    dealt = dealt.repartition(*order).sortWithinPartitions(*order)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        found: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0

        def flush() -> pa.RecordBatch:
            a, b = (np.concatenate([f[k] for f in found]) for k in (0, 1))
            node, root = local_components(a.view(np.int64), b.view(np.int64))
            moved = node != root
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(root[moved])], names=["a", "b"])

        def check(columns: list[np.ndarray]) -> int:
            part, key, cell, home, fp = columns
            change = (np.diff(part) != 0) | (np.diff(key) != 0) | (np.diff(cell) != 0)
            pair = verify_sorted(np.concatenate([[0], np.flatnonzero(change) + 1]), fp, home, distance)
            if len(pair[0]):
                found.append(pair)
            return len(pair[0])

        for batch in batches:
            new = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("part", "key", "cell", "home", "fp")]
            new[4] = new[4].view(np.uint64)
            if not batch.num_rows:
                continue
            now = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            same = (now[0] == now[0][-1]) & (now[1] == now[1][-1]) & (now[2] == now[2][-1])
            at = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            if at:
                waiting += check([x[:at] for x in now])
            held = [x[at:] for x in now]
            if waiting > 250_000:
                yield flush()
                waiting = 0
        if held is not None:
            check(held)
        if found:
            yield flush()

    return dealt.mapInArrow(verify, "a long, b long")


def group_fingerprints(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``fp``, ``component_id`` (least doc_id of its group), ``root`` (its group) and ``rows`` (that have it) for each distinct fingerprint of ``fps``."""
    files = few_files(fps.sparkSession, fps.count())
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows")), "fingerprints", files=files)
    total = distinct.count()
    order = F.xxhash64(F.lit(29), "fp")
    sample = np.array([r.fp for r in distinct.select("fp").orderBy(order, "fp").limit(SAMPLE).collect()], np.int64).view(np.uint64)
    plan = allocate(sample, total, distance)
    edges = links(distinct.select("fp"), plan, distance, files=files)
    roots = connected_components(edges, files=files)
    joined = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "rep", "rows", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("rep").alias("component_id"))
    out = cut(joined.join(least, "root").select("fp", "component_id", "root", "rows"), "components", files=files)
    drop_cut(distinct)
    return out


def near_duplicates(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for every row of ``df``."""
    fps = cut(fingerprints(df, text_col, id_col), "simhash")
    groups = group_fingerprints(fps, distance)
    return fps.join(groups, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Bytes of bitmaps and file names that may be sent to every task: some 250 million rows have as many in large files, fewer rows in small ones.
SENT = 32 << 20


def marked_rows(rows: DataFrame, files: int) -> DataFrame:
    """``file``, ``block``, ``bits``: the places in files that ``rows`` (file, place) have, as bitmaps.

    A block is 32,768 places (the bucket of Spark's bitmap functions, which count from 1) and its
    bitmap ends with the last bit that is set, so all have an eighth of a byte for a row of the files.
    """
    nth = F.col("place") + 1
    at = rows.select("file", F.bitmap_bucket_number(nth).alias("block"), F.bitmap_bit_position(nth).alias("bit"))
    # Dealt by key before they are set: a bitmap for each task and block would take more room than the places.
    maps = at.repartition(files, "file", "block").groupBy("file", "block").agg(F.bitmap_construct_agg("bit").alias("bits"), F.max("bit").alias("last"))
    return maps.select("file", "block", F.substring("bits", F.lit(1), (F.col("last") / 8).cast("int") + 1).alias("bits"))


def is_marked(bits: Column, place: Column) -> Column:
    """Whether the bitmap of its block has the bit of a place; null behind the bitmap's end."""
    bit = F.bitmap_bit_position(place + 1).cast("int")
    byte = F.conv(F.hex(F.substring(bits, (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, bit % 8) == 1


def without_marked(df: DataFrame, file: Column, place: Column, marks: DataFrame, sent: int = SENT) -> DataFrame:
    """The rows of ``df`` that ``marks`` hasn't. It goes to every task if it has ``sent`` bytes at most; else Spark chooses the join."""
    held = marks.agg(F.sum(F.length("bits") + F.length("file"))).first()[0] or 0
    marks = F.broadcast(marks) if held <= sent else marks
    same = (file == marks["file"]) & (F.bitmap_bucket_number(place + 1) == marks["block"])
    return df.join(marks, same & is_marked(marks["bits"], place), "left_anti")


def keep_one_of_each(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", distance: int = DISTANCE) -> DataFrame:
    """One row of ``df`` for each group: that of the least doc_id.

    Of several such rows the one with the least (signed) fingerprint stays, and of
    those that are alike in both the first by file and place. Rows of one doc_id and
    unlike texts are rows of their own groups. Rows without a doc_id can't stand for a
    group and are all kept. A null text is an empty one.

    No text is shuffled: rows are known by file and place in it, and what goes is a table of
    bitmaps of places that is sent to the tasks of the last scan (if it has over ``SENT``
    bytes, Spark may deal the rows out by file and block instead). Spark alone reads it, so
    the shared folder may be in any store that Spark knows. A ``df`` that is more than
    one scan of Parquet files with projections and filters (a join, a union, an explode,
    a sample) is written to the shared folder first.
    """
    df, file, place = table_rows_of(df)
    fps = cut(fingerprints(df, text_col, id_col, file.alias("file"), place.alias("place")), "simhash")
    groups = group_fingerprints(fps.select("doc_id", "fp"), distance)
    # Groups of one row, most of them, need no more looking at.
    alone = groups.groupBy("root").agg(F.sum("rows").alias("rows")).filter("rows > 1").select("root")
    files = few_files(df.sparkSession, fps.count())
    members = cut(fps.filter("doc_id is not null").join(groups.join(alone, "root", "left_semi").select("fp", "root"), "fp"), "members", files=files)
    rank = F.struct("doc_id", "fp", "file", "place")
    stay = members.groupBy("root").agg(F.min(rank).alias("best")).select("best.file", "best.place")
    gone = members.join(stay, ["file", "place"], "left_anti").select("file", "place")
    marks = cut(marked_rows(gone, files), "gone", files=files)
    for done in (members, groups, fps):
        drop_cut(done)
    return without_marked(df, file, place, marks)
