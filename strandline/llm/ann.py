"""Approximate nearest neighbours by an inverted multi-index, for cosine.

Unit vectors are cut into two halves; each half has a codebook of K centroids,
so a vector lies in one of K x K cells. A query ranks the centroids of either
half by distance and walks over pairs of them, least summed distance first,
with a heap (the multi-sequence walk), until the cells it has passed hold a
given number of entries. The entries there are scored exactly.

K follows the number of entries; codebooks are fitted on a bounded sample. How
far to walk is calibrated on the index itself: some queries are compared with
every entry (a fixed number of queries, one pass), and the walk is the least one
that finds ``recall`` of their true neighbours.

Every row that takes part is an entry, with one exception that changes nothing:
of more than k + 1 equal vectors none but the k + 1 least ids can be among the k
nearest, as ties go to smaller ids, so only those are entered.

Entries are dealt into buckets of bounded bytes, cell by cell, large cells over
several buckets. Cells are dealt in an order that keeps near cells together
(``cell_order``), so a walk stays in few buckets. A query takes to each bucket
the cells there that it has walked over, and only entries of those are scored. A
bucket that many queries visit is copied for blocks of them. Vectors are shuffled
once, into their buckets, and a query's goes to each bucket it visits.

Vectors that are null, zero, or hold null or non-finite components take no part,
nor do vectors of another length than most, nor rows without an id. An id that
occurs on several rows is a candidate with each. Fewer candidates than k: all of
them. An empty table gives no rows. Very long vectors make small buckets.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, few_files

#: Vectors that codebooks are fitted on: so many for each centroid, and at least and at most so many.
PER_CENTROID, SAMPLE, MOST_SAMPLE = 32, 8192, 32_768
#: Centroids of a half, at most, and entries of a cell that K aims at.
MOST_CENTROIDS, CELL = 1024, 12
#: Queries that the walk is calibrated on.
CALIBRATION = 100
#: Bytes of a bucket's vectors, and queries that one copy of it serves.
BUCKET_BYTES, SERVED = 8 << 20, 8192
RESULT = "query long, vec_id long, score double"


@dataclass(frozen=True)
class MultiIndex:
    """Two codebooks, how many entries each cell has, and how many a query walks over."""

    books: tuple[np.ndarray, np.ndarray]
    counts: np.ndarray | None = None
    walk: int = 0

    @property
    def k(self) -> int:
        return len(self.books[0])

    def distances(self, vectors: np.ndarray) -> list[np.ndarray]:
        return [((h**2).sum(1)[:, None] - 2 * h @ c.T + (c**2).sum(1)) for h, c in zip(halves(vectors), self.books, strict=True)]

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        a, b = self.distances(vectors)
        return a.argmin(1) * self.k + b.argmin(1)

    def visited(self, a: np.ndarray, b: np.ndarray, walk: int) -> list[int]:
        """Non-empty cells in order of summed distance until they hold ``walk`` entries."""
        order_a, order_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        sa, sb = a[order_a].tolist(), b[order_b].tolist()
        k, counts = self.k, self.counts
        order_a, order_b = order_a.tolist(), order_b.tolist()
        heap, out, held = [(sa[0] + sb[0], 0, 0)], [], 0
        while heap and held < walk:
            _, i, j = heapq.heappop(heap)
            cell = order_a[i] * k + order_b[j]
            if counts[cell]:
                out.append(cell)
                held += int(counts[cell])
            # Each pair is reached once: along a row, and down the first column only.
            if j + 1 < k:
                heapq.heappush(heap, (sa[i] + sb[j + 1], i, j + 1))
            if j == 0 and i + 1 < k:
                heapq.heappush(heap, (sa[i + 1] + sb[0], i + 1, 0))
        return out


def halves(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both halves; the second of a single component is a zero."""
    half = (vectors.shape[1] + 1) // 2
    return vectors[:, :half], vectors[:, half:] if vectors.shape[1] > half else np.zeros((len(vectors), 1))


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors**2).sum(1))[:, None]


def k_means(points: np.ndarray, k: int, seed: int, rounds: int = 15) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), k, replace=False)].copy()
    for _ in range(rounds):
        near = ((centres**2).sum(1) - 2 * points @ centres.T).argmin(1)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        centres[n > 0] = sums[n > 0] / n[n > 0][:, None]
    return centres


def centroids(entries: int) -> int:
    """K for an index of so many entries: cells of about ``CELL``."""
    return int(np.clip(2 ** round(np.log2(max(4.0, entries / CELL)) / 2), 2, MOST_CENTROIDS))


def fit(sample: np.ndarray, entries: int) -> MultiIndex:
    """Codebooks for an index of ``entries`` vectors, from unit vectors of a sample."""
    k = min(centroids(entries), len(sample))
    return MultiIndex(tuple(k_means(h, k, s) for s, h in enumerate(halves(sample))), np.zeros(k * k, np.int64))


def calibrate(model: MultiIndex, queries: np.ndarray, cells: list[np.ndarray], recall: float, total: int) -> int:
    """Entries to walk over so that ``recall`` of the queries' true neighbours, which are in ``cells``, are passed."""
    needed = []
    for a, b, own in zip(*model.distances(queries), cells, strict=True):
        order = np.argsort((a[:, None] + b[None, :]).ravel(), kind="stable")
        passed = np.zeros(model.k**2, np.int64)
        # A walk that is to reach a cell must not be over when all cells before it are passed.
        passed[order] = np.cumsum(model.counts[order]) - model.counts[order] + 1
        needed.append(passed[own])
    needed = np.concatenate([np.zeros(0, np.int64), *needed])
    return int(np.quantile(needed, recall, method="higher")) if len(needed) else total


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and ``v``, the vector in doubles, of the rows that take part."""
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0))


def cell_order(books: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """All cells, near ones close together: ranks of both halves' centroids along their widest direction, bits interleaved."""
    ranks = []
    for book in books:
        apart = book - book.mean(axis=0)
        widest = np.linalg.svd(apart, full_matrices=False)[2][0]
        rank = np.empty(len(book), np.int64)
        rank[np.argsort(apart @ widest, kind="stable")] = np.arange(len(book))
        ranks.append(rank)
    a, b = (r.ravel() for r in np.meshgrid(*ranks, indexing="ij"))
    place = np.zeros(len(a), np.int64)
    for bit in range(max(1, len(books[0]).bit_length())):
        place |= (a >> bit & 1) << (2 * bit + 1) | (b >> bit & 1) << (2 * bit)
    return np.argsort(place, kind="stable")


def deal_cells(counts: np.ndarray, bucket: int, order: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """First bucket of each cell, and how many buckets it spreads over, dealt in ``order``."""
    first, spread = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64)
    at, held = 0, 0
    for c in range(len(counts)) if order is None else order.tolist():
        n = int(counts[c])
        if held and held + n > bucket:
            at, held = at + 1, 0
        first[c], spread[c] = at, max(1, -(-n // bucket))
        if spread[c] > 1:
            at, held = at + int(spread[c]), 0
        else:
            held += n
    return first, spread


def rows_of_cells(sorted_cells: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Places of the entries of ``cells`` among entries sorted by cell."""
    a, b = np.searchsorted(sorted_cells, cells), np.searchsorted(sorted_cells, cells, side="right")
    size = b - a
    return np.repeat(a - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))


def best_of_cells(x: np.ndarray, ids: np.ndarray, lengths: np.ndarray, at: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and exact scores of the ``k`` + 1 nearest to ``q`` among the entries ``at``."""
    length_q = np.sqrt((q**2).sum())
    rough = x[at] @ q / lengths[at] / length_q
    n = min(2 * k + 6, len(at))
    best = np.argpartition(-rough, n - 1)[:n]
    # All that tie with the last one that counts, multiples of one vector say, however many.
    top = np.sort(rough[best])[::-1]
    last = top[min(k, n - 1)] - 1e-12
    cand = at[np.flatnonzero(rough >= last) if top[-1] >= last else best]
    # Scores of the few that count are summed one by one, alike for all.
    exact = np.einsum("ij,j->i", x[cand], q) / (lengths[cand] * length_q)
    found = np.lexsort((ids[cand], -exact))[: k + 1]
    return ids[cand[found]], exact[found]


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def entered(good: DataFrame, k: int, files: int) -> DataFrame:
    """id and v of the entries: all rows, but of more than k + 1 equal vectors only those with the least ids.

    Vectors are counted by a hash, so only rows of hashes that occur so often, mostly
    none, are shuffled to be compared.
    """
    keyed = good.withColumn("h", F.xxhash64("v"))
    crowded = cut(keyed.groupBy("h").count().filter(F.col("count") > k + 1).select("h"), "crowded", files=files)
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    few = keyed.join(crowded, "h", "left_semi").withColumn("place", place).filter(F.col("place") <= k + 1)
    return keyed.join(crowded, "h", "left_anti").select("id", "v").unionByName(few.select("id", "v"))


def nearest_of_batches(batches: Iterator[pa.RecordBatch], queries: np.ndarray, own: list[int], k: int) -> Iterator[pa.RecordBatch]:
    """q, cell, score: the ``k`` best of each batch of placed entries for each unit vector of ``queries``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        score = queries @ unit(_matrix(batch.column("v"))).T
        score[np.array(own)[:, None] == batch.column("id").to_numpy()[None, :]] = -2.0
        top = np.argsort(-score, axis=1, kind="stable")[:, :k]
        q = np.repeat(np.arange(len(queries)), top.shape[1])
        cell = batch.column("cell").to_numpy()[top.ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(cell), pa.array(score[q, top.ravel()])], names=["q", "cell", "score"])


def build(good: DataFrame, dim: int, k: int, recall: float) -> tuple[DataFrame, MultiIndex]:
    """Entries with their cells, as a table, and the calibrated index."""
    total = good.count()
    size = int(np.clip(PER_CENTROID * centroids(total), SAMPLE, MOST_SAMPLE))
    rank = F.pmod(F.xxhash64(F.lit(31), "v", "id"), F.lit(1 << 40))
    # Thinned to about twice what is wanted, or each task would send as many as that.
    thin = good.filter(rank < int((1 << 40) * min(1.0, (2 * size + 100) / max(1, total))))
    sampled = thin.select("id", "v").orderBy(rank, "id").limit(size).toArrow()
    sample = unit(_matrix(sampled.column("v")))
    model = fit(sample, total)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = model.cells(unit(_matrix(batch.column("v")))) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    placed = cut(entered(good, k, few_files(good.sparkSession, total)).mapInArrow(assign, "id long, v array<double>, cell long"), "cells")
    counts = np.zeros(model.k**2, np.int64)
    for r in placed.groupBy("cell").count().collect():  # K x K numbers at most
        counts[r["cell"]] = r["count"]
    model = MultiIndex(model.books, counts)
    some = np.linspace(0, len(sample) - 1, min(CALIBRATION, len(sample))).astype(int)
    asked, own = sample[some], [sampled.column("id")[int(n)].as_py() for n in some]
    best = placed.mapInArrow(lambda batches: nearest_of_batches(batches, asked, own, k), "q long, cell long, score double")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "cell")
    best = best.filter("score > -2").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).select("q", "cell").toArrow()
    q, cell = best.column("q").to_numpy(), best.column("cell").to_numpy()
    walk = calibrate(model, asked, [cell[q == n] for n in range(len(some))], recall, int(counts.sum()))
    # However near the neighbours are, enough entries for k of them and the query itself.
    return placed, MultiIndex(model.books, counts, max(walk, 2 * k + 2))


def search(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, every: int = 50, recall: float = 0.97, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found for each row whose id ``every`` divides."""
    spark = df.sparkSession
    good = usable(df, id_col, vector_col)
    common = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    good = good.filter(F.size("v") == common.n)
    placed, model = build(good, common.n, k, recall)
    first, spread = deal_cells(model.counts, max(64, bucket_bytes // (8 * common.n)), cell_order(model.books))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            vectors = batch.column("v").to_pylist()
            distances = model.distances(unit(_matrix(batch.column("v")))) if vectors else ()
            for q, v, a, b in zip(batch.column("query").to_pylist(), vectors, *distances, strict=True):
                cells = np.array(model.visited(a, b, model.walk), np.int64)
                there: dict[int, list[int]] = {}
                for c in cells.tolist():
                    for bucket in range(int(first[c]), int(first[c] + spread[c])):
                        there.setdefault(bucket, []).append(c)
                rows += [(q, v, bucket, held) for bucket, held in sorted(there.items())]
            columns = zip(*rows, strict=True) if rows else ((), (), (), ())
            kinds = (pa.int64(), pa.list_(pa.float64()), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["query", "v", "bucket", "visited"])

    # Equal vectors ask once, for the least of their ids.
    asked = good.filter(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "v")
    files = few_files(spark, placed.count())
    asking = cut(asked.groupBy("v").agg(F.min("query_id").alias("query")), "asking", files=files)
    visits = cut(asking.mapInArrow(walk, "query long, v array<double>, bucket long, visited array<long>"), "visits")
    # As many copies of a bucket as its visitors need. As a written table its size is known to the joins.
    copies = cut(visits.groupBy("bucket").agg(F.ceil(F.count("*") / SERVED).alias("copies")), "copies", files=files)
    visiting = visits.join(copies, "bucket").withColumn("copy", F.pmod(F.xxhash64(F.lit(37), "query"), F.col("copies"))).drop("copies")

    def bucket_of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for cells, salts in batches:
            cell = cells.to_numpy()
            yield pa.array(first[cell] + salts.to_numpy() % spread[cell])

    dealt = F.arrow_udf(bucket_of, returnType="long")
    bucketed = placed.withColumn("bucket", dealt("cell", F.pmod(F.xxhash64(F.lit(41), "id", "v"), F.lit(1 << 40))))
    stored = bucketed.join(copies, "bucket").select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"), "id", "v", "cell")

    def rerank(key: tuple[pa.Scalar, ...], queries: pa.Table, bucket: pa.Table) -> pa.Table:
        out: list[pa.Table] = []
        if queries.num_rows and bucket.num_rows:
            bucket = bucket.sort_by("cell")
            x, ids, cell = _matrix(bucket.column("v")), bucket.column("id").to_numpy(), bucket.column("cell").to_numpy()
            lengths = np.sqrt((x**2).sum(1))
            for q, number, visited in zip(_matrix(queries.column("v")), queries.column("query").to_pylist(), queries.column("visited").to_pylist(), strict=True):
                at = rows_of_cells(cell, np.array(visited, np.int64))
                if len(at):
                    found, score = best_of_cells(x, ids, lengths, at, q, k)
                    out.append(pa.table({"query": [number] * len(found), "vec_id": found, "score": score}))
        kind = pa.schema([("query", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        return pa.concat_tables([t.cast(kind) for t in out]) if out else kind.empty_table()

    near = visiting.groupBy("bucket", "copy").cogroup(stored.groupBy("bucket", "copy")).applyInArrow(rerank, RESULT)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    near = near.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k + 1).drop("place")
    # Back from distinct vectors to the rows that ask; a row is not its own neighbour.
    who = asked.join(asking, "v").select("query_id", "query")
    each = who.join(near, "query").filter(F.col("query_id") != F.col("vec_id"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
