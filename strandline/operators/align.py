"""Pair tables in, alignment tables out: the kernels mapped over rows in Arrow batches.

A pair table has pair_id (long), first and second (strings). Pairs are
independent: a table of moderate ones is aligned in one map, a pair to a task. Pairs longer than
``refine.LEAF`` letters are aligned, counted and bridged as rows. Null sequences are empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bridges as graph
from . import kernels, lcs, ranks, refine, suffix, ties


def _map_pairs(pairs: DataFrame, schema: str, kinds: list[pa.DataType], rows_of: Callable[[str, str], list[tuple]], spread: bool = True) -> DataFrame:
    """Rows of ``rows_of(first, second)`` for each pair, its id in front."""
    names = ["pair_id", *[f.strip().split(" ")[0] for f in _fields(schema)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, firsts, seconds = (batch.column(k).to_pylist() for k in range(3))
            for pair, a, b in zip(ids, firsts, seconds, strict=True):
                found = rows_of(a or "", b or "")
                if found:
                    columns = [[pair] * len(found), *map(list, zip(*found, strict=True))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64(), *kinds], strict=True)], names=names)

    return _dealt(pairs, spread).mapInArrow(run, "pair_id long, " + schema)


def _dealt(pairs: DataFrame, spread: bool = True) -> DataFrame:
    """pair_id, first, second: few, heavy rows, dealt over all tasks whatever files they came in.

    The number of partitions is given, or adaptive execution would merge them again:
    a pair is few bytes and much work.
    """
    narrow = pairs.select(F.col("pair_id").cast("long"), F.col("first").cast("string"), F.col("second").cast("string"))
    if not spread:
        return narrow
    spark = pairs.sparkSession
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return narrow.repartition(partitions, "pair_id")


def _fields(schema: str) -> list[str]:
    out, depth = [""], 0
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


LONG, TEXT = pa.int64(), pa.string()


def align(pairs: DataFrame, max_count: int = 50, all_widths: bool = False, leaf: int = refine.LEAF) -> DataFrame:
    """pair_id, cigar_primary (first chain), cigar_recursive (all blocks refined), cigar (mismatches told apart), valid.

    Pairs of more than ``leaf`` letters are aligned as rows by ``refine``, the others one to a task; the strings are the same.
    ``pair_id`` must be distinct and not null among the longer ones (rows meet by it). Streams have all pairs one to a task: their batches go by rows in ``foreachBatch``.
    """
    return _by_length(pairs, leaf, lambda some: _align_whole(some, max_count, all_widths), lambda some: _align_rows(some, max_count, all_widths, leaf))


def _align_rows(pairs: DataFrame, max_count: int, all_widths: bool, leaf: int) -> DataFrame:
    steps = refine.align_steps(pairs, max_count, all_widths, leaf)
    found = refine.render(steps).join(refine.check(pairs, steps), ["pair_id", "form"])
    of = lambda form: F.max(F.when(F.col("form") == form, F.col("cigar")))
    return found.groupBy("pair_id").agg(of(refine.PRIMARY).alias("cigar_primary"), of(refine.RECURSIVE).alias("cigar_recursive"), of(refine.MISMATCHES).alias("cigar"), F.min("valid").alias("valid"))


def _align_whole(pairs: DataFrame, max_count: int, all_widths: bool) -> DataFrame:
    def rows(a: str, b: str) -> list[tuple]:
        steps = kernels.primary(a, b, max_count, all_widths)
        deep = kernels.refine(steps, a, b, max_count, all_widths)
        done = kernels.with_mismatches(deep, a, b)
        valid = all(kernels.is_valid(s, a, b) for s in (steps, deep, done))
        return [(*map(kernels.render, (steps, deep, done)), valid)]

    return _map_pairs(pairs, "cigar_primary string, cigar_recursive string, cigar string, valid boolean", [TEXT, TEXT, TEXT, pa.bool_()], rows)


def rare_prefixes(pairs: DataFrame, max_count: int = 50, all_widths: bool = False, unset: int = 2147483647) -> DataFrame:
    """pair_id, m, n, pos, len: the least rare prefix at every place of both sequences, ``unset`` where there is none.

    Places run over first, its end, second and its end, as in the exported files.
    """

    def rows(a: str, b: str) -> list[tuple]:
        out = []
        for (m, n), p, _, least, _ in kernels.rare_matches(a, b, max_count, all_widths):
            known = dict(zip(p.tolist(), least.tolist(), strict=True))
            out += [(m, n, k, known.get(k, unset)) for k in range(len(a) + len(b) + 2)]
        return out

    return _map_pairs(pairs, "m long, n long, pos long, len long", [LONG] * 4, rows)


def _anchors(pairs: DataFrame, max_count: int, all_widths: bool) -> DataFrame:
    sizes = pairs.select("pair_id", F.coalesce(F.length("first"), F.lit(0)).alias("n_first"))
    hits = suffix.rare_matches(ranks.ranked_suffixes(pairs), sizes, max_count, all_widths)
    return suffix.anchors(suffix.anchor_intervals(hits, sizes))


def _by_length(pairs: DataFrame, leaf: int, whole: Callable[[DataFrame], DataFrame], by_rows: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``whole`` of pairs of at most ``leaf`` letters, ``by_rows`` of longer ones, for which no task has room."""
    if pairs.isStreaming:
        return whole(pairs)
    size = F.coalesce(F.length("first"), F.lit(0)) + F.coalesce(F.length("second"), F.lit(0))
    longer = pairs.filter(size > leaf)
    if longer.isEmpty():
        return whole(pairs)
    return whole(pairs.filter(size <= leaf)).unionByName(by_rows(longer))


def path_counts(pairs: DataFrame, max_count: int = 50, all_widths: bool = False, leaf: int = refine.LEAF) -> DataFrame:
    """``ties.path_counts`` of whole pairs: best chains that lead to each anchor and on from it, as decimals of any length."""

    def rows(a: str, b: str) -> list[tuple]:
        anchors = kernels.anchors_of(kernels.match_intervals(a, b, max_count, all_widths))
        to, onward = kernels.path_counts(*kernels.tied_chains(anchors))
        return [(x, y, size, str(to[k]), str(onward[k]), m, n) for k, (x, y, size, m, n) in enumerate(anchors)]

    schema = "start_1 long, start_2 long, len long, n_opt_paths_fwd string, n_opt_paths_rev string, n_count long, m_count long"
    whole = lambda some: _map_pairs(some, schema, [LONG, LONG, LONG, TEXT, TEXT, LONG, LONG], rows)
    return _by_length(pairs, leaf, whole, lambda some: ties.path_counts(_anchors(some, max_count, all_widths)))


def bridges(pairs: DataFrame, max_count: int = 50, all_widths: bool = False, leaf: int = refine.LEAF) -> DataFrame:
    """pair_id, start_1, start_2, end_1, end_2: steps that every undirected tour of the best chains needs."""

    def rows(a: str, b: str) -> list[tuple]:
        anchors = kernels.anchors_of(kernels.match_intervals(a, b, max_count, all_widths))
        return kernels.bridge_coordinates(anchors, kernels.chain_bridges(*kernels.tied_chains(anchors)))

    whole = lambda some: _map_pairs(some, "start_1 long, start_2 long, end_1 long, end_2 long", [LONG] * 4, rows)
    return _by_length(pairs, leaf, whole, lambda some: graph.bridges(_anchors(some, max_count, all_widths)))


def align_kmers(pairs: DataFrame, k: int = 10, most: int = 1) -> DataFrame:
    """pair_id, ord, left, right: ``lcs.align_kmers``; in streams, whose batches can't be written in between, a pair is one task's."""
    if not pairs.isStreaming:
        return lcs.align_kmers(pairs, k, most)
    rows = lambda a, b: [(o, x, y) for o, (x, y) in enumerate(kernels.align_kmers(a, b, k, most))]
    return _map_pairs(pairs, "ord long, left long, right long", [LONG] * 3, rows)


def kmer_path(pairs: DataFrame, k: int = 10, most: int = 1) -> DataFrame:
    """pair_id, ord, x, y: corner points of the path through the aligned k-mers."""

    def rows(a: str, b: str) -> list[tuple]:
        matches = [(x, y) for x, y in kernels.align_kmers(a, b, k, most) if x is not None and y is not None]
        return [(o, x, y) for o, (x, y) in enumerate(kernels.densify(matches, k, a, b))]

    return _map_pairs(pairs, "ord long, x long, y long", [LONG] * 3, rows)


def edit_identity(pairs: DataFrame) -> DataFrame:
    """pair_id, distance, columns, identity."""
    return _map_pairs(pairs, "distance long, columns long, identity double", [LONG, LONG, pa.float64()], lambda a, b: [kernels.edit_identity(a, b)])
