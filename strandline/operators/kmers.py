"""K-mers as rows: enumeration, rarity, sharing, positions, minimizers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import bases
from ..sources.shared import Tables
from . import words
from .scan import running

#: Letters of a stretch that k-mers are read from: a k-mer's cost doesn't grow with its place.
STRETCH = 256
#: Letters of a sequence up to which its k-mers are counted in one task.
WHOLE = 1 << 19
#: Bounds of the bits of a sieve: 8 MB are held at most.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 26


def chunks(seqs: DataFrame, size: int, overlap: int, id_col: str = "seq_id", seq_col: str = "seq") -> DataFrame:
    """Overlapping pieces: id, start, chunk_id (``id_start``) and chunk.

    A piece begins every ``size`` letters and also holds the next ``overlap``; no
    piece is only the overlap of the one before.
    """
    if size < 1 or overlap < 0:
        raise ValueError("size must be positive and overlap not negative")
    last = F.greatest(F.length(seq_col) - overlap - 1, F.lit(0))
    starts = F.sequence(F.lit(0), last, F.lit(size))
    rows = seqs.filter(F.length(seq_col) > 0).select(F.col(id_col).alias("seq_id"), seq_col, F.explode(starts).alias("start"))
    return rows.select(
        "seq_id", F.col("start").cast("long").alias("start"),
        F.concat_ws("_", F.col("seq_id").cast("string"), F.col("start").cast("string")).alias("chunk_id"),
        F.substring(F.col(seq_col), F.col("start") + 1, F.lit(size + overlap)).alias("chunk"),
    )


def kmers(seqs: DataFrame, k: int, id_col: str = "seq_id", seq_col: str = "seq") -> DataFrame:
    """seq_id, pos, kmer for every position; sequences under ``k`` letters have none."""
    pieces = chunks(seqs.filter(F.length(seq_col) >= k), STRETCH, k - 1, id_col, seq_col)
    at = pieces.filter(F.length("chunk") >= k).select("seq_id", "start", "chunk", F.explode(F.sequence(F.lit(0), F.length("chunk") - k)).alias("i"))
    return at.select("seq_id", (F.col("start") + F.col("i")).alias("pos"), F.substring(F.col("chunk"), F.col("i") + 1, F.lit(k)).alias("kmer"))


def counts(found: DataFrame) -> DataFrame:
    """seq_id, kmer, n."""
    return found.groupBy("seq_id", "kmer").agg(F.count("*").alias("n"))


def rare(found: DataFrame, most: int = 1) -> DataFrame:
    """K-mers that occur ``most`` times at most in their sequence."""
    return counts(found).filter(F.col("n") <= most)


def shared_rare(a: DataFrame, b: DataFrame, most: int = 1) -> DataFrame:
    """first_id, second_id, kmer: k-mers that are rare in both sequences of a pair. ``b`` is the smaller side.

    Only k-mers that are rare somewhere in ``b`` are counted in ``a``: the semi-join
    comes before the grouping, so with a small ``b`` (which adaptive execution
    then broadcasts) the k-mers of ``a`` are thinned where they are read.
    """
    right = rare(b, most).select(F.col("seq_id").alias("second_id"), "kmer")
    wanted = a.join(right.select("kmer").distinct(), "kmer", "left_semi")
    left = rare(wanted, most).select(F.col("seq_id").alias("first_id"), "kmer")
    return left.join(right, "kmer").select("first_id", "second_id", "kmer")


def _by_blocks(seqs: DataFrame, id_col: str, seq_col: str, schema: str, cut: Callable, of_block: Callable) -> DataFrame:
    """seq_id and the columns of ``schema``: what ``of_block`` gives for each block that ``cut`` makes of a batch, as rows of the batch and columns."""
    named = seqs.select(F.col(id_col).alias("seq_id"), F.col(seq_col).cast("string").alias("seq"))
    out = StructType([named.schema["seq_id"], *StructType.fromDDL(schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in cut(x.as_py() for x in batch.column(1)):
                rows, *columns = of_block(block)
                if len(rows):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *map(pa.array, columns)], names=out.names)

    return named.mapInArrow(run, out)


def rare_numbers(seqs: DataFrame, k: int, most: int = 1, id_col: str = "seq_id", seq_col: str = "seq", whole: int = WHOLE) -> DataFrame:
    """seq_id, n_rare: how many k-mers occur ``most`` times at most in their sequence; sequences without any have no row.

    A sequence of at most ``whole`` letters is counted where it is read, and no k-mer is a row. Longer
    ones, and ids of several rows, are counted by ``rare``.
    """
    named = seqs.select(F.col(id_col).alias("seq_id"), F.col(seq_col).cast("string").alias("seq"))
    sizes = named.groupBy("seq_id").agg(F.count("*").alias("n"), F.max(F.length("seq")).alias("longest"))
    apart = Tables(seqs.sparkSession).settled(sizes.filter((F.col("n") > 1) | (F.col("longest") > whole)).select(F.col("seq_id").alias("apart")))
    is_apart = F.col("seq_id").eqNullSafe(F.col("apart"))

    def of_block(block: words.Block) -> tuple:
        n = words.rare_numbers(block, k, most)
        some = np.flatnonzero(n)
        return block.rows[some], n[some].astype(np.int64)

    here = _by_blocks(named.join(apart, is_apart, "left_anti"), "seq_id", "seq", "n_rare long", lambda texts: words.blocks(texts, 0, most=whole), of_block)
    rest = rare(kmers(named.join(apart, is_apart, "left_semi"), k), most).groupBy("seq_id").agg(F.count("*").alias("n_rare"))
    return here.unionByName(rest)


def sieve(wanted: DataFrame, k: int) -> words.Sieve:
    """A bitmap for the k-mers of ``wanted`` (kmer), made by its tasks: 16 bits for each up to four million of them, and never more than ``MOST_BITS``."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * wanted.count()).bit_length()))
    empty = words.Sieve(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in words.blocks((x.as_py() for x in batch.column(0)), 0):
                at, _ = block.places(k)
                p = np.unique(np.concatenate(empty.places(words.hashes(block.codes, k)[at])))
                place, first = np.unique(p >> 6, return_index=True)
                word = np.bitwise_or.reduceat(np.uint64(1) << (p & 63).astype(np.uint64), first) if len(p) else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(word.view(np.int64))], names=["place", "word"])

    found = wanted.select("kmer").mapInArrow(run, "place long, word long").groupBy("place").agg(F.bit_or("word").alias("word")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[found.column("place").to_numpy()] = found.column("word").to_numpy().view(np.uint64)
    return words.Sieve(bits, out)


def likely(seqs: DataFrame, k: int, wanted: DataFrame, id_col: str = "seq_id", seq_col: str = "seq") -> DataFrame:
    """seq_id, pos, kmer of ``kmers``, without most of those that aren't in ``wanted`` (kmer): those in it are all there.

    Texts are read against a bitmap of bounded size, and only what passes becomes a row. The join
    with ``wanted`` is still the caller's; the more k-mers it has, the less is left out.
    """
    held = sieve(wanted, k)

    def of_block(block: words.Block) -> tuple:
        at, piece = block.places(k)
        some = held.may_hold(words.hashes(block.codes, k)[at])
        at, piece = at[some], piece[some]
        return block.rows[piece], block.starts[piece] + at - block.at[piece], block.words(at, k)

    return _by_blocks(seqs, id_col, seq_col, "pos long, kmer string", lambda texts: words.blocks(texts, k - 1), of_block)


def positions_of(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """The occurrences whose k-mer is in ``wanted`` (kmer)."""
    return found.join(wanted.select("kmer").distinct(), "kmer", "left_semi").select("seq_id", "pos", "kmer")


def coordinate_lists(found: DataFrame) -> DataFrame:
    """seq_id, kmer and its sorted positions."""
    return found.groupBy("seq_id", "kmer").agg(F.sort_array(F.collect_list("pos")).alias("positions"))


def dotplot_pairs(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Every co-occurrence of a k-mer: both positions and where the match ends on either side."""
    left = a.select(F.col("seq_id").alias("first_id"), F.col("pos").alias("x"), "kmer")
    right = b.select(F.col("seq_id").alias("second_id"), F.col("pos").alias("y"), "kmer")
    both = left.join(right, "kmer")
    return both.select("first_id", "second_id", "x", "y", (F.col("x") + k).alias("x_end"), (F.col("y") + k).alias("y_end"))


def minimizers(seqs: DataFrame, k: int, w: int, id_col: str = "seq_id", seq_col: str = "seq", strands: bool = True) -> DataFrame:
    """seq_id, pos, kmer: the least k-mer of each window of ``w``, leftmost of equals, repeats dropped.

    Sequences are read block by block where they are: neither k-mers nor windows are
    rows. A sequence with fewer than ``w`` k-mers has one window.
    """
    if w < 2:
        raise ValueError("a window holds two k-mers or more")

    def of_block(block: words.Block) -> tuple:
        piece, at = words.minimizers(block, k, w, strands)
        return block.rows[piece], block.starts[piece] + at - block.at[piece], block.words(at, k)

    cut = lambda texts: words.blocks(texts, k + w - 2, gap=w, early=1)
    word = bases.canonical(F.col("kmer")) if strands else F.col("kmer")
    return _by_blocks(seqs, id_col, seq_col, "pos long, kmer string", cut, of_block).select("seq_id", "pos", word.alias("kmer"))


def sliding_min(rows: DataFrame, keys: list[str], order: list[str], value: str, w: int) -> DataFrame:
    """Rows with ``low``, the least ``value`` of the row and the ``w`` - 1 after it; short ends are left out."""
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(0, w - 1)
    out = rows.select("*", F.min(value).over(window).alias("low"), F.count("*").over(window).alias("in_window"))
    return out.filter(F.col("in_window") == w).drop("in_window")


def moving_average(rows: DataFrame, keys: list[str], order: list[str], value: str, w: int) -> DataFrame:
    """Rows with ``mean`` over the row and the ``w`` - 1 after it; short ends are left out."""
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(0, w - 1)
    out = rows.select("*", F.avg(value).over(window).alias("mean"), F.count("*").over(window).alias("in_window"))
    return out.filter(F.col("in_window") == w).drop("in_window")


def rare_prefix_summary(rows: DataFrame, keys: list[str], unset: int = 2147483647, long: int = 10_000) -> DataFrame:
    """Of each group of ``keys``: mean and number of long ones among the first half of the set lengths (pos, len)."""
    known = rows.filter(F.col("len") < unset)
    placed = running(known, keys, "pos", sums={"place": F.lit(1)})
    half = placed.join(known.groupBy(*keys).agg(F.count("*").alias("all")), keys).filter(F.col("place") <= F.floor(F.col("all") / 2))
    return half.groupBy(*keys).agg(F.avg("len").alias("mean"), F.count_if(F.col("len") > long).alias("n_long"))
