"""Suffix order of sequences of any length, as rows: prefix doubling by global ranks, and common prefixes from them.

A place is (pair_id, side, pos). Places are grouped by their first ``WORD`` letters, groups
are put in order over all pairs at once, and a group's rank is the number of places in
groups before it. Then, round by round, only places that still share their group are told
apart by the rank of the place as many letters ahead; a round doubles the letters that are
known to be in order. What is ranked are distinct keys: they are sorted by ranges, counted
range by range, and joined back, so neither a pair nor a group is ever in one task. Each
round's groups are kept: two places begin with the same letters exactly if they share a
group, which gives the common prefix of any two places by descending powers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bases import common_prefix
from ..sources.shared import Tables

#: Letters that the first order looks at.
WORD = 64
PLACE = ["pair_id", "side", "pos"]


@dataclass
class SuffixIndex:
    """``words``: pair_id, side, pos, word. ``ranks``: pair_id, side, pos, rank (over all pairs, pair by pair).

    ``levels``: for each number of letters, the places that share them with another place, and
    the number of their group.
    """

    words: DataFrame
    ranks: DataFrame
    levels: list[tuple[int, DataFrame]]
    tables: Tables
    word: int = WORD


def words_of(pairs: DataFrame, word: int = WORD) -> DataFrame:
    """Every place of both sequences and what it begins with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                pair = batch.column(0)[row].as_py()
                for side in (1, 2):
                    seq = batch.column(side)[row].as_py() or ""
                    for a in range(0, len(seq), 1 << 15):
                        b = min(len(seq), a + (1 << 15))
                        columns = [pa.array([pair] * (b - a), pa.int64()), pa.array(np.full(b - a, side, np.int32)), pa.array(np.arange(a, b)), pa.array([seq[p : p + word] for p in range(a, b)], pa.string())]
                        yield pa.RecordBatch.from_arrays(columns, names=[*PLACE, "word"])

    narrow = pairs.select(F.col("pair_id").cast("long"), F.col("first").cast("string"), F.col("second").cast("string"))
    return narrow.mapInArrow(run, "pair_id long, side int, pos long, word string")


def counted_before(keys: DataFrame, by: list[str], tables: Tables) -> DataFrame:
    """``keys`` (columns ``by`` and n, each key once) plus ``before``: the sum of n over all smaller keys.

    Ranges of keys are summed up each in its task; what all ranges before one hold is added from
    a table of one row a range.
    """
    spark = keys.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            upto = held + np.cumsum(batch.column("n").to_numpy())
            if len(upto):
                held = int(upto[-1])
            columns = [*batch.columns, pa.array(upto - batch.column("n").to_numpy(), pa.int64()), pa.array(np.full(batch.num_rows, part, np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "inside", "part"])

    kinds = dict(keys.dtypes)
    ordered = keys.select(*by, "n").repartitionByRange(ranges, *by).sortWithinPartitions(*by)
    summed = tables.settled(ordered.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in [*by, "n"]) + ", inside long, part int"))
    held = summed.groupBy("part").agg(F.sum("n").alias("held"))
    # As many rows as there are ranges.
    entered = held.select("part", (F.sum("held").over(Window.orderBy("part")) - F.col("held")).alias("entered"))
    return summed.join(F.broadcast(entered), "part").select(*by, "n", (F.col("inside") + F.col("entered")).alias("before"))


def suffix_index(pairs: DataFrame, word: int = WORD) -> SuffixIndex:
    """Ranks of all suffixes of both sequences of each pair. pair_ids are distinct; null sequences are empty.

    A suffix that another begins with comes first; of equal ones that of the first sequence.
    """
    tables = Tables(pairs.sparkSession)
    words = tables.settled(words_of(pairs, word))
    # Words that the sequence's end cuts short are told apart by their sides, and so done with.
    cut = F.when(F.length("word") < word, F.col("side")).otherwise(F.lit(0))
    keyed = words.withColumn("cut", cut)
    by = ["pair_id", "word", "cut"]
    keys = counted_before(keyed.groupBy(*by).agg(F.count("*").alias("n")), by, tables)
    now = tables.settled(keyed.join(keys, by).select(*PLACE, F.col("before").alias("rank"), (F.col("n") > 1).alias("tied")))
    done, levels, width = now.filter("not tied").select(*PLACE, "rank"), [], word
    while True:
        tied = now.filter("tied").select(*PLACE, "rank")
        if tied.isEmpty():
            return SuffixIndex(words, done, levels, tables, word)
        levels.append((width, tied))
        ahead = done.unionByName(tied).select("pair_id", "side", (F.col("pos") - width).alias("pos"), F.col("rank").alias("rank2"))
        # Past the last letter of a sequence comes its end, before all letters.
        both = tables.settled(tied.join(ahead, PLACE, "left").withColumn("rank2", F.coalesce("rank2", (F.col("side") - 3).cast("long"))))
        by = ["rank", "rank2"]
        keys = counted_before(both.groupBy(*by).agg(F.count("*").alias("n")), by, tables)
        # Ranks of a group go on from the group's own.
        groups = keys.groupBy("rank").agg(F.min("before").alias("start"))
        keys = keys.join(groups, "rank").select(*by, (F.col("rank") + F.col("before") - F.col("start")).alias("finer"), (F.col("n") > 1).alias("tied"))
        now = tables.settled(both.join(keys, by).select(*PLACE, F.col("finer").alias("rank"), "tied"))
        done = done.unionByName(now.filter("not tied").select(*PLACE, "rank"))
        width *= 2


def ranks_in_pairs(index: SuffixIndex) -> DataFrame:
    """pair_id, side, pos, r: ranks from 0 in each pair."""
    least = index.ranks.groupBy("pair_id").agg(F.min("rank").alias("least"))
    return index.ranks.join(least, "pair_id").select(*PLACE, (F.col("rank") - F.col("least")).alias("r"))


def common_prefixes(index: SuffixIndex, places: DataFrame) -> DataFrame:
    """``places`` (pair_id, side_a, pos_a, side_b, pos_b and others) plus ``lcp``: how many letters both suffixes begin with.

    The two are different places. From the most letters to the least, places that share a group
    move on by as many; what is left is within a word. Two joins a level. Places past a sequence's
    last letter share nothing.
    """
    out = places.withColumn("lcp", F.lit(0).cast("long"))

    def at(table: DataFrame, letter: str, value: str) -> DataFrame:
        return table.select("pair_id", F.col("side").alias(f"side_{letter}"), F.col("pos").alias(f"_at_{letter}"), F.col(value).alias(f"_{value}_{letter}"))

    def beside(rows: DataFrame, table: DataFrame, value: str) -> DataFrame:
        for letter in ("a", "b"):
            rows = rows.withColumn(f"_at_{letter}", F.col(f"pos_{letter}") + F.col("lcp"))
        for letter in ("a", "b"):
            rows = rows.join(at(table, letter, value), ["pair_id", f"side_{letter}", f"_at_{letter}"], "left")
        return rows

    for width, tied in reversed(index.levels):
        rows = beside(out, tied, "rank")
        out = rows.select(*places.columns, (F.col("lcp") + F.when(F.col("_rank_a") == F.col("_rank_b"), width).otherwise(0)).alias("lcp"))
    rows = beside(out, index.words, "word")
    rest = common_prefix(F.coalesce("_word_a", F.lit("")), F.coalesce("_word_b", F.lit("")))
    return rows.select(*places.columns, (F.col("lcp") + rest).alias("lcp"))


def ranked_suffixes(pairs: DataFrame, word: int = WORD) -> DataFrame:
    """pair_id, side, pos, r, and lcp with the suffix of the next rank (0 at the pair's end), as a written table."""
    index = suffix_index(pairs, word)
    ranks = index.tables.settled(ranks_in_pairs(index))
    after = ranks.select("pair_id", (F.col("r") - 1).alias("r"), F.col("side").alias("side_b"), F.col("pos").alias("pos_b"))
    here = ranks.select("pair_id", "r", F.col("side").alias("side_a"), F.col("pos").alias("pos_a"))
    lcp = common_prefixes(index, here.join(after, ["pair_id", "r"])).select("pair_id", F.col("side_a").alias("side"), F.col("pos_a").alias("pos"), "lcp")
    out = Tables(pairs.sparkSession).settled(ranks.join(lcp, PLACE, "left").select(*PLACE, "r", F.coalesce("lcp", F.lit(0)).cast("long").alias("lcp")))
    index.tables.drop()
    return out
