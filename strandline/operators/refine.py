"""Alignment of pairs that no task should hold: a table of open blocks, aligned level by level.

A block is a stretch of both sequences of a pair; at first each pair is one. All blocks of a level
are aligned at once by ``ranks``, ``suffix`` and ``chains``, whose tasks hold ranges of places, blocks of ranks
and stripes of anchors, whatever block these are of. The anchors of a block's best chain are
grown over equal letters; what lies between two of them is deleted and inserted. Where
both are longer than one letter and the block has come to more than two steps, it
is a block of the next level. A step is known by where it begins, x + y, which grows along an
alignment: so blocks need no paths, and all steps of all levels are put in order by it at the end.

Blocks of at most ``leaf`` letters are finished by the kernel, many side by side; they are
small however long their pair is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import Tables
from . import chains, kernels, suffix
from .scan import running

#: Letters of both sides of a block that one task may finish.
LEAF = 1 << 16
#: Letters of a piece of a sequence.
PIECE = 1 << 14
PRIMARY, RECURSIVE, MISMATCHES = 0, 1, 2
BLOCK = "pair_id long, x0 long, y0 long, first string, second string, root boolean"
BLOCK_NAMES = [f.split(" ")[0] for f in BLOCK.split(", ")]
STEP = "pair_id long, form int, x long, y long, len long, op string"
STEP_NAMES = [f.split(" ")[0] for f in STEP.split(", ")]
GAP = "block long, g long, left long, right long, x long, y long, d string, i string"
GAP_NAMES = [f.split(" ")[0] for f in GAP.split(", ")]


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _steps(rows: list[tuple]) -> pa.RecordBatch:
    return _batch(rows, STEP_NAMES, [pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.string()])


def pieces_of(blocks: DataFrame) -> DataFrame:
    """block, side, piece, letters: both sequences, cut every ``PIECE`` letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                for side in (1, 2):
                    seq = batch.column(side)[row].as_py() or ""
                    rows = [(batch.column(0)[row].as_py(), side, a // PIECE, seq[a : a + PIECE]) for a in range(0, len(seq), PIECE)]
                    yield _batch(rows, ["block", "side", "piece", "letters"], [pa.int64(), pa.int32(), pa.int64(), pa.string()])

    return blocks.select("block", "first", "second").mapInArrow(run, "block long, side int, piece long, letters string")


def texts_of(pieces: DataFrame, ranges: DataFrame) -> DataFrame:
    """block, g, first, second: the letters from x to x_end and from y to y_end of ``ranges`` (block, g, x, x_end, y, y_end)."""
    sides = ranges.select("block", "g", F.lit(1).alias("side"), F.col("x").alias("a"), F.col("x_end").alias("b"))
    sides = sides.unionByName(ranges.select("block", "g", F.lit(2).alias("side"), F.col("y").alias("a"), F.col("y_end").alias("b")))
    of = lambda c: ((c - F.pmod(c, F.lit(PIECE))) / PIECE).cast("long")
    met = sides.filter("b > a").withColumn("piece", F.explode(F.sequence(of(F.col("a")), of(F.col("b") - 1)))).join(pieces, ["block", "side", "piece"])
    begin = F.greatest(F.col("a") - F.col("piece") * PIECE, F.lit(0))
    end = F.least(F.col("b") - F.col("piece") * PIECE, F.lit(PIECE))
    parts = met.select("block", "g", "side", "piece", F.substring("letters", (begin + 1).cast("int"), (end - begin).cast("int")).alias("part"))
    side = lambda n: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == n, F.struct("piece", "part")))), lambda s: s["part"]), "")
    whole = parts.groupBy("block", "g").agg(side(1).alias("first"), side(2).alias("second"))
    return ranges.select("block", "g").join(whole, ["block", "g"], "left").select("block", "g", *[F.coalesce(c, F.lit("")).alias(c) for c in ("first", "second")])


def _grown(gaps: DataFrame) -> DataFrame:
    """``GAP`` of gaps (block, g, x, y, last, first, second): equal letters go to the anchors around, first to the one before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for block, g, x, y, last, a, b in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                most = min(len(a), len(b))
                right = kernels.equal_ahead(a, 0, b, 0, most) if g else 0
                left = 0 if last else kernels.equal_behind(a, len(a), b, len(b), most - right)
                rows.append((block, g, left, right, x + right, y + right, a[right : len(a) - left], b[right : len(b) - left]))
            yield _batch(rows, GAP_NAMES, [*[pa.int64()] * 6, pa.string(), pa.string()])

    return gaps.select("block", "g", "x", "y", "last", "first", "second").mapInArrow(run, GAP)


def _told_apart(gaps: DataFrame) -> DataFrame:
    """Runs of equal and unequal letters of gaps (pair_id, x, y, d, i) of one length on both sides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for pair, x, y, d, i in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                same = np.frombuffer(d.encode("utf-32-le"), "<u4") == np.frombuffer(i.encode("utf-32-le"), "<u4")
                cuts = [0, *(np.flatnonzero(same[1:] != same[:-1]) + 1).tolist(), len(same)]
                rows += [(pair, MISMATCHES, x + a, y + a, b - a, "M" if same[a] else "X") for a, b in zip(cuts, cuts[1:], strict=False)]
            yield _steps(rows)

    return gaps.select("pair_id", "x", "y", "d", "i").mapInArrow(run, STEP)


def _finished(blocks: DataFrame, max_count: int, all_widths: bool) -> DataFrame:
    """All steps of small blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pair, x0, y0, a, b, root in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                steps = kernels.primary(a, b, max_count, all_widths)
                deep = kernels.refine(steps, a, b, max_count, all_widths)
                forms = [(RECURSIVE, deep), (MISMATCHES, kernels.with_mismatches(deep, a, b)), *([(PRIMARY, steps)] if root else [])]
                rows = []
                for form, found in forms:
                    x, y = x0, y0
                    for n, op in found:
                        rows.append((pair, form, x, y, n, op))
                        x, y = x + n * (op != "I"), y + n * (op != "D")
                yield _steps(rows)

    spark = blocks.sparkSession
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    # Blocks are few bytes and much work, and lie in few files.
    return blocks.select(BLOCK_NAMES).repartition(partitions, "pair_id", "x0", "y0").mapInArrow(run, STEP)


def _in_forms(rows: DataFrame, *forms: tuple[int, Column]) -> DataFrame:
    """Steps once for each form whose condition holds."""
    wanted = F.filter(F.array(*[F.when(c, F.lit(f)) for f, c in forms]), lambda f: f.isNotNull())
    return rows.withColumn("form", F.explode(wanted)).select(STEP_NAMES)


def _one_level(blocks: DataFrame, tables: Tables, max_count: int, all_widths: bool) -> tuple[list[DataFrame], DataFrame]:
    """Steps of ``blocks`` (and block, a number), and the blocks of the next level, without numbers."""
    sizes = blocks.select("block", F.length("first").cast("long").alias("n_first"), F.length("second").cast("long").alias("n_second"))
    pairs = blocks.select(F.col("block").alias("pair_id"), "first", "second")
    firsts = sizes.select(F.col("block").alias("pair_id"), "n_first")
    hits = suffix.rare_matches(suffix.suffixes(pairs), firsts, max_count, all_widths)
    chain = chains.best_chains(suffix.anchors(suffix.anchor_intervals(hits, firsts)))
    chain = tables.settled(chain.select(F.col("pair_id").alias("block"), F.col("ord").cast("long").alias("g"), "x", "y", "len"))

    # Gap g lies before anchor g; the last one ends with the sequences.
    held = chain.groupBy("block").agg(F.count("*").alias("held"))
    zero = F.lit(0).cast("long")
    begins = chain.select("block", (F.col("g") + 1).alias("g"), (F.col("x") + F.col("len")).alias("x"), (F.col("y") + F.col("len")).alias("y"))
    begins = begins.unionByName(sizes.select("block", zero.alias("g"), zero.alias("x"), zero.alias("y")))
    ends = chain.select("block", "g", F.col("x").alias("x_end"), F.col("y").alias("y_end"), F.lit(False).alias("last"))
    ends = ends.unionByName(sizes.join(held, "block", "left").select("block", F.coalesce("held", zero).alias("g"), F.col("n_first").alias("x_end"), F.col("n_second").alias("y_end"), F.lit(True).alias("last")))
    ranges = tables.settled(begins.join(ends, ["block", "g"]))
    gaps = tables.settled(_grown(ranges.join(texts_of(tables.settled(pieces_of(blocks)), ranges), ["block", "g"])))

    size = {"n_d": F.length("d").cast("long"), "n_i": F.length("i").cast("long")}
    gaps = gaps.withColumns(size)
    after = gaps.select("block", (F.col("g") - 1).alias("g"), F.col("right").alias("grown"))
    matched = chain.join(gaps.select("block", "g", "left", (F.col("n_d") + F.col("n_i") > 0).cast("long").alias("parted")), ["block", "g"]).join(after, ["block", "g"])
    matched = matched.select("block", "g", (F.col("x") - F.col("left")).alias("x"), (F.col("y") - F.col("left")).alias("y"), (F.col("left") + F.col("len") + F.col("grown")).alias("len"), "parted")
    # Anchors with nothing between them are one step.
    runs = running(matched, ["block"], "g", sums={"run": F.col("parted")}).groupBy("block", "run")
    matched = tables.settled(runs.agg(F.min("x").alias("x"), F.min("y").alias("y"), F.sum("len").alias("len")).drop("run"))
    count = gaps.select("block", ((F.col("n_d") > 0).cast("long") + (F.col("n_i") > 0).cast("long")).alias("n")).unionByName(matched.select("block", F.lit(1).cast("long").alias("n")))
    of_block = blocks.select("block", "pair_id", "x0", "y0", "root").join(count.groupBy("block").agg((F.sum("n") > 2).alias("deep")), "block")

    here = lambda rows: rows.join(of_block, "block").withColumns({"x": F.col("x") + F.col("x0"), "y": F.col("y") + F.col("y0")})
    gaps = here(gaps).withColumn("open", F.col("deep") & (F.col("n_d") > 1) & (F.col("n_i") > 1))
    always, stays = F.lit(True), ~F.col("open")
    unlike = stays & (F.col("n_d") != F.col("n_i"))
    narrow = gaps.select("pair_id", "x", "y", "n_d", "n_i", "open", "root")
    forms = ((PRIMARY, F.col("root")), (RECURSIVE, stays), (MISMATCHES, unlike))
    steps = [
        _in_forms(here(matched).withColumn("op", F.lit("M")), (PRIMARY, F.col("root")), (RECURSIVE, always), (MISMATCHES, always)),
        _in_forms(narrow.filter("n_d > 0").withColumns({"len": F.col("n_d"), "op": F.lit("D")}), *forms),
        _in_forms(narrow.filter("n_i > 0").withColumns({"x": F.col("x") + F.col("n_d"), "len": F.col("n_i"), "op": F.lit("I")}), *forms),
        _told_apart(gaps.filter(stays & (F.col("n_d") == F.col("n_i")) & (F.col("n_d") > 0))),
    ]
    opened = gaps.filter("open").select("pair_id", F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("d").alias("first"), F.col("i").alias("second"), F.lit(False).alias("root"))
    return steps, opened


def align_steps(pairs: DataFrame, max_count: int = 50, all_widths: bool = False, leaf: int = LEAF) -> DataFrame:
    """pair_id, form (``PRIMARY``, ``RECURSIVE``, ``MISMATCHES``), x, y, len, op: every step of each pair's alignments, in order of x + y.

    pair_ids are distinct and not null; null sequences are empty. Pairs of two empty sequences have no steps.
    """
    tables = Tables(pairs.sparkSession)
    zero = F.lit(0).cast("long")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    blocks = pairs.select(F.col("pair_id").cast("long").alias("pair_id"), zero.alias("x0"), zero.alias("y0"), text("first").alias("first"), text("second").alias("second"), F.lit(True).alias("root"))
    small = F.length("first") + F.length("second") <= leaf
    out = pairs.sparkSession.createDataFrame([], STEP)
    while True:
        # Written, so that numbers stay as they are.
        blocks = tables.settled(blocks.withColumn("block", F.monotonically_increasing_id()))
        if blocks.isEmpty():
            return out
        steps = [_finished(blocks.filter(small), max_count, all_widths)]
        large = blocks.filter(~small)
        if large.isEmpty():
            return out.unionByName(tables.settled(steps[0]))
        more, blocks = _one_level(tables.settled(large), tables, max_count, all_widths)
        for rows in [*steps, *more]:
            out = out.unionByName(tables.settled(rows.select(STEP_NAMES)))


def render(steps: DataFrame) -> DataFrame:
    """pair_id, form, cigar."""
    each = F.array_sort(F.collect_list(F.struct((F.col("x") + F.col("y")).alias("at"), "len", "op")))
    return steps.groupBy("pair_id", "form").agg(F.array_join(F.transform(each, lambda s: F.concat(s["len"].cast("string"), s["op"])), "").alias("cigar"))


def check(pairs: DataFrame, steps: DataFrame) -> DataFrame:
    """pair_id, form, valid: steps use up both sequences one after the other, M letters are equal, X letters all differ.

    Letters are looked at step by step, from pieces of the sequences. Pairs without steps have no rows.
    """
    tables = Tables(pairs.sparkSession)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    blocks = pairs.select(F.col("pair_id").cast("long").alias("block"), text("first"), text("second"))
    both = steps.filter("op <> 'D' AND op <> 'I'").select(F.col("pair_id").alias("block"), "op", "x", "y", "len").distinct()
    ranges = tables.settled(both.select("block", F.monotonically_increasing_id().alias("g"), "op", "x", "y", (F.col("x") + F.col("len")).alias("x_end"), (F.col("y") + F.col("len")).alias("y_end")))
    read = ranges.join(texts_of(tables.settled(pieces_of(blocks)), ranges), ["block", "g"])
    equal = F.exists(F.arrays_zip(F.split("first", "").alias("a"), F.split("second", "").alias("b")), lambda z: (z["a"] == z["b"]) & (z["a"] != ""))
    right = F.when(F.col("op") == "X", ~equal & (F.length("first") == F.length("second"))).otherwise(F.col("first") == F.col("second"))
    read = read.select(F.col("block").alias("pair_id"), "op", "x", "y", (F.col("x_end") - F.col("x")).alias("len"), (right & (F.length("first") == F.col("x_end") - F.col("x"))).alias("right"))
    along = steps.withColumns({"dx": F.when(F.col("op") == "I", 0).otherwise(F.col("len")), "dy": F.when(F.col("op") == "D", 0).otherwise(F.col("len")), "at": F.col("x") + F.col("y")})
    along = running(along, ["pair_id", "form"], "at", sums={"to_x": F.col("dx"), "to_y": F.col("dy")})
    placed = (F.col("to_x") - F.col("dx") == F.col("x")) & (F.col("to_y") - F.col("dy") == F.col("y"))
    seen = along.join(read, ["pair_id", "op", "x", "y", "len"], "left").withColumn("right", placed & F.coalesce("right", F.col("op").isin("D", "I")))
    found = seen.groupBy("pair_id", "form").agg(F.min("right").alias("right"), F.max("to_x").alias("to_x"), F.max("to_y").alias("to_y"))
    lengths = blocks.select(F.col("block").alias("pair_id"), F.length("first").alias("n_first"), F.length("second").alias("n_second"))
    return found.join(lengths, "pair_id").select("pair_id", "form", (F.col("right") & (F.col("to_x") == F.col("n_first")) & (F.col("to_y") == F.col("n_second"))).alias("valid"))
