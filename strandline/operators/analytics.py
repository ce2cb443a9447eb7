"""What is asked of finished alignments: regions, projections, overlap, coverage, blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bases import project
from ..sources.shared import Tables
from . import cigar
from .scan import running


def conserved_regions(rows: DataFrame, longest_indel: int = 1000, least: int = 1000, include_tail: bool = False) -> DataFrame:
    """aln_id, first_start, second_start, first_end, second_end: stretches between long indels.

    A stretch counts if both its spans exceed ``least``. What follows the last long
    indel is left out unless ``include_tail`` asks for it.
    """
    big = F.col("op").isin("I", "D") & (F.col("len") > longest_indel)
    dx, dy = (cigar.advance(F.col("op"), F.col("len"), s) for s in (1, 2))
    t = running(rows.select("aln_id", "ord", "len", "op"), ["aln_id"], "ord", sums={"x1": dx, "y1": dy, "upto": big.cast("int")})
    # The big indel closes the island that lies before it.
    t = t.select("aln_id", "x1", "y1", (F.col("x1") - dx).alias("x0"), (F.col("y1") - dy).alias("y0"), big.alias("big"), (F.col("upto") - big.cast("int")).alias("island"))
    regions = t.groupBy("aln_id", "island").agg(
        F.min(F.when(~F.col("big"), F.col("x0"))).alias("first_start"), F.min(F.when(~F.col("big"), F.col("y0"))).alias("second_start"),
        F.max(F.when(~F.col("big"), F.col("x1"))).alias("first_end"), F.max(F.when(~F.col("big"), F.col("y1"))).alias("second_end"),
        F.max("big").alias("closed"),
    )
    wide = F.least(F.col("first_end") - F.col("first_start"), F.col("second_end") - F.col("second_start")) > least
    return regions.filter(wide & (F.lit(include_tail) | F.col("closed"))).select("aln_id", "first_start", "second_start", "first_end", "second_end")


def orthologues(points: DataFrame, rows: DataFrame, side: int = 1) -> DataFrame:
    """aln_id, name, pos and ``projected``: positions on one side carried to the other.

    Points and step ends are ordered together, so each point finds its step by one
    scan: the first whose end lies beyond it. Points past the end of the
    alignment get the end of the other side. ``side`` is where the points are.
    Each place is looked up once, however many points it has.
    """
    s0, s1, d0, d1 = ("x0", "x1", "y0", "y1") if side == 1 else ("y0", "y1", "x0", "x1")
    # Steps and points are looked at several times, so each is written once.
    tables = Tables(rows.sparkSession)
    rows = tables.settled(rows.select("aln_id", "ord", "len", "op"))
    named = tables.settled(points.select("aln_id", F.col("name").cast("string").alias("name"), F.col("pos").cast("long").alias("at")))
    # Steps that don't advance on the points' side hold no point, but may reach on along the other.
    inside = F.when(F.col(s1) > F.col(s0), F.struct(*[F.col(c).alias(n) for c, n in ((s0, "s0"), (s1, "s1"), (d0, "d0"), (d1, "d1"))]))
    events = cigar.trace(rows, tables=tables).select("aln_id", F.col(s1).alias("at"), F.lit(1).alias("kind"), F.col(d1).alias("d"), inside.alias("step"))
    asked = named.select("aln_id", "at").distinct()
    asked = asked.select("aln_id", "at", F.lit(2).alias("kind"), F.lit(None).cast("long").alias("d"), F.lit(None).cast(events.schema["step"].dataType).alias("step"))
    every = tables.settled(events.unionByName(asked))
    found = running(every, ["aln_id"], "at", after={"next": F.col("step")}, peaks={"last_d": F.col("d")}, ties=("kind",), tables=tables).filter("kind = 2")
    put = project(F.col("at"), F.col("next.s0"), F.col("next.s1"), F.col("next.d0"), F.col("next.d1"))
    # Points of alignments without steps have neither a step nor an end.
    found = found.filter(F.col("next").isNotNull() | F.col("last_d").isNotNull())
    found = found.select("aln_id", "at", F.when(F.col("next").isNull(), F.col("last_d").cast("double")).otherwise(put).alias("projected"))
    return named.join(found, ["aln_id", "at"]).select("aln_id", "name", F.col("at").alias("pos"), "projected")


def compare(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """a_id, b_id, size_a, size_b, shared, ratio: matched coordinate pairs that two alignments share.

    Matches lie on diagonals, so runs on one diagonal overlap like intervals: no
    coordinate is ever a row of its own.
    """
    runs = cigar.trace(rows).filter(F.col("op").isin("M", "=")).select("aln_id", (F.col("x0") - F.col("y0")).alias("diagonal"), "x0", "x1")
    sizes = runs.groupBy("aln_id").agg(F.sum(F.col("x1") - F.col("x0")).alias("size"))
    a = pairs.join(runs, pairs.a_id == runs.aln_id).select("a_id", "b_id", "diagonal", F.col("x0").alias("a0"), F.col("x1").alias("a1"))
    b = runs.select(F.col("aln_id").alias("b_id"), "diagonal", F.col("x0").alias("b0"), F.col("x1").alias("b1"))
    both = a.join(b, ["b_id", "diagonal"]).filter("a0 < b1 and b0 < a1")
    shared = both.groupBy("a_id", "b_id").agg(F.sum(F.least("a1", "b1") - F.greatest("a0", "b0")).alias("shared"))
    out = pairs.select("a_id", "b_id").join(shared, ["a_id", "b_id"], "left")
    for s in ("a", "b"):
        out = out.join(sizes.select(F.col("aln_id").alias(f"{s}_id"), F.col("size").alias(f"size_{s}")), f"{s}_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = out.select("a_id", "b_id", zero("size_a").alias("size_a"), zero("size_b").alias("size_b"), zero("shared").alias("shared"))
    return out.withColumn("ratio", F.try_divide(F.col("shared").cast("double"), F.least("size_a", "size_b").cast("double")))


def overlaps(a: DataFrame, b: DataFrame, width: int) -> DataFrame:
    """Pairs of half-open segments (id, name, left, right) on one sequence that overlap, and by how much.

    The axis is cut into bins of ``width``; a pair meets in each bin that both
    reach and counts in the first of these, so the join is on (id, bin).
    """
    cut = lambda s, p: s.filter("left < right").select(
        "id", F.col("name").alias(f"{p}_name"), F.col("left").alias(f"{p}_left"), F.col("right").alias(f"{p}_right"),
        F.explode(F.sequence(F.floor(F.col("left") / width), F.floor((F.col("right") - 1) / width))).alias("bin"),
    )
    both = cut(a, "a").join(cut(b, "b"), ["id", "bin"])
    start, end = F.greatest("a_left", "b_left"), F.least("a_right", "b_right")
    return both.filter((start < end) & (F.floor(start / width) == F.col("bin"))).select("id", "a_name", "b_name", (end - start).alias("overlap"))


def gap_between(a_left, a_right, b_left, b_right):
    """Distance of two segments: 0 if they overlap or touch."""
    return F.greatest(F.lit(0), F.col(b_left) - F.col(a_right), F.col(a_left) - F.col(b_right))


def flip_segment(left, right, size):
    """A segment as the other strand has it."""
    return (F.col(size) - F.col(right)).alias("left"), (F.col(size) - F.col(left)).alias("right")


def uncovered(segments: DataFrame, sizes: DataFrame) -> DataFrame:
    """id and the share of the cells 0 .. size that no segment covers.

    There are size + 1 cells: the last, past the end, is never covered.
    Segments (id, left, right) open and close in one running sum.
    """
    real = segments.filter("left < right")
    events = real.select("id", F.col("left").alias("at"), F.lit(1).alias("d")).unionByName(real.select("id", F.col("right").alias("at"), F.lit(-1).alias("d")))
    edges = events.groupBy("id", "at").agg(F.sum("d").alias("d"))
    open_now = running(edges, ["id"], "at", sums={"depth": F.col("d")}, after={"until": F.col("at")})
    covered = open_now.filter("depth > 0").groupBy("id").agg(F.sum(F.col("until") - F.col("at")).alias("covered"))
    cells = F.col("size") + 1
    out = sizes.select("id", "size").join(covered, "id", "left")
    return out.select("id", ((cells - F.coalesce("covered", F.lit(0))).cast("double") / cells).alias("uncovered"))


def interval_buckets(intervals: DataFrame, thresholds: tuple[int, ...] = (1, 20, 50, 80)) -> DataFrame:
    """Intervals (first_freq, second_freq, len, ...) of at least the least threshold, with ``bucket``: the largest threshold strictly below ``len`` (or the least)."""
    limits = sorted(thresholds)
    below = F.array_max(F.filter(F.array(*map(F.lit, limits)), lambda t: t < F.col("len")))
    return intervals.filter(F.col("len") >= limits[0]).withColumn("bucket", F.coalesce(below, F.lit(limits[0])))


def blocks_of_steps(rows: DataFrame, most_gap: int) -> DataFrame:
    """aln_id, st1, en1, st2, en2: stretches of =, joined over gaps of at most ``most_gap``.

    For printed alignments in which D consumes the second sequence. Leading gaps
    are dropped; a tolerated last gap belongs to the last block.
    """
    dx, dy = (cigar.advance(F.col("op"), F.col("len"), s, "second") for s in (1, 2))
    eq = F.col("op") == "="
    t = running(rows.select("aln_id", "ord", "len", "op"), ["aln_id"], "ord", sums={"x1": dx, "y1": dy}, runs={"part": eq})
    t = t.select("aln_id", "part", eq.alias("eq"), "x1", "y1", (F.col("x1") - dx).alias("x0"), (F.col("y1") - dy).alias("y0"))
    parts = t.groupBy("aln_id", "part").agg(F.first("eq").alias("eq"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    wide = ~F.col("eq") & (F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) > most_gap)
    # The first part is dropped if it is a gap, whatever its size.
    parts = Tables(rows.sparkSession).settled(parts.withColumn("wide", wide).filter(F.col("eq") | (F.col("part") > 1)))
    parts = running(parts, ["aln_id"], "part", sums={"upto": F.col("wide").cast("int")})
    parts = parts.withColumn("block", F.col("upto") - F.col("wide").cast("int"))
    inside = parts.filter(~F.col("wide"))
    return inside.groupBy("aln_id", "block").agg(F.min("x0").alias("st1"), F.max("x1").alias("en1"), F.min("y0").alias("st2"), F.max("y1").alias("en2")).drop("block")


def blocks_of_kmers(matches: DataFrame, most_gap: int, k: int) -> DataFrame:
    """aln_id, st1, en1, st2, en2 of a k-mer alignment (aln_id, ord, left, right; a null is a gap).

    Match runs are joined over gaps whose span, first to last k-mer start, is at
    most ``most_gap`` on both sides; ends then move on by ``k``.
    """
    eq = F.col("left").isNotNull() & F.col("right").isNotNull()
    t = running(matches, ["aln_id"], "ord", runs={"part": eq}).withColumn("eq", eq)
    parts = t.groupBy("aln_id", "part").agg(F.first("eq").alias("eq"), *[f(c).alias(f"{c}_{n}") for c in ("left", "right") for f, n in ((F.min, "a"), (F.max, "b"))])
    span = F.greatest(F.coalesce(F.col("left_b") - F.col("left_a"), F.lit(0)), F.coalesce(F.col("right_b") - F.col("right_a"), F.lit(0)))
    parts = parts.withColumn("wide", ~F.col("eq") & (span > most_gap))
    parts = running(parts, ["aln_id"], "part", sums={"block": F.col("wide").cast("int")})
    out = parts.filter("eq").groupBy("aln_id", "block").agg(F.min("left_a").alias("st1"), (F.max("left_b") + k).alias("en1"), F.min("right_a").alias("st2"), (F.max("right_b") + k).alias("en2"))
    return out.drop("block")


def match_parts(matches: DataFrame) -> DataFrame:
    """aln_id, part, is_match, st1, en1, st2, en2: alternating runs of matches and gaps, no gap first."""
    both = F.col("left").isNotNull() & F.col("right").isNotNull()
    t = running(matches, ["aln_id"], "ord", runs={"part": both}).withColumn("is_match", both)
    parts = t.groupBy("aln_id", "part").agg(F.first("is_match").alias("is_match"), F.min("left").alias("st1"), F.max("left").alias("en1"), F.min("right").alias("st2"), F.max("right").alias("en2"))
    return parts.filter(F.col("is_match") | (F.col("part") > 1))
