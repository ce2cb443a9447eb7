"""Alignments as rows (aln_id, ord, len, op): parsing, printing, traces, statistics.

Ops: M (match or, in plain alignments, aligned), = (match), X (mismatch), D
(in the first sequence only) and I (in the second only). ``convention`` says
which sequence D consumes: "first" (this engine's own) or "second" (some
printed alignments).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import Tables
from .scan import running

STEP = r"(\d+)([=MXID])"


def parse(alignments: DataFrame, id_col: str = "aln_id", cigar_col: str = "cigar") -> DataFrame:
    """aln_id, ord (from 0), len, op of CIGAR strings. Null and empty ones have no rows."""
    lens = F.regexp_extract_all(F.col(cigar_col), F.lit(STEP), 1)
    ops = F.regexp_extract_all(F.col(cigar_col), F.lit(STEP), 2)
    rows = alignments.select(F.col(id_col).alias("aln_id"), F.posexplode(F.arrays_zip(lens.alias("len"), ops.alias("op"))).alias("ord", "s"))
    return rows.select("aln_id", "ord", F.col("s.len").cast("long").alias("len"), F.col("s.op").alias("op"))


def render(rows: DataFrame) -> DataFrame:
    """aln_id and its CIGAR string."""
    steps = F.array_sort(F.collect_list(F.struct("ord", "len", "op")))
    return rows.groupBy("aln_id").agg(F.array_join(F.transform(steps, lambda s: F.concat(s["len"].cast("string"), s["op"])), "").alias("cigar"))


def merge(rows: DataFrame) -> DataFrame:
    """Neighbours of one op joined, empty ones dropped, ords numbered anew."""
    islands = running(rows.filter(F.col("len") > 0), ["aln_id"], "ord", runs={"island": F.col("op")})
    return islands.groupBy("aln_id", "island").agg(F.sum("len").alias("len"), F.first("op").alias("op")).select("aln_id", (F.col("island") - 1).cast("int").alias("ord"), "len", "op")


def encode_runs(letters: DataFrame) -> DataFrame:
    """Rows (aln_id, ord, op), one for each column of an alignment, as a CIGAR."""
    return merge(letters.select("aln_id", "ord", F.lit(1).cast("long").alias("len"), "op"))


def splice(rows: DataFrame, inner: DataFrame) -> DataFrame:
    """Steps at (aln_id, ord) replaced by the steps of ``inner`` (aln_id, ord, inner_ord, len, op), neighbours unmerged."""
    stay = rows.join(inner.select("aln_id", "ord").distinct(), ["aln_id", "ord"], "left_anti").withColumn("inner_ord", F.lit(0))
    every = stay.unionByName(inner.select("aln_id", "ord", "len", "op", "inner_ord"))
    # Places within the steps that come for one, and steps before that one: neither gathers an alignment.
    held = running(every.groupBy("aln_id", "ord").agg(F.count("*").alias("held")), ["aln_id"], "ord", sums={"upto": F.col("held")})
    within = running(every, ["aln_id", "ord"], "inner_ord", sums={"place": F.lit(1)})
    out = within.join(held, ["aln_id", "ord"])
    return out.select("aln_id", (F.col("upto") - F.col("held") + F.col("place") - 1).cast("int").alias("ord"), "len", "op")


def advance(op: Column, length: Column, side: int, convention: str = "first") -> Column:
    """How far a step goes along the first (1) or the second (2) sequence."""
    if convention not in ("first", "second"):
        raise ValueError("convention is first or second")
    skipped = "I" if (side == 1) == (convention == "first") else "D"
    return F.when(op == skipped, F.lit(0).cast("long")).otherwise(length)


def trace(rows: DataFrame, convention: str = "first", tables: Tables | None = None) -> DataFrame:
    """aln_id, ord, len, op, x0, y0, x1, y1: where each step begins and ends. ``tables`` is as in ``running``."""
    dx, dy = (advance(F.col("op"), F.col("len"), s, convention) for s in (1, 2))
    ends = running(rows.select("aln_id", "ord", "len", "op"), ["aln_id"], "ord", sums={"x1": dx, "y1": dy}, tables=tables)
    return ends.select("aln_id", "ord", "len", "op", (F.col("x1") - dx).alias("x0"), (F.col("y1") - dy).alias("y0"), "x1", "y1")


def vertices(rows: DataFrame) -> DataFrame:
    """The polyline of each alignment: aln_id, ord, x, y, from (0, 0)."""
    t = trace(rows)
    origin = t.select("aln_id").distinct().select("aln_id", F.lit(0).alias("ord"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"))
    return origin.unionByName(t.select("aln_id", (F.col("ord") + 1).alias("ord"), F.col("x1").alias("x"), F.col("y1").alias("y")))


def lengths(rows: DataFrame, convention: str = "first") -> DataFrame:
    """aln_id, target (first) and query (second) length."""
    return rows.groupBy("aln_id").agg(*[F.sum(advance(F.col("op"), F.col("len"), s, convention)).alias(n) for s, n in ((1, "target"), (2, "query"))])


def mutability(rows: DataFrame) -> DataFrame:
    """aln_id and 1 - (M / target + M / query) / 2; null where a side is empty."""
    matched = F.sum(F.when(F.col("op").isin("M", "="), F.col("len")).otherwise(0))
    of = lambda side: F.try_divide(matched.cast("double"), F.sum(advance(F.col("op"), F.col("len"), side)).cast("double"))
    return rows.groupBy("aln_id").agg((1 - (of(1) + of(2)) / 2).alias("mutability"))


def summary(rows: DataFrame) -> DataFrame:
    """aln_id, op, bases (total length) and configurations (steps)."""
    return rows.groupBy("aln_id", "op").agg(F.sum("len").alias("bases"), F.count("*").alias("configurations"))


def totals(rows: DataFrame) -> DataFrame:
    """aln_id and the total length of each op, 0 where there is none."""
    names = {"=": "n_eq", "M": "n_m", "X": "n_x", "I": "n_i", "D": "n_d"}
    return rows.groupBy("aln_id").agg(*[F.sum(F.when(F.col("op") == op, F.col("len")).otherwise(0)).alias(n) for op, n in names.items()])


def indel_statistics(rows: DataFrame, longest_short: int = 5) -> DataFrame:
    """Mismatches, short and long indels of each alignment; the normaliser leaves long indels out."""
    op, n = F.col("op"), F.col("len")
    long = op.isin("I", "D") & (n > longest_short)
    count = lambda c, name: F.count_if(c).alias(name)
    length = lambda c, name: F.sum(F.when(c, n).otherwise(0)).alias(name)
    parts = [count(op == "X", "n_mism"), length(op == "X", "len_mism"), length(~long, "norm_len")]
    for letter, name in (("I", "insertions"), ("D", "deletions")):
        mine = op == letter
        parts += [count(mine & ~long, f"n_short_{name}"), length(mine & ~long, f"len_short_{name}")]
        parts += [count(mine & long, f"n_long_{name}"), length(mine & long, f"len_long_{name}")]
        parts.append(F.coalesce(F.max(F.when(mine & long, n)), F.lit(0)).alias(f"max_{name[:-1]}"))
    return rows.groupBy("aln_id").agg(*parts)


def indel_histogram(rows: DataFrame, width: int = 200, keys: tuple[str, ...] = ("aln_id",)) -> DataFrame:
    """op, bin_start and count of indels in bins of ``width``."""
    start = (F.floor(F.col("len") / width) * width).alias("bin_start")
    return rows.filter(F.col("op").isin("I", "D")).groupBy(*keys, "op", start).agg(F.count("*").alias("n"))


def unit_multiples(rows: DataFrame, unit: int, most_off: float = 0.05) -> DataFrame:
    """Indels whose length is nearly a multiple of ``unit``: with ``mult`` and the position ``x0`` where they are."""
    mult = F.bround(F.col("len") / F.lit(float(unit)), 0)
    off = F.abs(F.col("len") - mult * unit) / unit
    return trace(rows).filter(F.col("op").isin("I", "D")).withColumn("mult", mult.cast("long")).filter((F.col("mult") != 0) & (off < most_off))


def unit_multiplicity(rows: DataFrame, unit: int, most_off: float = 0.05) -> DataFrame:
    """aln_id, mult, n, percent, mean_mult, lens (sorted) and positions (sorted) of near multiples."""
    found = unit_multiples(rows, unit, most_off).groupBy("aln_id", "mult").agg(
        F.count("*").alias("n"), F.sort_array(F.collect_list("len")).alias("lens"), F.sort_array(F.collect_list("x0")).alias("positions")
    )
    every = Window.partitionBy("aln_id")
    total = F.sum("n").over(every)
    return found.select(
        "aln_id", "mult", "n",
        F.bround(F.col("n") / total * 100, 0).cast("int").alias("percent"),
        (F.sum(F.col("n") * F.col("mult")).over(every) / total).alias("mean_mult"), "lens", "positions",
    )


def square_blocks(rows: DataFrame) -> DataFrame:
    """len and n: how often an insertion and a deletion of one length are neighbours."""
    after = running(rows.select("aln_id", "ord", "len", "op"), ["aln_id"], "ord", after={"next": F.struct("op", "len")})
    after = after.select("*", F.col("next.op").alias("op2"), F.col("next.len").alias("len2"))
    hit = F.col("op").isin("I", "D") & F.col("op2").isin("I", "D") & (F.col("op") != F.col("op2")) & (F.col("len") == F.col("len2"))
    return after.filter(hit).groupBy("aln_id", "len").agg(F.count("*").alias("n"))


def gapped(alignments: DataFrame, convention: str = "first") -> DataFrame:
    """aln_id, a, b: both sequences with gaps, from (aln_id, first, second, cigar)."""
    t = trace(parse(alignments.select("aln_id", "cigar")), convention).join(alignments.select("aln_id", "first", "second"), "aln_id")
    cut = lambda s, x0, x1, n: F.rpad(F.substring(F.col(s), (F.col(x0) + 1).cast("int"), (F.col(x1) - F.col(x0)).cast("int")), n, "-")
    size = F.col("len").cast("int")
    parts = t.select("aln_id", "ord", cut("first", "x0", "x1", size).alias("a"), cut("second", "y0", "y1", size).alias("b"))
    steps = F.array_sort(F.collect_list(F.struct("ord", "a", "b")))
    joined = parts.groupBy("aln_id").agg(steps.alias("s"))
    return joined.select("aln_id", *[F.array_join(F.col(f"s.{c}"), "").alias(c) for c in ("a", "b")])


def check(alignments: DataFrame) -> DataFrame:
    """aln_id and ``valid``: lengths agree, M and = letters are equal, X letters all differ."""
    size = lengths(parse(alignments.select("aln_id", "cigar")))
    t = trace(parse(alignments.select("aln_id", "cigar"))).join(alignments.select("aln_id", "first", "second"), "aln_id")
    letters = lambda s, a: F.substring(F.col(s), (F.col(a) + 1).cast("int"), F.col("len").cast("int"))
    a, b = letters("first", "x0"), letters("second", "y0")
    # All letters differ if none of the places where both have letters holds equal ones.
    apart = ~F.exists(F.arrays_zip(F.split(a, "").alias("a"), F.split(b, "").alias("b")), lambda z: (z["a"] == z["b"]) & (z["a"] != ""))
    wrong = (F.col("op").isin("M", "=") & (a != b)) | ((F.col("op") == "X") & ~apart)
    bad = t.groupBy("aln_id").agg(F.max(wrong).alias("wrong"))
    out = alignments.join(size, "aln_id", "left").join(bad, "aln_id", "left")
    fits = (F.coalesce("target", F.lit(0)) == F.length("first")) & (F.coalesce("query", F.lit(0)) == F.length("second"))
    return out.select("aln_id", (fits & ~F.coalesce("wrong", F.lit(False))).alias("valid"))
