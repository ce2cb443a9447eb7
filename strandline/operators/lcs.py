"""Longest common subsequences of word lists of any length, in cells: no pair's words are ever in one task.

A word of the first list and an equal one of the second are a point (i, j). A point's level
is the length of the longest run of points that ends there and grows on both sides. Both lists are
cut into ranges of ``CELL`` words, so a pair is a grid of cells, and cells with the same
a + b, of all pairs, are worked on side by side, one round after another. What a cell needs
of the cells before it is bounded by its own ranges:

* from cells before on both sides one number, the highest level;
* from cells of the same range on the second side the staircase of levels by j;
* from cells of the same range on the first side the staircase of levels by i.

Staircases go straight to the next cell of their range that has points. Predecessors then
follow by ordered scans within levels, and the subsequence by going back range by range.
"""

from __future__ import annotations

from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import Tables
from . import chains, kmers
from .chains import Staircase
from .scan import running

#: Words of a range.
CELL = 50_000
POINT, BY_J, BY_I, HIGHEST, BEFORE = range(5)
#: ``up`` and ``right``: the next cells with points in the same ranges; ``top_a`` and ``top_b``: the pair's last ranges.
ROW = "pair_id long, a long, b long, kind int, i long, j long, level long, up long, right long, top_a long, top_b long, wave long"
NAMES = [f.split(" ")[0] for f in ROW.split(", ")]
KINDS = [pa.int32() if n == "kind" else pa.int64() for n in NAMES]


def cell_levels(points: list[tuple[int, int]], by_j: list[tuple[int, int]], by_i: list[tuple[int, int]], base: int) -> tuple[list[int], list[tuple[int, int]], list[tuple[int, int]]]:
    """Levels of a cell's points (sorted), and both staircases (place, level) with them. Steps up to ``base`` say nothing and go."""
    stairs = Staircase()
    for place, level in sorted(by_j):
        if level > base:
            stairs.enter(place, level)
    entered = sorted(by_i)
    levels: list[int] = []
    at, best = 0, base
    for i, row in groupby(points, key=lambda p: p[0]):
        while at < len(entered) and entered[at][0] < i:
            best = max(best, entered[at][1])
            at += 1
        own = [(j, 1 + max(best, stairs.up_to(j - 1) or 0)) for _, j in row]
        # Points of one word of the first list don't follow one another.
        for j, level in own:
            stairs.enter(j, level)
        levels += [level for _, level in own]
    along, highest = [], base
    for place, level in sorted(entered + [(i, level) for (i, _), level in zip(points, levels, strict=True)]):
        if level > highest:
            # Of one place only the highest level stays.
            if along and along[-1][0] == place:
                along.pop()
            along.append((place, level))
            highest = level
    return levels, list(zip(stairs.places, stairs.best, strict=True)), along


def _cell(key: tuple, table: pa.Table) -> pa.Table:
    pair, a, b = (k.as_py() for k in key)
    rows = list(zip(*[table.column(n).to_pylist() for n in NAMES], strict=True))
    top_a, top_b = rows[0][9], rows[0][10]
    of = lambda kind: [r for r in rows if r[3] == kind]
    points = sorted(of(POINT), key=lambda r: (r[4], r[5]))
    base = max((r[6] for r in of(BEFORE)), default=0)
    highest = max([base, *(r[6] for r in of(HIGHEST))])
    out = []

    def send(to_a: int | None, to_b: int | None, kind: int, i: int | None, j: int | None, level: int) -> None:
        if to_a is not None and to_b is not None and to_a <= top_a and to_b <= top_b:
            out.append((pair, to_a, to_b, kind, i, j, level, None, None, top_a, top_b, to_a + to_b))

    if points:
        levels, by_j, by_i = cell_levels([r[4:6] for r in points], [(r[5], r[6]) for r in of(BY_J)], [(r[4], r[6]) for r in of(BY_I)], base)
        highest = max(highest, *levels)
        for r, level in zip(points, levels, strict=True):
            send(a, b, POINT, r[4], r[5], level)
        for j, level in by_j:
            send(points[0][7], b, BY_J, None, j, level)
        for i, level in by_i:
            send(a, points[0][8], BY_I, i, None, level)
    send(a + 1, b, HIGHEST, None, None, highest)
    send(a, b + 1, HIGHEST, None, None, highest)
    send(a + 1, b + 1, BEFORE, None, None, highest)
    columns = list(zip(*out, strict=True)) if out else [[]] * len(NAMES)
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, KINDS, strict=True)], names=NAMES)


def levels(points: DataFrame, tables: Tables, cell: int = CELL) -> tuple[DataFrame, int]:
    """pair_id, i, j, level of points (pair_id, i, j), each of which comes once; and how many ranges the longest first list has."""
    range_of = lambda c: ((F.col(c) - F.pmod(F.col(c), F.lit(cell))) / cell).cast("long")
    placed = points.select(F.col("pair_id").cast("long").alias("pair_id"), F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), range_of("i").alias("a"), range_of("j").alias("b"))
    # A row for each cell: as many as a range has words, over ``cell``.
    cells = placed.select("pair_id", "a", "b").distinct()
    along_a, along_b, all_of = Window.partitionBy("pair_id", "b").orderBy("a"), Window.partitionBy("pair_id", "a").orderBy("b"), Window.partitionBy("pair_id")
    cells = cells.select("*", F.lead("a").over(along_a).alias("up"), F.lead("b").over(along_b).alias("right"), F.max("a").over(all_of).alias("top_a"), F.max("b").over(all_of).alias("top_b"))
    placed = placed.join(cells, ["pair_id", "a", "b"]).withColumns({"kind": F.lit(POINT), "level": F.lit(None).cast("long"), "wave": F.col("a") + F.col("b")})
    placed = tables.settled(placed.select(*NAMES), by="wave")
    last, ranges = placed.agg(F.max("wave"), F.max("a")).first()
    if last is None:
        return points.sparkSession.createDataFrame([], "pair_id long, i long, j long, level long"), 0
    path = f"{tables.folder}/cells-{tables.made}"
    spark = points.sparkSession
    for wave in range(last + 1):
        rows = placed.filter(F.col("wave") == wave)
        if wave:
            rows = rows.unionByName(spark.read.schema(ROW).parquet(path).filter((F.col("wave") == wave) & (F.col("kind") != POINT)))
        made = rows.groupBy("pair_id", "a", "b").applyInArrow(_cell, ROW)
        made.write.mode("append").partitionBy("wave", "kind").parquet(path)
    return spark.read.schema(ROW).parquet(path).filter(F.col("kind") == POINT).select("pair_id", "i", "j", "level"), ranges + 1


def _number(i: str, j: str):
    """A point as one number that grows with i; 0 is no point."""
    return F.shiftleft(F.col(i) + 1, 32) + F.col(j)


def subsequence(points: DataFrame, sizes: DataFrame, cell: int = CELL, unique: bool = False) -> DataFrame:
    """pair_id, i, j, level: of each pair the common subsequence that is found going back from both ends.

    ``sizes``: pair_id, n, m, the words of both lists (under 2^31). ``points`` are read several times. Going back, a match is taken if the last two words are
    equal, else a word of the first list is left out if that costs no level, else one of the second. So a
    point's predecessor is one level lower and lies just before it on the second side, with the largest i, or, where there
    is none, has the least i of all that lie before it, with the largest j. ``unique``: words occur once.
    """
    tables = Tables(points.sparkSession)
    found, ranges = levels(points, tables, cell)
    asked = found.select("pair_id", "i", "j", (F.col("level") - 1).alias("at_level"), F.lit(0).alias("given"))
    given = found.select("pair_id", "i", "j", F.col("level").alias("at_level"), F.lit(1).alias("given"))
    both = asked.unionByName(given)
    # Points that ask come before those of the same place.
    value = F.when(F.col("given") == 1, F.struct((-F.col("i")).alias("minus_i"), F.col("j").alias("j")))
    back = running(both, ["pair_id", "at_level"], "j", peaks={"back": value}, ties=("given", "i"))
    back = back.filter("given = 0").select("pair_id", "i", "j", (F.col("at_level") + 1).alias("level"), (-F.col("back.minus_i")).alias("back_i"), F.col("back.j").alias("back_j"))
    if not unique:
        column = both.withColumn("column", F.col("j") - 1 + F.col("given"))
        near = running(column, ["pair_id", "at_level", "column"], "i", before={"near_i": F.when(F.col("given") == 1, F.col("i"))}, ties=("given",))
        near = near.filter("given = 0").select("pair_id", "i", "j", "near_i")
        back = back.join(near, ["pair_id", "i", "j"]).withColumn("back_j", F.when(F.col("near_i").isNotNull(), F.col("j") - 1).otherwise(F.col("back_j"))).withColumn("back_i", F.coalesce("near_i", "back_i"))
    linked = back.select("pair_id", _number("i", "j").alias("k"), F.col("level").cast("double").alias("score"), F.coalesce(_number("back_i", "back_j"), F.lit(0).cast("long")).alias("back"), ((F.col("i") - F.pmod(F.col("i"), F.lit(cell))) / cell).cast("long").alias("range"))
    linked = tables.settled(linked, by="range")
    # The end is the predecessor of what would follow both lists.
    last_word = F.when(F.col("j") == F.col("m") - 1, F.col("i")).otherwise(F.lit(-1))
    end = F.max(F.struct("level", last_word.alias("near_i"), (-F.col("i")).alias("minus_i"), F.col("j").alias("j")))
    ends = found.join(sizes.select("pair_id", "m"), "pair_id").groupBy("pair_id").agg(end.alias("end"))
    pointers = ends.select("pair_id", (-F.col("end.minus_i")).alias("i"), F.col("end.j").alias("j")).select("pair_id", _number("i", "j").alias("k"))
    members = chains.followed([linked.filter(F.col("range") == r) for r in range(ranges)], pointers, tables)
    low = F.col("k").bitwiseAND(F.lit((1 << 32) - 1))
    return members.select("pair_id", (F.shiftright("k", 32) - 1).alias("i"), low.alias("j"), F.col("score").cast("long").alias("level"))


def aligned(left: DataFrame, right: DataFrame, points: DataFrame, cell: int = CELL, unique: bool = False) -> DataFrame:
    """pair_id, ord, left, right: the places of both lists' words in order, those of the subsequence side by side, others with a null.

    ``left``: pair_id, i, pos and ``right``: pair_id, j, pos, the words' numbers from 0 and places; ``points``: pair_id, i, j of equal words.
    All are read several times. Between two matches the words of the second list come before those of the first.
    """
    sizes = left.groupBy("pair_id").agg((F.max("i") + 1).alias("n")).join(right.groupBy("pair_id").agg((F.max("j") + 1).alias("m")), "pair_id")
    chain = subsequence(points, sizes, cell, unique)
    on_left = left.join(chain, ["pair_id", "i"], "left").select("pair_id", "i", "pos", "j", "level")
    on_right = right.join(chain, ["pair_id", "j"], "left").select("pair_id", "j", "pos", "i", "level")
    # How far the other list is before a word: for the first list's up to the next match, for the second's behind the last one.
    lefts = running(on_left, ["pair_id"], "i", before={"upto": F.col("level")}, after={"next_j": F.col("j")}).join(sizes, "pair_id")
    rights = running(on_right, ["pair_id"], "j", before={"upto": F.col("level"), "last_i": F.col("i")})
    none = F.lit(None).cast("long")
    upto = F.coalesce("upto", F.lit(0))
    gaps = lefts.filter("level is null").select("pair_id", (F.col("i") + F.coalesce("next_j", "m") - upto).alias("ord"), F.col("pos").alias("left"), none.alias("right"))
    gaps = gaps.unionByName(rights.filter("level is null").select("pair_id", (F.coalesce(F.col("last_i") + 1, F.lit(0)) + F.col("j") - upto).alias("ord"), none.alias("left"), F.col("pos").alias("right")))
    matches = chain.join(left.withColumnRenamed("pos", "left"), ["pair_id", "i"]).join(right.withColumnRenamed("pos", "right"), ["pair_id", "j"])
    return gaps.unionByName(matches.select("pair_id", (F.col("i") + F.col("j") - F.col("level") + 1).alias("ord"), "left", "right"))


def _numbered(words: DataFrame, place: str, name: str) -> DataFrame:
    """``words`` plus their numbers from 0 by ``place``."""
    counted = running(words, ["pair_id"], place, sums={"_upto": F.lit(1).cast("long")})
    return counted.withColumn(name, F.col("_upto") - 1).drop("_upto")


def _places(pairs: DataFrame, side: str, k: int) -> DataFrame:
    found = kmers.kmers(pairs.select(F.col("pair_id").cast("long").alias("pair_id"), F.col(side).cast("string").alias("seq")), k, "pair_id", "seq")
    return found.select(F.col("seq_id").alias("pair_id"), F.col("kmer").alias("word"), F.col("pos").cast("long").alias("pos"))


def _shared(first: DataFrame, second: DataFrame, most: int) -> DataFrame:
    """pair_id, word, x, y: words that occur ``most`` times at most on either side, and where first."""

    def rare(found: DataFrame, name: str) -> DataFrame:
        return found.groupBy("pair_id", "word").agg(F.count("*").alias("n"), F.min("pos").alias(name)).filter(F.col("n") <= most).drop("n")

    return rare(first, "x").join(rare(second, "y"), ["pair_id", "word"])


def _unique_points(both: DataFrame, tables: Tables) -> DataFrame:
    return tables.settled(_numbered(_numbered(both.drop("word"), "x", "i"), "y", "j"))


def lengths(pairs: DataFrame, k: int = 10, cell: int = CELL) -> DataFrame:
    """pair_id, shared, matched: k-mers that occur once on both sides, and how many of them a longest common subsequence has."""
    tables = Tables(pairs.sparkSession)
    both = tables.settled(_shared(_places(pairs, "first", k), _places(pairs, "second", k), 1))
    found, _ = levels(_unique_points(both, tables), tables, cell)
    return found.groupBy("pair_id").agg(F.count("*").alias("shared"), F.max("level").alias("matched"))


def align_kmers(pairs: DataFrame, k: int = 10, most: int = 1, cell: int = CELL) -> DataFrame:
    """pair_id, ord, left, right: shared k-mers that occur ``most`` times at most on either side, in a longest common subsequence, gaps as nulls.

    pair_ids are distinct; null sequences are empty; pairs that share no such k-mer give no rows.
    """
    tables = Tables(pairs.sparkSession)
    first, second = _places(pairs, "first", k), _places(pairs, "second", k)
    both = tables.settled(_shared(first, second, most))
    if most == 1:
        points = _unique_points(both, tables)
        left, right = points.select("pair_id", "i", F.col("x").alias("pos")), points.select("pair_id", "j", F.col("y").alias("pos"))
    else:
        shared = both.select("pair_id", "word")
        every = lambda found, name: tables.settled(_numbered(tables.settled(found.join(shared, ["pair_id", "word"], "left_semi")), "pos", name))
        left, right = every(first, "i"), every(second, "j")
        points = tables.settled(left.drop("pos").join(right.drop("pos"), ["pair_id", "word"]).select("pair_id", "i", "j"))
    return aligned(left.select("pair_id", "i", "pos"), right.select("pair_id", "j", "pos"), points.select("pair_id", "i", "j"), cell, unique=most == 1)
