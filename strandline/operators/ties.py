"""All best chains at once: how many lead to an anchor and on from it, in stripes as in ``chains``.

Of an anchor's predecessors all those count that give it its best score, whatever their
own is (sums are compared as they are rounded). A stripe's task adds up ways by a tree over the
ends of the second side for each score; it hands on the ends that no better one shadows. On the
way back, levels of equal score are taken from the highest down: what leads on from an anchor is
a sum over later ones that it is a predecessor of. Counts are exact, of any size.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import Tables
from .chains import ANCHOR, HANDED_ON, SCORED, STRIPE, Staircase, numbered

STEP = "pair_id long, kind int, k long, x long, y long, x_end long, y_end long, weight double, score double, ways string, earlier double"
STEP_NAMES = [f.split(" ")[0] for f in STEP.split(", ")]
STEP_KINDS = [pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.float64(), pa.float64(), pa.string(), pa.float64()]
#: Scores this far below the best may give the same sum with a weight by rounding (far more than they need).
ROUNDING = 1e-3


class Sums:
    """Sums of values by place up to a place, for places known beforehand: a tree that holds only what was entered."""

    def __init__(self, places: list[int]):
        self.places = places
        self.tree: dict[int, int] = {}

    def add(self, place: int, value: int) -> None:
        k = bisect_left(self.places, place) + 1
        while k <= len(self.places):
            self.tree[k] = self.tree.get(k, 0) + value
            k += k & -k

    def up_to(self, place: int) -> int:
        k, out = bisect_right(self.places, place), 0
        while k:
            out += self.tree.get(k, 0)
            k -= k & -k
        return out


def levels_that_give(levels: list[float], score: float, weight: float) -> list[float]:
    """Those of the sorted ``levels`` that are ``score`` when ``weight`` is added."""
    k = bisect_right(levels, score - weight + ROUNDING)
    out = []
    while k and levels[k - 1] >= score - weight - ROUNDING:
        k -= 1
        if levels[k] + weight == score:
            out.append(levels[k])
    return out


def ways_to(anchors: list[tuple], handed: list[tuple]) -> tuple[list[tuple], list[tuple]]:
    """Rows (k, x, y, x_end, y_end, weight, score, ways, earlier) of a stripe's anchors (k, x, y, len, m, n), and those to hand on.

    ``earlier`` is the best score of all stripes before.
    """
    places = sorted({y + size for _, _, y, size, _, _ in anchors} | {h[4] for h in handed})
    stairs, levels = Staircase(), []
    by_level: dict[float, Sums] = {}
    open_: dict[tuple[int, float], int] = defaultdict(int)
    waiting = [(h[3], h[4], h[6], h[7]) for h in handed]
    earlier = max((h[6] for h in handed), default=0.0)
    heapify(waiting)
    out = []
    for k, x, y, size, m, n in anchors:
        while waiting and waiting[0][0] <= x:
            _, y_end, score, ways = heappop(waiting)
            stairs.enter(y_end, (score, 0))
            if score not in by_level:
                insort(levels, score)
                by_level[score] = Sums(places)
            by_level[score].add(y_end, ways)
            open_[y_end, score] += ways
        best = stairs.up_to(y)
        weight = size / (m * n)
        score = best[0] + weight if best else weight
        ways = sum(by_level[v].up_to(y) for v in levels_that_give(levels, score, weight)) if best else 1
        out.append((k, x, y, x + size, y + size, weight, score, ways, earlier))
        heappush(waiting, (x + size, y + size, score, ways))
    stay = [(0, 0, 0, 0, y_end, 0.0, score, ways, 0.0) for (y_end, score), ways in open_.items() if score >= stairs.up_to(y_end)[0] - ROUNDING]
    return out, stay + [(0, 0, 0, x_end, y_end, 0.0, score, ways, 0.0) for x_end, y_end, score, ways in waiting]


def ways_onward(own: list[tuple], later: list[tuple], top: float) -> tuple[list[tuple], list[tuple]]:
    """(k, ways on from it: 0 off all best chains) of a stripe's rows of ``ways_to``, and the rows to hand on, with such ways.

    ``later`` has rows of anchors behind the stripe that are on best chains, ``top`` is the pair's best score.
    """
    levels = sorted({r[6] for r in own})
    of_level: dict[float, list[tuple]] = defaultdict(list)
    for r in own:
        of_level[r[6]].append(r)
    after: dict[float, list[tuple]] = defaultdict(list)

    def leads_on(r: tuple) -> None:
        for v in levels_that_give(levels, r[6], r[5]):
            after[v].append(r)

    for r in later:
        leads_on(r)
    found, reached = [], list(later)
    for v in reversed(levels):
        # Places from the right and from above: those with x and y at least as large come first.
        behind = sorted(after.pop(v, []), key=lambda r: -r[1])
        sums = Sums(sorted({-r[2] for r in behind}))
        at = 0
        for r in sorted(of_level[v], key=lambda r: -r[3]):
            while at < len(behind) and behind[at][1] >= r[3]:
                sums.add(-behind[at][2], behind[at][7])
                at += 1
            ways = sums.up_to(-r[4]) or int(v == top)
            found.append((r[0], ways))
            if ways:
                row = (*r[:7], ways, r[8])
                reached.append(row)
                leads_on(row)
    # Those that an earlier anchor may be a predecessor of.
    earlier = own[0][8]
    return found, [r for r in reached if r[6] - r[5] <= earlier + ROUNDING] if earlier else []


def _table(pair: int, rows: list[tuple[int, tuple]]) -> pa.Table:
    columns = list(zip(*[(pair, kind, *r[:7], str(r[7]), r[8]) for kind, r in rows], strict=True)) if rows else [[]] * len(STEP_NAMES)
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, STEP_KINDS, strict=True)], names=STEP_NAMES)


def _rows(table: pa.Table) -> list[tuple]:
    values = [table.column(n).to_pylist() for n in STEP_NAMES[2:]]
    values[7] = list(map(int, values[7]))
    return list(zip(*values, strict=True))


def _forward(key: tuple, anchors: pa.Table, handed: pa.Table) -> pa.Table:
    if not anchors.num_rows:
        return _table(key[0].as_py(), [])
    anchors = anchors.sort_by("k")
    own = list(zip(*[anchors.column(n).to_pylist() for n in ("k", *ANCHOR)], strict=True))
    scored, stay = ways_to(own, _rows(handed))
    return _table(key[0].as_py(), [(SCORED, r) for r in scored] + [(HANDED_ON, r) for r in stay])


def _backward(key: tuple, scored: pa.Table, later: pa.Table) -> pa.Table:
    if not scored.num_rows:
        # The pair has anchors in earlier stripes only, or none.
        return _table(key[0].as_py(), [])
    found, stay = ways_onward(_rows(scored.select(STEP_NAMES)), _rows(later), scored.column("top")[0].as_py())
    return _table(key[0].as_py(), [(SCORED, (k, 0, 0, 0, 0, 0.0, 0.0, ways, 0.0)) for k, ways in found] + [(HANDED_ON, r) for r in stay])


def path_counts(anchors: DataFrame, stripe: int = STRIPE) -> DataFrame:
    """pair_id, start_1, start_2, len, n_opt_paths_fwd, n_opt_paths_rev, n_count, m_count for every anchor.

    Best chains that lead to the anchor, and that lead on from it, as decimals of any length; 0 off all best chains.
    """
    spark = anchors.sparkSession
    tables = Tables(spark)
    # Numbering looks at the anchors twice.
    placed = tables.settled(numbered(tables.settled(anchors.select("pair_id", *ANCHOR)), stripe), by="stripe")
    most = placed.agg(F.max("stripe")).first()[0]
    none = spark.createDataFrame([], STEP)
    handed, by_stripe = none, []
    for s in range(-1 if most is None else most + 1):
        made = tables.settled(placed.filter(F.col("stripe") == s).groupBy("pair_id").cogroup(handed.groupBy("pair_id")).applyInArrow(_forward, STEP), by="kind")
        by_stripe.append(made.filter(F.col("kind") == SCORED))
        handed = made.filter(F.col("kind") == HANDED_ON)
    to = none
    for scored in by_stripe:
        to = to.unionByName(scored)
    top = to.groupBy("pair_id").agg(F.max("score").alias("top"))
    handed, onward = none, none
    for scored in reversed(by_stripe):
        made = tables.settled(scored.join(top, "pair_id").groupBy("pair_id").cogroup(handed.groupBy("pair_id")).applyInArrow(_backward, STEP), by="kind")
        onward = onward.unionByName(made.filter(F.col("kind") == SCORED))
        handed = made.filter(F.col("kind") == HANDED_ON)
    both = placed.join(to.select("pair_id", "k", F.col("ways").alias("to")), ["pair_id", "k"]).join(onward.select("pair_id", "k", F.col("ways").alias("onward")), ["pair_id", "k"])
    to_all = F.when(F.col("onward") == "0", F.lit("0")).otherwise(F.col("to"))
    return both.select("pair_id", F.col("x").alias("start_1"), F.col("y").alias("start_2"), "len", to_all.alias("n_opt_paths_fwd"), F.col("onward").alias("n_opt_paths_rev"), F.col("m").cast("long").alias("n_count"), F.col("n").cast("long").alias("m_count"))
