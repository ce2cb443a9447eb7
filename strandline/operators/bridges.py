"""Steps that all tours of the best chains need: bridges of their graph, in stripes as in ``chains``, without its edges.

The graph has an edge from each anchor on a best chain to each of its tied predecessors, and
one from a common source to each that begins a chain. Every anchor hangs on its last best
predecessor, which makes a tree that nobody has to search for. Four passes over the stripes:

1. forward, ``chains.scores``: scores, and where each anchor hangs;
2. back: which anchors are on best chains, how many hang below each, and so the distance of its
   number from that of the anchor it hangs on, in an order where what hangs below has neighbouring numbers;
3. forward: the numbers, and the least and largest number among each anchor's predecessors;
4. back: the same of its successors, and the extremes of all that hangs below. A step of the tree is a
   bridge if its anchor has one predecessor and nothing below it has a neighbour outside.

Ties can be far more than anchors (all of one column with all of the next); they are only
ever looked at as ranges of a tree over ends, so a task holds its stripe and what is handed on.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Callable, Iterable
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import Tables
from .chains import HANDED_ON, SCORED, STRIPE, Staircase, scores
from .ties import ROUNDING, levels_that_give

#: A member of the graph: its anchor and score, where it hangs, and what the passes find; 0 in what isn't known yet.
NODE = ["k", "x", "y", "x_end", "y_end", "weight", "score", "parent", "offset", "size", "number", "low", "high"]
REALS = {"weight", "score"}
STEP = "pair_id long, kind int, " + ", ".join(f"{c} {'double' if c in REALS else 'long'}" for c in NODE)
STEP_NAMES = ["pair_id", "kind", *NODE]
STEP_KINDS = [pa.int64(), pa.int32(), *[pa.float64() if c in REALS else pa.int64() for c in NODE]]
EMPTY = dict.fromkeys(NODE, 0)
Range = tuple[int, int] | None


def joined(ranges: Iterable[Range]) -> Range:
    """The least and the largest of all ranges; none of none."""
    found = [r for r in ranges if r]
    return (min(r[0] for r in found), max(r[1] for r in found)) if found else None


class Extremes:
    """Ranges of values by place up to a place, for places known beforehand: a tree that holds only what was entered."""

    def __init__(self, places: list[int]):
        self.places = places
        self.tree: dict[int, tuple[int, int]] = {}

    def add(self, place: int, low: int, high: int) -> None:
        k = bisect_left(self.places, place) + 1
        while k <= len(self.places):
            was = self.tree.get(k)
            self.tree[k] = (min(was[0], low), max(was[1], high)) if was else (low, high)
            k += k & -k

    def up_to(self, place: int) -> Range:
        k, found = bisect_right(self.places, place), []
        while k:
            found.append(self.tree.get(k))
            k -= k & -k
        return joined(found)


def by_level_down(own: list[dict], later: list[dict], visit: Callable[[dict, list[dict]], None]) -> None:
    """Levels of equal score from the highest down: ``visit(level, behind)`` gives those of a level that go on being looked at.

    ``behind`` has the nodes that those of the level may be predecessors of, by score, from the
    right; ``later`` are such nodes of other stripes.
    """
    levels = sorted({r["score"] for r in own})
    of_level: dict[float, list[dict]] = defaultdict(list)
    for r in own:
        of_level[r["score"]].append(r)
    after: dict[float, list[dict]] = defaultdict(list)

    def leads_on(rows: Iterable[dict]) -> None:
        for r in rows:
            for v in levels_that_give(levels, r["score"], r["weight"]):
                after[v].append(r)

    leads_on(later)
    for v in reversed(levels):
        behind = sorted(after.pop(v, []), key=lambda r: -r["x"])
        leads_on(visit(sorted(of_level[v], key=lambda r: -r["x_end"]), behind))


def _to_earlier(rows: list[dict], earlier: float | None) -> list[dict]:
    """Those that anchors of earlier stripes may be predecessors of."""
    return [] if earlier is None else [r for r in rows if r["score"] - r["weight"] <= earlier + ROUNDING]


def members(own: list[dict], handed: list[dict], top: float, earlier: float | None) -> tuple[list[dict], list[dict]]:
    """Those of a stripe's scored anchors that are on best chains, with ``offset`` and ``size``, and what to hand back.

    ``handed`` has members behind the stripe (x, y, weight, score) and, with k below 0, how many
    hang below the anchor -k - 1 so far (0: the source).
    """
    below: dict[int, int] = defaultdict(int, {-r["k"] - 1: r["size"] for r in handed if r["k"] < 0})
    later = [r for r in handed if r["k"] >= 0]
    found: list[dict] = []

    def visit(level: list[dict], behind: list[dict]) -> list[dict]:
        here, at, farthest = [], 0, -1
        for r in level:
            while at < len(behind) and behind[at]["x"] >= r["x_end"]:
                farthest = max(farthest, behind[at]["y"])
                at += 1
            if farthest >= r["y_end"] or r["score"] == top:
                size = 1 + below.pop(r["k"], 0)
                here.append({**r, "offset": 1 + below[r["parent"]], "size": size})
                below[r["parent"]] += size
        found.extend(here)
        return here

    by_level_down(own, later, visit)
    return found, _to_earlier([*later, *found], earlier) + [{**EMPTY, "k": -k - 1, "size": n} for k, n in below.items()]


def numbered(own: list[dict], handed: list[dict]) -> tuple[list[dict], list[dict]]:
    """A stripe's members, in their order, with ``number`` and the range of their predecessors' (0, the source: none), and what to hand on.

    ``handed`` has members that end behind the stripe's begin; with x_end -1, steps of the
    staircase; with x_end -2, ranges of what has ended, by end and score.
    """
    places = sorted({r["y_end"] for r in own} | {r["y_end"] for r in handed})
    stairs, levels = Staircase(), []
    by_level: dict[float, Extremes] = {}
    ended: dict[tuple[int, float], tuple[int, int]] = {}
    number: dict[int, int] = {}

    def end(y_end: int, score: float, low: int, high: int) -> None:
        if score not in by_level:
            insort(levels, score)
            by_level[score] = Extremes(places)
        by_level[score].add(y_end, low, high)
        ended[y_end, score] = joined([ended.get((y_end, score)), (low, high)])

    waiting: list[tuple] = []
    for r in handed:
        if r["x_end"] == -2:
            end(r["y_end"], r["score"], r["low"], r["high"])
            continue
        number[r["k"]] = r["number"]
        if r["x_end"] == -1:
            stairs.enter(r["y_end"], (r["score"], r["k"]))
        else:
            waiting.append((r["x_end"], r["k"], r["y_end"], r["score"]))
    heapify(waiting)
    out = []
    for r in own:
        while waiting and waiting[0][0] <= r["x"]:
            _, k, y_end, score = heappop(waiting)
            stairs.enter(y_end, (score, k))
            end(y_end, score, number[k], number[k])
        here = number.get(r["parent"], 0) + r["offset"]
        before = joined(by_level[v].up_to(r["y"]) for v in levels_that_give(levels, r["score"], r["weight"])) if r["parent"] else None
        number[r["k"]] = here
        low, high = before or (0, 0)
        out.append({**r, "number": here, "low": low, "high": high})
        heappush(waiting, (r["x_end"], r["k"], r["y_end"], r["score"]))
    steps = [{**EMPTY, "k": k, "x_end": -1, "y_end": place, "score": score, "number": number[k]} for place, (score, k) in zip(stairs.places, stairs.best, strict=True)]
    ranges = [{**EMPTY, "x_end": -2, "y_end": y, "score": v, "low": a, "high": b} for (y, v), (a, b) in ended.items() if v >= stairs.up_to(y)[0] - ROUNDING]
    return out, steps + ranges + [{**EMPTY, "k": k, "x_end": x_end, "y_end": y_end, "score": score, "number": number[k]} for x_end, k, y_end, score in waiting]


def bridging(own: list[dict], handed: list[dict], earlier: float | None) -> tuple[list[dict], list[dict]]:
    """Those of a stripe's numbered members whose step from ``parent`` is a bridge, and what to hand back.

    ``handed`` has members behind the stripe and, with k below 0, the range of all neighbours of
    what hangs below the anchor -k - 1.
    """
    below = {-r["k"] - 1: (r["low"], r["high"]) for r in handed if r["k"] < 0}
    later = [r for r in handed if r["k"] >= 0]
    found: list[dict] = []

    def visit(level: list[dict], behind: list[dict]) -> list[dict]:
        # Places from above: those with y at least as large come first.
        places, at = Extremes(sorted({-r["y"] for r in behind})), 0
        for r in level:
            while at < len(behind) and behind[at]["x"] >= r["x_end"]:
                places.add(-behind[at]["y"], behind[at]["number"], behind[at]["number"])
                at += 1
            inner = joined([places.up_to(-r["y_end"]), below.pop(r["k"], None)])
            if r["low"] == r["high"] and (not inner or (inner[0] >= r["number"] and inner[1] < r["number"] + r["size"])):
                found.append(r)
            if r["parent"]:
                below[r["parent"]] = joined([below.get(r["parent"]), inner, (r["low"], r["high"])])
        return level

    by_level_down(own, later, visit)
    return found, _to_earlier([*later, *own], earlier) + [{**EMPTY, "k": -k - 1, "low": a, "high": b} for k, (a, b) in below.items()]


def _table(pair: int, found: list[dict], handed: list[dict]) -> pa.Table:
    rows = [(SCORED, r) for r in found] + [(HANDED_ON, r) for r in handed]
    columns = [[pair] * len(rows), [kind for kind, _ in rows], *[[r[c] for _, r in rows] for c in NODE]]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, STEP_KINDS, strict=True)], names=STEP_NAMES)


def _rows(table: pa.Table) -> list[dict]:
    return table.select(NODE).to_pylist()


def _members(key: tuple, scored: pa.Table, handed: pa.Table) -> pa.Table:
    # A pair without rows here has anchors in earlier stripes only.
    found = members(_rows(scored), _rows(handed), scored.column("top")[0].as_py(), scored.column("earlier")[0].as_py()) if scored.num_rows else ([], [])
    return _table(key[0].as_py(), *found)


def _numbered(key: tuple, own: pa.Table, handed: pa.Table) -> pa.Table:
    return _table(key[0].as_py(), *numbered(_rows(own.sort_by("k")), _rows(handed)))


def _bridging(key: tuple, own: pa.Table, handed: pa.Table) -> pa.Table:
    rows = own.select([*NODE, "earlier"]).to_pylist()
    kept = [r for r in rows if r["k"]]
    found, handed_on = bridging([{c: r[c] for c in NODE} for r in kept], _rows(handed), rows[0]["earlier"] if rows else None)
    return _table(key[0].as_py(), found, handed_on)


def bridges(anchors: DataFrame, stripe: int = STRIPE) -> DataFrame:
    """pair_id, start_1, start_2, end_1, end_2: from the end of the left anchor (or the origin) to the start of the right.

    Anchors (pair_id, x, y, len, m, n) are distinct. Pairs without anchors have no rows.
    """
    spark = anchors.sparkSession
    tables = Tables(spark)
    placed, by_stripe = scores(anchors, tables, stripe)
    none = spark.createDataFrame([], STEP)
    # One row a stripe of a pair: the best score before it, and that of the whole pair.
    best = spark.createDataFrame([], "pair_id long, stripe long, best double")
    for s, scored in enumerate(by_stripe):
        best = best.unionByName(scored.groupBy("pair_id").agg(F.max("score").alias("best")).select("pair_id", F.lit(s).cast("long").alias("stripe"), "best"))
    of_pair = Window.partitionBy("pair_id")
    before = of_pair.orderBy("stripe").rowsBetween(Window.unboundedPreceding, -1)
    best = tables.settled(best.select("pair_id", "stripe", F.max("best").over(before).alias("earlier"), F.max("best").over(of_pair).alias("top")))

    def stripe_of(s: int) -> DataFrame:
        return best.filter(F.col("stripe") == s).drop("stripe")

    def passed(own: DataFrame, handed: DataFrame, step: Callable) -> tuple[DataFrame, DataFrame]:
        made = tables.settled(own.groupBy("pair_id").cogroup(handed.groupBy("pair_id")).applyInArrow(step, STEP), by="kind")
        return made.filter(F.col("kind") == SCORED), made.filter(F.col("kind") == HANDED_ON)

    own, handed = [none] * len(by_stripe), none
    for s in reversed(range(len(by_stripe))):
        rows = placed.filter(F.col("stripe") == s).join(by_stripe[s].select("pair_id", "k", "x_end", "y_end", "score", F.col("back").alias("parent")), ["pair_id", "k"])
        rows = rows.withColumns({"weight": F.col("len") / (F.col("m") * F.col("n")), **{c: F.lit(0) for c in NODE[8:]}}).select("pair_id", *[F.col(c).cast("double" if c in REALS else "long").alias(c) for c in NODE])
        own[s], handed = passed(rows.join(stripe_of(s), "pair_id"), handed, _members)
    handed = none
    for s in range(len(by_stripe)):
        own[s], handed = passed(own[s], handed, _numbered)
    found, handed = none, none
    for s in reversed(range(len(by_stripe))):
        # A row for the stripe itself, as none of its anchors need be on a best chain.
        rows = stripe_of(s).join(own[s], "pair_id", "left").na.fill(0, NODE)
        bridging_here, handed = passed(rows, handed, _bridging)
        found = found.unionByName(bridging_here)
    left = placed.select("pair_id", F.col("k").alias("parent"), (F.col("x") + F.col("len")).alias("start_1"), (F.col("y") + F.col("len")).alias("start_2"))
    found = found.select("pair_id", "parent", F.col("x").alias("end_1"), F.col("y").alias("end_2")).join(left, ["pair_id", "parent"], "left")
    return found.select("pair_id", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("start_1", "start_2")], "end_1", "end_2")
