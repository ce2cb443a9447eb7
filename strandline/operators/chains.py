"""Best colinear chains of anchors, pair by pair, in stripes: no pair's anchors are ever in one task.

Anchors (pair_id, x, y, len, m, n) are numbered in their order (x, y, len, m, n) and cut
into stripes of as many along x. A stripe's task gets, from the stripes before, only what
can still matter: of the anchors that end before the stripe's last start, the staircase of
best scores by where they end on the second side, and those that end later. It scores its own
anchors and hands on the same. So there is one round for each stripe of the largest pair, all
pairs side by side, and rows pass through written tables in between. The chain is then
followed back stripe by stripe in the same way.

An anchor's score is len / (m * n) plus the best score of the anchors that end at or before
its start on both sides. Of equal predecessors the last counts, of equal chain ends the first.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import Tables
from .scan import running

ANCHOR = ["x", "y", "len", "m", "n"]
#: Anchors of a stripe.
STRIPE = 50_000
STEP = "pair_id long, kind int, k long, x_end long, y_end long, score double, back long"
STEP_NAMES = [f.split(" ")[0] for f in STEP.split(", ")]
STEP_KINDS = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
SCORED, HANDED_ON = 0, 1


class Staircase:
    """The best (score, number) among ends up to a place on the second side: better ones only, by place."""

    def __init__(self):
        self.places: list[int] = []
        self.best: list[tuple[float, int]] = []

    def enter(self, place: int, value: tuple[float, int]) -> None:
        k = bisect_right(self.places, place)
        if k and self.best[k - 1] >= value:
            return
        k = bisect_left(self.places, place)
        # What ends no earlier and is no better goes.
        last = k
        while last < len(self.places) and self.best[last] <= value:
            last += 1
        self.places[k:last], self.best[k:last] = [place], [value]

    def up_to(self, place: int) -> tuple[float, int] | None:
        k = bisect_right(self.places, place)
        return self.best[k - 1] if k else None


def score_stripe(anchors: list[tuple], handed: list[tuple]) -> tuple[list[tuple], list[tuple]]:
    """Rows (k, x_end, y_end, score, back) of a stripe's anchors (k, x, y, len, m, n), and those to hand on.

    ``handed`` has such rows of earlier stripes; ``back`` is 0 where a chain begins.
    """
    stairs = Staircase()
    waiting = [(x_end, y_end, score, k) for k, x_end, y_end, score, _ in handed]
    heapify(waiting)
    out = []
    for k, x, y, size, m, n in anchors:
        while waiting and waiting[0][0] <= x:
            _, y_end, score, before = heappop(waiting)
            stairs.enter(y_end, (score, before))
        best = stairs.up_to(y)
        own = size / (m * n)
        score = best[0] + own if best else own
        out.append((k, x + size, y + size, score, best[1] if best else 0))
        heappush(waiting, (x + size, y + size, score, k))
    # Steps of the staircase count at any later start: 0 is before all of them.
    stay = [(k, 0, place, score, 0) for place, (score, k) in zip(stairs.places, stairs.best, strict=True)]
    return out, stay + [(k, x_end, y_end, score, 0) for x_end, y_end, score, k in waiting]


def _table(pair: int, scored: list[tuple], handed: list[tuple]) -> pa.Table:
    rows = [(pair, SCORED, *r) for r in scored] + [(pair, HANDED_ON, *r) for r in handed]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(STEP_NAMES)
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, STEP_KINDS, strict=True)], names=STEP_NAMES)


def _rows(table: pa.Table, names: list[str]) -> list[tuple]:
    return list(zip(*[table.column(n).to_pylist() for n in names], strict=True)) if table.num_rows else []


def _scored(key: tuple, anchors: pa.Table, handed: pa.Table) -> pa.Table:
    if not anchors.num_rows:
        return _table(key[0].as_py(), [], [])
    own = _rows(anchors.sort_by("k"), ["k", *ANCHOR])
    return _table(key[0].as_py(), *score_stripe(own, _rows(handed, ["k", "x_end", "y_end", "score", "back"])))


def _walked(key: tuple, scored: pa.Table, pointer: pa.Table) -> pa.Table:
    """Members of the chain in this stripe (SCORED), and where it goes on (HANDED_ON)."""
    if not pointer.num_rows or not scored.num_rows:
        return _table(key[0].as_py(), [], [])
    scored = scored.sort_by("k")
    k, back = scored.column("k").to_numpy(), scored.column("back").to_numpy()
    at, members = pointer.column("k")[0].as_py(), []
    while at >= k[0]:
        place = int(np.searchsorted(k, at))
        members.append((at, 0, 0, scored.column("score")[place].as_py(), int(back[place])))
        at = int(back[place])
    return _table(key[0].as_py(), members, [(at, 0, 0, 0.0, 0)] if at else [])


def numbered(anchors: DataFrame, stripe: int = STRIPE) -> DataFrame:
    """``anchors`` plus k (from 1, in each pair's order) and the stripe that follows from it."""
    found = running(anchors.select("pair_id", *ANCHOR), ["pair_id"], "x", sums={"k": F.lit(1).cast("long")}, ties=("y", "len", "m", "n"))
    return found.withColumn("stripe", ((F.col("k") - 1 - F.pmod(F.col("k") - 1, F.lit(stripe))) / stripe).cast("long"))


def scores(anchors: DataFrame, tables: Tables, stripe: int = STRIPE) -> tuple[DataFrame, list[DataFrame]]:
    """``numbered`` anchors, and for each stripe pair_id, k, score and back (the number of the best predecessor, 0 if there is none)."""
    # Numbering looks at the anchors twice.
    placed = tables.settled(numbered(tables.settled(anchors.select("pair_id", *ANCHOR)), stripe), by="stripe")
    most = placed.agg(F.max("stripe")).first()[0]
    handed = anchors.sparkSession.createDataFrame([], STEP)
    out = []
    for s in range(-1 if most is None else most + 1):
        own = placed.filter(F.col("stripe") == s)
        made = tables.settled(own.groupBy("pair_id").cogroup(handed.groupBy("pair_id")).applyInArrow(_scored, STEP), by="kind")
        out.append(made.filter(F.col("kind") == SCORED))
        handed = made.filter(F.col("kind") == HANDED_ON)
    return placed, out


def followed(by_stripe: list[DataFrame], pointers: DataFrame, tables: Tables) -> DataFrame:
    """Members (pair_id, k, score, back, ...) of the chains that begin at ``pointers`` (pair_id, k) and go by ``back``, to 0, through stripes (pair_id, k, score, back) that follow one another in k."""
    members = pointers.sparkSession.createDataFrame([], STEP)
    pointers = tables.settled(pointers)
    for s in range(len(by_stripe) - 1, -1, -1):
        made = tables.settled(by_stripe[s].groupBy("pair_id").cogroup(pointers.groupBy("pair_id")).applyInArrow(_walked, STEP), by="kind")
        members = members.unionByName(made.filter(F.col("kind") == SCORED))
        if s:
            moved = made.filter(F.col("kind") == HANDED_ON).select("pair_id", "k")
            # Pairs with no part of their chain in this stripe go on as they are.
            met = made.select("pair_id").distinct()
            pointers = tables.settled(moved.unionByName(pointers.join(met, "pair_id", "left_anti")))
    return members


def best_chains(anchors: DataFrame, stripe: int = STRIPE) -> DataFrame:
    """pair_id, ord, x, y, len, m, n, score (of the chain so far): the best chain of each pair."""
    tables = Tables(anchors.sparkSession)
    placed, by_stripe = scores(anchors, tables, stripe)
    members = anchors.sparkSession.createDataFrame([], STEP)
    if by_stripe:
        every = by_stripe[0]
        for more in by_stripe[1:]:
            every = every.unionByName(more)
        first = every.groupBy("pair_id").agg(F.min(F.struct((-F.col("score")).alias("minus"), "k")).alias("end"))
        members = followed(by_stripe, first.select("pair_id", F.col("end.k").alias("k")), tables)
    found = members.select("pair_id", "k", "score").join(placed, ["pair_id", "k"])
    found = running(found, ["pair_id"], "k", sums={"place": F.lit(1).cast("long")})
    return found.select("pair_id", (F.col("place") - 1).alias("ord"), *[F.col(c).cast("long").alias(c) for c in ANCHOR], "score")


def best_scores(anchors: DataFrame, stripe: int = STRIPE) -> DataFrame:
    """pair_id and the score of its best chain."""
    _, by_stripe = scores(anchors, Tables(anchors.sparkSession), stripe)
    out = anchors.sparkSession.createDataFrame([], STEP)
    for scored in by_stripe:
        out = out.unionByName(scored)
    return out.groupBy("pair_id").agg(F.max("score").alias("score"))
