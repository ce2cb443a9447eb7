"""Common subsequences in cells against the kernel, which holds whole pairs."""

import random
from bisect import bisect_left

import pytest

from strandline.operators import kernels, lcs


def by_pair(df):
    out: dict = {}
    for r in df.orderBy("pair_id", "ord").collect():
        assert r.ord == len(out.setdefault(r.pair_id, [])), r
        out[r.pair_id].append((r.left, r.right))
    return out


def related(rng, n, letters):
    a = "".join(rng.choice(letters) for _ in range(n))
    pieces = [a[p : p + 15] for p in range(0, n, 15)]
    for _ in range(rng.randint(0, 4)):
        p, q = rng.randrange(len(pieces)), rng.randrange(len(pieces))
        pieces[p], pieces[q] = pieces[q], pieces[p]
    return a, "".join(c for c in "".join(pieces) if rng.random() > 0.03)


@pytest.mark.parametrize(("k", "most", "cell"), [(4, 1, 17), (4, 1, 50_000), (3, 3, 25), (2, 2, 50_000)])
def test_kmers_against_the_kernel(spark, k, most, cell):
    rng = random.Random(k * most)
    pairs = {p: related(rng, rng.randint(20, 120), "acgt" if p % 2 else "acgtmnopq") for p in range(8)}
    pairs |= {20: (None, "acgt"), 21: ("", ""), 22: ("acgtacca", "acgtacca"), 23: ("acg", "gtt")}
    got = by_pair(lcs.align_kmers(spark.createDataFrame([(p, *ab) for p, ab in pairs.items()], "pair_id long, first string, second string"), k, most, cell))
    wanted = {p: kernels.align_kmers(a or "", b or "", k, most) for p, (a, b) in pairs.items()}
    assert got == {p: rows for p, rows in wanted.items() if rows}


def test_levels_of_a_long_pair(spark):
    """Forty cells; in cells without points only the highest level is handed on."""
    rng = random.Random(5)
    order = list(range(4000))
    for _ in range(300):
        p = rng.randrange(3990)
        order[p : p + 9] = order[p : p + 9][::-1]
    order = order[3000:] + order[:3000]
    points = spark.createDataFrame([(1, i, j) for i, j in enumerate(order)], "pair_id long, i long, j long")
    tables = lcs.Tables(spark)
    got = {r.i: r.level for r in lcs.levels(points, tables, 700)[0].collect()}
    tails: list = []
    for i, j in enumerate(order):
        k = bisect_left(tails, j)
        tails[k : k + 1] = [j]
        assert got[i] == k + 1


def test_a_cell_alone():
    rng = random.Random(8)
    for _ in range(200):
        points = sorted({(rng.randint(0, 12), rng.randint(0, 12)) for _ in range(rng.randint(1, 30))})
        level: dict = {}
        for i, j in points:
            level[i, j] = 1 + max((v for (x, y), v in level.items() if x < i and y < j), default=0)
        cut = rng.randint(0, 12)
        # What lies before the cell on the first side comes by j, on the second by i.
        below = [p for p in points if p[0] < cut]
        inside = [p for p in points if p[0] >= cut]
        levels, by_j, _ = lcs.cell_levels(inside, [(j, level[i, j]) for i, j in below], [], 0)
        assert levels == [level[p] for p in inside]
        for j in range(14):
            assert max((v for place, v in by_j if place <= j), default=0) == max((v for (_, y), v in level.items() if y <= j), default=0)
        rows = [p for p in points if p[1] >= cut]
        levels, _, by_i = lcs.cell_levels(rows, [], [(i, level[i, j]) for i, j in points if j < cut], 0)
        assert levels == [level[p] for p in rows]
        for i in range(14):
            assert max((v for place, v in by_i if place <= i), default=0) == max((v for (x, _), v in level.items() if x <= i), default=0)
