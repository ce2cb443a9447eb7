"""Bridges in stripes against the kernel and against the loss of every edge in turn."""

import random

import pytest

from strandline.operators import align, bridges, kernels

from .test_chains import made, table


def by_removal(anchors):
    """Edges of the graph of best chains without which it falls apart."""
    preds, ends = kernels.tied_chains(anchors)
    inside = kernels.optimal_subgraph(preds, ends)
    edges = {(p, k) for k in inside for p in preds[k] or [-1]}

    def whole(kept):
        seen, stack = {-1}, [-1]
        while stack:
            v = stack.pop()
            for a, b in kept:
                for w in ({a, b} - {v} if v in (a, b) else ()):
                    if w not in seen:
                        seen.add(w)
                        stack.append(w)
        return len(seen) == len(inside) + 1

    assert whole(edges)
    return kernels.bridge_coordinates(anchors, [e for e in edges if not whole(edges - {e})])


def grid(rng, n, wide):
    """Anchors of one length: they tie all the time."""
    return sorted({(2 * rng.randint(0, wide), 2 * rng.randint(0, wide), 2, 1, 1) for _ in range(n)})


def got_of(spark, by_pair, stripe):
    got: dict = {p: [] for p in by_pair}
    for r in bridges.bridges(table(spark, by_pair), stripe).collect():
        got[r.pair_id].append((r.start_1, r.start_2, r.end_1, r.end_2))
    return {p: sorted(v) for p, v in got.items()}


@pytest.mark.parametrize("stripe", [1, 5, 50_000])
def test_bridges_against_the_kernel_and_removal(spark, stripe):
    rng = random.Random(stripe + 3)
    n = 8 if stripe == 1 else 40
    by_pair = {p: made(rng, rng.randint(1, n), rng.choice([5, 20, 120])) for p in range(20)}
    by_pair |= {p: grid(rng, n, rng.choice([3, 7, 15])) for p in range(20, 50)}
    by_pair[90] = [(0, 0, 5, 1, 1)]
    got = got_of(spark, by_pair, stripe)
    for p, anchors in by_pair.items():
        want = kernels.bridge_coordinates(anchors, kernels.chain_bridges(*kernels.tied_chains(anchors)))
        assert got[p] == want == by_removal(anchors), (p, anchors)
    # Graphs with and without bridges, and with more anchors than bridges.
    assert any(not b for b in got.values()) and any(len(b) > 1 for b in got.values())


def test_a_million_ties(spark):
    """A hundred columns of a hundred anchors, each tied with all of the next: 990,000 edges that are never made."""
    column = [(10 * c, 10 * c, r) for c in range(1, 100) for r in range(100)]
    anchors = sorted((1000 * c + r, 1000 * c + 99 - r, 1, 1, 1) for c, _, r in [(c // 10, 0, r) for c, _, r in column])
    narrow = [(c * 1000 + 500, c * 1000 + 500, 1, 1, 1) for c in (40, 60)]
    anchors = sorted([a for a in anchors if a[0] // 1000 not in (40, 60)] + narrow)
    got = got_of(spark, {3: anchors}, 3000)[3]
    # Columns of a hundred around a single anchor are tied to it by a hundred edges each: no bridges.
    assert got == []
    # Two single anchors side by side: the step between them.
    close = sorted([a for a in anchors if a[0] // 1000 != 41] + [(41_500, 41_500, 1, 1, 1)])
    assert got_of(spark, {3: close}, 3000)[3] == [(40_501, 40_501, 41_500, 41_500)]


def test_long_pairs_go_by_rows(spark):
    """Pairs over the limit give the same counts and bridges as those under it."""
    rng = random.Random(9)
    core = "".join(rng.choices("ACGT", k=300))
    rows = [(1, core, core[:200] + "GATTACA" + core[120:]), (2, core[:40], core[10:60]), (3, None, "AC")]
    pairs = spark.createDataFrame(rows, "pair_id long, first string, second string")
    for operator in (align.path_counts, align.bridges):
        whole, by_rows = (sorted(map(tuple, operator(pairs, leaf=leaf).collect())) for leaf in (10**6, 200))
        assert whole == by_rows and whole


def test_no_anchors(spark):
    none = table(spark, {1: [(0, 0, 1, 1, 1)]}).filter("len > 1")
    assert bridges.bridges(none).count() == 0
