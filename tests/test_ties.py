"""Counts of best chains in stripes against the kernel and against all chains of small sets."""

import random

import pytest

from strandline.operators import kernels, ties

from .test_chains import made, table


def by_enumeration(anchors):
    """Ways to and on from each anchor, by writing down all best chains."""
    w = [n / (a * b) for _, _, n, a, b in anchors]
    before = lambda j, k: anchors[j][0] + anchors[j][2] <= anchors[k][0] and anchors[j][1] + anchors[j][2] <= anchors[k][1]
    chains = [((k,), w[k]) for k in range(len(anchors))]
    every = list(chains)
    while chains:
        chains = [((*c, k), s + w[k]) for c, s in chains for k in range(c[-1] + 1, len(anchors)) if before(c[-1], k)]
        every += chains
    top = max(s for _, s in every)
    best = [c for c, s in every if s == top]
    to = [len({c[: c.index(k) + 1] for c in best if k in c}) for k in range(len(anchors))]
    onward = [len({c[c.index(k) :] for c in best if k in c}) for k in range(len(anchors))]
    return to, onward


@pytest.mark.parametrize("stripe", [1, 5, 50_000])
def test_counts_against_the_kernel(spark, stripe):
    rng = random.Random(stripe + 1)
    n = 9 if stripe == 1 else 45
    by_pair = {p: made(rng, rng.randint(1, n), rng.choice([5, 20, 120])) for p in range(6)}
    # Anchors of one length on a grid tie all the time.
    by_pair |= {p: sorted({(2 * rng.randint(0, 7), 2 * rng.randint(0, 7), 2, 1, 1) for _ in range(n)}) for p in range(6, 12)}
    got = {(r.pair_id, r.start_1, r.start_2, r.len, r.n_count, r.m_count): (int(r.n_opt_paths_fwd), int(r.n_opt_paths_rev)) for r in ties.path_counts(table(spark, by_pair), stripe).collect()}
    assert len(got) == sum(map(len, by_pair.values()))
    many = 0
    for p, anchors in by_pair.items():
        to, onward = kernels.path_counts(*kernels.tied_chains(anchors))
        many += max(to) > 2
        for k, (x, y, size, m, n_) in enumerate(anchors):
            assert got[p, x, y, size, m, n_] == (to[k], onward[k]), (p, anchors)
        if len(anchors) < 12:
            assert by_enumeration(anchors) == (to, onward)
    assert many or stripe == 1, by_pair


def test_counts_of_any_size(spark):
    """Forty steps with two ways each: 2 ** 40 ways and more than a long holds for a hundred."""
    anchors = sorted((10 * k, 10 * k + 3 * side, 2, 1, 1) for k in range(100) for side in (0, 1))
    got = {(r.start_1, r.start_2): (r.n_opt_paths_fwd, r.n_opt_paths_rev) for r in ties.path_counts(table(spark, {1: anchors}), 64).collect()}
    assert got[990, 990] == (str(2**99), "1") and got[0, 0] == ("1", str(2**99))


def test_no_ties(spark):
    assert ties.path_counts(table(spark, {1: [(0, 0, 1, 1, 1)]}).filter("len > 1")).count() == 0
