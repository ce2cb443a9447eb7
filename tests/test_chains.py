"""Chains in stripes against the kernel and against all chains."""

import random

import pytest

from strandline.operators import chains, kernels, ranks


def made(rng, n, wide):
    """Distinct anchors with many equal scores and touching ends."""
    return sorted({(rng.randint(0, wide), rng.randint(0, wide), rng.choice([1, 2, 2, 3, 8]), m := rng.choice([1, 1, 2]), m) for _ in range(n)})


def table(spark, by_pair):
    return spark.createDataFrame([(p, *a) for p, anchors in by_pair.items() for a in anchors], "pair_id long, x long, y long, len long, m long, n long")


@pytest.mark.parametrize("stripe", [1, 4, 50_000])
def test_chains_against_the_kernel(spark, stripe):
    rng = random.Random(stripe)
    n = 9 if stripe == 1 else 40
    by_pair = {p: made(rng, rng.randint(1, n), rng.choice([6, 30, 200])) for p in range(14)}
    by_pair[50] = [(0, 0, 5, 1, 1)]
    got: dict = {}
    for r in chains.best_chains(table(spark, by_pair), stripe).orderBy("pair_id", "ord").collect():
        got.setdefault(r.pair_id, []).append((r.ord, (r.x, r.y, r.len, r.m, r.n), r.score))
    for p, anchors in by_pair.items():
        chain, scores = kernels.best_chain(anchors)
        assert got[p] == [(o, anchors[k], scores[k]) for o, k in enumerate(chain)], (p, anchors)


def test_no_anchors(spark):
    none = table(spark, {1: [(0, 0, 1, 1, 1)]}).filter("len > 1")
    assert chains.best_chains(none).count() == chains.best_scores(none).count() == 0


def test_a_staircase_keeps_the_best():
    rng = random.Random(3)
    for _ in range(200):
        stairs, entered = chains.Staircase(), []
        for k in range(rng.randint(1, 30)):
            place, value = rng.randint(0, 9), (float(rng.randint(0, 5)), k)
            stairs.enter(place, value)
            entered.append((place, value))
            for at in range(-1, 11):
                assert stairs.up_to(at) == max((v for p, v in entered if p <= at), default=None)
        assert stairs.places == sorted(set(stairs.places)) and stairs.best == sorted(stairs.best)


def test_many_anchors_of_one_pair(spark):
    """One pair of 30,000 anchors in eight stripes: each task holds a stripe and a staircase."""
    rng = random.Random(5)
    anchors = sorted({(x := rng.randint(0, 10**6), x + rng.randint(-300, 300) + 300, rng.randint(5, 40), 1, 1) for _ in range(30_000)})
    assert len(anchors) > 29_000
    score, = [r.score for r in chains.best_scores(table(spark, {7: anchors}), 4000).collect()]
    assert score == max(kernels.best_chain(anchors)[1])


def test_index_and_chains_give_the_primary_chain(spark):
    """From texts to chains as rows alone."""
    from pyspark.sql import functions as F

    from strandline.operators import suffix

    rng = random.Random(6)
    core = "".join(rng.choices("ACGT", k=200))
    rows = [(1, core, core[:90] + "GATTACA" + core[70:]), (2, core[:50], "TTT"), (3, "", core)]
    pairs = spark.createDataFrame(rows, "pair_id long, first string, second string")
    sizes = pairs.select("pair_id", F.length("first").alias("n_first"))
    found = suffix.anchor_intervals(suffix.rare_matches(ranks.ranked_suffixes(pairs), sizes), sizes)
    got: dict = {}
    for r in chains.best_chains(suffix.anchors(found)).orderBy("pair_id", "ord").collect():
        got.setdefault(r.pair_id, []).append((r.x, r.y, r.len, r.m, r.n))
    for p, a, b in rows:
        anchors = kernels.anchors_of(kernels.match_intervals(a, b))
        assert got.get(p, []) == [anchors[k] for k in kernels.best_chain(anchors)[0]]
