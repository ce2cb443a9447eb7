"""Suffix ranks, common prefixes and rare matches as rows, against sorting and the kernels."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import kernels, ranks, suffix


def texts(seed=1):
    rng = random.Random(seed)
    make = lambda n, letters: "".join(rng.choices(letters, k=n))
    core = make(150, "ACGT")
    return [
        ("", ""), ("A", ""), ("", "AC"), ("A", "A"), ("AAAAAAA" * 9, "AAAAAAAAAA"), ("ab" * 40, "ba" * 45), (make(60, "AB"), make(70, "AB")), (make(200, "ACGT"), make(180, "ACGT")),
        (core + make(20, "ACGT") + core, make(9, "ACGT") + core), (core, core), ("été😀été日本", "日本été😀"), (make(5, "AC") * 20, make(5, "AC") * 21), (None, "AC"),
    ]


def frame(spark, rows):
    return spark.createDataFrame([(k * 3, a, b) for k, (a, b) in enumerate(rows)], "pair_id long, first string, second string")


def by_sorting(a, b):
    suffixes = sorted([(a[p:], 1, p) for p in range(len(a))] + [(b[p:], 2, p) for p in range(len(b))])
    shared = lambda x, y: next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))  # noqa: B905, E731
    return [(side, p, r, shared(s, suffixes[r + 1][0]) if r + 1 < len(suffixes) else 0) for r, (s, side, p) in enumerate(suffixes)]


@pytest.mark.parametrize("word", [2, 32])
def test_ranks_and_prefixes_against_sorting(spark, word):
    rows = texts()
    got: dict = {}
    for r in ranks.ranked_suffixes(frame(spark, rows), word).collect():
        got.setdefault(r.pair_id, []).append((r.side, r.pos, r.r, r.lcp))
    for k, (a, b) in enumerate(rows):
        assert sorted(got.get(k * 3, []), key=lambda r: r[2]) == by_sorting(a or "", b or ""), (a, b)
    assert ranks.ranked_suffixes(frame(spark, rows).limit(0), word).count() == 0


def test_prefixes_of_any_two_places(spark):
    rows = texts(2)
    rng = random.Random(3)
    places = []
    for k, (a, b) in enumerate(rows):
        for n in range(40):
            sides = rng.choice([(1, 1), (1, 2), (2, 2)])
            at = [rng.randint(0, len((a if s == 1 else b) or "")) for s in sides]
            if (sides[0], at[0]) != (sides[1], at[1]):
                places.append((k * 3, n, sides[0], at[0], sides[1], at[1]))
    index = ranks.suffix_index(frame(spark, rows), 4)
    df = spark.createDataFrame(places, "pair_id long, n int, side_a int, pos_a long, side_b int, pos_b long")
    found = ranks.common_prefixes(index, df).collect()
    assert len(found) == len(places) and len(index.levels) > 3
    for r in found:
        both = rows[r.pair_id // 3]
        x, y = (both[s - 1] or "" for s in (r.side_a, r.side_b))
        x, y = x[r.pos_a :], y[r.pos_b :]
        same = next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))  # noqa: B905
        assert r.lcp == same, r
    index.tables.drop()


def test_long_sequences_spread_over_tasks(spark):
    """A pair of 73 kb with a long repeat equals the kernel; no task ranks the pair."""
    rng = random.Random(6)
    base = "".join(rng.choices("ACGT", k=30_000))
    a, b = base + base[:9000], base[:15_000] + "T" + base[15_000:] + "AC" * 2000
    index = ranks.suffix_index(frame(spark, [(a, b)]))
    got = ranks.ranks_in_pairs(index).toPandas().sort_values("r")
    order = kernels.suffix_order(kernels.codes_of(a, b, 0))[2:]
    side = np.where(order < len(a), 1, 2)
    assert (got.side.to_numpy() == side).all() and (got.pos.to_numpy() == np.where(side == 1, order, order - len(a) - 1)).all()
    assert index.levels[-1][0] >= 8192 and index.ranks.rdd.getNumPartitions() > 4
    index.tables.drop()


def kernel_hits(a, b, max_count, all_widths):
    codes = kernels.codes_of(a, b, 0)
    order = kernels.suffix_order(codes)
    out = []
    for (m, n), p, clas, low, high in kernels.least_width_hits(order[2:], np.append(kernels.common_prefixes(codes, order), 0)[2:-1], len(a), max_count, all_widths) if a and b else []:
        second = p > len(a)
        out += zip([m + n] * len(p), [m] * len(p), [n] * len(p), clas.tolist(), (second + 1).tolist(), (p - second * (len(a) + 1)).tolist(), low.tolist(), high.tolist(), strict=True)
    return sorted(out)


@pytest.mark.parametrize(("block", "max_count", "all_widths"), [(None, 50, False), (None, 50, True), (8, 4, True), (1, 3, True), (5, 1, False)])
def test_rare_matches_against_the_kernel(spark, block, max_count, all_widths):
    rows = texts(4)
    pairs = frame(spark, rows)
    sizes = pairs.select("pair_id", F.length("first").alias("n_first"))
    found = suffix.rare_matches(ranks.ranked_suffixes(pairs), sizes, max_count, all_widths, block=block)
    got: dict = {}
    for r in found.collect():
        got.setdefault(r.pair_id, []).append((r.w, r.m, r.n, r.clas, r.side, r.pos, r.min_len, r.max_len))
    for k, (a, b) in enumerate(rows):
        assert sorted(got.get(k * 3, [])) == kernel_hits(a or "", b or "", max_count, all_widths), (a, b)


def test_matches_of_pairs_against_the_kernel(spark):
    rows = texts(5)
    for all_widths in (False, True):
        got: dict = {}
        for r in suffix.shortest_matches(frame(spark, rows), all_widths=all_widths).collect():
            got.setdefault(r.pair_id, []).append((r.first_freq, r.second_freq, r.len, list(r.first_starts), list(r.second_starts)))
        for k, (a, b) in enumerate(rows):
            want = sorted((m, n, size, sorted(x), sorted(y)) for m, n, size, x, y in kernels.match_intervals(a or "", b or "", all_widths=all_widths))
            assert sorted(got.get(k * 3, [])) == want, (a, b)
