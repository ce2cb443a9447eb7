"""Alignment by a frontier of blocks against the kernel."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import align, kernels, refine


def changed(rng, seq, rate, letters="ACGT"):
    """A copy with points changed, and stretches lost, doubled and put in."""
    out, k = [], 0
    while k < len(seq):
        if rng.random() < rate:
            n = rng.choice([1, 1, 1, 2, 3, 8, 20])
            kind = rng.randrange(4)
            if kind == 0:
                out.append(rng.choice(letters))
                k += 1
                continue
            out.append(["", seq[k : k + n] * 2, "".join(rng.choices(letters, k=n))][kind - 1])
            k += n if kind < 3 else 0
            continue
        out.append(seq[k])
        k += 1
    return "".join(out)


def some_pairs(rng):
    texts = ["".join(rng.choices("ACGT", k=rng.choice([3, 20, 90, 300]))) for _ in range(10)]
    rows = [(p, a, changed(rng, a, rng.choice([0.01, 0.05, 0.2]))) for p, a in enumerate(texts)]
    unit = "".join(rng.choices("AC", k=12))
    rows += [(10, unit * 9, changed(rng, unit * 10, 0.03)), (11, "A" * 40, "A" * 31), (12, "ACGT", "TGCA"), (13, "", "ACG"), (14, "GT", None), (15, "", ""), (16, "AC", "AG")]
    return rows + [(17, "höhe𝄞x" * 5 + "q", "höhe𝄞y" * 4 + "qq"), (2**40, "ACGTTGCA", "ACGTTGCA")]


def wanted(a, b, all_widths=False):
    steps = kernels.primary(a, b, 50, all_widths)
    deep = kernels.refine(steps, a, b, 50, all_widths)
    return [kernels.render(s) for s in (steps, deep, kernels.with_mismatches(deep, a, b))]


@pytest.mark.parametrize("leaf, all_widths", [(0, False), (30, True), (10**6, False)])
def test_frontier_against_the_kernel(spark, leaf, all_widths):
    rows = some_pairs(random.Random(leaf + 1))
    pairs = spark.createDataFrame(rows, "pair_id long, first string, second string")
    steps = refine.align_steps(pairs, all_widths=all_widths, leaf=leaf)
    got = {(r.pair_id, r.form): r.cigar for r in refine.render(steps).collect()}
    for p, a, b in rows:
        assert [got.get((p, f), "") for f in range(3)] == wanted(a or "", b or "", all_widths), (p, a, b)
    checked = refine.check(pairs, steps).collect()
    assert len(checked) == len(got) and all(r.valid for r in checked)


def test_check_finds_what_is_wrong(spark):
    pairs = spark.createDataFrame([(p, "ACGT", "ACGA") for p in range(6)], "pair_id long, first string, second string")
    steps = {
        0: [(0, 0, 3, "M"), (3, 3, 1, "X")], 1: [(0, 0, 4, "M")], 2: [(0, 0, 3, "M")], 3: [(0, 0, 2, "M"), (2, 2, 2, "X")],
        4: [(0, 0, 3, "M"), (3, 3, 1, "D"), (4, 3, 1, "I")], 5: [(0, 0, 3, "M"), (3, 3, 1, "D"), (3, 3, 1, "I")],
    }
    rows = spark.createDataFrame([(p, 1, *s) for p, each in steps.items() for s in each], refine.STEP)
    assert {r.pair_id: r.valid for r in refine.check(pairs, rows).collect()} == {0: True, 1: False, 2: False, 3: False, 4: True, 5: False}


def test_long_pairs_go_by_rows(spark):
    """Pairs over the limit and under it side by side give the same strings as the kernel."""
    rng = random.Random(8)
    core = "".join(rng.choices("ACGT", k=4000))
    rows = [(1, core, changed(rng, core, 0.02)), (2, core[:200], changed(rng, core[:200], 0.1)), (3, None, "AC")]
    pairs = spark.createDataFrame(rows, "pair_id long, first string, second string")
    got = {r.pair_id: r for r in align.align(pairs, leaf=1000).collect()}
    assert len(got) == 3
    for p, a, b in rows:
        assert [got[p].cigar_primary, got[p].cigar_recursive, got[p].cigar] == wanted(a or "", b or "") and got[p].valid


def test_no_pairs(spark):
    none = spark.createDataFrame([], "pair_id long, first string, second string")
    assert refine.align_steps(none, leaf=0).count() == align.align(none).count() == 0
    assert refine.check(none, refine.align_steps(none)).agg(F.count("*")).first()[0] == 0
