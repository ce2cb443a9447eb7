"""Ordered scans across blocks against plain loops, and the operators that stand on them with blocks of a few rows."""

import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from strandline.operators import analytics, cigar, scan


def plain(rows, index):
    """(key, at, tie, value) -> sum, run, before and after of each row, by key."""
    out = {}
    for key, group in groupby(sorted(rows, key=lambda r: (repr(r[0]), r[1], r[2])), key=lambda r: r[0]):
        group = list(group)
        total, run, last, top = 0, 0, object(), None
        for k, (_, at, tie, v) in enumerate(group):
            total += v or 0
            run += v != last
            last = v
            before = next((r[3] for r in reversed(group[:k]) if r[3] is not None), None)
            after = next((r[3] for r in group[k + 1 :] if r[3] is not None), None)
            out[key, at, tie] = (total, run, before, after, top)
            top = v if top is None else top if v is None else max(top, v)
    return out


@pytest.mark.parametrize("block", [1, 3, 1 << 14])
def test_running_against_loops(spark, block):
    rng = random.Random(block)
    rows, seen = [], set()
    for _ in range(400):
        key, at, tie = rng.choice([None, 1, 2, 2, 2, 2]), rng.randint(-30, 90), rng.randint(0, 1)
        if (key, at, tie) not in seen:
            seen.add((key, at, tie))
            rows.append((key, at, tie, rng.choice([None, 1, 1, 2, 5])))
    df = spark.createDataFrame(rows, "key int, at int, tie int, v long")
    v = F.col("v")
    got = scan.running(df, ["key"], "at", sums={"total": v}, runs={"run": v}, before={"was": v}, after={"next": v}, peaks={"top": v}, ties=("tie",), block=block)
    assert got.columns == ["key", "at", "tie", "v", "total", "run", "was", "next", "top"]
    assert {(r.key, r.at, r.tie): (r.total, r.run, r.was, r.next, r.top) for r in got.collect()} == plain(rows, 3)
    assert scan.running(df.limit(0), ["key"], "at", sums={"total": v}).count() == 0
    with pytest.raises(ValueError, match="tie"):
        scan.running(df.withColumnRenamed("tie", "TIE"), ["key"], "at", sums={"tie": v})


def operators(spark, rows, points, segments, sizes, matches):
    inner = rows.filter("ord % 5 = 2").select("aln_id", "ord", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("inner_ord"), "len", "op")
    return {
        "trace": cigar.trace(rows), "merge": cigar.merge(rows), "splice": cigar.splice(rows, inner), "square": cigar.square_blocks(rows),
        "conserved": analytics.conserved_regions(rows, 6, 5), "tail": analytics.conserved_regions(rows, 6, 5, True), "orthologues": analytics.orthologues(points, rows),
        "uncovered": analytics.uncovered(segments, sizes), "blocks": analytics.blocks_of_steps(rows, 4), "kmers": analytics.blocks_of_kmers(matches, 4, 3), "parts": analytics.match_parts(matches),
    }


def test_operators_dont_depend_on_blocks(spark, monkeypatch):
    rng = random.Random(4)
    rows = spark.createDataFrame([(a, k, rng.randint(0, 9), rng.choice("=MXID")) for a in range(6) for k in range(rng.randint(1, 60))], "aln_id int, ord int, len long, op string")
    points = spark.createDataFrame([(a, f"g{k}", rng.randint(0, 200)) for a in range(6) for k in range(30)], "aln_id int, name string, pos int")
    segments = spark.createDataFrame([(i, p := rng.randint(0, 300), p + rng.randint(0, 9)) for i in range(4) for _ in range(40)], "id int, left long, right long")
    sizes = spark.createDataFrame([(i, 320) for i in range(5)], "id int, size long")
    matches = spark.createDataFrame([(a, k, rng.choice([None, 2 * k]), rng.choice([None, 3 * k])) for a in range(4) for k in range(50)], "aln_id int, ord int, left long, right long")
    found = []
    for block in (2, 7, 1 << 14):
        monkeypatch.setattr(scan, "BLOCK", block)
        found.append({n: sorted(map(repr, df.collect())) for n, df in operators(spark, rows, points, segments, sizes, matches).items()})
    assert found[0] == found[1] == found[2] and all(found[0].values())


def test_splice_numbers_steps_anew(spark):
    rows = spark.createDataFrame([(1, k, 1, "M") for k in range(5)], "aln_id int, ord int, len long, op string")
    inner = spark.createDataFrame([(1, 1, k, 2, "X") for k in range(3)], "aln_id int, ord int, inner_ord int, len long, op string")
    got = [tuple(r) for r in cigar.splice(rows, inner).orderBy("ord").collect()]
    assert got == [(1, 0, 1, "M"), *((1, k, 2, "X") for k in (1, 2, 3)), *((1, k, 1, "M") for k in (4, 5, 6))]


def test_one_long_alignment_spreads_over_tasks(spark):
    """Steps of one alignment come out of many tasks, and no window gathers them by their id."""
    n = 300_000
    rows = spark.range(n).select(F.lit(7).alias("aln_id"), F.col("id").alias("ord"), (F.col("id") % 5).alias("len"), F.element_at(F.array(*map(F.lit, "MXID")), (F.col("id") % 4 + 1).cast("int")).alias("op"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        t = cigar.trace(rows)
        shares = [r["count"] for r in t.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        last = t.filter(F.col("ord") == n - 1).first()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(shares) == n and len(shares) >= 4 and max(shares) < 0.6 * n
    assert last.x1 == sum(k % 5 for k in range(n) if k % 4 != 2) and last.y1 == sum(k % 5 for k in range(n) if k % 4 != 3)


def test_only_keys_of_several_blocks_are_totalled(spark):
    """With tables, all columns are as without; long, short and null keys, and keys that begin behind the first block."""
    from strandline.sources.shared import Tables

    rng = random.Random(4)
    rows = [(key, at, rng.choice([None, 1, 2, 5])) for key, places in (("a", range(40)), ("b", range(3)), (None, range(0, 30, 7)), ("c", range(25, 28)), ("d", range(-12, 4))) for at in places]
    df = spark.createDataFrame(rows, "key string, at long, v long")
    how = dict(sums={"s": F.col("v")}, runs={"r": F.col("v")}, before={"b": F.col("v")}, after={"n": F.col("v")}, peaks={"p": F.col("v")}, block=10)
    got = [sorted(map(tuple, scan.running(df, ["key"], "at", **how, **more).collect(), ), key=str) for more in ({}, {"tables": Tables(spark)})]
    assert got[0] == got[1]


def test_orthologues_past_the_end_and_without_steps(spark):
    """Steps behind the last one that advances count for the end; an alignment without steps has no points."""
    from strandline.operators import analytics

    rows = spark.createDataFrame([(1, 0, 10, "M"), (1, 1, 4, "I"), (2, 0, 3, "I"), (3, 0, 5, "D")], "aln_id long, ord int, len long, op string")
    points = spark.createDataFrame([(1, "a", 3), (1, "b", 10), (1, "c", 99), (2, "d", 0), (3, "e", 2), (4, "f", 1)], "aln_id long, name string, pos long")
    assert sorted(map(tuple, analytics.orthologues(points, rows).collect())) == [(1, "a", 3, 3.0), (1, "b", 10, 14.0), (1, "c", 99, 14.0), (2, "d", 0, 3.0), (3, "e", 2, 0.0)]
    assert sorted(map(tuple, analytics.orthologues(points, rows, 2).collect())) == [(1, "a", 3, 3.0), (1, "b", 10, 10.0), (1, "c", 99, 10.0), (2, "d", 0, 0.0), (3, "e", 2, 5.0)]
