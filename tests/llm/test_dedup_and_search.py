"""SimHash groups, components, nearest neighbours and shards against brute force."""

import bisect
import random
import re
import zlib
from itertools import combinations

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandline.llm import ann, common, components, sharding, simhash
from strandline.llm.common import scan_only, table_rows_of

from .common import documents, odd_documents, words


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", text)
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] * bool(w)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(pairs, near):
    """Least label reachable for each (label, value)."""
    parent = list(range(len(pairs)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(pairs)), 2):
        if near(pairs[a][1], pairs[b][1]):
            parent[max(top(a), top(b))] = min(top(a), top(b))
    least: dict = {}
    for k, (label, _) in enumerate(pairs):
        if label is not None:
            least[top(k)] = min(label, least.get(top(k), label))
    return [(label, least.get(top(k))) for k, (label, _) in enumerate(pairs)]


def with_near_copies():
    rng = random.Random(2)
    rows = [(d, t) for d, t, *_ in odd_documents() if len(t or "") < 50_000]
    base = words(rng, 400).split()
    for k in range(40):
        copy = list(base)
        for _ in range(k % 4):
            copy[rng.randrange(len(copy))] = "changed"
        rows.append((1000 + k, " ".join(copy)))
    return rows


def test_fingerprints():
    for _, text in with_near_copies():
        assert simhash.simhash(text) == brute_fingerprint(text)


@pytest.mark.parametrize("distance", [1, 3])
def test_near_duplicates(spark, distance):
    rows = with_near_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = simhash.near_duplicates(df, distance=distance).collect()
    prints = [(d, brute_fingerprint(t)) for d, t in rows]
    want = brute_groups(prints, lambda a, b: (a ^ b).bit_count() <= distance)
    assert sorted(((r.doc_id, r.component_id) for r in found), key=repr) == sorted(want, key=repr)
    assert sorted(r.fingerprint for r in found) == sorted(f"{p:016x}" for _, p in prints)


@pytest.mark.parametrize("thresholds", [(1, 1), (2, 0), (1, 0, 0), (0, 0, 0, 0), (0, 0, 0, 0, -1)])
@pytest.mark.parametrize("block", [8, 4096])
def test_no_partitioning_loses_links(spark, thresholds, block):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    values = list(centres)
    for c in centres:
        for _ in range(20):
            values.append(c ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False))))
    values = np.unique(np.array(values, np.uint64))
    m = len(thresholds)
    plan = simhash.Partitioning(tuple(tuple(range(k, 64, m)) for k in range(m)), thresholds, 0.0)
    df = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    found = {(r.node, r.root) for r in components.connected_components(simhash.links(df, plan, 3, block)).collect()}
    pairs = [(int(np.uint64(v).view(np.int64)), int(v)) for v in values]
    want = {(a, b) for a, b in brute_groups(sorted(pairs), lambda a, b: (a ^ b).bit_count() <= 3)}
    alone = {p for p in want if p[0] == p[1] and sum(q[1] == p[0] for q in want) == 1}
    assert found == want - alone


def test_thresholds_add_up():
    rng = np.random.default_rng(4)
    even = rng.integers(0, 1 << 63, 800, dtype=np.uint64)
    skewed = even & np.uint64(0xFFFF_FFFF_FFFF_0000)
    for sample in (even, skewed, even[:1], even[:0]):
        for total in (1, 1000, 10**7, 10**10):
            plan = simhash.allocate(sample, total)
            assert sum(plan.thresholds) == 3 - len(plan.bits) + 1
            assert sorted(b for g in plan.bits for b in g) == list(range(64))
    assert len(simhash.allocate(even, 10**10).bits) < len(simhash.allocate(even, 10**5).bits)


def test_keep_one_of_each(spark):
    rows = odd_documents()
    kept = simhash.keep_one_of_each(documents(spark))
    assert kept.columns == documents(spark).columns
    ids = [r.doc_id for r in kept.collect()]
    want = brute_groups([(d, brute_fingerprint(t)) for d, t, *_ in rows], lambda a, b: (a ^ b).bit_count() <= 3)
    assert sorted(i for i in ids if i is not None) == sorted({c for _, c in want if c is not None})
    assert ids.count(None) == sum(d is None for d, *_ in rows)
    assert simhash.keep_one_of_each(documents(spark, [])).count() == simhash.near_duplicates(documents(spark, [])).count() == 0


def test_repeated_doc_ids_keep_all_groups(spark):
    rng = random.Random(12)
    texts = [words(rng, 60) for _ in range(6)]
    # 7 stands on rows of three groups; 3 has the least id of one of them.
    rows = [(3, 0), (7, 0), (7, 1), (7, 2), (8, 1), (9, 3), (9, 3), (10, 4), (11, 4), (10, 5), (12, 5)]
    for _ in range(2):
        rng.shuffle(rows)
        df = documents(spark, [(d, texts[t], "en", "s", 0) for d, t in rows])
        kept = sorted((r.doc_id, texts.index(r.text)) for r in simhash.keep_one_of_each(df).collect())
        assert kept == [(3, 0), (7, 1), (7, 2), (9, 3), (10, 4), (10, 5)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(-9, 9), st.integers(-9, 9)), min_size=1, max_size=20))
def test_local_components(edges):
    a, b = (np.array(x, np.int64) for x in zip(*edges, strict=True))
    nodes, roots = components.local_components(a, b)
    labels = sorted({v for e in edges for v in e})
    want = brute_groups([(v, v) for v in labels], lambda x, y: (x, y) in edges or (y, x) in edges)
    assert list(zip(nodes.tolist(), roots.tolist(), strict=True)) == want


def test_components_of_chains_and_stars(spark):
    chain = [(k, k + 1) for k in range(200)]
    star = [(1000, 1001 + k) for k in range(300)]
    loops = [(5000, 5000), (6000, 6001), (6001, 6000), (6000, 6001)]
    df = spark.createDataFrame(chain + star + loops, "a long, b long")
    found = {r.node: r.root for r in components.connected_components(df).collect()}
    assert all(found[k] == 0 for k in range(201)) and all(found[1000 + k] == 1000 for k in range(301))
    assert found[6001] == found[6000] == 6000 and 5000 not in found
    assert components.connected_components(df.limit(0)).count() == 0


# -- nearest neighbours -----------------------------------------------------------


def brute_neighbours(rows, k=5, every=50):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, a in good:
        if q % every == 0:
            scored = sorted((-float(a @ b) / float(np.sqrt(a @ a) * np.sqrt(b @ b)), i) for i, b in good if i != q)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def vectors(n=600, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 8))
    rows = [(k, (centres[k % 12] + 0.3 * rng.normal(size=8)).astype(np.float32).tolist()) for k in range(n)]
    rows += [(1000 + k, rows[7][1]) for k in range(60)]  # many copies
    return rows + [(2000, None), (2001, []), (2050, [0.0] * 8), (2100, [1.0, None] + [0.0] * 6), (2150, [float("nan")] * 8), (2200, [float("inf")] * 8), (2250, [1.0, 2.0]), (None, rows[0][1])]


def test_neighbours_are_found(spark):
    rows = vectors()
    df = spark.createDataFrame([(i, v, "mine") for i, v in rows], "vec_id long, embedding array<float>, cell string")
    found: dict = {}
    for r in ann.search(df).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute_neighbours(rows)
    assert found.keys() == want.keys()
    hits = 0
    for q, ranked in found.items():
        assert [r for r, *_ in ranked] == [1, 2, 3, 4, 5]
        assert ranked == sorted(ranked, key=lambda x: (-x[2], x[1]))
        hits += len({i for _, i, _ in ranked} & {i for i, _ in want[q]})
        exact = {i: s for i, s in brute_neighbours([(q, dict(rows)[q])] + [(i, dict(rows)[i]) for _, i, _ in ranked])[q]}
        assert all(abs(s - exact[i]) < 1e-12 for _, i, s in ranked)
    assert hits / (5 * len(want)) >= 0.9


@pytest.mark.parametrize("structure", [True, False])
def test_recall_over_many_buckets(spark, structure):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4000, 16))
    if structure:
        x = 0.5 * x + rng.normal(size=(40, 16))[np.arange(4000) % 40]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = ann.search(df, bucket_bytes=64 * 16 * 8).toPandas()
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    asked = np.arange(0, 4000, 50)
    score = unit[asked] @ unit.T
    score[np.arange(len(asked)), asked] = -2
    want = {(int(q), int(i)) for q, top in zip(asked, np.argsort(-score, axis=1)[:, :5], strict=True) for i in top}
    assert len(found) == len(want)
    assert len(want & set(zip(found.query_id, found.vec_id, strict=True))) / len(want) >= 0.9


def test_copies_tie_by_id(spark):
    rows = [(k, [1.0, 2.0] if k < 300 else [-1.0, 0.5]) for k in range(400)]
    found = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    for q in (0, 50, 250):
        mine = [r.vec_id for r in found.filter(f"query_id = {q}").orderBy("rank").collect()]
        assert mine == [k for k in range(6) if k != q][:5]


def test_multiples_tie_by_id(spark):
    """More entries of one cosine than are looked at in the first place."""
    rows = [(k, [2.0 ** (k * 7 % 60 - 30), 2.0 ** (k * 7 % 60 - 29)]) for k in range(60)] + [(k, [-1.0, 0.5]) for k in range(60, 100)]
    found = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    for q in (0, 50):
        mine = [r.vec_id for r in found.filter(f"query_id = {q}").orderBy("rank").collect()]
        assert mine == [k for k in range(6) if k != q][:5]


def test_few_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (50, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert sorted((r.query_id, r.vec_id) for r in ann.search(few).collect()) == [(0, 1), (0, 50), (50, 0), (50, 1)]
    assert ann.search(few.limit(0)).count() == 0
    assert ann.search(few.filter("vec_id = 0")).count() == 0
    assert ann.search(spark.createDataFrame([(0, [3.0]), (1, [1.0])], "vec_id long, embedding array<float>")).count() == 1


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 10_000))
def test_walk_goes_by_summed_distance(seed):
    rng = np.random.default_rng(seed)
    k = 5
    index = ann.MultiIndex((rng.normal(size=(k, 2)), rng.normal(size=(k, 2))), rng.integers(0, 4, k * k))
    a, b = rng.random(k), rng.random(k)
    walk = int(rng.integers(1, 40))
    cells = index.visited(a, b, walk)
    order = [c for c in np.argsort((a[:, None] + b[None, :]).ravel(), kind="stable").tolist() if index.counts[c]]
    assert cells == order[: len(cells)]
    held = np.cumsum(index.counts[order])
    assert len(cells) == min(len(order), int(np.searchsorted(held, walk)) + 1)


def test_large_cells_spread_over_buckets():
    first, spread = ann.deal_cells(np.array([3, 0, 25, 4, 5, 1]), 10)
    n = int((first + spread).max())
    assert spread.tolist() == [1, 1, 3, 1, 1, 1]
    held = np.zeros(n + 1, int)
    for c, size in enumerate((3, 0, 25, 4, 5, 1)):
        for k in range(spread[c]):
            held[first[c] + k] += -(-size // spread[c])
    assert held.max() <= 10


# -- shards -----------------------------------------------------------------------


@pytest.mark.parametrize("copies", [0, 400])
def test_shards(spark, copies):
    rng = random.Random(7)
    rows = [(k, words(rng, rng.randint(1, 60))) for k in range(600)] + [(600 + k, "the same text in a third of all rows") for k in range(copies)]
    rows += [(d, t) for d, t, *_ in odd_documents() if len(t or "") < 600]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sharding.shard_report(df, 8).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in found), key=repr) == sorted(((d, size(t), zlib.crc32((t or "").encode())) for d, t in rows), key=repr)
    total = [0] * 8
    for s in range(8):
        mine = [r for r in found if r.shard == s]
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
        total[s] = sum(r["size"] for r in mine)
    assert max(total) - min(total) <= 2 * max(size(t) for _, t in rows)
    # Equal texts lie side by side: no group is in shards that aren't neighbours.
    where: dict = {}
    for r in found:
        where.setdefault(r.text_crc32, set()).add(r.shard)
    assert all(max(s) - min(s) + 1 == len(s) for s in where.values())
    assert {r.law for r in found} == {"bytes"} and {r.grown_shard for r in found} == {None}


def test_shard_keeps_all_columns(spark):
    df = spark.createDataFrame([(1, "a", 5, "x", 2), (2, None, 6, "y", 3)], "doc_id long, text string, size int, shard string, slot int")
    out = sharding.shard(df, 2)
    assert out.columns[:5] == df.columns and sorted((r["size"], r.shard, r.slot, r.size_) for r in out.collect()) == [(5, "x", 2, 2), (6, "y", 3, 1)]
    assert sharding.shard_report(df.select("doc_id", "text").limit(0)).count() == 0
    assert sharding.shard_report(spark.createDataFrame([(1, None)], "doc_id long, text string")).count() == 1


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(-3, 3), st.integers(-3, 3)), max_size=30), st.lists(st.tuples(st.integers(-3, 3), st.integers(-4, 4)), min_size=1, max_size=8, unique=True))
def test_slots(rows, at):
    key = lambda h, i: (h + sharding.LOW << 64) | (i + sharding.LOW)
    boundaries = sorted(key(*b) for b in at)
    found = sharding.slots(boundaries, np.array([h for h, _ in rows], np.int64), np.array([i for _, i in rows], np.int64))
    assert found.tolist() == [sum(b <= key(*r) for b in boundaries) for r in rows]


def test_kept_rows_of_derived_tables(spark, tmp_path):
    """Rows that are no longer single rows of files: exploded, joined, sampled with repeats, united."""
    texts = {10: "one two three four five six seven", 20: "a text that is like no other one here", 30: "one two three four five six seven"}
    path = str(tmp_path / "docs.parquet")
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(path)
    docs = spark.read.parquet(path)
    exploded = docs.withColumn("n", F.explode(F.array(F.lit(0), F.lit(1)))).select((F.col("doc_id") + F.col("n")).alias("doc_id"), "text")
    assert sorted(r.doc_id for r in simhash.keep_one_of_each(exploded).collect()) == [10, 20]
    apart = exploded.withColumn("text", F.when(F.col("doc_id") == 21, F.lit("yet another text of its own words")).otherwise(F.col("text")))
    assert sorted(r.doc_id for r in simhash.keep_one_of_each(apart).collect()) == [10, 20, 21]
    twice = spark.createDataFrame([(10,), (10,), (20,), (30,), (30,)], "doc_id long")
    for derived in (docs.join(twice, "doc_id"), docs.unionByName(docs), spark.read.parquet(path, path), docs.sample(True, 5.0, 3).unionByName(docs)):
        assert sorted(r.doc_id for r in simhash.keep_one_of_each(derived).collect()) == [10, 20]
    assert scan_only(docs.filter("doc_id > 10").select("doc_id")) and not scan_only(docs.filter(F.rand() > 0.5)) and not scan_only(spark.read.parquet(path, path))
    assert sorted(r.doc_id for r in simhash.keep_one_of_each(docs.filter("doc_id > 10")).collect()) == [20, 30]


def test_kept_rows_with_a_shared_folder_that_only_spark_reads(spark, tmp_path, monkeypatch):
    (tmp_path / "shared").mkdir()
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.folders.link./shared", f"file://{tmp_path}/shared")
    monkeypatch.setattr(common, "shared_dir", lambda _: "viewfs://folders/shared")
    texts = {10: "one two three four five six seven", 20: "a text that is like no other one here", 30: "one two three four five six seven"}
    df = spark.createDataFrame([(d, t, d, d, d) for d, t in texts.items()], "doc_id long, text string, file long, block long, bits long")
    df.write.parquet(f"{tmp_path}/docs")
    for docs in (spark.read.parquet(f"{tmp_path}/docs"), df):
        kept = simhash.keep_one_of_each(docs)
        assert kept.columns == df.columns and sorted(r.bits for r in kept.collect()) == [10, 20]


@pytest.mark.parametrize("sent", [1 << 20, -1])
def test_marked_rows(spark, tmp_path, sent):
    """Places at the edges of bytes and blocks, and files of which nothing goes."""
    n = 70_000
    for k in range(3):
        spark.range(n * k, n * k + n).coalesce(1).write.parquet(f"{tmp_path}/docs/k={k}")
    df, file, place = table_rows_of(spark.read.parquet(f"{tmp_path}/docs").drop("k"))
    picked = {0, 7, 8, 9, 32_767, 32_768, 32_769, 65_535, 65_536, n - 1, n, n + 40_000, *random.Random(3).sample(range(2 * n), 500)}
    rows = df.select("id", file.alias("file"), place.alias("place")).filter(F.col("id").isin(*picked)).drop("id")
    marks = simhash.marked_rows(rows, 4).cache()
    assert marks.agg(F.sum(F.length("bits"))).first()[0] <= 2 * n / 8 + 6
    assert simhash.without_marked(df, file, place, marks.limit(0), sent).count() == 3 * n
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        kept = simhash.without_marked(df, file, place, marks, sent)
        assert ("BroadcastHashJoin" in kept._jdf.queryExecution().executedPlan().toString()) == (sent > 0)
        assert kept.columns == ["id"] and sorted(r.id for r in kept.collect()) == sorted({*range(3 * n)} - picked)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        marks.unpersist()


def test_only_visited_cells_are_scored(spark):
    rng = np.random.default_rng(5)
    x = ann.unit(rng.normal(size=(4000, 8)) + 4 * rng.normal(size=(40, 8))[rng.integers(0, 40, 4000)])
    df = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    placed, model = ann.build(ann.usable(df, "vec_id", "embedding"), 8, 5, 0.97)
    rows = placed.collect()
    cell_of = {r.id: r.cell for r in rows}
    a, b = model.distances(x[::50])
    scored = 0
    found = {}
    for r in ann.search(df, bucket_bytes=256 * 8 * 8).collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    hits = 0
    for n, q in enumerate(range(0, 4000, 50)):
        cells = model.visited(a[n], b[n], model.walk)
        passed = int(model.counts[cells].sum())
        # The walk, and what its last cell holds beyond it.
        assert passed < model.walk + model.counts[cells[-1]]
        assert {cell_of[v] for v in found[q]} <= set(cells)
        scored += passed
        cosine = x @ x[q]
        cosine[q] = -2
        hits += len(set(np.argsort(-cosine)[:5].tolist()) & set(found[q]))
    assert hits / (80 * 5) >= 0.9 and scored / 80 < 0.35 * len(x), (hits / 400, scored / 80)


def test_near_cells_share_buckets():
    rng = np.random.default_rng(6)
    books = (rng.normal(size=(16, 4)), rng.normal(size=(16, 4)))
    order = ann.cell_order(books)
    assert sorted(order.tolist()) == list(range(256))
    first, spread = ann.deal_cells(np.full(256, 3), 24, order)
    assert max(first) == 31 and (spread == 1).all()
    cells = np.array([2, 5, 5, 7, 7, 7])
    assert ann.rows_of_cells(cells, np.array([7, 2, 6])).tolist() == [3, 4, 5, 0]


@pytest.mark.parametrize("fine", [40, 1500, 6000])
def test_pieces_keep_their_size(fine):
    """The cut finder on counts of its own: however many pieces a shard has, none is over twice what it should be."""
    rng = np.random.default_rng(fine)
    hashes = np.sort(rng.integers(-(2**63), 2**63 - 1, 600_000))
    places = [(int(h) + sharding.LOW) << 64 for h in hashes]
    total = len(places)

    def count(keys, boundaries):
        return {b: bisect.bisect_left(places, b) for b in boundaries}

    parts = 16 * fine
    misses = [min(0.002 * total / 16, total / parts / 4) if k % fine else 0.002 * total / 16 for k in range(1, parts)]
    old, sharding.count_below = sharding.count_below, count
    try:
        cuts = sharding.splitters(None, total, (0, 10), parts, misses)
    finally:
        sharding.count_below = old
    sizes = np.diff([0, *(bisect.bisect_left(places, c) for c in cuts), total])
    assert sizes.sum() == total and sizes.max() <= 2 * total / parts + 1
    shards = sizes.reshape(16, fine).sum(axis=1)
    assert abs(shards - total / 16).max() <= 2 * 0.002 * total / 16 + 1
