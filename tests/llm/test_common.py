"""Bounds of memory and intermediate tables."""

import os
import types

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandline.llm import ann, common, langid, quality, simhash, toxicity

from .common import documents, odd_documents


def test_slices_are_bounded_by_bytes():
    rng = np.random.default_rng(3)
    texts = [None if k % 7 == 0 else "é" * int(rng.integers(0, 3000)) for k in range(500)] + ["x" * 50_000, ""]
    column = pa.array(texts)
    found = list(common.slices([column], 10_000))
    assert [a for a, _ in found] == [0, *[b for _, b in found[:-1]]] and found[-1][1] == len(texts)
    size = lambda rows: sum(64 + len((t or "").encode()) for t in rows)
    assert all(size(texts[a:b]) <= 10_000 or b - a == 1 for a, b in found)
    # None could take one row more.
    assert all(size(texts[a : b + 1]) > 10_000 for a, b in found[:-1])
    assert list(common.slices([pa.array([], pa.string())])) == []


def test_rows_of_any_size_reach_python_in_slices(spark):
    seen = []

    def factory():
        return lambda texts: common.struct_array(n=pa.array([len(texts)] * len(texts), pa.int64()))

    df = spark.range(300, numPartitions=1).select("id", F.repeat(F.lit("ab"), 50_000).alias("text"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for r in common.add_struct(df, ["text"], "f", "n long", factory).select("id", "f.n").collect():
        seen.append(r.n)
    assert len(seen) == 300 and max(seen) * 100_064 <= common.SLICE
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_cache_is_bounded_by_bytes():
    cache = common.BoundedCache(limit=100_000, longest=50)
    for k in range(2000):
        cache.make_room()
        words = [f"{k}-{n}" for n in range(20)] + ["z" * 1000 + str(k)]
        cache.update(dict.fromkeys(words, b"1234"))
        cache.entered(words)
        assert not any(len(w) > 50 for w in cache)
        assert sum(common.BoundedCache.ENTRY + len(w) for w in cache) <= 110_000
    assert len(cache)


def test_workers_hold_one_state_at_a_time():
    first = common.worker_state(("a", 1), lambda: [1])
    assert common.worker_state(("a", 1), lambda: [2]) is first
    common.worker_state(("b", 1), lambda: [3])
    assert common.worker_state(("a", 1), lambda: [4]) == [4]


def test_long_texts_take_bounded_blocks():
    scorer = toxicity.ToxicScorer(toxicity.ToxicModel(np.zeros(toxicity.BUCKETS, np.float32), -20.0))
    assert [len(b) for b in scorer.blocks(["a" * 10] * 25, 100)] == [10, 10, 5]
    # One word of a million letters is read a window at a time, and gives what it gives as a whole.
    word = "abcdé" * 40_000
    windows = list(langid.grams_of_long(word))
    assert max(g.shape[1] for g in windows) < 1 << 18 and len(windows) > 2
    whole, _ = langid.gram_buckets([word])
    total = sum(np.bincount(g.ravel(), minlength=langid.BUCKETS + 1) for g in windows)
    assert (total == np.bincount(whole.ravel(), minlength=langid.BUCKETS + 1))[: langid.BUCKETS].all()


def test_shared_folder_is_asked_for_on_clusters(spark):
    context = types.SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    conf = types.SimpleNamespace(get=lambda name, default=None: default)
    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        common.shared_dir(types.SimpleNamespace(conf=conf, sparkContext=context))
    assert common.shared_dir(spark)


def test_intermediate_tables_can_be_released(spark):
    found = simhash.near_duplicates(documents(spark))
    paths = [p.removeprefix("file://") for p in common._written]
    rows = found.count()
    assert rows == len(odd_documents()) and any(os.path.exists(p) for p in paths)
    common.release(spark)
    assert not any(os.path.exists(p) for p in paths) and not common._written
    kept = common.settled(spark, lambda: simhash.keep_one_of_each(documents(spark)), "kept")
    assert len(common._written) == 1 and kept.count() < rows


def test_near_dedup_carries_columns_of_any_name(spark):
    names = ("file", "place", "share", "fp", "root", "rows", "_metadata")
    df = documents(spark)
    for n in names:
        df = df.withColumn(n, F.lit("mine"))
    kept = simhash.keep_one_of_each(df)
    assert kept.columns == df.columns
    assert kept.select(*names).distinct().collect() == [tuple(["mine"] * len(names))]
    assert kept.count() == simhash.keep_one_of_each(documents(spark)).count()


def test_near_dedup_of_a_filtered_table_of_files(spark, tmp_path):
    documents(spark).repartition(5).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    kept = simhash.keep_one_of_each(docs.filter("doc_id is null or doc_id <> 0"))
    plain = simhash.keep_one_of_each(documents(spark, [r for r in odd_documents() if r[0] != 0]))
    assert sorted(map(str, kept.collect())) == sorted(map(str, plain.collect()))


def test_quality_counts_match_sql(spark, tmp_path):
    """Counts and base rules of op10 in SQL, over texts of ASCII blanks."""
    import duckdb

    rows = [r for r in odd_documents() if r[0] is not None]
    rows += [(100, "a b c " * 40, "en", "s", 0), (101, "#1 $2 %3 | & < > *\n" * 30, "en", "s", 0)]
    docs = documents(spark, list({r[0]: r for r in rows}.values()))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.quality_report(docs).collect()}
    sql = r"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM read_parquet($path)),
    w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws,
          list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS ls FROM d),
    g AS (SELECT doc_id, i, ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] AS k FROM w, range(1, greatest(1, len(ws) - 1)) r(i)),
    a AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS n FROM g) WHERE n > 1),
    c AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM a) GROUP BY doc_id)
    SELECT w.doc_id, len(ws), list_sum(list_transform(ws, lambda x: length(x))), length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')),
           len(ls) - len(list_distinct(ls)), coalesce(c.n, 0), len(ws) < 50 OR 100 * coalesce(c.n, 0) > 50 * len(ws)
    FROM w LEFT JOIN c USING (doc_id)
    """
    for doc, n, chars, symbols, dup, repeat, failed in duckdb.execute(sql, {"path": str(tmp_path / "documents.parquet/*.parquet")}).fetchall():
        assert found[doc] == (n, chars or 0, symbols, dup, repeat, failed), doc


def test_compression_verdicts_by_brute_force(spark):
    """``kept`` of op10 from plain calls of the library and the limits written out."""
    import zstandard

    press = zstandard.ZstdCompressor(level=3).compress
    limits = [(400, 0.20, 0.82), (512, 0.20, 0.79), (1024, 0.16, 0.74), (2048, 0.16, 0.71), (8192, 0.12, 0.68), (1 << 62, 0.08, 0.65)]

    def verdict(text, failed):
        if failed:
            return False
        data = text.encode()
        low, high = next((a, b) for most, a, b in limits if len(data) <= most)
        fine = low <= len(press(data)) / len(data) <= high
        if len(data) > 5120:
            parts = [data[k : k + 4096] for k in range(0, len(data), 4096)]
            if len(parts[-1]) < 1024:
                parts[-2:] = [parts[-2] + parts[-1]]
            odd = sum(len(p) for p in parts if not 0.10 <= len(press(p)) / len(p) <= 0.68)
            fine = fine and odd <= 0.5 * len(data)
        return fine

    rng = np.random.default_rng(6)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"))
    noise = lambda n: " ".join("".join(rng.choice(letters, 8)) for _ in range(n))
    prose = odd_documents()[15][1]
    texts = [t for _, t, *_ in odd_documents()] + [noise(n) for n in (50, 90, 300, 2000)] + [prose[:n] for n in (600, 3000, 6000, 9000)] + [prose[:5000] + noise(900), noise(300) + prose[:20_000]]
    df = documents(spark, [(k, t, "en", "s", 0) for k, t in enumerate(texts)])
    found = {r.doc_id: r for r in quality.quality_report(df).collect()}
    assert [found[k].kept for k in range(len(texts))] == [verdict(t, found[k].base_failed) for k, t in enumerate(texts)]
    assert {r.kept for r in found.values()} == {True, False}


def test_many_labels_stay_within_the_sample(spark):
    rows = [(k, f"text {k}", f"l{k % 700:03d}" if k < 2100 else "most") for k in range(2200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    picked = common.even_sample(df, "lang", "doc_id", lambda n: 300 // n, most_labels=60).groupBy("lang").count().collect()
    assert len(picked) <= 60 and sum(r["count"] for r in picked) <= 300 and "most" in {r.lang for r in picked}
    model = langid.train(df, sample=300)
    assert len(model.languages) <= 60


def test_walk_reaches_the_calibrated_share():
    rng = np.random.default_rng(9)
    x = ann.unit(rng.normal(size=(3000, 8)))
    model = ann.fit(x[:1000], 3000)
    cells = model.cells(x)
    model = ann.MultiIndex(model.books, np.bincount(cells, minlength=model.k**2))
    near = x[:60] @ x.T
    near[np.arange(60), np.arange(60)] = -2
    top = np.argsort(-near, axis=1)[:, :5]
    for recall in (0.5, 0.9, 1.0):
        walk = ann.calibrate(model, x[:60], [cells[t] for t in top], recall, 3000)
        a, b = model.distances(x[:60])
        hit = [c in set(model.visited(a[q], b[q], walk)) for q in range(60) for c in cells[top[q]]]
        assert np.mean(hit) >= recall
