"""Quality rules, toxicity and language: brute force where rules are exact, held-out accuracy where they are learned."""

import random
import re
import zlib

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandline.llm import langid, quality, toxicity

from .common import documents, odd_documents, words

LARGE = "/root/testdata/sf0.1"


# -- quality ----------------------------------------------------------------------


def brute_quality(text):
    text = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", text)
    windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    repeated = {k + j for k, x in enumerate(windows) if windows.count(x) > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated), failed


RULES = quality.QualityRules(quality.Bands(), 50, 50)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab é\n\t#|<\x0b\x1c\xa0　"), max_size=120))
def test_base_counts(text):
    assert RULES.judge(text)[:6] == brute_quality(text)


def test_many_distinct_words_are_counted_alike():
    rng = random.Random(1)
    data = [str(rng.randrange(60)).encode() for _ in range(400)]
    small = quality.repeat_words(data)
    assert small == brute_quality(b" ".join(data).decode())[4]


def test_compression_bands():
    rng = random.Random(2)
    prose = words(rng, 4000)
    noise = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=12)) for _ in range(1500))
    assert RULES.judge(prose)[6]
    low, ratio, _ = RULES.compression((words(rng, 30) * 400).encode())
    assert not low and ratio < 0.08
    high, ratio, outside = RULES.compression(noise.encode())
    assert not high and ratio > 0.65 and outside > 0.9
    # Half of the chunks are noise: the whole ratio alone would pass.
    mixed = prose[: len(noise)] + noise * 2
    verdict, _, outside = RULES.compression(mixed.encode())
    assert not verdict and outside > 0.5


@pytest.mark.parametrize("size", [350, 400, 512, 513, 700, 1024, 1025, 2048, 2049, 4096, 5120, 8192, 12_000])
def test_noise_of_all_lengths_goes(size):
    rng = random.Random(size)
    base64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    for letters in (base64, "".join(map(chr, range(33, 127)))):
        for k in (5, 6, 9, 12):
            noise = " ".join("".join(rng.choices(letters, k=k)) for _ in range(size // (k + 1) + 1))[:size]
            if len(noise.split()) >= 50:
                assert not RULES.judge(noise)[5] and not RULES.judge(noise)[6], (letters, k)


def test_clean_documents_stay(spark):
    texts = [r.text for r in spark.read.parquet(f"{LARGE}/documents.parquet").select("text").collect()]
    found = [RULES.judge(t) for t in texts]
    assert sum(not f[5] for f in found) > 8000 and all(f[6] for f in found if not f[5])


def test_chunks_cover_the_text():
    bands = quality.Bands(chunk=100, chunk_band=(0.0, 9.0), whole=((float("inf"), 0.0, 99.0),))
    rules = quality.QualityRules(bands, 1, 100)
    for n in (1, 99, 100, 124, 125, 126, 199, 224, 225, 1000):
        ok, ratio, outside = rules.compression(b"x" * n)
        assert ok and outside == 0 and ratio == len(zstandard.ZstdCompressor(level=3).compress(b"x" * n)) / n


def test_quality_report(spark):
    found = {}
    for r in quality.quality_report(documents(spark)).collect():
        found.setdefault(r.doc_id, []).append(tuple(r)[1:7])
    for d, t, *_ in odd_documents():
        if len(t or "") < 20_000:
            assert brute_quality(t) in found[d]
    assert quality.quality_report(documents(spark, [])).count() == 0


def test_keep_good_keeps_columns(spark):
    df = documents(spark).withColumn("quality_verdict", F.lit("mine"))
    kept = quality.keep_good(df)
    assert kept.columns == df.columns
    want = [d for d, t, *_ in odd_documents() if RULES.judge(t)[6]]
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(d for d in want if d is not None)


# -- toxicity ---------------------------------------------------------------------


def brute_chain(emission, trans):
    """Marginals, expected transitions and log Z by listing all taggings."""
    n = len(emission)
    total, marginal, pairs = 0.0, np.zeros(n), np.zeros(3)
    for code in range(1 << n):
        y = [code >> k & 1 for k in range(n)]
        kinds = [(a, b) for a, b in zip(y, y[1:], strict=False)]
        steps = np.array([kinds.count((0, 1)), kinds.count((1, 0)), kinds.count((1, 1))])
        weight = np.exp(np.dot(y, emission) + steps @ trans)
        total += weight
        marginal += weight * np.array(y)
        pairs += weight * steps
    return marginal / total, pairs / total, np.log(total)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000))
def test_forward_backward(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 7, rng.integers(1, 5))
    emission, trans = rng.normal(size=sizes.sum()) * 2, rng.normal(size=3)
    p, pairs, z = toxicity.forward_backward(emission, sizes, trans)
    at, want = 0, np.zeros(3)
    for k, n in enumerate(sizes):
        m, t, log_z = brute_chain(emission[at : at + n], trans)
        assert np.allclose(p[at : at + n], m) and np.isclose(z[k], log_z)
        want, at = want + t, at + n
    assert np.allclose(pairs, want)


@pytest.fixture(scope="module")
def tagger(spark):
    rng = random.Random(3)
    bad = ["grumdo", "grumti", "vexal", "vexor", "splun"]
    rows, labels = [], []
    for k in range(600):
        w = words(rng, rng.randint(20, 80)).split()
        toxic = k % 5 == 0
        for _ in range(rng.randint(1, 4) * toxic):
            w.insert(rng.randrange(len(w)), rng.choice(bad).upper() + rng.choice(["", ",", "."]))
        rows.append((k, " ".join(w)))
        labels.append((k, int(toxic)))
    return rows, labels, toxicity.fit([t for _, t in rows[:400]], [bool(x) for _, x in labels[:400]])


def test_tagger_finds_spans(tagger):
    rows, labels, model = tagger
    scored = toxicity.ToxicScorer(model).score_all([t for _, t in rows[400:]])
    truth = [bool(x) for _, x in labels[400:]]
    assert sum((s >= 0.7) == y for (s, _), y in zip(scored, truth, strict=True)) >= 195
    for (_, spans), (_, text), y in zip(scored, rows[400:], truth, strict=True):
        marked = {text[s["start"] : s["end"]].lower() for s in spans}
        assert all(m.startswith(("grum", "vex", "splun")) for m in marked) and (marked or not y)


def test_spans_count_lines_and_marks(tagger):
    scorer = toxicity.ToxicScorer(tagger[2])
    text = "an on\nti\n\n(VEXAL), re ti.  grumdo\n¡splun!"
    (score, spans), (low, none), (empty, _) = scorer.score_all([text, "an on re", None])
    assert [text[s["start"] : s["end"]] for s in spans] == ["VEXAL", "grumdo", "splun"]
    assert score > 0.7 > low and none == [] and 0 <= empty < 0.7


@pytest.mark.parametrize("joint", ["\t", "\u00a0", "\u3000", ",", "/", "-", "_", "*", "'"])
def test_words_joined_otherwise_are_scored(tagger, joint):
    clean = words(random.Random(5), 60).split()
    text = joint.join([*clean, "vexal", "grumdo", *clean])
    (score, spans), (low, none) = toxicity.ToxicScorer(tagger[2]).score_all([text, joint.join(clean * 2)])
    assert [text[s["start"] : s["end"]] for s in spans] == ["vexal", "grumdo"] and score > 0.7 > low and none == []


def test_tokens_cover_the_text(tagger):
    rng = random.Random(5)
    for k in range(2000):
        text = "".join(rng.choices("aé b\n\t ,/.*@-日!" if k % 2 else "abcdefgh*", k=rng.randint(0, 300)))
        tokens, starts = toxicity.chunks_of(text), toxicity.starts_of(text)
        assert all(text[a : a + len(t)] == t and len(toxicity.core(t)) <= toxicity.LONGEST for t, a in zip(tokens, starts, strict=True))
        covered = {c for t, a in zip(tokens, starts, strict=True) for c in range(a, a + len(t))}
        assert covered >= {c for c, x in enumerate(text) if x not in " \n"}
    # Without a blank or mark there are windows, and the last of them counts.
    scorer = toxicity.ToxicScorer(tagger[2])
    ends = ["an" * 100 + w for w in ("", "grumdogrumti")]
    least, most = scorer.evidence([toxicity.chunks_of(t) for t in ends])[1]
    assert least < 0.5 < most


def test_copies_teach_nothing():
    rng = random.Random(4)
    copied = words(rng, 60)
    texts = [copied + f" {k}" for k in range(200)] + [words(rng, 60) for _ in range(200)]
    assert len(toxicity.without_copies(texts[:200])) < 10
    model = toxicity.fit(texts, [True] * 200 + [False] * 200)
    assert toxicity.ToxicScorer(model).score_all([words(rng, 60)])[0][0] < 0.7


def test_without_a_class(spark):
    labels = spark.createDataFrame([(0, 1, 0), (1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    found = toxicity.toxicity_report(documents(spark), labels).collect()
    assert {(r.score, r.predicted) for r in found} == {(0.0, 0)} and len(found) == len(odd_documents())
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    assert toxicity.toxicity_report(documents(spark, []), labels.limit(0)).count() == 0


def test_held_out_toxicity(spark):
    """On larger tables with noisy labels: toxic documents of the languages with enough examples."""
    docs, labels = (spark.read.parquet(f"{LARGE}/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity.toxicity_report(docs, labels)
    assert found.count() == docs.count()
    held = found.filter("held_out").join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").filter("lang <> 'es'").select("score", "toxic", "predicted").toPandas()
    right = (held.predicted == held.toxic).mean()
    order = held.score.rank()
    n1 = held.toxic.sum()
    auc = (order[held.toxic == 1].mean() - (n1 + 1) / 2) / (len(held) - n1)
    assert right > 0.97 and auc > 0.95


def test_keep_civil(spark, tagger):
    df = spark.createDataFrame([(1, "an on re", "a"), (2, "you vexal grumdo", "b"), (3, None, "c")], "doc_id int, text string, toxicity_verdict string")
    kept = toxicity.keep_civil(df, tagger[2])
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]


# -- language ---------------------------------------------------------------------


def test_codewords_are_apart():
    for n in (1, 2, 3, 4, 7, 8, 30):
        code = langid.codewords(n).astype(int)
        assert code.shape[0] == n and len({tuple(r) for r in code}) == n
        if n > 2:
            apart = min((a != b).sum() for i, a in enumerate(code) for b in code[:i])
            assert apart >= code.shape[1] // 4
            assert all(len(set(c)) == 2 for c in code.T)


def test_word_sums_equal_whole_texts():
    rng = np.random.default_rng(6)
    model = langid.LanguageModel(("a", "b", "c"), langid.codewords(3), rng.normal(size=(langid.BUCKETS, 3)).astype(np.float32), rng.normal(size=3))
    scorer = langid.LanguageScorer(model)
    for _, text, *_ in odd_documents():
        lang, score, _ = scorer.score(text)
        share = langid.profile(text or "")
        if not share.any():
            assert (lang, score) == ("und", 0.0)
            continue
        margins = share.astype(float) @ model.weights + model.bias
        loss = [sum(np.log1p(np.exp(-c * m)) for c, m in zip(row, margins, strict=True)) for row in model.code.astype(float)]
        assert lang == model.languages[int(np.argmin(loss))]


def test_no_letters_or_languages(spark):
    rows = [(k, t, "en", "s", 0) for k, t in enumerate([None, "", "12 3!", "²", "an on"])]
    found = {r.doc_id: r for r in langid.language_report(documents(spark, rows)).collect()}
    assert [found[k].lang_pred for k in range(4)] == ["und"] * 4 and found[4].lang_pred == "en"
    bare = langid.language_report(documents(spark, [(1, "an on", None, None, 1)])).collect()
    assert [(r.lang_pred, r.score) for r in bare] == [("und", 0.0)]
    assert langid.language_report(documents(spark, [])).count() == 0


def test_odd_documents_get_languages(spark):
    found = langid.language_report(documents(spark)).collect()
    assert len(found) == len(odd_documents()) and all(0 <= r.score <= 1 for r in found)
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)


def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{LARGE}/documents.parquet")
    found = langid.language_report(docs)
    held = found.filter("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    right = held.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.99


def test_ambiguous_texts_are_flagged():
    code = langid.codewords(4)
    model = langid.LanguageModel(("a", "b", "c", "d"), code, np.zeros((langid.BUCKETS, 7), np.float32), np.zeros(7))
    scorer = langid.LanguageScorer(model)
    assert scorer.decode(4.0 * code[2].astype(float))[0::2] == ("c", False)
    assert scorer.decode(np.zeros(7))[2]
