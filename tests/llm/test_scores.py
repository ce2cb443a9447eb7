"""Whole results of the scoring operators against plain loops."""

import math
import random
import re

import numpy as np
import pytest

from strandline.llm import langid, toxicity

from .common import documents, odd_documents, words

M64 = (1 << 64) - 1


def odd_texts(rng):
    texts = [t for _, t, *_ in odd_documents()]
    texts += ["İİİ bad, BADİ worse...\nnext line! (bad)", "bad" * 300, "x\ty  bad worse,bad/good", "b@d w*rse " * 40]
    return texts + [" ".join(rng.choices(["bad", "worse", "good", "so-so", "fine.", "Bad!", "\n"], k=rng.randint(1, 1500))) for _ in range(12)]


# -- toxicity -----------------------------------------------------------------------


def bucket(h, kind):
    h = (h + kind) * 0x9E3779B97F4A7C15 & M64
    h ^= h >> 32
    return (h * 0xD6E8FEB86659FD93 & M64) >> 48


def plain_features(word):
    p, codes, marked = 0x9E3779B97F4A7C55, list(map(ord, word)), list(map(ord, f"<{word}>"))
    if not word:
        return []
    power = [pow(p, k + 1, 1 << 64) for k in range(len(marked))]
    out = [bucket(sum(c * power[k] for k, c in enumerate(marked)) & M64, 1)]
    for k in range(3, min(8, len(codes)) + 1):
        out.append(bucket(sum(c * power[j + 1] for j, c in enumerate(codes[:k])) & M64, 2 * k))
    for k in range(len(marked) - 3):
        a, b, c, d = marked[k : k + 4]
        out.append(bucket((a * power[0] + b * power[1] + c * power[2] + d * 0x165667B19E3779F9) & M64, 3))
    return out


def test_features_by_hand():
    rng = random.Random(7)
    some = ["", "a", "ab", "abc", "日本語です", "ünïcödé", "😀" * 12, *("".join(rng.choices("abé日", k=rng.randint(1, 30))) for _ in range(200))]
    owner, found = toxicity.feature_arrays(some)
    for k, w in enumerate(some):
        assert sorted(found[owner == k].tolist()) == sorted(plain_features(w))
    assert all(len(x) == 0 for x in toxicity.feature_arrays(["", ""]))


def plain_marginals(emission, trans):
    """By sums over all labelings' prefixes and suffixes, one token at a time."""
    ct, tc, tt = trans
    step = {(0, 0): 0.0, (0, 1): ct, (1, 0): tc, (1, 1): tt}
    add = lambda x, y: max(x, y) + math.log1p(math.exp(-abs(x - y)))
    at = lambda t, s: emission[t] * s
    n = len(emission)
    ahead = [[at(0, 0), at(0, 1)]]
    for t in range(1, n):
        ahead.append([add(ahead[-1][0] + step[0, s], ahead[-1][1] + step[1, s]) + at(t, s) for s in (0, 1)])
    behind = [[0.0, 0.0]]
    for t in range(n - 1, 0, -1):
        behind.append([add(step[s, 0] + at(t, 0) + behind[-1][0], step[s, 1] + at(t, 1) + behind[-1][1]) for s in (0, 1)])
    behind.reverse()
    z = add(*ahead[-1])
    return [math.exp(min(0.0, ahead[t][1] + behind[t][1] - z)) for t in range(n)]


def plain_score(model, text):
    tokens = [c[a:b] for c in toxicity.blank_chunks(text) for a, b in toxicity.places(c)]
    chains, now = [], []
    for t in tokens:
        if now and (len(now) == toxicity.CHAIN or t.startswith("\n")):
            chains.append(now)
            now = []
        now.append(t)
        if t and t[-1] in ".!?":
            chains.append(now)
            now = []
    p = []
    for chain in [*chains, now] if now else chains:
        p += plain_marginals([float(sum(model.weights[f] for f in plain_features(toxicity.core(t)))) + model.bias for t in chain], model.trans)
    a, b, c = model.head
    x = a + b * math.log1p(sum(q for q in p if q >= 0.5)) + c * max(p)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x)))), [toxicity.core(t) for t, q in zip(tokens, p, strict=True) if q >= 0.5]


def test_scores_by_brute_force(spark):
    rng = random.Random(8)
    weights = np.random.default_rng(2).normal(0, 0.05, toxicity.BUCKETS).astype(np.float32)
    for w in ("bad", "worse", "b@d", "w*rse"):
        weights[plain_features(w)] += 1.5
    model = toxicity.ToxicModel(weights, -4.0, (-1.0, 0.5, 1.0), (-3.0, 2.0, 3.0))
    texts = [t for t in odd_texts(rng) if t is None or len(t) < 20_000]
    df = documents(spark, [(k, t, "en", "s", 0) for k, t in enumerate(texts)])
    found = {r.doc_id: r.toxicity for r in toxicity.with_toxicity(df, model).collect()}
    for k, text in enumerate(texts):
        score, offending = plain_score(model, text or "")
        # Chains without a likely token are taken for clean: 2e-5 at most in the largest marginal.
        assert found[k].score == pytest.approx(score, abs=1e-4), text
        spans = [(s.start, s.end) for s in found[k].spans]
        assert all(a < b for a, b in spans) and spans == sorted(spans)
        for a, b in spans:
            assert (text[a:b] == text[a:b].strip(toxicity.EDGES)) and any(toxicity.core(text[a:b]) in (o, toxicity.core(o)) or o in text[a:b].lower() for o in offending)
        assert bool(spans) == bool([o for o in offending if o])
    assert {r.score >= 0.7 for r in found.values()} == {True, False}


def test_toxic_words_count_wherever_they_are(spark):
    """Behind 40 letters of a token, and learned from a document of over 20,000 characters."""
    rng = random.Random(15)
    clean = [words(rng, 60) for _ in range(300)]
    toxic = [words(rng, 30) + " vilegrum " + words(rng, 30) for _ in range(60)]
    toxic += [words(rng, 3000) + " vilegrum " + words(rng, 3000) for _ in range(3)]
    assert all(len(t) > 20_000 for t in toxic[-3:])
    texts = clean + toxic
    docs = documents(spark, [(k, t, "en", "s", 0) for k, t in enumerate(texts)])
    labels = spark.createDataFrame([(k, None, int(k >= len(clean))) for k in range(len(texts))], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels, folds=1, held=1)
    scorer = toxicity.ToxicScorer(model)
    ends = [words(rng, 20), words(rng, 20) + " " + "-".join(["anti"] * 12) + "-vilegrum", words(rng, 20) + " " + "/".join(["www"] * 15) + "/vilegrum"]
    scores = [s for s, _ in scorer.score_all(ends)]
    assert scores[0] < 0.5 < min(scores[1:])
    assert scorer.score_all([toxic[-1]])[0][0] > 0.5
    assert toxicity.within([5, 9, 3, 2], 10) == [0, 2, 3]


# -- languages ------------------------------------------------------------------------


def plain_language(model, text):
    total, n = np.zeros(model.weights.shape[1]), 0
    primes = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)

    def add(h):
        nonlocal total, n
        h = (h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 & M64
        total = total + model.weights[(h >> 40) % langid.BUCKETS]
        n += 1

    for word in re.split("[ \n]", (text or "").lower()):
        form = " " + " ".join(langid.LETTERS.findall(word)) + " "
        codes = list(map(ord, form))
        for k, c in enumerate(codes):
            pair = codes[k : k + 2]
            if c > 32:
                add(c * primes[0] & M64)
            if len(pair) == 2 and max(pair) > 32:
                add(pair[0] * primes[0] + pair[1] * primes[1] + 7 & M64)
            if k + 2 < len(codes) and codes[k + 1] > 32:
                add(c * primes[0] + codes[k + 1] * primes[1] + codes[k + 2] * primes[2] + 13 & M64)
    if not n or not langid.LETTERS.search(text or ""):
        return "und", 0.0
    margins = total / n + model.bias
    loss = [sum(math.log1p(math.exp(-float(b) * m)) for b, m in zip(code, margins, strict=True)) for code in model.code]
    best = min(range(len(loss)), key=loss.__getitem__)
    return model.languages[best], 1 / sum(math.exp(loss[best] - x) for x in loss)


def test_languages_by_brute_force(spark):
    rng = random.Random(10)
    stems = {"en": "the and of ing", "fr": "le été ça oui", "de": "und ß über ein", "ja": "日本 語 です ます"}
    texts = [(lang, " ".join(rng.choices(stem.split(), k=30))) for lang, stem in stems.items() for _ in range(40)]
    docs = documents(spark, [(k, t, lang, "s", 0) for k, (lang, t) in enumerate(texts)])
    model = langid.train(docs)
    odd = [t for t in odd_texts(rng) if t is None or len(t) < 20_000] + ["été" * 400, "1 2 3", "の" * 1000 + "ab"] + [t for _, t in texts[::9]]
    df = documents(spark, [(k, t, None, None, 0) for k, t in enumerate(odd)])
    found = {r.doc_id: r.language for r in langid.with_language(df, model).collect()}
    for k, text in enumerate(odd):
        lang, score = plain_language(model, text)
        assert found[k].lang == lang and found[k].score == pytest.approx(score, abs=1e-5), text
