"""Secrets, whitening and spelling variants against plain versions of themselves."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import automaton, quality, secrets, variants, whitening

from .common import SCHEMA, documents, odd_documents

EITHER = "".join  # keywords in either case, spelled out so that no other letters match


def any_case(word):
    return EITHER(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


ASSIGN = re.compile("(?:" + "|".join(map(any_case, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
PLAIN = [("assign", ASSIGN, 6), ("access", re.compile("(AKIA[A-Z0-9]+)"), 20), ("hex", re.compile("([0-9a-f]+)"), 24)]


def plain_spans(text):
    found = [(m.start(), r, m.end(), kind) for r, (kind, p, least) in enumerate(PLAIN) for m in p.finditer(text or "") if len(m.group(1)) >= least]
    return [(kind, a, e) for a, _, e, kind in sorted(found)]


PARTS = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "=", ":", " ", "  ", '"', "'", "AKIA", "AKIA", "ABCDEF0123456789", "0123abcdef", "deadbeef" * 3, "x", "é", "日", "\n", "abc", "tokentoken", "/", "==", "ab12ab12", "AKI", "ſecret", "\x00"]


def secret_texts(n=300, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choices(PARTS, k=rng.randint(0, rng.choice([5, 60, 400])))) for _ in range(n)]


def test_spans_are_those_of_the_rules():
    scanner = secrets.Scanner()
    texts = [*secret_texts(), None, "", "a" * 700_000 + " AKIA" + "B" * 300_000 + "\n" + "0f" * 200_000, "password=" * 3000]
    for text, spans in zip(texts, scanner.spans(texts), strict=True):
        assert [s for s in spans if s[0] in ("assign", "access", "hex")] == plain_spans(text)


def test_blocks_and_stretches_dont_show(monkeypatch):
    text = "".join(secret_texts(40, 3))
    want = secrets.Scanner().spans([text, "x", text])
    monkeypatch.setattr(secrets, "BLOCK", 512)
    assert secrets.Scanner().spans([text, "x", text]) == want and len(want[0]) > 20


def test_more_kinds_and_masks(spark):
    jwt = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmN"
    texts = ["é ghp_" + "a1B2" * 9 + " end", jwt, "-----BEGIN RSA PRIVATE KEY-----", "see http://me:pa55@host/", "AIza" + "x" * 35 + ".", "xoxb-123-456-abcdef", "ghp_short", "token=abcdefgh tail"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r.secrets for r in secrets.with_secrets(df, mask=True).collect()}
    assert [[s.kind for s in got[k].spans] for k in range(8)] == [["github"], ["jwt"], ["private_key"], ["login"], ["google"], ["slack"], [], ["assign"]]
    assert got[0].masked == "é [github] end" and got[3].masked == "see [login]host/" and got[6].masked == "ghp_short"
    assert secrets.masked("abcdef", [("p", 1, 4), ("q", 2, 5)]) == "a[p]f"


def test_secret_report(spark):
    rows = [(k, t, None, None, None) for k, t in enumerate(secret_texts(60, 5))]
    rows += [rows[0], *odd_documents()]
    got = sorted(map(tuple, secrets.secret_report(documents(spark, rows)).collect()), key=repr)
    want = []
    for doc, text, *_ in rows:
        spans = plain_spans(text)
        line = ",".join(f"{k}:{a}:{e}" for k, a, e in spans)
        n = Counter(k for k, _, _ in spans)
        want.append((doc, n["assign"], n["access"], n["hex"], hashlib.sha256(line.encode()).hexdigest(), line))
    assert got == sorted(want, key=repr)
    assert secrets.secret_report(documents(spark, [])).count() == 0


def test_automata_match_like_re():
    rng = random.Random(2)
    for pattern in ("a(b|c)*d", "(ab){2,3}c?", "x?y+z{2}", "[a-c]+\\.[b-d]{1,2}", "(?i:aB)c|ca*b"):
        found = automaton.compile_patterns([automaton.PatternReader(pattern).tree()], anchored=True)
        for _ in range(300):
            text = "".join(rng.choices("abcdxyzAB.", k=rng.randint(1, 8))).encode()
            state = 0
            for b in text:
                state = found.rows[state][b]
            assert (state >= found.first_out) == bool(re.fullmatch(pattern.encode(), text)), (pattern, text)
    for bad in ("a(b", "a)", "[^a]", "a|", "a{2,1}", ".", "\\d"):
        with pytest.raises(ValueError):
            automaton.compile_patterns([automaton.PatternReader(bad).tree()], anchored=True)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, extra string")


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 20)) @ rng.normal(size=(20, 20))
    rows = [(k, [float(x) for x in v], "e") for k, v in enumerate(base)]
    rows += [rows[5]] * 200 + [(900, None, "e"), (901, [1.0, None], "e"), (902, [float("nan")] * 20, "e"), (903, [float("inf")] * 20, "e"), (904, [], "e"), (905, [1.0, 2.0], "e"), (None, rows[7][1], "e")]
    df = vectors(spark, rows).repartition(5)
    got = whitening.whitening_report(df).collect()
    used = [r for r in rows if r[1] and len(r[1]) == 20 and all(x is not None and np.isfinite(x) for x in r[1])]
    x = lambda v: [int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v]
    fit = np.array(sorted({tuple(x(r[1])) for r in used}), np.int64)
    n, total = len(fit), fit.sum(axis=0)
    apart = fit - total / n
    v = apart.T @ apart / n
    e, w = np.linalg.eigh(v)
    e, w = e[::-1], w[:, ::-1]
    assert len(got) == 16 * len(used) and n == 300
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), r)
    signs = {}
    for r in used:
        whole = [n * a - int(s) for a, s in zip(x(r[1]), total, strict=True)]
        white = (np.array(x(r[1])) - total / n) @ w / np.sqrt(e)
        for k in range(16):
            row = by[r[0], k + 1]
            assert row.n == n and row.deviation == sum(a * a for a in whole)
            signs.setdefault(k, np.sign(row.whitened * white[k]))
            assert row.whitened == pytest.approx(signs[k] * white[k], abs=1e-6)
            assert row.explained == pytest.approx(e[k] / np.trace(v), rel=1e-9) and row.identity_error < 1e-9


def test_whitening_of_odd_tables(spark):
    assert whitening.whitening_report(vectors(spark, [])).count() == 0
    assert whitening.whitening_report(vectors(spark, [(1, None, "e"), (2, [], "e")])).count() == 0
    same = whitening.whitening_report(vectors(spark, [(1, [1.0, 2.0], "e")] * 3)).collect()
    assert len(same) == 6 and all((r.whitened, r.explained, r.identity_error, r.deviation) == (None, None, None, 0) for r in same)
    flat = whitening.whitening_report(vectors(spark, [(k, [float(k), 2.0], "e") for k in range(5)])).collect()
    assert {(r.component, r.whitened is None) for r in flat} == {(1, False), (2, True)} and flat[0].identity_error < 1e-12
    huge = whitening.whitening_report(vectors(spark, [(1, [3e38], "e"), (2, [-3e38], "e"), (3, [0.0], "e")])).collect()
    assert [r.deviation for r in huge if r.vec_id == 1] == [None]
    two = vectors(spark, [(1, [1.0, 2.0], "e"), (2, [0.0, 1.0], "e"), (3, [1.0], "e")])
    assert {r.vec_id for r in whitening.whitening_report(two).collect()} == {1, 2}
    model = whitening.fit_whitening(two)
    with pytest.raises(ValueError, match="extra"):
        whitening.with_whitened(two, model, out="extra")


def test_moments_merge():
    rng = np.random.default_rng(4)
    x = rng.integers(-500, 500, size=(1000, 7))
    merged = whitening.Moments.of(x[:1])
    for a, b in ((1, 2), (2, 300), (300, 1000)):
        merged = merged.merged(whitening.Moments.of(x[a:b]))
    apart = x - x.mean(axis=0)
    assert merged.n == 1000 and merged.total == x.sum(axis=0).tolist()
    assert np.allclose(merged.scatter, apart.T @ apart, rtol=1e-12) and np.allclose(merged.mean, x.mean(axis=0))


def near_by_rule(a, b):
    if a == b:
        return False
    short, long = sorted((a, b), key=len)
    if len(short) == len(long):
        return sum(p != q for p, q in zip(a, b, strict=True)) == 1
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def plain_variants(rows):
    n = Counter()
    for doc, text, *_ in rows:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[a-zÀ-ÿ]+", lowered):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= 6:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= 5}
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and near_by_rule(v, w)] for w in n}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def edited_texts(seed=7):
    """Texts of words and their edits, some much rarer than others."""
    rng = random.Random(seed)
    letters = "abcdeéàÿz"
    words = ["".join(rng.choices(letters, k=rng.choice([6, 6, 7, 8, 12, 40]))) for _ in range(60)] + ["aaaaaaa", "aaaaaaaa", "abababab", "bababab"]
    for w in list(words):
        for _ in range(6):
            k = rng.randrange(len(w))
            words.append(w[:k] + rng.choice(["", rng.choice(letters), rng.choice(letters) + w[k]]) + w[k + 1 :])
    bag = [w for w in words for _ in range(rng.choice([3, 5, 6, 30, 160, 900]))]
    rng.shuffle(bag)
    return [(k, " ".join(x.upper() if rng.random() < 0.1 else x for x in bag[k * 200 : k * 200 + 200]), None, None, None) for k in range(len(bag) // 200 + 1)]


@pytest.mark.parametrize("largest", [400, 3, 1])
def test_variants_against_all_pairs(spark, largest):
    rows = [*edited_texts(), *odd_documents()]
    rows += [rows[0], (None, rows[1][1], None, None, None)]
    want = plain_variants(rows)
    got = variants.variant_report(documents(spark, rows), largest=largest)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == want
    assert sum(r[1] is not None for r in want) > 20 and any(r[2] != (r[1] or r[0]) for r in want)


def test_variants_of_groups_that_share_much(spark):
    """Words that are all one pattern but for few letters: the groups are dealt on to the last place."""
    rng = random.Random(8)
    words = {"q" * 12 + "".join(rng.choices("abcdefgh", k=3)) + "q" * 9 for _ in range(150)} | {"q" * k for k in range(6, 40)}
    df = spark.createDataFrame([(w, rng.randint(5, 500)) for w in words], "word string, n long")
    pairs = {tuple(sorted((r.a, r.b))) for r in variants.near_pairs(df, 10).collect()}
    listed = sorted(words)
    assert pairs == {(a, b) for k, a in enumerate(listed) for b in listed[k + 1 :] if near_by_rule(a, b)}
    assert variants.near_pairs(df, 10).count() == len(pairs)


def test_variants_of_nothing(spark):
    assert variants.variant_report(documents(spark, [])).count() == 0
    assert variants.variant_report(documents(spark, [(1, None, None, None, None), (2, "short words only", None, None, None)])).count() == 0


def test_result_columns_dont_replace_the_tables(spark):
    df = documents(spark).withColumn("Quality", F.lit(7))
    with pytest.raises(ValueError, match="quality"):
        quality.with_quality(df)
    assert quality.keep_good(df).columns == [*(f.split(" ")[0] for f in SCHEMA.split(", ")), "Quality"]
