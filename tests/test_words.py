"""K-mers counted, sieved and picked block by block: against brute force, and without a row for each k-mer."""

import random
from collections import Counter

import pytest

from strandline.functions import bases
from strandline.operators import kmers, words

from .shuffled import shuffled_mb

COMPLEMENT = str.maketrans(bases.FROM_BASES, bases.TO_BASES)


def texts(letters, n, longest, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choices(letters, k=rng.randint(0, longest))) for _ in range(n)]


def rare_by_hand(rows, k, most):
    found = {}
    for name, text in rows:
        found.setdefault(name, Counter()).update(text[i : i + k] for i in range(len(text or "") - k + 1))
    return {name: n for name, c in found.items() if (n := sum(v <= most for v in c.values()))}


@pytest.mark.parametrize("most", [1, 2])
def test_rare_numbers(spark, most, monkeypatch):
    rows = list(enumerate(texts("abé𝄞", 60, 120))) + [(3, "abababab"), (None, "aab"), (None, "baa"), (70, None), (71, ""), (72, "ab" * 90)]
    seqs = spark.createDataFrame(rows, "seq_id long, seq string")
    for whole in (40, 1 << 19):
        assert {r.seq_id: r.n_rare for r in kmers.rare_numbers(seqs, 3, most, whole=whole).collect()} == rare_by_hand(rows, 3, most)
    # Hashes that collide are found out.
    (block,) = words.blocks([t for _, t in rows], 0)
    expected = words.rare_numbers(block, 3, most).tolist()
    monkeypatch.setattr(words, "hashes", lambda codes, k: (codes[: len(codes) - k + 1] % 2).astype("u8"))
    assert words.rare_numbers(block, 3, most).tolist() == expected


def test_rare_numbers_shuffle_no_kmers(spark):
    seqs = spark.createDataFrame(list(enumerate(texts("acgt ", 100, 4000))), "seq_id long, seq string").repartition(4).localCheckpoint()
    assert shuffled_mb(spark, kmers.rare_numbers(seqs, 24)) < 0.1


def test_likely_loses_no_wanted_kmer(spark, monkeypatch):
    monkeypatch.setattr(words, "BLOCK", 64)
    rows = list(enumerate(texts("abcdé𝄞", 40, 300, 2))) + [(50, None), (51, ""), (1, "again")]
    seqs, other = spark.createDataFrame(rows, "seq_id long, seq string"), spark.createDataFrame([(1, rows[3][1] + rows[7][1]), (2, "é𝄞a")], "seq_id long, seq string")
    every, wanted = kmers.kmers(seqs, 4), kmers.kmers(other, 4)
    some = kmers.likely(seqs, 4, wanted)
    assert sorted(map(tuple, kmers.positions_of(some, wanted).collect())) == sorted(map(tuple, kmers.positions_of(every, wanted).collect()))
    assert set(map(tuple, some.collect())) <= set(map(tuple, every.collect()))
    assert kmers.likely(seqs, 4, wanted.limit(0)).count() == 0


def test_likely_makes_few_rows(spark):
    seqs = spark.createDataFrame(list(enumerate(texts("abcdefgh", 50, 4000, 3))), "seq_id long, seq string")
    wanted = kmers.kmers(spark.createDataFrame(list(enumerate(texts("abcdefgh", 20, 400, 4))), "seq_id long, seq string"), 12)
    assert kmers.likely(seqs, 12, wanted).count() < 0.02 * kmers.kmers(seqs, 12).count()


def minimizers_by_hand(text, k, w, strands):
    found = [text[i : i + k] for i in range(len(text) - k + 1)]
    found = [min(x, x.translate(COMPLEMENT)[::-1]) if strands else x for x in found]
    picks = {min(range(p, min(p + w, len(found))), key=lambda i: (found[i], i)) for p in range(max(1, len(found) - w + 1))} if found else set()
    out, before = [], None
    for p in sorted(picks):
        if found[p] != before:
            out.append((p, found[p]))
        before = found[p]
    return out


@pytest.mark.parametrize("letters, k, w, strands, block", [("ACGT", 13, 10, True, 1 << 18), ("ACGT", 3, 4, True, 50), ("ACGTNacgt-", 5, 2, True, 37), ("aé𝄞xyzuvw", 20, 7, False, 90), ("ab", 1, 9, False, 64), ("ACGTNRY", 31, 12, True, 100)])
def test_minimizers_block_by_block(spark, monkeypatch, letters, k, w, strands, block):
    some = texts(letters, 40, 400, k) + ["", letters[0] * (k + 1), letters[:2] * 200]
    for most in {block, 1 << 18}:
        found = [[] for _ in some]
        for b in words.blocks(some, k + w - 2, gap=w, most=most, early=1):
            piece, at = words.minimizers(b, k, w, strands)
            for row, pos, word in zip(b.rows[piece].tolist(), (b.starts[piece] + at - b.at[piece]).tolist(), b.words(at, k).to_pylist(), strict=True):
                found[row].append((pos, min(word, word.translate(COMPLEMENT)[::-1]) if strands else word))
        assert found == [minimizers_by_hand(t, k, w, strands) for t in some]


def test_minimizers_shuffle_nothing(spark):
    rows = list(enumerate(texts("ACGT", 100, 4000, 5))) + [(200, None)]
    seqs = spark.createDataFrame(rows, "seq_id long, seq string").repartition(4).localCheckpoint()
    picked = kmers.minimizers(seqs, 13, 10)
    assert shuffled_mb(spark, picked) < 0.1
    assert sorted(map(tuple, picked.collect())) == [(n, *x) for n, t in rows for x in minimizers_by_hand(t or "", 13, 10, True)]
