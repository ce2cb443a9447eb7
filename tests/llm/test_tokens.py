"""Token counts and the piece codec against their libraries; packing as a whole."""

import random
import time
import zlib
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2
from tokenizers import Tokenizer

from strandline.llm import packing, sp_codec, token_counts

from .common import documents, odd_documents

BYTES = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
WORDS = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
PIECES = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
TEXT = st.text(st.sampled_from(list("aBcdeé'sItl .,\n\t-#19<|>İΣ　▁\x01\x1c日😀")) | st.characters(codec="utf-8"), max_size=60)
SPECIAL = st.lists(TEXT | st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<s>", "<0x41>", "  ", "'ll"]), max_size=6).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(SPECIAL, min_size=1, max_size=4))
def test_counts_equal_the_library(texts):
    assert token_counts.counter(None).count(texts) == [len(e.ids) for e in BYTES.encode_batch(texts)]


def test_overlapping_pairs_and_long_words():
    texts = ["a" * n for n in (1, 2, 3, 7, 1000)] + ["abab" * 300, "xyz" * 2000, "é" * 501]
    assert token_counts.counter(None).count(texts) == [len(e.ids) for e in BYTES.encode_batch(texts)]


def test_token_report(spark):
    found = token_counts.token_report(documents(spark)).collect()
    want = [(d, len((t or "").encode()), n := len(BYTES.encode(t or "").ids), n > 512) for d, t, *_ in odd_documents()]
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)


@settings(max_examples=300, deadline=None)
@given(SPECIAL)
def test_pieces_equal_the_library(text):
    c = sp_codec.codec(None)
    ids, begins, ends = c.encode(text)
    assert ids.tolist() == PIECES.encode(text)
    assert c.decode(ids.tolist()) == c.decode_fast(ids) == PIECES.decode(PIECES.encode(text))
    if len(ids):
        assert begins[0] == 0 and ends[-1] == len(text.encode()) and (begins[1:] == ends[:-1]).all()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 31_999) | st.integers(0, 270), max_size=12))
def test_any_ids_decode_like_the_library(ids):
    c = sp_codec.codec(None)
    assert c.decode(ids) == c.decode_fast(np.array(ids, np.int32)) == PIECES.decode(ids)


def trained_like(rules: str, **fields):
    """The installed model with another normaliser, and the library over it."""
    model = sentencepiece_model_pb2.ModelProto()
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model.ParseFromString(f.read())
    model.normalizer_spec.name = rules
    for name, value in fields.items():
        setattr(model.normalizer_spec, name, value)
    return model


def double_array(table: dict[bytes, bytes]) -> bytes:
    """A compiled character map for a few keys: units placed by first fit."""
    pool, values = b"", {}
    for key, new in table.items():
        values[key] = len(pool)
        pool += new + b"\0"
    tree: dict = {}
    for key in table:
        node = tree
        for b in key:
            node = node.setdefault(b, {})
        node[None] = values[key]
    units = {0: 0}
    taken = {0}

    def place(at: int, node: dict) -> None:
        marks = [0 if b is None else b for b in node]
        offset = next(o for o in range(1, 1 << 16) if all(at ^ o ^ b not in taken for b in marks) and o < 1 << 20)
        units[at] = units.get(at, 0) | offset << 10 | (1 << 8 if None in node else 0)
        base = at ^ offset
        taken.update(base ^ b for b in marks)
        for b, child in node.items():
            if b is None:
                units[base] = child | 1 << 31
            else:
                units[base ^ b] = b
        for b, child in node.items():
            if b is not None:
                place(base ^ b, child)

    place(0, tree)
    array = [units.get(k, 0) for k in range((max(taken) | 255) + 1)]
    blob = np.array(array, "<u4").tobytes()
    return len(blob).to_bytes(4, "little") + blob + pool


MAP = {"ﬁ".encode(): b"fi", "Ａ".encode(): b"A", "Ａ゛".encode(): b"B", "\t".encode(): b" ", "é".encode(): "e".encode(), "­".encode(): b""}


@pytest.mark.parametrize("fields", [{}, {"remove_extra_whitespaces": True}, {"remove_extra_whitespaces": True, "add_dummy_prefix": False}, {"add_dummy_prefix": False}])
@pytest.mark.parametrize("mapped", [False, True])
def test_normalisation_with_a_character_map(fields, mapped):
    model = trained_like("own", **fields, **({"precompiled_charsmap": double_array(MAP)} if mapped else {}))
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    c = sp_codec.PieceCodec.from_proto(model)
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice(["a", "ﬁ", "Ａ", "゛", " ", "  ", "\t", "é", "\xad", "the", "日", "\n", "▁"]) for _ in range(rng.randint(0, 14)))
        ids, begins, ends = c.encode(text)
        assert ids.tolist() == library.encode(text), repr(text)
        assert c.decode(ids.tolist()) == library.decode(ids.tolist()), repr(text)
        assert (begins <= ends).all() and (not len(ids) or ends[-1] <= len(text.encode()))


def test_longest_prefix_wins():
    norm, origin = sp_codec.PieceCodec.from_proto(trained_like("own", precompiled_charsmap=double_array(MAP))).normalise("xＡ゛ﬁ")
    assert norm.decode() == "▁xBfi"
    assert origin.tolist() == [0, 0, 0, 0, 1, 7, 7, 10]


def test_codec_report(spark):
    found = sp_codec.codec_report(documents(spark)).collect()
    want = []
    for d, t, *_ in odd_documents():
        ids = PIECES.encode(t or "")
        want.append((d, len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256(PIECES.decode(ids).encode()).hexdigest(), len((t or "").encode())))
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)


def test_pieces_as_columns(spark):
    df = spark.createDataFrame([(1, "été ab", "mine"), (2, None, "x")], "id int, text string, pieces string")
    out = sp_codec.with_decoded(sp_codec.with_pieces(df, "text", "p").withColumn("ids", F.col("p.ids")), "ids", "d").orderBy("id").collect()
    assert [r.d.text for r in out] == ["été ab", ""] and out[0].pieces == "mine"
    assert b"".join("été ab".encode()[a:b] for a, b in zip(out[0].p.begins, out[0].p.ends, strict=True)).decode() == "été ab"


@settings(max_examples=200, deadline=None)
@given(st.lists(SPECIAL, min_size=1, max_size=4))
def test_word_ids_equal_the_library(texts):
    found = [np.frombuffer(b, "<u4").tolist() for b in packing.tokenizer(None).encode(texts, 2)]
    assert found == [[*e.ids, 2] for e in WORDS.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_first_fit_decreasing(lengths):
    lengths = sorted(lengths, reverse=True)
    bins, offsets = packing.first_fit_decreasing(np.array(lengths, np.int64), 20)
    room: list[int] = []
    for n, b, o in zip(lengths, bins.tolist(), offsets.tolist(), strict=True):
        first = next((k for k, r in enumerate(room) if r >= n), len(room))
        if first == len(room):
            room.append(20)
        assert (b, o) == (first, 20 - room[first])
        room[first] -= n


@pytest.mark.parametrize("group", [4, 8192])
def test_packing_is_whole(spark, group):
    rows = [r.asDict() for r in packing.pack_documents(documents(spark), capacity=256, group_pieces=group).collect()]
    docs: dict = {}
    for d, t, *_ in odd_documents():
        ids = np.array([*WORDS.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        docs.setdefault(d, []).append(ids)
    want = sorted((d, a, len(part := ids[a : a + 256]), zlib.crc32(part.tobytes()), len(ids)) for d, copies in docs.items() if d is not None for ids in copies for a in range(0, len(ids), 256))
    assert sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows if r["doc_id"] is not None) == want
    assert sum(r["length"] for r in rows if r["doc_id"] is None) == sum(len(i) for i in docs[None])
    by_sequence: dict = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    if group > 1000:
        total = sum(r["length"] for r in rows)
        assert 1 - total / 256 / len(by_sequence) < 0.02


def test_empty_tables(spark):
    none = documents(spark, [])
    assert token_counts.token_report(none).count() == sp_codec.codec_report(none).count() == packing.pack_documents(none).count() == 0


def test_ids_can_be_kept(spark):
    rows = packing.token_pieces(documents(spark), 64, keep_ids=True).filter("doc_id = 0").collect()
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)


def test_long_pretokens_merge_as_the_library_does():
    rng = random.Random(21)
    count = token_counts.counter(None)
    texts = ["a" * n for n in (2049, 5000, 4097)] + ["ab" * 3001, "abc" * 2000 + "d", "日本" * 1500, "é" * 2500]
    texts += ["".join(rng.choices(a, k=rng.randint(2049, 9000))) for a in ("ab", "etaoinshr", "xyzé日") for _ in range(4)]
    assert count.count(texts) == [len(BYTES.encode(t, add_special_tokens=False).ids) for t in texts]
    began = time.perf_counter()
    long = "".join(rng.choices("etaoinshrdlu", k=400_000))
    assert count.count([long]) == [len(BYTES.encode(long, add_special_tokens=False).ids)]
    assert time.perf_counter() - began < 60


def test_both_ways_to_encode_give_equal_spans():
    """Words laid end to end, and the general path through ``normalise``."""
    rng = random.Random(22)
    codec = sp_codec.codec(None)
    texts = [" ".join("".join(rng.choices("abcdefgh é日😀.,-'1\n", k=rng.randint(1, 12))).replace(" ", "") or "x" for _ in range(rng.randint(1, 60))) for _ in range(300)]
    for text, fast in zip(texts, codec.encode_iter(texts), strict=True):
        for a, b in zip(fast, codec._encode_one(text), strict=True):
            assert a.tolist() == b.tolist(), text
