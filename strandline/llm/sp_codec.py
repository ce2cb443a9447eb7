"""Offset-preserving encoding and decoding with a piece (sentence-level BPE) model.

Normalisation looks up the longest prefix of what is left of the text in the
model's compiled character map (a double-array trie) and records, for each byte
of the result, the byte of the source it came from. Merging runs on the
normalised text; the record then projects every piece back to its span of
source bytes. Decoding joins the pieces, byte pieces included.

Models without a character map, as the installed one, need no look-up: there a text
of single blanks is cut into words and the words' pieces are laid end to end, with the
spans that the general path gives.

Nulls and empty texts have no ids and decode to an empty text. Repeated rows are
encoded alike, once each; an empty table gives no rows. A very long text is encoded
whole, in memory in proportion.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BoundedCache, add_struct, struct_array, worker_state
from .ragged import PairTable, merge_rows

#: The sign that stands for a blank in pieces. Fixed value.
BLANK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class CharacterMap:
    """A compiled character map: a double-array trie and a pool of replacements.

    Layout: the trie's size in bytes (little-endian, 32 bits), its units of 32
    bits each, then the replacements, each closed by a zero byte.
    """

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0]
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
        self.pool = blob[4 + size :]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """Replacement of the longest key that ``data`` has at ``at``, and the key's length."""
        node = self._offset(self.units[0])
        found = None
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != data[k]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = (self.units[node] & 0x7FFFFFFF, k + 1 - at)
        if found is None:
            return None
        value, n = found
        return self.pool[value : self.pool.index(b"\0", value)], n


class PieceCodec:
    """Encoder and decoder for a BPE piece model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        with open(path, "rb") as f:
            self._read(pb.ModelProto.FromString(f.read()))

    @classmethod
    def from_proto(cls, proto) -> PieceCodec:
        self = cls.__new__(cls)
        self._read(proto)
        return self

    def _read(self, model) -> None:
        if model.trainer_spec.model_type != 2:
            raise ValueError("only BPE piece models can be read")
        norm = model.normalizer_spec
        self.map = CharacterMap(norm.precompiled_charsmap) if norm.precompiled_charsmap else None
        self.dummy, self.trim, self.escape = norm.add_dummy_prefix, norm.remove_extra_whitespaces, norm.escape_whitespaces
        self.suffix = model.trainer_spec.treat_whitespace_as_suffix
        self.pieces = [p.piece for p in model.pieces]
        self.kinds = [p.type for p in model.pieces]
        if USER_DEFINED in self.kinds or UNUSED in self.kinds:
            raise ValueError("models with user-defined or unused pieces can't be read")
        self.ids = {p.piece: k for k, p in enumerate(model.pieces) if p.type == NORMAL}
        self.score = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.unknown = self.kinds.index(UNKNOWN)
        self.unk_surface = model.trainer_spec.unk_surface if model.trainer_spec.HasField("unk_surface") else " ⁇ "
        self.byte_ids = {int(p[1:-1], 16): k for k, p in enumerate(self.pieces) if self.kinds[k] == BYTE} if model.trainer_spec.byte_fallback else {}
        self.byte_of = {k: b for b, k in self.byte_ids.items()}
        longer = [p for p in self.ids if len(p) > 1]
        inside = {c for p in longer for c in p}
        # Blanks begin words in all pieces, and line ends join nothing: words can be merged one by one.
        self.by_word = not any(BLANK in p.lstrip(BLANK) for p in longer) and "\n" not in inside
        self.simple = self.by_word and self.map is None and self.dummy and self.escape and not self.trim and not self.suffix
        self.cache = BoundedCache()
        self._tables()

    def _tables(self) -> None:
        """Arrays for merging many words at once. Characters without a piece get symbols of their own."""
        size = len(self.pieces)
        self.symbol = np.full(0x110000, -1, np.int32)
        loose = sorted({c for p in self.ids for c in p if c not in self.ids})
        self.loose = dict(enumerate(loose, size))
        number = {**self.ids, **{c: k for k, c in self.loose.items()}}
        for c, k in number.items():
            if len(c) == 1:
                self.symbol[ord(c)] = k
        ranks = {s: k for k, s in enumerate(sorted(set(self.score.values()), reverse=True))}
        splits = [(p[:k], p[k:], p) for p in self.ids for k in range(1, len(p)) if p[:k] in number and p[k:] in number]
        self.pairs = PairTable([number[a] for a, _, _ in splits], [number[b] for _, b, _ in splits], [ranks[self.score[p]] for _, _, p in splits], [number[p] for _, _, p in splits])
        # Bytes of source that a piece stands for, where all blanks come from real ones.
        self.source_size = np.array([1 if k == BYTE else len(p.replace(BLANK, " ").encode()) for p, k in zip(self.pieces, self.kinds, strict=True)], np.int32)

    # -- normalisation ------------------------------------------------------------

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each of them (and the end) its source byte."""
        data = text.encode("utf-8")
        out, origin, at = bytearray(), [], 0
        blank = BLANK.encode() if self.escape else b" "

        def prefix(k: int) -> tuple[bytes, int]:
            hit = self.map.longest(data, k) if self.map else None
            if hit:
                return hit
            n = 1 if data[k] < 0x80 else 2 if data[k] < 0xE0 else 3 if data[k] < 0xF0 else 4
            return data[k : k + n], n

        if self.trim:
            while at < len(data):
                new, n = prefix(at)
                if new != b" ":
                    break
                at += n
        if at == len(data):
            return b"", np.zeros(1, np.int64)

        def put(piece: bytes, source: int) -> None:
            out.extend(piece)
            origin.extend([source] * len(piece))

        if self.dummy and not self.suffix:
            put(blank, at)
        after_blank = self.trim
        while at < len(data):
            new, n = prefix(at)
            if after_blank:
                new = new.lstrip(b" ")
            if new:
                put(new.replace(b" ", blank), at)
                after_blank = new.endswith(b" ")
            if not self.trim:
                after_blank = False
            at += n
        if self.trim:
            while out.endswith(blank):
                at = origin[len(out) - len(blank)]
                del out[-len(blank) :], origin[-len(blank) :]
        if self.dummy and self.suffix:
            put(blank, at)
        return bytes(out), np.array([*origin, at], np.int64)

    # -- merging ------------------------------------------------------------------

    def merge(self, text: str) -> list[str]:
        """Pieces of normalised text: the best-scoring pair first, the leftmost of equals."""
        part = list(text)
        score = self.score.get
        if len(part) > 48:
            return self._merge_long(part)
        pair = [score(a + b) for a, b in zip(part, part[1:])]
        while True:
            best, at = None, -1
            for k, s in enumerate(pair):
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                return part
            part[at : at + 2] = [part[at] + part[at + 1]]
            del pair[at]
            if at < len(pair):
                pair[at] = score(part[at] + part[at + 1])
            if at:
                pair[at - 1] = score(part[at - 1] + part[at])

    def _merge_long(self, part: list[str]) -> list[str]:
        n = len(part)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue: list[tuple[float, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (s := self.score.get(part[a] + part[b])) is not None:
                heapq.heappush(queue, (-s, a, part[a] + part[b]))

        for k in range(n - 1):
            offer(k, k + 1)
        while queue:
            _, a, whole = heapq.heappop(queue)
            b = after[a]
            if not part[a] or b < 0 or part[a] + part[b] != whole:
                continue
            part[a], part[b] = whole, ""
            after[a] = after[b]
            if after[b] >= 0:
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [p for p in part if p]

    def _to_ids(self, pieces: list[str]) -> tuple[list[int], list[int]]:
        """Ids, and the length of each one's piece in bytes of normalised text."""
        ids, sizes = [], []
        for p in pieces:
            known = self.ids.get(p)
            if known is not None:
                ids.append(known)
                sizes.append(len(p.encode()))
            elif self.byte_ids:
                raw = p.encode()
                ids += [self.byte_ids[b] for b in raw]
                sizes += [1] * len(raw)
            elif ids and ids[-1] == self.unknown:
                sizes[-1] += len(p.encode())
            else:
                ids.append(self.unknown)
                sizes.append(len(p.encode()))
        return ids, sizes

    # -- encoding -----------------------------------------------------------------

    def encode_iter(self, texts: list[str | None], block_chars: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text in turn: ids, with the first and the end byte of each one's source span."""
        block: list[str] = []
        held = 0
        for text in texts:
            block.append(text or "")
            held += len(block[-1])
            if held >= block_chars:
                yield from self._encode_block(block)
                block, held = [], 0
        yield from self._encode_block(block)

    def _encode_block(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        split = [t.replace("\n", " \n").split(" ") if t and self.simple and BLANK not in t else None for t in texts]
        split = [None if words is None or "" in words else words for words in split]
        cache = self.cache
        cache.make_room()
        new = cache.missing(chain.from_iterable(filter(None, split)))
        self.learn(new)
        for text, words in zip(texts, split, strict=True):
            if words is None:
                yield self._encode_one(text)
                continue
            ids = np.frombuffer(b"".join(map(cache.__getitem__, words)), "<i4")
            sizes = self.source_size[ids]
            ends = np.cumsum(sizes, dtype=np.int32) - np.int32(1)  # the blank in front has no source byte
            begins = ends - sizes
            begins[0] = 0
            yield ids, begins, ends
        cache.entered(new)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return next(self.encode_iter([text]))

    def _encode_one(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not text:
            none = np.zeros(0, np.int32)
            return none, none, none
        norm, origin = self.normalise(text)
        words = re.findall(f"{BLANK}+[^{BLANK}\n]*|\n|[^{BLANK}\n]+", norm.decode()) if self.by_word else [norm.decode()]
        ids, sizes = self._to_ids([p for w in words for p in self.merge(w)])
        sizes = np.array(sizes, np.int64)
        ends = np.cumsum(sizes)
        begin, end = origin[ends - sizes], origin[ends]
        return np.array(ids, np.int32), begin.astype(np.int32), np.maximum(begin, end).astype(np.int32)

    def learn(self, words: list[str]) -> None:
        """Ids of new words: those that begin with a line end stand as they are, all others follow a blank."""
        short = []
        for w in words:
            if len(w) < 48:
                short.append(w)
            else:
                parts = ["\n", w[1:]] if w[0] == "\n" else [BLANK + w]
                self.cache[w] = np.array(self._to_ids([p for x in parts for p in self.merge(x)])[0], "<i4").tobytes()
        if not short:
            return
        forms = [w if w[0] == "\n" else BLANK + w for w in short]
        codes = np.frombuffer("".join(forms).encode("utf-32-le"), "<u4")
        start = self.symbol[codes]
        # Characters in no piece: a symbol below 0 that names the character and merges with nothing.
        start = np.where(start < 0, -1 - codes.astype(np.int64), start).astype(np.int64)
        sizes, symbols = merge_rows(start, np.fromiter(map(len, forms), np.int64, len(forms)), self.pairs, one_at_a_time=True, keep=True)
        ends = np.cumsum(sizes)
        odd = np.zeros(len(forms), bool)
        strange = (symbols < 0) | (symbols >= len(self.pieces))
        odd[np.searchsorted(ends, np.flatnonzero(strange), side="right")] = True
        raw = np.where(strange, 0, symbols).astype("<i4").tobytes()
        last = 0
        for w, end, rare in zip(short, (4 * ends).tolist(), odd.tolist(), strict=True):
            if rare:
                parts = [self.loose.get(k) or chr(-1 - k) if k < 0 or k >= len(self.pieces) else self.pieces[k] for k in symbols[last // 4 : end // 4].tolist()]
                self.cache[w] = np.array(self._to_ids(parts)[0], "<i4").tobytes()
            else:
                self.cache[w] = raw[last:end]
            last = end

    # -- decoding -----------------------------------------------------------------

    def decode(self, ids) -> str:
        out: list[str] = []
        raw = bytearray()
        front = True  # nothing has been written yet
        some = False
        cut_front = self.dummy or self.trim
        surface, byte_of = self.surface_table(), self.byte_of
        for k in ids:
            if k in byte_of:
                raw.append(byte_of[k])
                continue
            if raw:
                out.append(replace_invalid(bytes(raw)))
                raw.clear()
                some = True
            piece, text = surface[k]
            if front and (some or any(out)):
                front = False
            if front and cut_front and piece.startswith(BLANK):
                # Where extra blanks are removed, the next piece is in front as well while nothing is written.
                out.append(text[1:])
                some = not self.trim
            else:
                out.append(text)
        if raw:
            out.append(replace_invalid(bytes(raw)))
        return "".join(out)

    def surface_table(self) -> list[tuple[str, str]]:
        table = getattr(self, "_surface", None)
        if table is None:
            table = self._surface = [
                ("", "") if kind == CONTROL else ("", self.unk_surface) if kind == UNKNOWN else (p, p.replace(BLANK, " "))
                for p, kind in zip(self.pieces, self.kinds, strict=True)
            ]
        return table

    def decode_fast(self, ids: np.ndarray) -> str:
        """``decode`` for ids whose byte pieces are rare: runs between them are joined at once."""
        if not len(ids):
            return ""
        if self.trim or not self.dummy:
            return self.decode(ids.tolist())
        if getattr(self, "_texts", None) is None:
            self._texts = [t for _, t in self.surface_table()]
            self._is_byte = np.array([k == BYTE for k in self.kinds])
            self._invisible = np.array([t == "" for t in self._texts])
        texts = self._texts
        if self._invisible[ids].any() and not self._is_byte[ids[self._invisible[ids]]].all():
            return self.decode(ids.tolist())
        marks = np.flatnonzero(self._is_byte[ids])
        items = ids.tolist()
        if not len(marks):
            text = "".join([texts[k] for k in items])
            return text[1:] if self.pieces[items[0]].startswith(BLANK) else text
        if not self.pieces[items[0]].startswith(BLANK) and marks[0] == 0:
            return self.decode(items)
        out = []
        groups = np.split(marks, np.flatnonzero(np.diff(marks) != 1) + 1)
        at = 0
        for g in groups:
            a, b = int(g[0]), int(g[-1]) + 1
            out += [texts[k] for k in items[at:a]]
            out.append(replace_invalid(bytes(self.byte_of[k] for k in items[a:b])))
            at = b
        out += [texts[k] for k in items[at:]]
        text = "".join(out)
        return text[1:] if self.pieces[items[0]].startswith(BLANK) else text


def replace_invalid(raw: bytes) -> str:
    """UTF-8 text of ``raw``; each byte that belongs to no character becomes U+FFFD."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + n].decode("utf-8"))
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


def codec(path: str | None) -> PieceCodec:
    """The worker's codec; without a path, the installed 32k piece model."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return worker_state(("pieces", path), lambda: PieceCodec(path))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    sizes = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *arrays]), pa.int32()))


def _encoder(path: str | None):
    c = codec(path)

    def run(texts: list[str | None]) -> pa.StructArray:
        found = list(c.encode_iter(texts))
        ids, begins, ends = zip(*found, strict=True) if found else ((), (), ())
        return struct_array(ids=_lists(list(ids)), begins=_lists(list(begins)), ends=_lists(list(ends)))

    return run


def _decoder(path: str | None):
    c = codec(path)

    def run(rows: list[list[int] | None]) -> pa.StructArray:
        return struct_array(text=pa.array([c.decode_fast(np.array(r or [], np.int32)) for r in rows], pa.string()))

    return run


def with_pieces(df: DataFrame, text_col: str = "text", out: str = "pieces", path: str | None = None) -> DataFrame:
    """``df`` plus a struct: ``ids``, and ``begins`` and ``ends``, each id's span of source bytes."""
    return add_struct(df, [text_col], out, "ids array<int>, begins array<int>, ends array<int>", _encoder, path)


def with_decoded(df: DataFrame, ids_col: str, out: str = "decoded", path: str | None = None) -> DataFrame:
    """``df`` plus a struct with the ``text`` that the ids of ``ids_col`` spell. Null ids: an empty text."""
    return add_struct(df, [ids_col], out, "text string", _decoder, path)


def _digester(path: str | None):
    c = codec(path)
    decimal = [str(k) for k in range(len(c.pieces))]

    def run(texts: list[str | None]) -> pa.StructArray:
        n, ids_sha, text_sha, last = [], [], [], []
        for ids, _, ends in c.encode_iter(texts):
            n.append(len(ids))
            ids_sha.append(sha256(",".join([decimal[k] for k in ids.tolist()]).encode()).hexdigest())
            text_sha.append(sha256(c.decode_fast(ids).encode()).hexdigest())
            last.append(int(ends[-1]) if len(ends) else 0)
        return struct_array(n=pa.array(n, pa.int64()), ids_sha=pa.array(ids_sha, pa.string()), text_sha=pa.array(text_sha, pa.string()), last=pa.array(last, pa.int64()))

    return run


def codec_report(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and source_bytes (where the last span ends).

    Every whole text is encoded with spans, its ids are decoded again, and both
    digested where they arise: id arrays don't travel.
    """
    narrow = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("body"))
    found = add_struct(narrow, ["body"], "d", "n long, ids_sha string, text_sha string, last long", _digester, path)
    return found.select("doc_id", F.col("d.n").alias("n_tokens"), F.col("d.ids_sha").alias("ids_sha256"), F.col("d.text_sha").alias("decoded_sha256"), F.col("d.last").alias("source_bytes"))
