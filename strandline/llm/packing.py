"""First-fit-decreasing packing of token pieces into fixed-length sequences.

Each document's ids are cut into full sequences plus a remainder. Pieces are
dealt into randomised groups of bounded size; every group is packed by itself:
longest piece first, each into the first open bin with room, which a
tournament tree of bin capacities finds in logarithmic time. Groups are
independent tasks, so the work is linear in the corpus and a lost executor
costs its groups only. Padding is what the last, loosest bins of a group leave.

Null texts count as empty: one piece that holds the closing id. Repeated rows
are packed as often as they occur. An empty table gives no pieces. A very long text
is many full pieces; its ids are held in memory at once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BoundedCache, cut, slices, worker_state

#: Parts words in one call to the library.
MARK = "\x01"
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, salt long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordTokenizer:
    """Ids of whole texts by the tokenizer library, one call for each new word.

    The vocabulary's pre-tokenizer never joins characters across white space, so
    a text's ids are those of its blank- or line-separated words in turn.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        (self.mark,) = self.library.encode(MARK, add_special_tokens=False).ids
        # For plain words, what normalises and cuts texts would find nothing to do.
        self.simple = Tokenizer.from_file(path)
        self.simple.normalizer = normalizers.Sequence([])
        self.simple.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.closes = np.zeros(self.library.get_vocab_size(), bool)
        self.closes[[k for t, k in self.library.get_vocab().items() if t.endswith("</w>")]] = True
        self.cache = BoundedCache(limit=96 << 20)

    def encode(self, texts: pa.Array | list[str | None], closing: int, block_bytes: int = 4 << 20) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text, then the closing id."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        for a, b in slices([texts], block_bytes):
            yield from self._encode_block(texts.slice(a, b - a), closing)

    def learn(self, words: list[str], joined: int = 2048) -> list[str]:
        """Encode new words. Those of Latin-1 letters are looked up in lower case and without a last stop or comma.

        Normalising leaves such letters as they are, and all of them are one pre-token.
        Returns the forms that were entered beside the words themselves.
        """
        cache, parts, simple, other = self.cache, [], {}, {}
        for w in words:
            tail = w[-1:]
            base = w[:-1] if tail == "." or tail == "," else w
            if base.isalpha() and (base.isascii() or max(base) <= "\xff"):
                base = base.lower()
                if base != w:
                    parts.append((w, base, tail if len(base) < len(w) else ""))
                if base not in cache:
                    simple[base] = None
            else:
                other[w] = None
        for tail in (".", ","):
            if tail not in cache:
                other[tail] = None
        names = list(simple)
        for at in range(0, len(names), joined):
            ids = self.ids_of(self.simple, " ".join(names[at : at + joined]))
            self.put(names[at : at + joined], ids, np.flatnonzero(self.closes[ids]) + 1, 0)
        names = [w for w in other if MARK not in w]
        for at in range(0, len(names), joined):
            # A mark is a pre-token and an id of its own: the places of that id tell the words apart.
            ids = self.ids_of(self.library, f" {MARK} ".join([*names[at : at + joined], ""]))
            self.put(names[at : at + joined], ids, np.flatnonzero(ids == self.mark), 1)
        for w in other:
            if MARK in w:
                cache[w] = self.ids_of(self.library, w).tobytes()
        for w, base, tail in parts:
            cache[w] = cache[base] + cache[tail] if tail else cache[base]
        own = set(words)
        return [w for w in simple if w not in own]

    @staticmethod
    def ids_of(library, text: str) -> np.ndarray:
        return np.array(library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def put(self, words: list[str], ids: np.ndarray, ends: np.ndarray, skip: int) -> None:
        """Keep each word's ids, which end where ``ends`` says; ``skip`` ids part two words."""
        raw, last = ids.tobytes(), 0
        for w, end in zip(words, (4 * ends).tolist(), strict=True):
            self.cache[w] = raw[last:end]
            last = end + 4 * skip

    def _encode_block(self, texts: pa.Array, closing: int) -> Iterator[bytes]:
        """Arrow cuts the texts and numbers their words; each different word is looked up once, and ids are gathered by number."""
        cache = self.cache
        cache.make_room()
        split = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        words, number = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        new = cache.missing(words)
        forms = self.learn(new)
        raw = list(map(cache.__getitem__, words))
        cache.entered(new + forms)
        size = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        known, first = np.frombuffer(b"".join(raw), "<u4"), np.cumsum(size) - size
        each = size[number]
        ends = np.cumsum(each)
        ids = known[np.repeat(first[number] - ends + each, each) + np.arange(int(ends[-1]) if len(ends) else 0)]
        # Where each text's words, and so its ids, end.
        last = np.append(0, np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False)))
        at = np.append(0, ends)[last].tolist()
        end = closing.to_bytes(4, "little")
        for a, b in zip(at, at[1:], strict=False):
            yield ids[a:b].tobytes() + end


def tokenizer(path: str | None) -> WordTokenizer:
    """The worker's tokenizer; without a path, the installed 49k word vocabulary."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return worker_state(("words", path), lambda: WordTokenizer(path))


def token_pieces(df: DataFrame, capacity: int = 4096, closing: int = 2, text_col: str = "text", id_col: str = "doc_id", path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """One row for each piece of at most ``capacity`` ids; with ``keep_ids``, the ids too.

    ``salt`` is a hash of the id and of the row's place in its task: it scatters
    rows evenly even where they are all alike.
    """
    narrow = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("body"))
    span = 4 * capacity
    schema = PIECE + (", ids array<int>" if keep_ids else "")

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, row = tokenizer(path), 0
        names = [f.split(" ")[0] for f in schema.split(", ")]
        kinds = [pa.int64()] * 6 + [pa.list_(pa.int32())] * keep_ids
        for batch in batches:
            for a, b in slices([batch.column(1)]):
                rows: list[tuple] = []
                for doc, data in zip(batch.column(0).slice(a, b - a).to_pylist(), tok.encode(batch.column(1).slice(a, b - a), closing), strict=True):
                    row += 1
                    for at in range(0, len(data), span):
                        piece = data[at : at + span]
                        salt = xxhash.xxh64_intdigest(f"{doc}/{row}/{at}", 17) >> 1
                        rows.append((doc, at // 4, len(piece) // 4, zlib.crc32(piece), len(data) // 4, salt) + ((np.frombuffer(piece, "<i4"),) if keep_ids else ()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return narrow.mapInArrow(cut_up, schema)


class TournamentTree:
    """Capacities of bins as leaves; each inner node holds the larger of its two."""

    def __init__(self, bins: int, capacity: int):
        self.width = 1 << max(0, (bins - 1).bit_length())
        self.room = [capacity] * (2 * self.width)

    def take(self, length: int) -> tuple[int, int]:
        """Put ``length`` into the first bin with room: that bin, and its room before."""
        room, node = self.room, 1
        while node < self.width:
            node *= 2
            if room[node] < length:
                node += 1
        had = room[node]
        room[node] = had - length
        leaf = node - self.width
        while node > 1:
            node >>= 1
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
        return leaf, had


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece. ``lengths`` are 1 to ``capacity`` and already in decreasing order."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    if len(lengths):
        tree = TournamentTree(len(lengths), capacity)
        for k, n in enumerate(lengths.tolist()):
            bins[k], had = tree.take(n)
            offsets[k] = capacity - had
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = 4096, group_pieces: int = 8192) -> DataFrame:
    """Sequences of at most ``capacity`` tokens from ``token_pieces`` rows.

    The pieces are written once to the shared folder, counted, and dealt into
    count / ``group_pieces`` groups by their salt: only these narrow rows are
    shuffled. A sequence's id holds its group in the upper and its bin in the
    lower 32 bits; offsets in a sequence run on from 0 without gaps.
    """
    pieces = cut(pieces, "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))

    def pack_group(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("salt", "ascending"), ("doc_id", "ascending"), ("start", "ascending")])
        bins, offsets = first_fit_decreasing(table.column("length").to_numpy(), capacity)
        keep = [table.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
        return pa.table([*keep, pa.array((key[0].as_py() << 32) | bins), pa.array(offsets)], names=[f.split(" ")[0] for f in PACKED.split(", ")])

    grouped = pieces.withColumn("part", F.pmod(F.xxhash64("salt"), F.lit(groups)).cast("long"))
    return grouped.groupBy("part").applyInArrow(pack_group, PACKED)


def pack_documents(df: DataFrame, capacity: int = 4096, closing: int = 2, group_pieces: int = 8192) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for every piece of every row."""
    return pack(token_pieces(df, capacity, closing), capacity, group_pieces)
