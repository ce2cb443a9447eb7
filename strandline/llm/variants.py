"""Spelling variants: words one edit apart, found through a positional q-gram index.

Words are counted over all texts first. Two words one edit apart begin alike or end alike
over half the shorter one's letters, so each word is dealt to the groups of its possible
halves: (length, side, half). Within a group an inverted index holds, for each 2-gram, the
words and places where it stands. A word's posting lists are merged by a heap; entries count
if the lengths differ by one at most and the places by one at most; words that share at
least ``longer - 1 - 2`` grams (one edit spoils two of a word's length - 1 grams) are kept
and verified.

No group is unbounded: a group of more than ``LARGEST`` words is dealt anew by half of what
its words don't yet share, and again, until only one place is open; then its size is bounded by
the alphabet. A pair is found in the first of its groups alone, so pairs need no deduplication.
Each word's nearest larger word and the roots at the end of such steps follow by joins;
counts grow five times a step at least, so doubling ends after a few rounds.

Null texts have no words. Repeated rows count as often as they stand there; a null doc_id
counts as an empty id. Texts are read whole and words may have any length. An empty table
gives no rows. Ties: the smallest word in code-point order. Output has columns of its own.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain, repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, few_files, slices

#: Letters of runs in UTF-8, after A-Z became small. Fixed by the query's contract, as are the next ones.
RUN = re.compile(rb"(?:[a-z]+|\xc3[\x80-\xbf])+")
THINNING, SHORTEST, LEAST_COUNT, RATIO = 199, 6, 5, 5
#: Letters of a gram.
Q = 2
#: Words of a group that are indexed together, and counted words that a task holds.
LARGEST, HELD = 400, 200_000


def counted_words(texts: list[str | None], ids: list, total: Counter) -> None:
    """Adds the words of some texts to ``total``, in UTF-8; of every 199th word of a document one letter is taken out."""
    for text, doc in zip(texts, ids, strict=True):
        if not text:
            continue
        begin = zlib.crc32(f"{'' if doc is None else doc}:".encode())
        for run, n in Counter(RUN.findall(text.encode("utf-8", "surrogatepass").lower())).items():
            h = zlib.crc32(run, begin)
            if h % THINNING == 0:
                letters = run.decode()
                k = h % len(letters)
                run = (letters[:k] + letters[k + 1 :]).encode()
            # As many bytes are needed for as many letters at least.
            if len(run) >= SHORTEST and (run.isascii() or len(run) - run.count(b"\xc3") >= SHORTEST):
                total[run] += n


def vocabulary(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", least: int = LEAST_COUNT) -> DataFrame:
    """word and n of all words that occur ``least`` times and more; counts are added up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([w.decode() for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for a, b in slices([batch.column(1)]):
                counted_words(batch.column(1).slice(a, b - a).to_pylist(), batch.column(0).slice(a, b - a).to_pylist(), total)
                if len(total) > HELD:
                    yield rows()
        yield rows()

    narrow = df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    return narrow.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def one_edit(a: str, b: str) -> bool:
    """Whether the words differ by exactly one letter inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


class GramIndex:
    """Posting lists of positional grams: for each gram and place, numbers of the words in order."""

    def __init__(self):
        self.words: list[str] = []
        self.postings: dict[tuple[str, int], list[int]] = defaultdict(list)

    def add(self, word: str) -> None:
        number = len(self.words)
        self.words.append(word)
        for place in range(len(word) - Q + 1):
            self.postings[word[place : place + Q], place].append(number)

    def near(self, word: str) -> Iterator[str]:
        """Indexed words one edit from ``word``: the heap brings all entries of an indexed word together."""
        # An entry is (number of the indexed word, place of the gram in ``word``).
        lists = []
        for place in range(len(word) - Q + 1):
            gram = word[place : place + Q]
            lists += [zip(found, repeat(place)) for at in (place - 1, place, place + 1) if (found := self.postings.get((gram, at)))]
        number, grams, last = -1, 0, -1
        for n, place in chain(heapq.merge(*lists), [(-1, -1)]):
            if n != number:
                if number >= 0 and self.passes(word, number, grams):
                    yield self.words[number]
                number, grams, last = n, 0, -1
            # A gram of the word counts once for an indexed word, however often that has it nearby.
            if place != last:
                grams, last = grams + 1, place

    def passes(self, word: str, number: int, grams: int) -> bool:
        other = self.words[number]
        longer = max(len(word), len(other))
        return abs(len(word) - len(other)) <= 1 and grams >= longer - Q + 1 - Q and one_edit(word, other)


def pairs_of_group(length: int, begin: int, end: int, seen: list[tuple[int, int]], words: list[tuple[str, int]]) -> Iterator[tuple[str, int, str, int]]:
    """Pairs of one group, each once: one of ``length`` letters and one as long or one longer.

    All words have the first ``begin`` and the last ``end`` letters in common. ``seen``: pairs
    that have so many letters in common at the beginning and the end are found in other groups.
    """
    counts = dict(words)
    index = GramIndex()
    for word in sorted((w for w in counts if len(w) == length)):
        for other in index.near(word):
            if not any(other[:p] == word[:p] and other[length - s :] == word[length - s :] for p, s in seen):
                yield other, counts[other], word, counts[word]
        index.add(word)
    for word in (w for w in counts if len(w) == length + 1):
        for other in index.near(word):
            if not any(other[:p] == word[:p] and other[length - s :] == word[length + 1 - s :] for p, s in seen):
                yield other, counts[other], word, counts[word]


def dealt_words(groups: DataFrame) -> DataFrame:
    """Rows (length, begin, end, seen, word, n) in the two halves of what is still open between ``begin`` and ``end``.

    In the second half, words that are in the first half together are left to that.
    """
    open_ = F.col("length") - F.col("begin") - F.col("end")
    step = F.floor(open_ / 2).cast("int")
    first = F.struct((F.col("begin") + step).alias("begin"), F.col("end"), F.col("seen"))
    other = F.struct(F.col("begin"), (F.col("end") + step).alias("end"), F.concat("seen", F.array(F.struct((F.col("begin") + step).alias("p"), F.col("end").alias("s")))).alias("seen"))
    rows = groups.select("length", "word", "n", F.explode(F.array(first, other)).alias("g"))
    return keyed(rows.select("length", "g.begin", "g.end", "g.seen", "word", "n"))


def keyed(rows: DataFrame) -> DataFrame:
    """With ``key``, which says all that the words of a group share."""
    size = F.length("word")
    shared = F.concat(F.substring(F.col("word"), F.lit(1), F.col("begin")), F.lit("\n"), F.substring(F.col("word"), size - F.col("end") + 1, F.col("end")))
    way = F.array_join(F.transform("seen", lambda s: F.concat_ws(".", s["p"].cast("string"), s["s"].cast("string"))), ",")
    return rows.withColumn("key", F.concat_ws("\n", F.col("length").cast("string"), F.col("begin").cast("string"), F.col("end").cast("string"), way, shared))


def _merged_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of groups that come one after another, each group at most ``LARGEST`` words or of one open place."""
    now, group = None, []
    out: list[list] = [[], [], [], []]

    def flush() -> None:
        if len(group) > 1:
            _, length, begin, end, seen = now
            for pair in pairs_of_group(length, begin, end, list(seen), group):
                for column, value in zip(out, pair, strict=True):
                    column.append(value)
        group.clear()

    def rows() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["a", "n_a", "b", "n_b"])
        for c in out:
            c.clear()
        return made

    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(7)]
        for key, length, begin, end, seen, word, n in zip(*columns, strict=True):
            head = (key, length, begin, end, tuple((s["p"], s["s"]) for s in seen))
            if head != now:
                flush()
                now = head
            group.append((word, n))
        if len(out[0]) > 50_000:
            yield rows()
    flush()
    yield rows()


def near_pairs(words: DataFrame, largest: int = LARGEST) -> DataFrame:
    """a, n_a, b, n_b: each pair of distinct words (word, n) one edit apart, once."""
    none = F.array().cast("array<struct<p:int,s:int>>")
    size = F.length("word").cast("int")
    # As the shorter or an equal one, and as the longer one.
    start = words.select(F.explode(F.array(size, size - 1)).alias("length"), F.lit(0).alias("begin"), F.lit(0).alias("end"), none.alias("seen"), "word", "n")
    rows = dealt_words(start)
    found = []
    while True:
        sizes = rows.groupBy("key").agg(F.count("*").alias("size"), F.first(F.col("length") - F.col("begin") - F.col("end")).alias("open"))
        large = cut(sizes.filter((F.col("size") > largest) & (F.col("open") > 1)).select("key"), "large", files=8)
        some = not large.isEmpty()
        small = rows.join(large, "key", "left_anti") if some else rows
        ordered = small.select("key", "length", "begin", "end", "seen", "word", "n").repartition("key").sortWithinPartitions("key")
        found.append(ordered.mapInArrow(_merged_groups, "a string, n_a long, b string, n_b long"))
        if not some:
            break
        rows = cut(dealt_words(rows.join(large, "key", "left_semi")), "dealt")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def roots(forms: DataFrame, files: int | None = None) -> DataFrame:
    """word and root, from rows (word, form): steps are doubled until none goes on."""
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        both = cut(now.join(ahead, "root", "left"), "roots", files=files)
        now = both.select("word", F.coalesce("next", "root").alias("root"))
        if both.filter(F.col("next").isNotNull()).isEmpty():
            return now


def variant_report(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", ratio: int = RATIO, largest: int = LARGEST) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    words = cut(vocabulary(df, text_col, id_col), "words")
    files = few_files(df.sparkSession, words.count())
    pairs = near_pairs(words, largest)
    both = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")),
    )).alias("p")).select("p.*")
    near = cut(both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near"))).alias("best")), "near", files=files)
    reached = words.join(near, "word", "left")
    large = -F.col("best.minus") >= ratio * F.col("n")
    found = reached.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(large, F.col("best.near")).alias("form"), F.when(large, -F.col("best.minus")).alias("form_n"))
    ends = roots(cut(found.filter(F.col("form").isNotNull()).select("word", "form"), "forms", files=files), files)
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
