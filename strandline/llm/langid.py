"""Language identification with error-correcting output codes.

Every language gets a codeword. One linear classifier for each bit, over hashed
character 1- to 3-grams of the letters of a text, predicts that bit. Decoding
sums, for each language, the logistic loss of all bits against its codeword;
the language with the least loss wins, and a text whose runner-up is close is
flagged as ambiguous.

The classifiers are fitted on at most ``SAMPLE`` texts in all, an even number
for each language, chosen by a hash. Prediction reads whole texts. Texts that
are null or have no letter are ``und`` with score 0; so is everything if there
is nothing to learn from. Rows without a doc_id count as held out. Languages that
tie in loss go to the first by name. Repeated rows are scored alike, and count
once each in the sample; an empty table gives no rows. Very long texts, and words,
are read a block at a time.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BoundedCache, add_struct, even_sample, struct_array, worker_state

SAMPLE = 3000
#: Texts to learn a language from, at least.
LEAST = 5
BUCKETS = 4096
LETTERS = regex.compile(r"\p{L}+")
PRIMES = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint64)


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """``n`` rows of -1 and 1: all splits for few languages, well-parted random ones for more."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 7:
        columns = [c for c in itertools.product((-1, 1), repeat=n) if c[0] == 1 and -1 in c]
        return np.array(columns, np.int8).T
    rng = np.random.default_rng(seed)
    bits = max(15, int(np.ceil(10 * np.log2(n))))
    tries = (rng.choice(np.array([-1, 1], np.int8), (n, bits)) for _ in range(200))
    gap = lambda c: -(c.astype(int) @ c.T - 2 * bits * np.eye(n, dtype=int)).max()
    return max((c for c in tries if (np.abs(c.sum(0)) < n).all()), key=gap)


def grams_at(codes: np.ndarray) -> np.ndarray:
    """Buckets of the 1- to 3-grams that begin at each place but the last two, row by row.

    Code 32 parts runs of letters, and grams reach over it at their ends only; 10
    ends a chunk. Places that hold no gram point to the bucket past the last.
    """
    n = len(codes) - 2
    inside, end = codes > 32, codes == 10
    a, b, c = codes[:n], codes[1 : n + 1], codes[2:]
    one = a * PRIMES[0]
    two = one + b * PRIMES[1]
    three = two + c * PRIMES[2] + np.uint64(13)
    fold = lambda h: ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)).astype(np.int64) % BUCKETS
    none = np.int64(BUCKETS)
    return np.stack([
        np.where(inside[:n], fold(one), none),
        np.where(~end[:n] & ~end[1 : n + 1] & (inside[:n] | inside[1 : n + 1]), fold(two + np.uint64(7)), none),
        np.where(~end[:n] & inside[1 : n + 1] & ~end[2:], fold(three), none),
    ])


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)


def gram_buckets(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``grams_at`` for the chunks' letter runs, set between blanks, and each chunk's number of places."""
    forms = [" " + " ".join(LETTERS.findall(c)) + " \n" for c in chunks]
    return grams_at(code_points("".join(forms) + "\n\n")), np.fromiter(map(len, forms), np.int64, len(forms))


def grams_of_long(chunk: str, window: int = 1 << 16) -> Iterator[np.ndarray]:
    """``gram_buckets`` of one chunk of any length, a window of its letters at a time."""
    held = " "
    for run in LETTERS.finditer(chunk):
        for at in range(run.start(), run.end(), window):
            held += chunk[at : min(at + window, run.end())]
            if len(held) > window:
                yield grams_at(code_points(held))
                held = held[-2:]
        held += " "
    # A chunk without a letter has two blanks, as in ``gram_buckets``.
    yield grams_at(code_points(held + (" " if held == " " else "") + "\n\n\n"))


#: Words over this length are read a window at a time, and aren't kept.
LONG = 256


def parts_of(text: str, block: int = 1 << 18) -> Iterator[tuple[list[str], str | None]]:
    """The blank- or line-separated words of a text in lower case: some short ones, or one long one, at a time."""
    for start, end in word_blocks(text, block):
        words = text[start:end].lower().replace("\n", " ").split(" ")
        if len(max(words, key=len)) <= LONG:
            yield words, None
            continue
        yield [w for w in words if len(w) <= LONG], None
        for w in words:
            if len(w) > LONG:
                yield [], w


def word_blocks(text: str, block: int) -> Iterator[tuple[int, int]]:
    """Ranges that cover a text but for the blanks and line ends between them; of about ``block`` characters, or one word."""
    at = 0
    while at < len(text):
        end = at + block
        if end < len(text):
            found = [k for k in (text.find(" ", end), text.find("\n", end)) if k >= 0]
            end = min(found, default=len(text))
        yield at, min(end, len(text))
        at = end + 1


def profile(text: str) -> np.ndarray:
    """Share of each bucket among a text's grams."""
    count = np.zeros(BUCKETS + 1)
    for words, long in parts_of(text):
        for grams in grams_of_long(long) if long else (gram_buckets(words)[0],):
            count += np.bincount(grams.ravel(), minlength=BUCKETS + 1)
    count = count[:BUCKETS].astype(np.float32)
    return count / max(1.0, float(count.sum()))


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits
    bias: np.ndarray
    margin: float = 0.5  # least difference of losses that is not ambiguous

    def digest(self) -> str:
        """Equal for equal models."""
        return xxhash.xxh3_128_hexdigest(repr((self.languages, self.margin)).encode() + self.code.tobytes() + self.weights.tobytes() + self.bias.tobytes())


def fit(texts: list[np.ndarray], langs: list[str], rounds: int = 120, scale: float = 60.0) -> LanguageModel | None:
    """Logistic classifiers of all bits at once, by full-batch Adam."""
    names = tuple(sorted(set(langs)))
    if not names:
        return None
    code = codewords(len(names))
    x = np.stack(texts).astype(np.float32) * scale
    y = code[[names.index(g) for g in langs]].astype(np.float32)
    share = np.array([langs.count(g) for g in names], np.float32)
    weight = (len(langs) / len(names) / share)[[names.index(g) for g in langs]][:, None]
    w = np.zeros((BUCKETS, y.shape[1]), np.float32)
    b = np.zeros(y.shape[1], np.float32)
    m, v = [np.zeros_like(w), np.zeros_like(b)], [np.zeros_like(w), np.zeros_like(b)]
    for k in range(1, rounds + 1):
        z = np.clip(y * (x @ w + b), -30, 30)
        g = -y * weight / (1 + np.exp(z)) / len(x)
        for i, (p, d) in enumerate(((w, x.T @ g + 1e-5 * w), (b, g.sum(0)))):
            m[i] = 0.9 * m[i] + 0.1 * d
            v[i] = 0.99 * v[i] + 0.01 * d * d
            p -= 0.1 * (m[i] / (1 - 0.9**k)) / (np.sqrt(v[i] / (1 - 0.99**k)) + 1e-7)
    return LanguageModel(names, code, w * scale, b)


class LanguageScorer:
    def __init__(self, model: LanguageModel | None):
        self.model = model
        if model is None:
            return
        bits = model.weights.shape[1]
        # One more column counts grams; one more row is for places without one.
        self.rows = np.zeros((BUCKETS + 1, bits + 1))
        self.rows[:BUCKETS, :bits] = model.weights
        self.rows[:BUCKETS, bits] = 1
        self.cache = BoundedCache()
        #: Words whose sums take as many bytes as the cache may.
        self.most = max(1024, self.cache.limit // (8 * (bits + 1) + self.cache.ENTRY))
        self.sums = np.zeros((1024, bits + 1))

    def learn(self, words: list[str]) -> None:
        at = len(self.cache)
        grams, sizes = gram_buckets(words)
        starts = np.cumsum(sizes) - sizes
        found = sum(np.add.reduceat(self.rows[g], starts, axis=0) for g in grams)
        while at + len(words) > len(self.sums):
            self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
        self.sums[at : at + len(words)] = found
        self.cache.update(zip(words, range(at, at + len(words)), strict=True))

    def total(self, words: list[str]) -> np.ndarray:
        """Sum over some words, none of them long."""
        if len(self.cache) > self.most:
            self.cache.clear()
        cache = self.cache
        new = [w for w in set(words) if w not in cache]
        for k in range(0, len(new), 8192):
            self.learn(new[k : k + 8192])
        return self.sums[np.fromiter(map(cache.__getitem__, words), np.int64, len(words))].sum(0)

    def score(self, text: str | None) -> tuple[str, float, bool]:
        if not text or self.model is None:
            return "und", 0.0, False
        total = np.zeros(self.rows.shape[1])
        for words, long in parts_of(text):
            if long:
                for grams in grams_of_long(long):
                    for g in grams:
                        total += self.rows[g].sum(0)
            elif words:
                total += self.total(words)
        n = total[-1]
        if n < 0.5:
            return "und", 0.0, False
        return self.decode(total[:-1] / n + self.model.bias)

    def decode(self, margins: np.ndarray) -> tuple[str, float, bool]:
        """Loss-weighted decoding: the codeword with the least logistic loss over all bits."""
        m = self.model
        loss = np.logaddexp(0, -m.code * margins).sum(1)
        best = int(loss.argmin())
        share = np.exp(loss[best] - loss)
        second = np.partition(loss, 1)[1] if len(loss) > 1 else np.inf
        return m.languages[best], float(1 / share.sum()), bool(second - loss[best] < m.margin)

    def score_all(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        return [self.score(t) for t in texts]


def _factory(model: LanguageModel | None):
    scorer = worker_state(("language", model and model.digest()), lambda: LanguageScorer(model))

    def run(texts: list[str | None]) -> pa.StructArray:
        found = scorer.score_all(texts)
        lang, score, ambiguous = zip(*found, strict=True) if found else ((), (), ())
        return struct_array(lang=pa.array(lang, pa.string()), score=pa.array(score, pa.float64()), ambiguous=pa.array(ambiguous, pa.bool_()))

    return run


def _profiler():
    return lambda texts: struct_array(profile=pa.array([profile(t or "").tolist() for t in texts], pa.list_(pa.float32())))


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", sample: int = SAMPLE) -> LanguageModel | None:
    """Fit on a bounded even sample of the rows of ``df`` that have a language and a text.

    The driver receives the profiles of the sample only: ``sample`` x ``BUCKETS`` numbers at most,
    the same number of texts for each language. Of more than ``sample`` / ``LEAST`` languages, those
    with the most rows are learned.
    """
    rows = df.select(F.col(f"`{key_col}`").alias("key"), F.col(f"`{text_col}`").alias("body"), F.col(f"`{lang_col}`").alias("label"))
    picked = even_sample(rows, "label", "key", lambda n: sample // n, condition=F.col("body").rlike(r"\p{L}"), most_labels=max(1, sample // LEAST))
    found = add_struct(picked.select("body", "label"), ["body"], "p", "profile array<float>", _profiler).select("label", "p.profile").toArrow()
    if not found.num_rows:
        return None
    values = found.column("profile").combine_chunks().flatten().to_numpy().reshape(found.num_rows, BUCKETS)
    return fit(list(values), found.column("label").to_pylist())


def with_language(df: DataFrame, model: LanguageModel | None, text_col: str = "text", out: str = "language") -> DataFrame:
    """``df`` plus a struct with ``lang``, ``score`` (0 to 1) and ``ambiguous``."""
    return add_struct(df, [text_col], out, "lang string, score double, ambiguous boolean", _factory, model)


def language_report(df: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous for every row; rows with crc32(doc_id) mod ``folds`` = ``held`` are not learned from."""
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == held, F.lit(True))
    narrow = df.select("doc_id", F.col("text").alias("body"), F.col("lang").alias("label"), out.alias("held_out"))
    model = train(narrow.filter(~F.col("held_out")), "body", "label")
    scored = with_language(narrow.select("doc_id", "held_out", "body"), model, "body", "g")
    return scored.select("doc_id", "held_out", F.col("g.lang").alias("lang_pred"), F.col("g.score").alias("score"), F.col("g.ambiguous").alias("ambiguous"))
