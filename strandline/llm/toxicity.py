"""Toxic spans by a linear-chain conditional random field, and document scores.

Tokens are words, parted by white space of any kind or by punctuation (other than
``*@#$``, which mask letters), in lower case and without punctuation at the ends.
What is over 40 characters long without a parting is read in windows of 40, each
overlapping the one before by half, so no part of a text goes unscored; a chain is a
sentence or line of them, of 512 tokens at most. A token's
features are its word, its prefixes and its character 4-grams, hashed; each has
one weight for the state "toxic". Three transition weights join neighbours.

Labelled tokens come from labelled documents: in a toxic document, the tokens
are positive that carry a word or prefix which is far more frequent (in
documents) among toxic than among clean ones, beyond chance. Copies in the
training sample are set aside first, or their every word would look toxic.

Forward-backward gives each token its marginal. A document's score is a
logistic function of the expected number of toxic tokens and of the largest
marginal, and the tokens with a marginal of one half or more are its spans.

Nulls and empty texts score what a document without toxic tokens scores. Rows
without a doc_id count as held out. If the sample lacks one of the classes, all
texts get the share of toxic rows in it (0 without any) and there are no spans.
Repeated rows score alike; of labels that differ for one doc_id the largest counts, and
of its texts the least. An empty table gives no rows. Very long texts are tagged whole.
"""

from __future__ import annotations

import re
import string
import sys
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BoundedCache, add_struct, cut, even_sample, free_name, struct_array, worker_state

SAMPLE_TOXIC, SAMPLE_CLEAN = 2000, 4000
CHARS_TOXIC, CHARS_CLEAN = 8_000_000, 16_000_000
BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
POLYNOMIAL = np.uint64(0x9E3779B97F4A7C55)
CHAIN = 512
#: Tokens under this marginal don't add to a document's evidence: long clean texts have many of them.
LIKELY = 0.5
#: Characters that masked words have inside; they part tokens over ``LONGEST`` only.
MASKS = "*@#$"
LONGEST, STRIDE = 40, 20
EDGES = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace()) + string.punctuation + "¡¿«»„“”‘’…–—·•、。，：；？！（）「」『』《》"
_JOINTS = "".join(map(re.escape, sorted(set(EDGES) - set(MASKS))))
#: A core, with the joints before it; the last one has what follows too.
PIECE = re.compile(f"[{_JOINTS}]*[^{_JOINTS}]+(?:[{_JOINTS}]+$)?")
#: Where a token begins inside a blank-separated chunk: at joints that have cores on both sides.
INNER = re.compile(f"(?<=[^{_JOINTS}])(?=[{_JOINTS.replace(re.escape(' '), '')}]+[^{_JOINTS}])")
UNMASKED = re.compile(rf"[{_JOINTS}{re.escape(MASKS)}]*[^{_JOINTS}{re.escape(MASKS)}]+(?:[{_JOINTS}{re.escape(MASKS)}]+$)?")
FIELDS = "score double, spans array<struct<start:long,end:long>>"


def core(chunk: str) -> str:
    return chunk.lower().strip(EDGES)


def marks(word: str) -> list[str]:
    """What seeds are mined from: the word and its prefixes."""
    return ["=" + word] + ["^" + word[:k] for k in range(3, min(8, len(word)) + 1)]


def feature_arrays(words: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all words, and for each the place of the word that it belongs to.

    A word's features are itself, its prefixes of 3 to 8 letters, and the 4-grams of
    it with a mark at either end; each kind is a polynomial of code points, mixed into
    ``BUCKETS``. An empty word has none.
    """
    words = list(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    real = np.flatnonzero(sizes)
    n = sizes[real]
    if not len(real):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.frombuffer("".join([f"<{words[k]}>" for k in real.tolist()]).encode("utf-32-le"), "<u4").astype(np.uint64)
    first = np.cumsum(n + 2) - n - 1  # of each word proper
    power = np.cumprod(np.full(int(n.max()) + 2, POLYNOMIAL, np.uint64))

    def bucket(h: np.ndarray, kind: int) -> np.ndarray:
        h = (h + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        return (h * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)

    at = np.arange(len(codes)) - np.repeat(first - 1, n + 2)
    whole = np.add.reduceat(codes * power[at], first - 1)
    owners, found = [real], [bucket(whole, 1)]
    prefix = np.zeros(len(n), np.uint64)
    for k in range(1, min(8, int(n.max())) + 1):
        enough = np.flatnonzero(n >= k)
        prefix[enough] += codes[first[enough] + k - 1] * power[k]
        if k >= 3:
            owners.append(real[enough])
            found.append(bucket(prefix[enough], 2 * k))
    gram = np.flatnonzero(at <= np.repeat(n, n + 2) - 2)
    if len(gram):
        h = codes[gram] * power[0] + codes[gram + 1] * power[1] + codes[gram + 2] * power[2] + codes[gram + 3] * np.uint64(0x165667B19E3779F9)
        owners.append(np.repeat(real, n + 2)[gram])
        found.append(bucket(h, 3))
    return np.concatenate(owners), np.concatenate(found)


def places(chunk: str) -> list[tuple[int, int]]:
    """Where the tokens of a blank-separated chunk are; together they cover it."""
    out = []
    for piece in PIECE.finditer(chunk):
        a, b = piece.span()
        if len(core(piece.group())) <= LONGEST:
            out.append((a, b))
            continue
        for part in UNMASKED.finditer(chunk, a, b):
            lead = len(part.group()) - len(part.group().lstrip(EDGES))
            start, end = part.start() + lead, part.end()
            least = start + len(part.group().strip(EDGES))
            cuts = list(range(start, max(start + 1, least - STRIDE), STRIDE)) if least - start > LONGEST else [start]
            out += [(part.start() if s == start else s, end if s == cuts[-1] else s + LONGEST) for s in cuts]
    return out or [(0, len(chunk))]


def blank_chunks(text: str) -> list[str]:
    """Blank-separated; the first word of a line keeps the line end."""
    return text.replace("\n", " \n").split(" ")


def chunks_of(text: str) -> list[str]:
    """All tokens, with the punctuation around them: what ``places`` gives for each blank-separated chunk."""
    found = INNER.sub(" ", text.replace("\n", " \n")).split(" ")
    if len(max(found, key=len)) <= LONGEST:
        return found
    out: list[str] = []
    for piece in found:
        out += [piece] if len(piece) <= LONGEST else [piece[a:b] for a, b in places(piece)]
    return out


def starts_of(text: str) -> list[int]:
    """Where each token of ``chunks_of`` starts."""
    out, at = [], 0
    for chunk in blank_chunks(text):
        # Every chunk but the first follows one character, which a line end's chunk has as its own.
        at -= chunk[:1] == "\n"
        out += [at + a for a, _ in places(chunk)]
        at += len(chunk) + 1
    return out


def chain_sizes(chunks: list[str]) -> list[int]:
    """Lengths of the chains that the chunks form."""
    sizes, n = [], 0
    for c in chunks:
        if n and (n == CHAIN or c[:1] == "\n"):
            sizes.append(n)
            n = 0
        n += 1
        if c[-1:] in ".!?":
            if c:
                sizes.append(n)
                n = 0
    return sizes + [n] if n else sizes


@dataclass(frozen=True)
class ToxicModel:
    weights: np.ndarray | None  # buckets; None: a constant score
    bias: float = 0.0
    trans: tuple[float, float, float] = (0.0, 0.0, 0.0)  # clean-toxic, toxic-clean, toxic-toxic
    head: tuple[float, float, float] = (0.0, 0.0, 0.0)  # constant, log(1 + expected tokens), largest marginal

    def digest(self) -> str:
        """Equal for equal models."""
        whole = (b"" if self.weights is None else self.weights.tobytes()) + repr((self.bias, self.trans, self.head)).encode()
        return xxhash.xxh3_128_hexdigest(whole)


def forward_backward(emission: np.ndarray, sizes: np.ndarray, trans) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of "toxic" for all tokens of many chains at once.

    ``emission`` holds the chains one after the other: the score of "toxic" (of
    "clean": 0). Chains are sorted by length, so step t works on a prefix of them.
    Returns marginals, the expected counts of the three transitions, and log Z.
    """
    order = np.argsort(-sizes, kind="stable")
    size = sizes[order]
    first = (np.cumsum(sizes) - sizes)[order]
    longest = int(size[0]) if len(size) else 0
    live = np.searchsorted(-size, -np.arange(longest), side="left")  # chains longer than t
    ct, tc, tt = trans
    a0, a1 = np.zeros(len(emission)), np.zeros(len(emission))
    b0, b1 = np.zeros(len(emission)), np.zeros(len(emission))
    for t in range(longest):
        at = first[: live[t]] + t
        if t == 0:
            a1[at] = emission[at]
        else:
            p0, p1 = a0[at - 1], a1[at - 1]
            a0[at] = np.logaddexp(p0, p1 + tc)
            a1[at] = np.logaddexp(p0 + ct, p1 + tt) + emission[at]
    for t in range(longest - 1, 0, -1):
        at = first[: live[t]] + t
        n0, n1 = b0[at], b1[at] + emission[at]
        b0[at - 1] = np.logaddexp(n0, n1 + ct)
        b1[at - 1] = np.logaddexp(n0 + tc, n1 + tt)
    last = first + size - 1
    z = np.zeros(len(sizes))
    z[order] = np.logaddexp(a0[last], a1[last])
    per_token = np.repeat(z, sizes)
    marginal = np.exp(np.minimum(0, a1 + b1 - per_token))
    inner = np.ones(len(emission), bool)
    inner[(np.cumsum(sizes) - sizes)] = False
    at = np.flatnonzero(inner)
    e1 = emission[at] + b1[at] - per_token[at]
    pairs = np.array([
        np.exp(np.minimum(0, a0[at - 1] + ct + e1)).sum(),
        np.exp(np.minimum(0, a1[at - 1] + tc + b0[at] - per_token[at])).sum(),
        np.exp(np.minimum(0, a1[at - 1] + tt + e1)).sum(),
    ])
    return marginal, pairs, z


def without_copies(texts: list[str], seeds: int = 4) -> list[int]:
    """Places of texts that share none of their ``seeds`` least 3-word hashes with an earlier one."""
    seen: set[tuple[int, int]] = set()
    keep = []
    for k, text in enumerate(texts):
        words = text.lower().split()
        digest = xxhash.xxh64_intdigest
        h = np.array([digest(f"{a} {b} {c}") for a, b, c in zip(words, words[1:], words[2:], strict=False)] or [digest(" ".join(words))], np.uint64)
        least = {(s, int((h * np.uint64(2 * s + 0x9E3779B97F4A7C15) ^ (h >> np.uint64(31 - s))).min())) for s in range(seeds)}
        if not least & seen:
            keep.append(k)
        seen |= least
    return keep


def mine_seeds(docs: list[set[str]], toxic: list[bool], z_least: float = 5.0, ratio: float = 10.0) -> set[str]:
    """Words and prefixes whose documents are toxic far beyond chance."""
    n1 = sum(toxic)
    n0 = len(toxic) - n1
    toxic_with = Counter(m for words, label in zip(docs, toxic, strict=True) if label for m in {m for w in words for m in marks(w)})
    # Only marks of several toxic documents can be seeds: all others needn't be held.
    toxic_with = {m: k for m, k in toxic_with.items() if k >= 4}
    with_mark = Counter(m for words in docs for m in {m for w in words for m in marks(w) if m in toxic_with})
    seeds = set()
    for m, k1 in toxic_with.items():
        k = with_mark[m]
        expected = k * n1 / (n0 + n1)
        if (k1 - expected) / np.sqrt(expected + 1) >= z_least and (k1 / n1) / ((k - k1 + 1) / (n0 + 1)) >= ratio:
            seeds.add(m)
    return seeds


def fit(texts: list[str], toxic: list[bool], rounds: int = 50) -> ToxicModel:
    share = sum(toxic) / len(toxic) if toxic else 0.0
    constant = ToxicModel(None, head=(share, 0.0, 0.0))
    keep = without_copies(texts)
    texts, toxic = [texts[k] for k in keep], [toxic[k] for k in keep]
    if not any(toxic) or all(toxic):
        return constant
    seeds = mine_seeds([{w for c in chunks_of(t) if (w := core(c))} for t in texts], toxic)
    if not seeds:
        return constant
    number: dict[str, int] = {}
    tokens, truth, sizes = array("l"), array("b"), array("l")
    hits = {}
    rng = np.random.default_rng(4)
    for text, label in zip(texts, toxic, strict=True):
        chunks, at = chunks_of(text), 0
        for n in chain_sizes(chunks):
            words = [core(c) for c in chunks[at : at + n]]
            at += n
            y = [False] * n
            for k, w in enumerate(words):
                if w not in hits:
                    hits[w] = any(m in seeds for m in marks(w))
                y[k] = label and hits[w]
            # Chains with seeds, in documents of either class, and some of the others.
            if any(hits[w] for w in words) or rng.random() < 0.1:
                tokens.extend(number.setdefault(w, len(number)) for w in words)
                truth.extend(y)
                sizes.append(n)
    words = list(number)
    owner, flat = feature_arrays(words)
    tokens, truth, sizes = np.array(tokens, np.int64), np.array(truth, float), np.array(sizes, np.int64)
    first = np.cumsum(sizes) - sizes
    inner = np.ones(len(tokens), bool)
    inner[first] = False
    at = np.flatnonzero(inner)
    seen = np.array([((1 - truth[at - 1]) * truth[at]).sum(), (truth[at - 1] * (1 - truth[at])).sum(), (truth[at - 1] * truth[at]).sum()])
    theta = np.zeros(BUCKETS + 4)
    theta[BUCKETS] = -3.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    scale = 1.0 / max(1.0, truth.sum())
    for k in range(1, rounds + 1):
        by_word = np.bincount(owner, theta[flat], len(words)) + theta[BUCKETS]
        p, pairs, _ = forward_backward(by_word[tokens], sizes, theta[BUCKETS + 1 :])
        gap = p - truth
        by_word = np.bincount(tokens, gap, len(words))
        g = np.concatenate([np.bincount(flat, by_word[owner], BUCKETS), [gap.sum()], pairs - seen]) * scale
        g += 2e-4 * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta -= 0.25 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    model = ToxicModel(theta[:BUCKETS].astype(np.float32), float(theta[BUCKETS]), tuple(theta[BUCKETS + 1 :].tolist()))
    scorer = ToxicScorer(model)
    found = [scorer.evidence([chunks_of(t) for t in block])[:2] for block in scorer.blocks(texts)]
    total, most = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    x = np.stack([np.ones(len(texts)), total, most], axis=1)
    return ToxicModel(model.weights, model.bias, model.trans, fit_head(x, np.array(toxic, float)))


def fit_head(x: np.ndarray, y: np.ndarray, rounds: int = 30, ridge: float = 0.5) -> tuple[float, ...]:
    """Logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    hold = ridge * np.diag([0.0] + [1.0] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + hold @ w
        h = (x * (p * (1 - p))[:, None]).T @ x + hold + 1e-6 * np.eye(len(w))
        w -= np.linalg.solve(h, g)
    return tuple(w.tolist())


class ToxicScorer:
    def __init__(self, model: ToxicModel):
        self.model = model
        self.cache = BoundedCache()

    def learn(self, chunks: list[str]) -> None:
        weights, bias = self.model.weights, self.model.bias
        owner, flat = feature_arrays(map(core, chunks))
        self.cache.update(zip(chunks, (np.bincount(owner, weights[flat], len(chunks)) + bias).tolist(), strict=True))

    def marginals(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Of all chunks of all texts, and how many chunks each text has."""
        cache = self.cache
        cache.make_room()
        new = cache.missing(chain.from_iterable(texts))
        for k in range(0, len(new), 20_000):
            self.learn(new[k : k + 20_000])
        counts = np.fromiter(map(len, texts), np.int64, len(texts))
        emission = np.fromiter(map(cache.__getitem__, chain.from_iterable(texts)), float, int(counts.sum()))
        sizes = np.array([n for chunks in texts for n in chain_sizes(chunks)], np.int64)
        cache.entered(new)
        if not len(sizes):
            return np.zeros(0), counts
        # A toxic run of n tokens is at most exp(sum of its emissions and transitions) likely: where no
        # token is above ``least``, all runs over a token together are under 2e-5, and the chain needn't be run.
        ct, tc, tt = self.model.trans
        least = min(-12.0 - max(ct, 0.0) - max(tc, 0.0), -1.0 - tt)
        starts = np.cumsum(sizes) - sizes
        live = np.maximum.reduceat(emission, starts) > least
        out = np.zeros(len(emission))
        if live.any():
            keep = np.repeat(live, sizes)
            out[keep] = forward_backward(emission[keep], sizes[live], self.model.trans)[0]
        return out, counts

    def evidence(self, split: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the texts that the chunks are from: log(1 + expected toxic tokens), the largest marginal, and all marginals."""
        p, counts = self.marginals(split)
        starts = np.cumsum(counts) - counts
        return np.log1p(np.add.reduceat(np.where(p >= LIKELY, p, 0.0), starts)), np.maximum.reduceat(p, starts), p

    def blocks(self, texts: list[str | None], block_chars: int = 1_000_000) -> Iterator[list[str]]:
        block, held = [], 0
        for text in texts:
            block.append(text or "")
            held += len(block[-1])
            if held >= block_chars:
                yield block
                block, held = [], 0
        if block:
            yield block

    def score_all(self, texts: list[str | None]) -> list[tuple[float, list[dict]]]:
        if self.model.weights is None:
            return [(min(1.0, max(0.0, self.model.head[0])), [])] * len(texts)
        return [x for block in self.blocks(texts) for x in self._score_block(block)]

    def _score_block(self, texts: list[str]) -> list[tuple[float, list[dict]]]:
        split = [chunks_of(t) for t in texts]
        total, most, p = self.evidence(split)
        a, b, c = self.model.head
        scores = 1 / (1 + np.exp(-np.clip(a + b * total + c * most, -30, 30)))
        spans: list[list[dict]] = [[] for _ in texts]
        starts = np.cumsum([0, *map(len, split)])
        offending = np.flatnonzero(p >= 0.5)
        owner = np.searchsorted(starts, offending, side="right") - 1
        for k in np.unique(owner).tolist():
            chunks, at, known = split[k], starts_of(texts[k]), spans[k]
            for t in (offending[owner == k] - starts[k]).tolist():
                # Edges are looked for in the text itself: some letters are longer in lower case.
                start, end = at[t] + len(chunks[t]) - len(chunks[t].lstrip(EDGES)), at[t] + len(chunks[t].rstrip(EDGES))
                if known and start < known[-1]["end"]:  # overlapping windows
                    known[-1]["end"] = end
                else:
                    known.append({"start": start, "end": end})
        return list(zip(scores.tolist(), spans, strict=True))


def _factory(model: ToxicModel):
    scorer = worker_state(("toxicity", model.digest()), lambda: ToxicScorer(model))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(texts: list[str | None]) -> pa.StructArray:
        found = scorer.score_all(texts)
        scores, spans = zip(*found, strict=True) if found else ((), ())
        return struct_array(score=pa.array(scores, pa.float64()), spans=pa.array(spans, kind))

    return run


def within(sizes: list[int], most: int) -> list[int]:
    """Places of the items that are taken in turn while they fit into ``most``; one that doesn't is passed over."""
    out, held = [], 0
    for k, n in enumerate(sizes):
        if held + n <= most:
            out.append(k)
            held += n
    return out


def train(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1) -> ToxicModel:
    """Fit on a bounded sample of labelled documents outside the held-out fold.

    At most ``SAMPLE_TOXIC`` and ``SAMPLE_CLEAN`` labels are picked, evenly by a hash, and
    sent to the documents (a broadcast of that many ids). Of the documents found, whole
    ones of any length are taken in the order of the hash while all taken of a class
    have no more than ``CHARS_TOXIC`` or ``CHARS_CLEAN`` characters. The driver gets those.
    """
    known = labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("label"))
    known = known.filter(F.col("label").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % folds != held)).groupBy("doc_id").agg(F.max("label").alias("label"))
    picked = even_sample(known, "label", "doc_id", SAMPLE_CLEAN)
    order = F.xxhash64(F.lit(3), "doc_id")
    toxic = picked.filter("label = 1").orderBy(order, "doc_id").limit(SAMPLE_TOXIC)
    ids = toxic.unionByName(picked.filter("label = 0")).toArrow()
    if not ids.num_rows:
        return fit([], [])
    chosen = docs.sparkSession.createDataFrame(ids)
    bodies = docs.select("doc_id", F.col("text").alias("body")).filter("body is not null")
    found = bodies.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("label").alias("label"), F.min("body").alias("body"))
    found = cut(found, "labelled")
    sizes = found.select("doc_id", "label", F.length("body").alias("n")).orderBy(order, "doc_id").collect()  # as many as were picked
    taken: list[int] = []
    for label, most in ((1, CHARS_TOXIC), (0, CHARS_CLEAN)):
        of = [r for r in sizes if r.label == label]
        taken += [of[k].doc_id for k in within([r.n for r in of], most)]
    if len(taken) < len(sizes):
        found = found.join(F.broadcast(docs.sparkSession.createDataFrame([(x,) for x in taken], found.select("doc_id").schema)), "doc_id", "left_semi")
    sample = found.toArrow().sort_by("doc_id")
    return fit(sample.column("body").to_pylist(), [bool(x) for x in sample.column("label").to_pylist()])


def with_toxicity(df: DataFrame, model: ToxicModel, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """``df`` plus a struct with ``score`` and ``spans`` (character offsets of offending tokens)."""
    return add_struct(df, [text_col], out, FIELDS, _factory, model)


def keep_civil(df: DataFrame, model: ToxicModel, text_col: str = "text", least: float = 0.7) -> DataFrame:
    """The rows of ``df`` that score under ``least``, with the columns that they came with."""
    name = free_name(df, "toxicity_verdict")
    return with_toxicity(df, model, text_col, name).filter(F.col(f"`{name}`.score") < least).drop(name)


def toxicity_report(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, least: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted and spans for every row of ``docs``."""
    model = train(docs, labels, folds, held)
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == held, F.lit(True))
    narrow = docs.select("doc_id", out.alias("held_out"), F.col("text").alias("body"))
    scored = with_toxicity(narrow, model, "body", "t")
    return scored.select("doc_id", "held_out", F.col("t.score").alias("score"), (F.col("t.score") >= least).cast("int").alias("predicted"), F.col("t.spans").alias("spans"))
