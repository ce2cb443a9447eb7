"""Whitening of embeddings: moments by Chan's merging, components by eigh, a second pass that verifies.

Each entry c becomes the whole number floor(64 * c) + 1,000,000. The moments are taken
over the distinct vectors of these (the fit list): each partition gives its count, exact
sums, local mean and centred scatter; ``treeReduce`` merges two such summaries by Chan's
formula, so the driver gets one d x d matrix. Its eigenvectors whiten all rows. The second
pass sums up the whitened fit list the same way and says how far its covariance is from
the identity.

Rows whose vector is null, empty or holds a null or non-finite entry are dropped. Vectors
have one length; if there are several, the one with the most distinct vectors counts (of
equals the largest) and rows of others are dropped too. Repeated rows are whitened alike
and count once in the fit. Components are at most 16 and at most the vector's length.
A component along which nothing varies has ``whitened`` null and takes no part in
``identity_error``; where nothing varies at all, ``explained`` and ``identity_error`` are null
too. A null vec_id stays null. An empty table gives no rows. ``deviation`` is exact; it is
null where it doesn't fit into a long, and entries are held within 2^52 in size. Other
columns pass through ``with_whitened``, which refuses output columns that are there already.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_struct, cut, struct_array

#: Fixed by the query's contract.
SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Entries of the fit list are summed up in blocks of so many bytes.
BLOCK = 4 << 20
LARGEST = float(1 << 52)


@dataclass
class Moments:
    """Count, exact sums (of entries without ``OFFSET``), mean and centred scatter of some vectors."""

    n: int
    total: list[int]
    mean: np.ndarray
    scatter: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        """Of the rows of ``x``, whole numbers without ``OFFSET``."""
        mean = x.mean(axis=0, dtype=np.float64)
        apart = x - mean
        # What rounding leaves in the mean is taken out of the scatter.
        rest = apart.mean(axis=0)
        apart -= rest
        high, low = np.divmod(x, 1 << 20)
        total = [(int(h) << 20) + int(p) for h, p in zip(high.sum(axis=0), low.sum(axis=0), strict=True)]
        return cls(len(x), total, mean + rest, apart.T @ apart)

    def merged(self, other: Moments) -> Moments:
        """Chan: the scatters and what the distance of the means adds."""
        n = self.n + other.n
        between = other.mean - self.mean
        scatter = self.scatter + other.scatter + np.outer(between, between) * (self.n / n * other.n)
        return Moments(n, [a + b for a, b in zip(self.total, other.total, strict=True)], self.mean + between * (other.n / n), scatter)


def merge_lengths(a: dict[int, Moments], b: dict[int, Moments]) -> dict[int, Moments]:
    """Summaries by the length of the vectors."""
    return {d: a[d].merged(b[d]) if d in a and d in b else a[d] if d in a else b[d] for d in a.keys() | b.keys()}


@dataclass
class Whitening:
    """What whitens a vector: x - S / n, projected on the components, over sqrt(e)."""

    n: int
    #: Sums by dimension, as exact numbers, of entries without ``OFFSET``.
    total: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float | None = None
    held: list[bool] = field(default_factory=list)

    def __post_init__(self):
        # A variance that rounding alone could leave is none.
        least = np.finfo(float).eps * max(1, len(self.total)) * max(self.trace, 0.0)
        self.held = [bool(e > least) for e in self.eigenvalues]

    @classmethod
    def fit(cls, moments: Moments, most: int = COMPONENTS) -> Whitening:
        v = moments.scatter / moments.n
        values, vectors = np.linalg.eigh((v + v.T) / 2)
        order = np.argsort(-values, kind="stable")[:most]
        return cls(moments.n, moments.total, vectors[:, order], np.maximum(values[order], 0.0), float(np.trace(v)))

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n. Quotient and remainder of S by n are whole, so only the last step rounds."""
        whole = np.array([t // self.n for t in self.total], np.int64)
        part = np.array([t % self.n / self.n for t in self.total])
        return (x - whole).astype(np.float64) - part

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Rows of x by component; NaN where a component has no variance."""
        scale = np.array([1 / np.sqrt(e) if h else np.nan for e, h in zip(self.eigenvalues, self.held, strict=True)])
        return self.centred(x) @ self.components * scale

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exact; None past the largest long."""
        apart = [max(abs(int(a) * self.n - t), abs(int(b) * self.n - t)) for a, b, t in zip(x.min(axis=0), x.max(axis=0), self.total, strict=True)] if len(x) else []
        if sum(a * a for a in apart) < 1 << 63:
            d = (x - np.array([t // self.n for t in self.total], np.int64)) * self.n - np.array([t % self.n for t in self.total], np.int64)
            return (d * d).sum(axis=1).tolist()
        d = x.astype(object) * self.n - np.array(self.total, object)
        return [int(s) if s < 1 << 63 else None for s in (d * d).sum(axis=1)]

    def explained(self) -> list[float | None]:
        return [float(e / self.trace) if self.trace > 0 else None for e in self.eigenvalues]


def whole_entries(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """floor(64 c) of all entries in one array, where each row's begin, and which rows are fit for use."""
    vectors = vectors.cast(pa.list_(pa.float64()))
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    entries = pc.fill_null(vectors.flatten(), float("nan")).to_numpy(zero_copy_only=False)
    begins = np.concatenate([[0], np.cumsum(lengths)])
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(entries))])
    fit = (lengths > 0) & (bad[begins[1:]] == bad[begins[:-1]])
    whole = np.floor(np.clip(np.where(np.isfinite(entries), entries, 0.0), -LARGEST / SCALE, LARGEST / SCALE) * SCALE).astype(np.int64)
    return whole, begins, fit


def pieces(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Batches cut so that the vectors of one take about ``BLOCK`` bytes."""
    for batch in batches:
        at = 0
        while at < len(batch):
            longest = max(1, int(pc.max(pc.list_value_length(batch.slice(at, 64))).as_py() or 1))
            size = max(1, min(len(batch) - at, BLOCK // (16 * longest)))
            yield batch.slice(at, size)
            at += size


def fit_list(df: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """``key``: each distinct vector of whole numbers once, packed in 4 or 8 bytes an entry; the last byte says which.

    Copies go before the shuffle, so a vector that a third of all rows hold is a row for each task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for column in pieces(b.column(0) for b in batches):
            whole, begins, fit = whole_entries(column)
            keys = []
            for k in np.flatnonzero(fit):
                x = whole[begins[k] : begins[k + 1]]
                narrow = x.astype("<i4")
                keys.append(narrow.tobytes() + b"\x04" if (narrow == x).all() else x.astype("<i8").tobytes() + b"\x08")
            yield pa.RecordBatch.from_arrays([pa.array(list(dict.fromkeys(keys)), pa.binary())], names=["key"])

    return df.select(F.col(f"`{vector_col}`")).mapInArrow(run, "key binary").distinct()


def unpacked(keys: list[bytes]) -> dict[int, np.ndarray]:
    """Arrays of the fit list's rows by length of the vector."""
    by_form: dict[tuple[int, int], list[bytes]] = {}
    for k in keys:
        by_form.setdefault((k[-1], (len(k) - 1) // k[-1]), []).append(k[:-1])
    out: dict[int, list[np.ndarray]] = {}
    for (width, d), rows in by_form.items():
        out.setdefault(d, []).append(np.frombuffer(b"".join(rows), f"<i{width}").reshape(len(rows), d).astype(np.int64))
    return {d: np.concatenate(parts) for d, parts in out.items()}


def _summed(fits: DataFrame, view=None) -> dict[int, Moments]:
    """Moments of the fit list by length of vectors, or of what ``view`` (of (x)) makes of the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Moments] = {}
        for batch in batches:
            most = max(1, BLOCK // max(1, int(pc.max(pc.binary_length(batch.column(0))).as_py() or 1)))
            for at in range(0, batch.num_rows, most):
                for d, x in unpacked(batch.column(0).slice(at, most).to_pylist()).items():
                    if view:
                        y = view(x)
                        if y is None:
                            continue
                        mean = y.mean(axis=0)
                        found = Moments(len(y), [0] * y.shape[1], mean, (y - mean).T @ (y - mean))
                    else:
                        found = Moments.of(x)
                    held = merge_lengths(held, {d: found})
        rows = [(d, m.n, [str(t) for t in m.total], m.mean.tobytes(), m.scatter.tobytes()) for d, m in held.items()]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["d", "n", "total", "mean", "scatter"])

    def read(row) -> dict[int, Moments]:
        mean = np.frombuffer(row.mean, np.float64)
        return {row.d: Moments(row.n, [int(t) for t in row.total], mean, np.frombuffer(row.scatter, np.float64).reshape(len(mean), len(mean)))}

    parts = fits.mapInArrow(run, "d long, n long, total array<string>, mean binary, scatter binary").rdd
    # As deep as the partitions need, so that no task and not the driver merges more than some sixteen summaries.
    depth = 2
    while 16**depth < parts.getNumPartitions():
        depth += 1
    return parts.map(read).treeReduce(merge_lengths, depth)


def fit_whitening(df: DataFrame, vector_col: str = "embedding", most: int = COMPONENTS) -> Whitening | None:
    """Fits and verifies; None if no row has a vector that can be used."""
    fits = cut(fit_list(df, vector_col), "fit")
    if fits.isEmpty():
        return None
    found = _summed(fits)
    d = max(found, key=lambda k: (found[k].n, k))
    model = Whitening.fit(found[d], most)
    held = np.array(model.held, bool)
    if held.any():
        again = _summed(fits, lambda x: model.whitened(x)[:, held] if x.shape[1] == d else None)[d]
        # Whitened means are zero up to rounding, which the centred scatter leaves out.
        model.identity_error = float(np.abs(again.scatter / again.n - np.eye(int(held.sum()))).max())
    return model


def _factory(model: Whitening):
    d = len(model.total)

    def run(vectors: list[list[float] | None]) -> pa.StructArray:
        whole, begins, fit = whole_entries(pa.array(vectors, pa.list_(pa.float64())))
        fit &= np.diff(begins) == d
        x = whole[(begins[:-1][fit][:, None] + np.arange(d)).ravel()].reshape(-1, d)
        deviation: list[int | None] = [None] * len(vectors)
        values: list[np.ndarray | None] = [None] * len(vectors)
        for k, dev, row in zip(np.flatnonzero(fit), model.deviation(x), model.whitened(x), strict=True):
            deviation[k], values[k] = dev, row
        return struct_array(fits=pa.array(fit), deviation=pa.array(deviation, pa.int64()), whitened=pa.array(values, pa.list_(pa.float64())))

    return run


def with_whitened(df: DataFrame, model: Whitening, vector_col: str = "embedding", out: str = "white") -> DataFrame:
    """``df`` plus a struct: ``fits`` (the vector can be used), ``deviation`` and ``whitened`` (an array by component, NaN where nothing varies)."""
    return add_struct(df, [vector_col], out, "fits boolean, deviation long, whitened array<double>", _factory, model)


def whitening_report(df: DataFrame, vector_col: str = "embedding", id_col: str = "vec_id", most: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error for each row that can be used."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit_whitening(df, vector_col, most)
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    narrow = df.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vector_col}`").alias("body"))
    rows = with_whitened(narrow, model, "body", "w").filter("w.fits")
    rows = rows.select("vec_id", "w.deviation", F.posexplode("w.whitened").alias("k", "value"))
    explained = F.array(*[F.lit(e).cast("double") for e in model.explained()])
    return rows.select(
        "vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
        F.when(~F.isnan("value"), F.col("value")).alias("whitened"), F.element_at(explained, F.col("k") + 1).alias("explained"),
        F.lit(model.identity_error).cast("double").alias("identity_error"),
    )
