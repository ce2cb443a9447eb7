"""Shared plumbing: shared-folder tables, batch evaluation, memory bounds of workers."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Paths of the intermediate tables that this driver has written and not yet deleted.
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see, from ``spark.checkpoint.dir``.

    Only a session that runs in one process (master ``local``) may lack that
    setting: it gets a temporary folder. On any cluster the lack is an error, as a
    folder of the driver's machine isn't the executors'.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="strandline-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def new_table_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder for something that ``release`` deletes."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    # With its scheme, as workers read some tables without Spark.
    path = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    if path.startswith("file:/") and not path.startswith("file:///"):
        path = "file://" + path.removeprefix("file:")
    _written.append(path)
    return path


def few_files(spark: SparkSession, rows: int, rows_of_a_file: int = 250_000) -> int:
    """Files for a narrow table of at most ``rows`` rows: as many as it needs, no more than a shuffle has partitions."""
    return max(8, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_of_a_file)))


def cut(df: DataFrame, name: str = "cut", by: str | None = None, files: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder, in folders of column ``by`` if given, and read it back: the lineage ends there.

    ``files`` merges partitions for the write. Small tables want that: some stores
    start a process for each file that an executor creates.
    """
    spark = df.sparkSession
    path = new_table_path(spark, name)
    df = df.coalesce(files) if files else df
    writer = df.write.partitionBy(by) if by else df.write
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._strandline_path = path
    return out


def path_of(df: DataFrame) -> str | None:
    """Where ``cut`` has put a table."""
    return getattr(df, "_strandline_path", None)


def drop_cut(df: DataFrame | None) -> None:
    """Delete a table made by ``cut`` that nothing reads any more."""
    path = path_of(df)
    if path:
        delete_path(df.sparkSession, path)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    if path in _written:
        _written.remove(path)


def release(spark: SparkSession, since: int = 0) -> None:
    """Delete the intermediate tables and archives written so far (from the ``since``-th that is still there).

    Operators return DataFrames that read them, so call this when those results are
    written or no longer wanted.
    """
    for path in _written[since:]:
        delete_path(spark, path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``make`` returns, as a table in the shared folder; the tables that making it took are deleted."""
    had = len(_written)
    made = make()
    before = _written[had:]
    out = cut(made, name)
    for path in before:
        if path in _written:
            delete_path(spark, path)
    return out


#: Bytes of a batch that are turned into Python values at a time.
SLICE = 4 << 20


def slices(columns: list[pa.Array], most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges that cover the columns of a batch; one holds ``most`` bytes of text, or a single row.

    Spark bounds a batch by rows and by ``spark.sql.execution.arrow.maxBytesPerBatch``;
    Python's own values take several times an array's room, and most operators make more of them.
    """
    n = len(columns[0])
    sizes = np.full(n, 64, np.int64)
    for c in columns:
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type):
            sizes += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
        elif pa.types.is_list(c.type):
            sizes += 8 * pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < n:
        before = int(ends[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield at, end
        at = end


def add_struct(df: DataFrame, inputs: list[str], out: str, ddl: str, factory: Callable, *args) -> DataFrame:
    """Append a struct column computed batch by batch in Arrow.

    ``factory(*args)`` is called once per task and returns a function from
    lists of Python values (one per input column, for a slice of a batch) to a
    ``pyarrow.StructArray`` with the fields of ``ddl``. All columns of ``df`` pass
    through untouched, whatever their names are; ``out`` must be none of them.
    """
    if out.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"the table has a column {out!r} already; give another name for the result")

    def run(batches: Iterator) -> Iterator[pa.Array]:
        f = factory(*args)
        for batch in batches:
            columns = list(batch) if isinstance(batch, tuple) else [batch]
            for a, b in slices(columns):
                yield f(*[c.slice(a, b - a).to_pylist() for c in columns])

    if len(inputs) == 1:

        def evaluate(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            return run(batches)

    else:

        def evaluate(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            return run(batches)

    udf = F.arrow_udf(evaluate, returnType=ddl).asNondeterministic()
    return df.withColumn(out, udf(*[F.col(f"`{c}`") for c in inputs]))


def struct_array(**columns: pa.Array) -> pa.StructArray:
    return pa.StructArray.from_arrays(list(columns.values()), names=list(columns))


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, lengthened until no column of ``df`` has it."""
    have = {c.lower() for c in df.columns}
    while wanted.lower() in have:
        wanted += "_"
    return wanted


def scan_only(df: DataFrame) -> bool:
    """Whether each row of ``df`` is one row of one Parquet file, and no file's row comes twice.

    That is so if there is one scan, of paths that don't overlap, under nothing but
    projections and filters that give the same rows whenever they run. Joins, unions,
    explodes and samples may repeat a row of a file.
    """
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        if not plan.deterministic():
            return False
        plan = plan.children().head()
    if plan.getClass().getSimpleName() != "LogicalRelation":
        return False
    relation = plan.relation()
    if relation.getClass().getSimpleName() != "HadoopFsRelation":
        return False
    found = relation.location().rootPaths()
    paths = sorted(found.apply(k).toString().rstrip("/") + "/" for k in range(found.size()))
    return not any(b.startswith(a) for a, b in zip(paths, paths[1:], strict=False))


def table_rows_of(df: DataFrame) -> tuple[DataFrame, Column, Column]:
    """``df`` with columns for the file of each row and its place there, which name no other row.

    A table that Spark reads from Parquet files, filtered or not, has them; anything
    else is written to the shared folder and read back.
    """
    for found in (lambda: df if scan_only(df) else None, lambda: cut(df, "rows")):
        table = found()
        if table is None:
            continue
        try:
            hidden = table.metadataColumn("_metadata")
            file, place = hidden["file_path"], hidden["row_index"]
            table.select(file, place).schema  # noqa: B018
            return table, file, place
        except AnalysisException:
            continue
    raise ValueError("the shared folder's tables have no row numbers")


class BoundedCache(dict):
    """A dict for results by word that holds about ``limit`` bytes, in two generations.

    When half of them are taken, what there is becomes the old generation, and the old
    one goes; words that are met again come back from it. An entry counts for its word's
    and its value's characters or bytes and the room that Python needs for any entry.
    """

    ENTRY = 220

    def __init__(self, limit: int = 64 << 20, longest: int = 256):
        super().__init__()
        self.limit, self.longest, self.held = limit, longest, 0
        self.old: dict = {}

    def make_room(self) -> None:
        """Call between, never within, the uses of what is looked up together."""
        if self.held > self.limit // 2:
            self.old = dict(self)
            super().clear()
            self.held = 0

    def clear(self) -> None:
        super().clear()
        self.held, self.old = 0, {}

    def missing(self, words: Iterable[str]) -> list[str]:
        """Those of some words, once each, that neither generation holds."""
        absent = [w for w in set(words) if w not in self]
        if self.old:
            back = {w: self.old[w] for w in absent if w in self.old}
            self.update(back)
            self.held += self.ENTRY * len(back) + 5 * sum(map(len, back))
            absent = [w for w in absent if w not in back]
        return absent

    def entered(self, keys: list[str]) -> None:
        """Say which keys were added. Long ones are forgotten: few texts share them, and they would take the room of many."""
        long = [k for k in keys if len(k) > self.longest]
        for k in long:
            self.pop(k, None)
        self.held += self.ENTRY * len(keys) + 5 * (sum(map(len, keys)) - sum(map(len, long)))


_held: dict[tuple, object] = {}


def worker_state(key: tuple, make: Callable):
    """Tables and caches that a Python worker keeps from one task to the next, for one operator at a time.

    Workers outlive stages. When the next operator's tasks come, what the last one held is let go.
    """
    if key not in _held:
        _held.clear()
        gc.collect()
        _held[key] = make()
    return _held[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def repository_root() -> str:
    return os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


#: Labels that a sample can be even over; beyond that, those with the most rows.
MOST_LABELS = 1000


def even_sample(df: DataFrame, label_col: str, key_col: str, per_label: int | Callable[[int], int], seed: int = 11, condition: Column | None = None, most_labels: int = MOST_LABELS) -> DataFrame:
    """At most ``per_label`` rows of each label, picked by a hash of ``key_col``.

    Labels are counted first, without any other column; of more than ``most_labels``
    those with the most rows take part (of equals, the first in order). Rows are then
    thinned by their hash to about twice what is wanted, before ``condition`` is looked
    at, and only that bounded number is shuffled to find the exact limit. ``per_label``
    may be a function of how many labels there are. Rows with equal keys stay or go
    together until the limit.
    """
    sizes = df.filter(F.col(label_col).isNotNull()).groupBy(label_col).count().orderBy(F.desc("count"), label_col).limit(most_labels).collect()
    if not sizes:
        return df.limit(0)
    most = per_label(len(sizes)) if callable(per_label) else per_label
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r[label_col], (2.0 * most + 20) / r["count"])])
    rank = F.pmod(F.xxhash64(F.lit(seed), F.col(key_col)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    thin = df.withColumn("_rank", rank).filter(F.col("_rank") < F.element_at(share, F.col(label_col)))
    if condition is not None:
        thin = thin.filter(condition)
    order = Window.partitionBy(label_col).orderBy("_rank", key_col)
    return thin.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= most).drop("_rank", "_place")
