"""Writers of the engine's tables as files, in the forms that the readers take.

With ``ids``, for tables of many pairs, a first column pair_id says which pair a
line belongs to; the readers take the forms without it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bases import join_fields, wrap


def _csv(df: DataFrame, path: str, sep: str = ",", header: bool = True, compression: str = "none") -> None:
    df.write.csv(path, sep=sep, header=header, compression=compression, emptyValue="")


def _ids(ids: bool) -> list[Column]:
    return [F.col("pair_id")] if ids else []


def matches(df: DataFrame, path: str, ids: bool = False, **options) -> None:
    """FstFreq, SndFreq, Length, FstStarts, SndStarts."""
    named = df.select(
        *_ids(ids), F.col("first_freq").alias("FstFreq"), F.col("second_freq").alias("SndFreq"), F.col("len").alias("Length"),
        join_fields(F.col("first_starts")).alias("FstStarts"), join_fields(F.col("second_starts")).alias("SndStarts"),
    )
    _csv(named, path, sep="\t", **options)


def rare_prefixes(df: DataFrame, path: str, ids: bool = False) -> None:
    """Pos and Length, a folder for each m and n."""
    df.select(*_ids(ids), "m", "n", F.col("pos").alias("Pos"), F.col("len").alias("Length")).write.partitionBy("m", "n").csv(path, sep="\t", header=True)


def cigars(df: DataFrame, path: str, column: str = "cigar", compression: str = "none", ids: bool = False) -> None:
    """One line for each alignment; with ``ids``, the pair's id and a tab before it."""
    line = F.concat_ws("\t", *[c.cast("string") for c in _ids(ids)], F.col(column))
    df.select(line.alias("value")).write.option("compression", compression).text(path)


def path_counts(df: DataFrame, path: str, ids: bool = False, **options) -> None:
    _csv(df.select(*_ids(ids), "start_1", "start_2", "len", "n_opt_paths_fwd", "n_opt_paths_rev", "n_count", "m_count"), path, **options)


#: The first line of bridge files. Fixed value.
BRIDGES_COMMENT = "#Bridges in alignment step"


def bridges(df: DataFrame, path: str, compression: str = "none", ids: bool = False) -> None:
    """A comment line, a header line, and rows, in every file."""
    rows = df.select(*_ids(ids), "start_1", "start_2", "end_1", "end_2")
    top = [BRIDGES_COMMENT, ",".join(rows.columns)]

    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(top)], names=["value"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays(batch.columns, names=["value"])

    lines = rows.select(F.concat_ws(",", *[F.col(c).cast("string") for c in rows.columns]).alias("value"))
    lines.mapInArrow(headed, "value string").write.option("compression", compression).text(path)


def kmer_alignment(df: DataFrame, path: str, ids: bool = False, **options) -> None:
    """Left and right positions, a minus for a gap, no header."""
    _csv(df.select(*_ids(ids), *[F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c) for c in ("left", "right")]), path, sep="\t", header=False, **options)


def indexed_alignment(df: DataFrame, path: str, ids: bool = False, compression: str = "none") -> None:
    """Lines of a left and a right k-mer as (number among its side's, position), a minus for a gap.

    ``df`` has pair_id, ord, left, right; every k-mer of a side stands in one row.
    """
    before = Window.partitionBy("pair_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    sides = [
        F.when(F.col(c).isNull(), "-").otherwise(F.concat(F.lit("("), F.coalesce(F.count(c).over(before), F.lit(0)).cast("string"), F.lit(", "), F.col(c).cast("string"), F.lit(")"))).alias(c)
        for c in ("left", "right")
    ]
    numbered = df.select("pair_id", "ord", *sides).sortWithinPartitions("pair_id", "ord")
    line = F.concat_ws(" ", *[c.cast("string") for c in _ids(ids)], "left", "right")
    numbered.select(line.alias("value")).write.option("compression", compression).text(path)


def blocks(df: DataFrame, path: str, header: bool = False, id_col: str | None = None, **options) -> None:
    """st1, en1, st2, en2, after the column ``id_col`` if one is named."""
    _csv(df.select(*([id_col] if id_col else []), "st1", "en1", "st2", "en2"), path, sep="\t", header=header, **options)


def conserved_regions(df: DataFrame, path: str, **options) -> None:
    _csv(df.select("first_start", "second_start", "first_end", "second_end"), path, **options)


def fasta(df: DataFrame, path: str, width: int = 60, compression: str = "none") -> None:
    """Records (seq_id, seq) with lines of ``width`` letters."""
    body = F.when(F.length("seq") > 0, F.concat(F.lit("\n"), wrap(F.col("seq"), width))).otherwise("")
    df.select(F.concat(F.lit(">"), F.col("seq_id").cast("string"), body).alias("value")).write.option("compression", compression).text(path)
