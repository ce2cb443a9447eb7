"""Alignment of pairs as they arrive: stateless, so a stream takes the batch operator as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import align

SCHEMA = "pair_id long, first string, second string"


def read(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Pairs from Parquet files that appear under ``path``."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def align_to(pairs: DataFrame, path: str, checkpoint: str, once: bool = False, **options) -> StreamingQuery:
    """Write the alignments of a stream of pairs as Parquet, each pair exactly once."""
    out = align.align(pairs, **options).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (out.trigger(availableNow=True) if once else out).start()
