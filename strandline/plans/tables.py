"""Inputs of the catalogue's queries: pairs, sequences and alignments from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bases

#: Order lines in a total order: some share their line number.
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as sequences; dealt out if they come in fewer splits than there are cores."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_id"), F.col("text").alias("seq"))
    cores = spark.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(4 * cores)


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("seq_id"), F.col("text").alias("seq"))


def document_dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).withColumn("seq", bases.dna_letters(F.col("seq")))


def passage_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, first, second: each passage and the one with the next id."""
    one = passages(spark, sf_dir).select(F.col("seq_id").alias("pair_id"), F.col("seq").alias("first"))
    two = passages(spark, sf_dir).select((F.col("seq_id") - 1).alias("pair_id"), F.col("seq").alias("second"))
    return one.join(two, "pair_id")


def related_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, first, second: each passage and a copy with points changed and its middle third doubled."""
    seq = passages(spark, sf_dir)
    third = F.floor(F.length("seq") / 3).cast("int")
    middle = F.substring(F.col("seq"), third + 1, third)
    copy = F.concat(F.substring(F.col("seq"), F.lit(1), third * 2), middle, F.substring(F.col("seq"), third * 2 + 1, F.length("seq")))
    return seq.select(F.col("seq_id").alias("pair_id"), F.col("seq").alias("first"), F.translate(copy, "q,", "k;").alias("second"))


def order_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """aln_id, ord, len, op: one alignment for each order, a step for each line."""
    rows = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    op = F.element_at(F.array(*[F.lit(x) for x in "MXID"]), (F.col("l_linenumber") % 4 + 1).cast("int"))
    return rows.select(F.col("l_orderkey").alias("aln_id"), (F.row_number().over(order) - 1).alias("ord"), F.col("l_quantity").cast("long").alias("len"), op.alias("op"))


def one_long_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """aln_id (1), ord, len, op: the steps of all orders as one alignment; an order's lines take at most 64 places."""
    steps = order_steps(spark, sf_dir)
    return steps.select(F.lit(1).cast("long").alias("aln_id"), (F.col("aln_id") * 64 + F.col("ord")).alias("ord"), "len", "op")


def part_segments(spark: SparkSession, sf_dir: str, flag: str) -> DataFrame:
    """id (supplier), name (order), left, right: a stretch of parts for each line with that return flag."""
    rows = table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == flag)
    return rows.select(F.col("l_suppkey").alias("id"), F.col("l_orderkey").alias("name"), F.col("l_partkey").alias("left"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("right"))
