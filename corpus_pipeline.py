"""From raw documents to packed training sequences.

Every stage takes (spark, docs, sf_dir) and returns a table that is written and
read again before the next one. All but the last return the columns of
``documents``; a stage's decisions hold for those after it. Each may be called by
itself: it tells Python workers where this repository is.

In all stages a null text is an empty one. Empty texts fail the quality rules, so
later stages see none when run in turn. Repeated rows are judged alike until near-dedup,
where one row of a doc_id and text stays; rows without a doc_id pass near-dedup. Texts
are read whole, whatever their length, and no limit cuts a table. An empty table
passes through as one. Columns beside doc_id and text, of any name, are carried along
up to packing, which returns its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import packing, quality, simhash, toxicity
from strandline.llm.common import drop_cut, settled, table
from strandline.workers import import_from_here


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the compression bands."""
    import_from_here(spark)
    return quality.keep_good(docs)


def civil_only(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.7 for toxicity; the tagger learns from the labels in ``sf_dir``."""
    import_from_here(spark)
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.keep_civil(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the least doc_id."""
    import_from_here(spark)
    return simhash.keep_one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    import_from_here(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", civil_only),
    ("simhash_near_dedup", near_dedup),
    ("packing", pack),
]

#: Compression, tagging and hashing have no SQL: the pipeline is tested stage by stage instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, over all documents of ``sf_dir``.

    Each stage's table is deleted when the next one is written; the last of them and what
    the result reads go with ``strandline.llm.common.release``.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = docs
        docs = settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
        drop_cut(before)
    return STAGES[-1][1](spark, docs, sf_dir)
