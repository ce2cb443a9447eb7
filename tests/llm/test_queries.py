"""The registered queries and the pipeline, over whole small tables."""

import os
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from strandline.llm import packing, quality, queries, simhash, toxicity
from strandline.llm.common import even_sample, free_name, table

from .common import SCHEMA, documents, odd_documents

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_return_every_row(spark, name):
    found = queries.queries()[name](spark, DATA)
    n = found.count()
    if name.startswith("op2_"):
        assert n == 5 * table(spark, DATA, "embeddings").filter("vec_id % 50 = 0").count()
    elif name.startswith("op6_"):
        assert found.select("doc_id").distinct().count() == table(spark, DATA, "documents").count()
    elif name.startswith("op12_"):
        assert n == 16 * table(spark, DATA, "embeddings").filter("embedding is not null").count()
    elif name.startswith("op13_"):
        assert n == found.select("word").distinct().count() > 100
    else:
        assert n == table(spark, DATA, "pages" if name.startswith("op8_") else "documents").count()
    assert name in entry.queries()


def test_warc_equals_sql(spark):
    duckdb.sql(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{DATA}/pages.parquet'")
    theirs = duckdb.sql(queries.oracle_sql()["op8_warc"])
    mine = queries.op8_warc(spark, DATA)
    assert sorted(map(tuple, mine.select(*theirs.columns).collect()), key=repr) == sorted(theirs.fetchall(), key=repr)


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))


def test_pipeline_stage_by_stage(spark):
    docs = table(spark, DATA, "documents")
    columns = docs.columns
    good = {r.doc_id for r in quality.quality_report(docs).filter("kept").collect()}
    now = corpus_pipeline.quality_rules(spark, docs, DATA)
    assert now.columns == columns and {r.doc_id for r in now.collect()} == good
    labels = table(spark, DATA, "labels")
    civil = {r.doc_id for r in toxicity.toxicity_report(docs, labels).filter("predicted = 0").collect()} & good
    now = corpus_pipeline.civil_only(spark, now, DATA)
    assert now.columns == columns and {r.doc_id for r in now.collect()} == civil
    prints = sorted((r.doc_id, simhash.simhash(r.text)) for r in now.collect())
    group = {d: d for d, _ in prints}
    for k, (a, x) in enumerate(prints):
        for b, y in prints[:k]:
            if (x ^ y).bit_count() <= 3:
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {d: new if g == old else g for d, g in group.items()}
    now = corpus_pipeline.near_dedup(spark, now, DATA)
    assert now.columns == columns and sorted(r.doc_id for r in now.collect()) == sorted(set(group.values()))
    want = packing.token_pieces(now).select("doc_id", "start", "ids_crc32")
    ran = corpus_pipeline.run(spark, DATA)
    assert sorted(map(tuple, ran.select("doc_id", "start", "ids_crc32").collect())) == sorted(map(tuple, want.collect()))


def test_stages_take_odd_documents(spark):
    docs = documents(spark).withColumn("kept", F.lit(1)).withColumn("score", F.lit("mine"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == [*(f.split(" ")[0] for f in SCHEMA.split(", ")), "kept", "score"]
    assert corpus_pipeline.pack(spark, docs, DATA).count() > 0
    none = documents(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, DATA).count() == 0


def test_samples_are_bounded(spark):
    rows = [(k, "a" if k % 10 else "b") for k in range(2000)] + [(7, "a")] * 3000
    df = spark.createDataFrame(rows, "key long, label string")
    n = {r.label: r["count"] for r in even_sample(df, "label", "key", 100).groupBy("label").count().collect()}
    assert 50 <= n["a"] <= 100 and n["b"] == 100
    assert even_sample(df.limit(0), "label", "key", 5).count() == 0


def test_free_names(spark):
    df = spark.createDataFrame([(1, 2)], "q int, Q_ int")
    assert free_name(df, "Q") == "Q__" and len(odd_documents()) > 15


STAGES_ALONE = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
builder = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2")
spark = builder.config("spark.executorEnv.PYTHONPATH", sys.argv[4]).getOrCreate()
import corpus_pipeline
docs = spark.read.parquet(f"{sys.argv[2]}/documents.parquet")
for name, stage in corpus_pipeline.STAGES:
    stage(spark, docs, sys.argv[2]).write.parquet(f"{sys.argv[3]}/{name}")
    docs = spark.read.parquet(f"{sys.argv[3]}/{name}")
print("rows:", docs.count())
"""


def test_stages_where_workers_have_another_path(spark, tmp_path):
    """The driver alone knows where the repository is; executors were started with a path of their own."""
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    run = subprocess.run([sys.executable, "-c", STAGES_ALONE, entry.HERE, DATA, str(tmp_path), str(tmp_path)], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=600)
    assert run.returncode == 0, run.stderr[-3000:]
    assert f"rows: {corpus_pipeline.run(spark, DATA).count()}" in run.stdout
