"""Sequence files as data sources: ranges, filters, pieces, streams, and repeated ids."""

import gzip
import random
import re

import pytest
from pyspark.sql import functions as F

from strandline.sources import files, formats

FASTA = "first line\nACG\nT\n>one first record\r\nACGT\r\nAC\r\n\r\nignored\n>two\nGG TT\n\n>empty\n>three\n" + "ACGTACGT\n" * 40 + ">last\nA"
WANT = [("first", "ACGT"), ("one", "ACGTAC"), ("two", "GGTT"), ("empty", ""), ("three", "ACGTACGT" * 40), ("last", "A")]


@pytest.fixture(scope="module")
def known(spark):
    return formats.register(spark)


@pytest.mark.parametrize("split", [1, 7, 64, 1 << 20])
def test_fasta_in_ranges(known, tmp_path, split):
    (tmp_path / "a.fasta").write_text(FASTA)
    with gzip.open(tmp_path / "b.fa.gz", "wt") as f:
        f.write(FASTA)
    (tmp_path / "_hidden").write_text(">no\nA\n")
    df = known.read.format("fasta").option("split", split).load(str(tmp_path))
    assert df.columns == ["seq_id", "seq", "file", "at"]
    rows = df.orderBy("file", "at").collect()
    assert [(r.seq_id, r.seq) for r in rows] == WANT * 2
    assert all(FASTA.encode()[r.at :].decode().startswith((">" if r.at else "") + r.seq_id) for r in rows)
    assert df.rdd.getNumPartitions() == -(-len(FASTA) // split) + 1
    two = known.read.format("fasta").load(f"{tmp_path}/a.fasta\n{tmp_path}/b.fa.gz")
    assert two.count() == 12


def test_columns_and_filters(known, tmp_path):
    (tmp_path / "a.fasta").write_text(FASTA)
    fresh = lambda: known.read.format("fasta").option("split", 50)
    read = fresh()
    assert fresh().schema("seq_id string").load(str(tmp_path)).columns == ["seq_id"]
    found = read.load(str(tmp_path)).filter(F.col("seq_id").isin("two", "last") & (F.length("seq") > 1))
    assert [tuple(r) for r in found.select("seq_id", "seq").collect()] == [("two", "GGTT")]
    plan = read.load(str(tmp_path)).filter("seq_id = 'one'")._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"\bFilter\b", plan)
    assert read.load(str(tmp_path)).filter("seq_id = 'one' and seq_id = 'two'").count() == 0
    with pytest.raises(Exception, match="no such columns"):
        fresh().schema("seq_id string, quality string, other int").load(str(tmp_path)).collect()
    with pytest.raises(Exception, match="FileNotFound"):
        read.load(str(tmp_path / "none")).collect()


def fastq(n, seed, folded):
    """Records whose qualities may begin with @ or +, on one line or several."""
    rng = random.Random(seed)
    text, want = "", []
    for k in range(n):
        size = rng.randint(1, 60)
        seq, quality = "".join(rng.choices("ACGTN", k=size)), "".join(rng.choices("@+#IIF;", k=size))
        fold = lambda s: "\n".join(s[a : a + 20] for a in range(0, len(s), 20)) if folded else s
        text += f"@r{k} x\n{fold(seq)}\n+{'' if k % 2 else f'r{k}'}\n{fold(quality)}\n"
        want.append((f"r{k}", seq, quality))
    return text, want


@pytest.mark.parametrize("split", [40, 333, 1 << 20])
def test_fastq_in_ranges(known, tmp_path, split):
    text, want = fastq(80, 1, False)
    (tmp_path / "a.fq").write_text(text)
    df = known.read.format("fastq").option("split", split).load(str(tmp_path / "a.fq"))
    assert [(r.seq_id, r.seq, r.quality) for r in df.orderBy("at").collect()] == want
    assert df.filter("seq_id = 'r7'").count() == 1


def test_fastq_of_folded_lines(known, tmp_path):
    text, want = fastq(60, 2, True)
    (tmp_path / "a.fq").write_text(text.replace("\n", "\r\n"))
    got = known.read.format("fastq").load(str(tmp_path / "a.fq")).orderBy("at").collect()
    assert [(r.seq_id, r.seq, r.quality) for r in got] == want


@pytest.mark.parametrize(("split", "piece"), [(30, 10), (100, 64), (1 << 20, 1 << 20)])
def test_pieces_make_up_the_records(known, spark, tmp_path, split, piece):
    (tmp_path / "a.fasta").write_text(FASTA)
    (tmp_path / "b.fasta").write_text(">x\nAC\n\n" + "GGGG\n" * 30 + ">y\n" + "TTA\n" * 30)
    got: dict = {}
    for r in files.fasta_pieces(spark, [str(tmp_path / "a.fasta"), str(tmp_path / "b.fasta")], piece, split).collect():
        got.setdefault((r.file, r.at, r.seq_id), []).append((r.start, r.seq))
    whole = []
    for key in sorted(got):
        text = ""
        for start, seq in sorted(got[key], key=lambda p: (p[0], len(p[1]))):
            assert start == len(text)
            text += seq
        whole.append((key[2], text))
    assert whole == [*WANT, ("x", "AC"), ("y", "TTA" * 30)]


def test_one_long_record_is_read_by_many_tasks(known, spark, tmp_path):
    rng = random.Random(3)
    seq = "".join(rng.choices("ACGT", k=400_000))
    (tmp_path / "a.fasta").write_text(">one\n" + "\n".join(seq[k : k + 70] for k in range(0, len(seq), 70)) + "\n>two\nAC\n")
    pieces = files.fasta_pieces(spark, str(tmp_path / "a.fasta"), 10_000, 50_000)
    rows = sorted((r.start, r.seq) for r in pieces.filter("seq_id = 'one'").collect())
    assert "".join(s for _, s in rows) == seq and len(rows) > 30 and max(len(s) for _, s in rows) <= 10_000
    assert known.read.format("fasta").option("pieces", 10_000).option("split", 50_000).load(str(tmp_path)).rdd.getNumPartitions() == 9


def test_stream_of_files(known, spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.fasta").write_text(FASTA)

    def run():
        df = known.readStream.format("fasta").option("split", 64).load(str(tmp_path / "in"))
        query = df.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted((r.seq_id, r.seq) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == sorted(WANT)
    assert run() == sorted(WANT)
    (tmp_path / "in/b.fasta").write_text(">new\nTTT\n")
    assert run() == sorted([*WANT, ("new", "TTT")])


def test_last_of_equal_ids_counts(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">x\nAAA\n>y\nCC\n>x\nGGG\n")
    (tmp_path / "b.fasta").write_text(">y\nTT\n>z\nA\n")
    found = files.sequences(spark, [str(tmp_path / "a.fasta"), str(tmp_path / "b.fasta")])
    assert sorted((r.seq_id, r.seq) for r in found.collect()) == [("x", "GGG"), ("y", "TT"), ("z", "A")]
    # Sequences stay where they are: few ids repeat, so what goes is sent to them.
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
