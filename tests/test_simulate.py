"""Mutated copies: the same as letter by letter and unit by unit, without a row for each of them."""

import hashlib
import random

from strandline.operators import simulate

from .shuffled import shuffled_mb


def sequences(spark, n=30, longest=900):
    rng = random.Random(9)
    rows = [(i, "".join(rng.choices("ACGTNacgt", k=rng.randint(0, longest)))) for i in range(n)] + [(n, None), (n + 1, "A" * 500)]
    return spark.createDataFrame(rows, "seq_id long, seq string")


def digest(df):
    return hashlib.md5(repr([tuple(r) for r in df.orderBy("seq_id").collect()]).encode()).hexdigest()


def of_units(seqs, events, duplicate):
    from pyspark.sql import functions as F

    starts = F.expr("CASE WHEN length(seq) > 0 THEN sequence(0, length(seq) - 1, 1 + seq_id % 7) END")
    return simulate.copy_number(seqs.withColumn("starts", starts.cast("array<long>")), events, 3, duplicate=duplicate)


def made(spark):
    seqs = sequences(spark)
    return {
        "mutate": digest(simulate.mutate(seqs, 1, 0.1, 0.1, 0.1)), "all": digest(simulate.mutate(seqs, 2, 0.4, 0.4, 0.2)), "none": digest(simulate.mutate(seqs, 2, 0, 0, 0)),
        "delete": digest(simulate.delete_once(seqs, 1, 0.2, 150)), "delete much": digest(simulate.delete_once(seqs, 4, 1.9, 3)),
        "copies": digest(of_units(seqs, 6, 0.5)), "many": digest(of_units(seqs, 40, 0.6)), "only deletions": digest(of_units(seqs, 300, 0.0)), "no events": digest(of_units(seqs, 0, 0.5)),
    }


#: What the row-by-row forms of these operators gave.
GOLD = {
    "mutate": "498b9b1eb1b15f400906f7b9980b3337",
    "all": "47ee51f19e1d37bb4402787903d1e283",
    "none": "5fb610f0b21528fb005871b364a3815b",
    "delete": "73873b24cc39794e9c36eadc60ce2ad2",
    "delete much": "6b71073db6afd363b78f469d6e652e12",
    "copies": "1ae777ba1b0af31e9b194780de37b40a",
    "many": "69fd878781da947ae4c2c7dfe5191436",
    "only deletions": "37ef4a7797ef5a6d921187b8f63249eb",
    "no events": "79f53f21fbbac14fd63218aa3d3bc053",
}


def test_same_copies_as_row_by_row(spark, monkeypatch):
    assert made(spark) == GOLD
    monkeypatch.setattr(simulate, "STRETCH", 7)
    seqs = sequences(spark)
    assert digest(simulate.mutate(seqs, 1, 0.1, 0.1, 0.1)) == GOLD["mutate"]
    assert digest(simulate.delete_once(seqs, 1, 0.2, 150)) == GOLD["delete"]


def test_letters_and_units_are_no_rows(spark):
    rng = random.Random(3)
    seqs = spark.createDataFrame([(i, "".join(rng.choices("ACGT", k=4000))) for i in range(100)], "seq_id long, seq string").repartition(4).localCheckpoint()
    # The texts themselves are 0.4 MB; letters as rows were over 2 MB.
    assert shuffled_mb(spark, simulate.mutate(seqs, 1, 0.01, 0.005, 0.005)) < 1
    assert shuffled_mb(spark, simulate.delete_once(seqs, 1, 0.02, 200)) < 1
    assert shuffled_mb(spark, of_units(seqs, 6, 0.5)) < 0.01
