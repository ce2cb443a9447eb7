"""Plot-ready tables: line segments and marks, grouped as a legend shows them. Drawing is the client's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import analytics, cigar


def match_segments(matches: DataFrame, thresholds: tuple[int, ...] = (1, 20, 50, 80)) -> DataFrame:
    """A diagonal segment for each pair of starts: pair_id, legend, first_freq, second_freq, bucket, x0, y0, x1, y1."""
    rows = analytics.interval_buckets(matches, thresholds).withColumn("x0", F.explode("first_starts")).withColumn("y0", F.explode("second_starts"))
    legend = F.format_string("(%d, %d), length > %d", F.col("first_freq").cast("long"), F.col("second_freq").cast("long"), F.col("bucket").cast("long"))
    return rows.select("pair_id", legend.alias("legend"), "first_freq", "second_freq", "bucket", "x0", "y0", (F.col("x0") + F.col("len")).alias("x1"), (F.col("y0") + F.col("len")).alias("y1"))


def alignment_segments(rows: DataFrame) -> DataFrame:
    """Each step of an alignment as a segment, with its op as legend."""
    return cigar.trace(rows).select("aln_id", "ord", F.col("op").alias("legend"), "x0", "y0", "x1", "y1")


def bridge_segments(bridges: DataFrame) -> DataFrame:
    return bridges.select("*", F.lit("bridges").alias("legend")).withColumnsRenamed({"start_1": "x0", "start_2": "y0", "end_1": "x1", "end_2": "y1"})


def gene_marks(genes: DataFrame, rows: DataFrame, side: int = 1, colour: str | None = None) -> DataFrame:
    """Two segments for each gene, from its axis to the alignment and on to the other axis.

    ``genes`` has aln_id, pos, gene and perhaps color. Genes of the first sequence
    rise from the x axis, those of the second leave the y axis.
    """
    default = colour or ("gray" if side == 1 else "maroon")
    named = F.coalesce(F.col("color"), F.lit(default)) if "color" in genes.columns else F.lit(default)
    key = F.to_json(F.struct(F.col("gene").alias("g"), named.alias("c")))
    put = analytics.orthologues(genes.select("aln_id", "pos", key.alias("name")), rows, side)
    label = F.from_json("name", "g string, c string")
    p, o = F.col("pos").cast("double"), F.col("projected")
    zero = F.lit(0.0)
    ends = [(p, zero, p, o), (p, o, zero, o)] if side == 1 else [(zero, p, o, p), (o, p, o, zero)]
    both = F.array(*[F.struct(*[c.alias(n) for c, n in zip(e, ("x0", "y0", "x1", "y1"), strict=True)]) for e in ends])
    return put.select("aln_id", label["g"].alias("gene"), label["c"].alias("color"), F.explode(both).alias("e")).select("aln_id", "gene", "color", "e.*")


def conserved_segments(rows: DataFrame, longest_indel: int = 1000, least: int = 1000) -> DataFrame:
    found = analytics.conserved_regions(rows, longest_indel, least)
    return found.withColumnsRenamed({"first_start": "x0", "second_start": "y0", "first_end": "x1", "second_end": "y1"}).withColumn("legend", F.lit("conserved"))


def block_segments(blocks: DataFrame) -> DataFrame:
    return blocks.withColumnsRenamed({"st1": "x0", "st2": "y0", "en1": "x1", "en2": "y1"})
