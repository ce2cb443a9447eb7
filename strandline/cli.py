"""Command line: ``python -m strandline.cli COMMAND``. Each command reads files and writes folders."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import align, analytics, cigar, simulate, suffix, traces
from .sources import files, sinks

LOG = logging.getLogger("strandline")


def _align(spark: SparkSession, a: argparse.Namespace) -> None:
    pairs = files.pairs(spark, a.first, a.second, strict=not a.many)
    if a.many:
        _name_pairs(pairs, a.output_dir)
    found = align.align(pairs, a.max_count, a.force_highfreq_search)
    sinks.matches(suffix.shortest_matches(pairs, a.max_count, a.force_highfreq_search), f"{a.output_dir}/shortest_matches", ids=a.many)
    for column in ("cigar_primary", "cigar_recursive", "cigar"):
        sinks.cigars(found, f"{a.output_dir}/{column}", column, ids=a.many)
    if a.debug:
        sinks.rare_prefixes(align.rare_prefixes(pairs, a.max_count, a.force_highfreq_search), f"{a.output_dir}/min_rare_prefixes", ids=a.many)
    if a.no_paths:
        sinks.path_counts(align.path_counts(pairs, a.max_count, a.force_highfreq_search), f"{a.output_dir}/no_paths", ids=a.many)
    if a.bridges:
        sinks.bridges(align.bridges(pairs, a.max_count, a.force_highfreq_search), f"{a.output_dir}/bridges", ids=a.many)


def _name_pairs(pairs: DataFrame, output_dir: str) -> None:
    """Which record each pair_id of the other outputs stands for."""
    pairs.select("pair_id", "seq_id").write.csv(f"{output_dir}/pairs", sep="\t", header=True)


def _kmer_align(spark: SparkSession, a: argparse.Namespace) -> None:
    pairs = files.pairs(spark, a.first, a.second, strict=not a.many)
    if a.many:
        _name_pairs(pairs, a.output_dir)
    found = align.align_kmers(pairs, a.k_mer_size, a.max_rare_freq)
    sinks.kmer_alignment(found.orderBy("pair_id", "ord"), f"{a.output_dir}/glob_alignment", ids=a.many)
    if a.indexed:
        sinks.indexed_alignment(found, f"{a.output_dir}/glob_align", ids=a.many)
    blocks = analytics.blocks_of_kmers(found.withColumnRenamed("pair_id", "aln_id"), a.tol_gap, a.k_mer_size)
    sinks.blocks(blocks, f"{a.output_dir}/blocks", id_col="aln_id" if a.many else None)


def _steps(spark: SparkSession, paths: list[str]):
    return cigar.parse(files.cigars(spark, paths), "file")


def _histogram(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = _steps(spark, a.input)
    cigar.indel_histogram(rows, a.bin_size).write.csv(f"{a.output_dir}/indel_histogram", header=True)
    cigar.indel_statistics(rows, a.max_short).write.csv(f"{a.output_dir}/indel_statistics", header=True)
    if a.hor_len:
        found = cigar.unit_multiplicity(rows, a.hor_len)
        text = [F.array_join(F.col(c).cast("array<string>"), " ").alias(c) for c in ("lens", "positions")]
        found.select("aln_id", "mult", "n", "percent", "mean_mult", *text).write.csv(f"{a.output_dir}/multiplicity", header=True)


def _compare(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = files.cigars(spark, [a.i1]).withColumn("file", F.lit(1)).unionByName(files.cigars(spark, [a.i2]).withColumn("file", F.lit(2)))
    pair = spark.createDataFrame([(1, 2)], "a_id int, b_id int")
    for r in analytics.compare(pair, cigar.parse(rows, "file")).collect():  # one row
        LOG.info("%d and %d matched, %d shared: %s", r.size_a, r.size_b, r.shared, r.ratio)
        print(r.size_a, r.size_b, r.shared, r.ratio)


def _blocks(spark: SparkSession, a: argparse.Namespace) -> None:
    found = analytics.blocks_of_steps(_steps(spark, a.input), a.tol_gap)
    sinks.blocks(found, f"{a.output_dir}/blocks", header=True, id_col="aln_id" if len(a.input) > 1 else None)


def _conserved(spark: SparkSession, a: argparse.Namespace) -> None:
    sinks.conserved_regions(analytics.conserved_regions(_steps(spark, a.input), a.max_indel, a.min_size, a.tail), f"{a.output_dir}/conserved_regions")


def _dotplot(spark: SparkSession, a: argparse.Namespace) -> None:
    limits = tuple(int(x) for x in a.min_lengths.split(","))
    traces.match_segments(files.matches(spark, a.matches).withColumn("pair_id", F.lit(1).cast("long")), limits).write.csv(f"{a.output_dir}/matches", header=True)
    rows = _steps(spark, a.input).withColumn("aln_id", F.lit(1))
    traces.alignment_segments(rows).write.csv(f"{a.output_dir}/alignment", header=True)
    traces.conserved_segments(rows).write.csv(f"{a.output_dir}/conserved", header=True)
    if a.bridges:
        traces.bridge_segments(files.bridges(spark, a.bridges)).write.csv(f"{a.output_dir}/bridges", header=True)
    for side, path in ((1, a.first_genes), (2, a.second_genes)):
        if path:
            genes = files.genes(spark, path, "gray" if side == 1 else "maroon").withColumn("aln_id", F.lit(1))
            traces.gene_marks(genes, rows, side).write.csv(f"{a.output_dir}/genes_{side}", header=True)


def _simulate(spark: SparkSession, a: argparse.Namespace) -> None:
    seqs = files.sequences(spark, a.seq)
    if a.hors:
        units = files.units(spark, a.hors).agg(F.sort_array(F.collect_list("st")).alias("starts"))
        found = simulate.copy_number(seqs.crossJoin(units), a.n_cnv, a.seed, a.lam, a.dup)  # one row of starts
    else:
        found = simulate.delete_once(seqs, a.seed, a.mut, a.del_len)
    sinks.fasta(found.select("seq_id", F.col("mutated").alias("seq")), f"{a.output_dir}/mod")
    sinks.cigars(found, f"{a.output_dir}/true_cigar")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="strandline", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)

    def command(name: str, run, help: str) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=help)
        p.add_argument("-o", "--output-dir", required=name != "compare")
        p.set_defaults(run=run)
        return p

    for name, run, text in (("align", _align, "align two sequence files"), ("kmer-align", _kmer_align, "align two files by their rare k-mers")):
        p = command(name, run, text)
        p.add_argument("--first", required=True)
        p.add_argument("--second", required=True)
        p.add_argument("--many", action="store_true", help="files hold many records, paired by id")
        if name == "align":
            p.add_argument("--max-count", "--max_count", type=int, default=50)
            for flag in ("debug", "force_highfreq_search", "no_paths", "bridges"):
                p.add_argument(f"--{flag}", action="store_true")
        else:
            p.add_argument("-k", "--k-mer-size", type=int, default=10)
            p.add_argument("--max-rare-freq", type=int, default=1)
            p.add_argument("--tol-gap", type=int, default=100)
            p.add_argument("--indexed", action="store_true", help="also write k-mers with their numbers")
    p = command("histogram", _histogram, "indel lengths, rates and unit multiples of CIGAR files")
    p.add_argument("-i", "--input", nargs="+", required=True)
    p.add_argument("-l", "--hor-len", type=int)
    p.add_argument("-m", "--max-short", type=int, default=5)
    p.add_argument("--bin-size", "--bin_size", type=int, default=200)
    p = command("compare", _compare, "matches that two CIGAR files share")
    p.add_argument("-i1", required=True)
    p.add_argument("-i2", required=True)
    p = command("blocks", _blocks, "matching blocks of CIGAR files")
    p.add_argument("-i", "--input", nargs="+", required=True)
    p.add_argument("--tol-gap", type=int, required=True)
    p = command("conserved", _conserved, "conserved regions of CIGAR files")
    p.add_argument("-i", "--input", nargs="+", required=True)
    p.add_argument("--max-indel", type=int, default=1000)
    p.add_argument("--min-size", type=int, default=1000)
    p.add_argument("--tail", action="store_true")
    p = command("dotplot", _dotplot, "plot-ready tables of an alignment")
    p.add_argument("-i", "--input", nargs="+", required=True)
    p.add_argument("--matches", required=True)
    p.add_argument("--bridges")
    p.add_argument("--first-genes")
    p.add_argument("--second-genes")
    p.add_argument("--min-lengths", default="1,20,50,80")
    p = command("simulate", _simulate, "mutated copies with their true alignment")
    p.add_argument("-s", "--seq", required=True)
    p.add_argument("-d", "--hors")
    p.add_argument("-N", "--n-cnv", type=int, default=10)
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--lam", type=float, default=simulate.MEAN_RUN)
    p.add_argument("--dup", type=float, default=0.5)
    p.add_argument("-m", "--mut", type=float, default=0.02)
    p.add_argument("--del-len", type=int, default=1000)
    return out


def main(argv: list[str] | None = None) -> None:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(levelname)s %(message)s")
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("strandline").getOrCreate()
    LOG.info("running %s on Spark %s", args.command, spark.version)
    args.run(spark, args)


if __name__ == "__main__":
    main()
