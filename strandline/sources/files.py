"""Readers of sequence and alignment files. All go through Spark's own file sources, gzip included."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.bases import compress_runs, split_fields
from ..operators.scan import running
from .formats import SPLIT, register
from .shared import Tables

Paths = str | list[str]


def _paths(paths: Paths) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def _records(spark: SparkSession, paths: Paths, sep: str) -> DataFrame:
    """value, file, and (block, at): the order of the records in a file."""
    rows = spark.read.option("lineSep", "\n" + sep).text(_paths(paths))
    meta = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")]
    return rows.select(F.regexp_replace("value", "\r", "").alias("text"), *meta)


def _fasta(spark: SparkSession, paths: Paths, collapse_runs: bool, strict: bool) -> DataFrame:
    records = _records(spark, paths, ">")
    header = F.regexp_extract("text", r"\A>?([^\n]*)", 1)
    body = F.regexp_replace(F.regexp_replace(F.regexp_extract("text", r"(?s)\A[^\n]*\n(.*)\z", 1), r"(?s)\n\s*\n.*\z", ""), r"\s+", "")
    rows = records.select(F.regexp_extract(F.trim(header), r"\A(\S*)", 1).alias("seq_id"), body.alias("seq"), "file", "block", "at").filter("seq_id <> '' or seq <> ''")
    return _finish(rows, collapse_runs, strict)


def fasta(spark: SparkSession, paths: Paths, collapse_runs: bool = False, strict: bool = False) -> DataFrame:
    """seq_id, seq, file of FASTA files, gzipped or not.

    A record's id is its header up to white space. Its sequence ends at a blank
    line; case stays. With ``collapse_runs`` runs of a letter are one. ``strict``
    raises when a sequence holds anything but A, C, G, T.
    """
    return _fasta(spark, paths, collapse_runs, strict).drop("block", "at")


def _fastq(spark: SparkSession, paths: Paths, collapse_runs: bool, strict: bool) -> DataFrame:
    records = _records(spark, paths, "@")
    # Header, sequence lines, a plus line, then qualities as far as they go.
    pattern = r"(?s)\A@?(\S*)[^\n]*\n([^+\n][^\n]*(?:\n[^+\n][^\n]*)*)\n\+[^\n]*(?:\n(.*))?\z"
    parts = [F.regexp_extract("text", pattern, k) for k in (1, 2, 3)]
    squeeze = lambda c: F.regexp_replace(c, r"\s+", "")
    rows = records.select(F.rlike("text", F.lit(pattern)).alias("head"), parts[0].alias("seq_id"), squeeze(parts[1]).alias("seq"), squeeze(parts[2]).alias("quality"), squeeze("text").alias("rest"), "file", "block", "at")
    whole = F.col("head") & (F.length("quality") >= F.length("seq"))
    fields = ["seq_id", "seq", "quality", "file", "block", "at"]
    # What a quality line that begins with @ has parted: heads without all their qualities, and the rest of these.
    loose = rows.filter(~whole)
    order = Window.partitionBy("file", "block").orderBy("at")
    loose = loose.withColumn("n", F.sum(F.col("head").cast("long")).over(order))
    # The first rests of a block belong to the last head of the blocks before it.
    ends = loose.groupBy("file", "block").agg(F.max("n").alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("file", "block", F.last(F.when(F.col("n") > 0, F.struct("block", "n")), ignorenulls=True).over(before).alias("earlier"))
    owner = F.when(F.col("n") > 0, F.struct("block", "n")).otherwise(F.col("earlier"))
    piece = F.struct("block", "at", "head", "seq_id", "seq", F.when(F.col("head"), F.col("quality")).otherwise(F.concat(F.lit("@"), F.col("rest"))).alias("quality"))
    joined = loose.join(ends, ["file", "block"]).groupBy("file", owner.alias("owner")).agg(F.sort_array(F.collect_list(piece)).alias("p")).filter(F.col("p")[0]["head"])
    joined = joined.select(F.col("p")[0]["seq_id"].alias("seq_id"), F.col("p")[0]["seq"].alias("seq"), F.array_join(F.transform("p", lambda x: x["quality"]), "").alias("quality"), "file", F.col("p")[0]["block"].alias("block"), F.col("p")[0]["at"].alias("at"))
    found = rows.filter(whole).select(fields).unionByName(joined.select(fields))
    return _finish(found.withColumn("quality", F.nullif("quality", F.lit(""))), collapse_runs, strict)


def fastq(spark: SparkSession, paths: Paths, collapse_runs: bool = False, strict: bool = False) -> DataFrame:
    """seq_id, seq, quality, file of FASTQ files; sequences and qualities may run over several lines.

    Files are split at lines that begin with @, so they are read in parallel. A
    quality line that begins with @ is parted from its record by that. Only such
    parts are shuffled, by file block, and joined again: qualities go on until they
    are as long as the sequence. A record cut short keeps what it has (null: nothing).
    """
    return _fastq(spark, paths, collapse_runs, strict).drop("block", "at")


def _finish(rows: DataFrame, collapse_runs: bool, strict: bool) -> DataFrame:
    if strict:
        ok = F.col("seq").rlike(r"\A[ACGTacgt]*\z")
        rows = rows.withColumn("seq", F.when(ok, F.col("seq")).otherwise(F.raise_error(F.concat(F.lit("not a base in "), F.col("seq_id")))))
    return rows.withColumn("seq", compress_runs(F.col("seq"))) if collapse_runs else rows


def sequences(spark: SparkSession, paths: Paths, **options) -> DataFrame:
    """seq_id, seq, file of a list of files, each read by its ending.

    Of equal ids the one of the last path counts; within a path that of the last
    file by name, and within a file the last record.
    """
    rows = None
    for k, p in enumerate(_paths(paths)):
        read = _fastq if p.lower().removesuffix(".gz").endswith((".fastq", ".fq")) else _fasta
        part = read(spark, p, options.get("collapse_runs", False), options.get("strict", False))
        part = part.select("seq_id", "seq", "file", F.struct(F.lit(k).alias("k"), "file", "block", "at").alias("rank"))
        rows = part if rows is None else rows.unionByName(part)
    # What goes is found by ids and places alone, and is written first: its size is known to the join, and
    # while few ids repeat no sequence is shuffled.
    ids = rows.select("seq_id", "rank")
    best = ids.groupBy("seq_id").agg(F.max("rank").alias("best"), F.count("*").alias("n")).filter("n > 1").select("seq_id", "best")
    gone = Tables(spark).settled(ids.join(best, "seq_id").filter(F.col("rank") < F.col("best")).select("rank"))
    return rows.join(gone, "rank", "left_anti").select("seq_id", "seq", "file")


def fasta_pieces(spark: SparkSession, paths: Paths, piece: int = 1 << 20, split: int = SPLIT) -> DataFrame:
    """seq_id, start, seq, file, at: sequences of FASTA files in pieces of about ``piece`` letters, with where each begins.

    A record of any length is read by all tasks that its bytes are dealt to. Which record a piece
    belongs to, and how many letters come before it, follows from ordered scans of the pieces; ``at`` is
    the byte at which the record begins.
    """
    reader = register(spark).read.format("fasta").option("pieces", piece).option("split", split)
    rows = reader.load("\n".join(_paths(paths)))
    state = F.when(F.col("begins").isNotNull(), F.struct(F.col("at").alias("record"), F.col("begins").alias("id"), F.col("ended").alias("over")))
    closed = F.when(F.col("ended"), F.struct(F.lit(None).cast("long").alias("record"), F.lit(None).cast("string").alias("id"), F.lit(True).alias("over")))
    block = piece << 14
    found = running(rows, ["file"], "at", before={"held": F.coalesce(state, closed)}, block=block)
    opens = F.col("begins").isNotNull()
    of = F.when(opens, F.struct(F.col("at").alias("record"), F.col("begins").alias("id"))).otherwise(F.when(~F.col("held.over"), F.struct(F.col("held.record").alias("record"), F.col("held.id").alias("id"))))
    mine = found.select(of.alias("of"), "at", "seq", "file").filter(F.col("of.record").isNotNull())
    placed = running(mine.select("file", F.col("of.record").alias("record"), F.col("of.id").alias("seq_id"), "at", "seq"), ["file", "record"], "at", sums={"upto": F.length("seq").cast("long")}, block=block)
    return placed.select("seq_id", (F.col("upto") - F.length("seq")).alias("start"), "seq", "file", F.col("record").alias("at"))


def cigars(spark: SparkSession, paths: Paths) -> DataFrame:
    """file and cigar, the first line of each text file."""
    rows = spark.read.option("wholetext", "true").text(_paths(paths))
    return rows.select(F.col("_metadata.file_path").alias("file"), F.trim(F.regexp_extract("value", r"\A([^\r\n]*)", 1)).alias("cigar"))


def matches(spark: SparkSession, paths: Paths) -> DataFrame:
    """first_freq, second_freq, len, first_starts, second_starts of match tables."""
    schema = "first_freq int, second_freq int, len long, first_starts string, second_starts string"
    rows = spark.read.csv(_paths(paths), sep="\t", header=True, schema=schema, enforceSchema=True)
    lists = {c: F.transform(F.split(c, ","), lambda x: x.cast("long")) for c in ("first_starts", "second_starts")}
    return rows.withColumns(lists)


def bridges(spark: SparkSession, paths: Paths) -> DataFrame:
    """start_1, start_2, end_1, end_2 of bridge tables: a comment line, a header, rows."""
    rows = spark.read.csv(_paths(paths), comment="#", schema="start_1 string, start_2 string, end_1 string, end_2 string")
    return rows.filter(F.col("start_1") != "start_1").select(*[F.col(c).cast("long").alias(c) for c in rows.columns])


def path_counts(spark: SparkSession, paths: Paths) -> DataFrame:
    """Path counts of anchors; counts are of any size, so they stay strings of digits."""
    kinds = {"start_1": "long", "start_2": "long", "len": "long", "n_opt_paths_fwd": "string", "n_opt_paths_rev": "string", "n_count": "long", "m_count": "long"}
    return spark.read.csv(_paths(paths), header=True, schema=", ".join(f"{n} {t}" for n, t in kinds.items()))


def genes(spark: SparkSession, paths: Paths, colour: str = "gray") -> DataFrame:
    """pos, gene, color of gene tables; the colour column may be missing."""
    rows = spark.read.csv(_paths(paths), header=True)
    named = F.coalesce(F.col("color"), F.lit(colour)) if "color" in rows.columns else F.lit(colour)
    return rows.select(F.col("pos").cast("long").alias("pos"), "gene", named.alias("color"))


def units(spark: SparkSession, paths: Paths) -> DataFrame:
    """ref_name, monomers, st, en, ident of unit tables with white space between fields."""
    fields = spark.read.text(_paths(paths)).select(split_fields(F.col("value")).alias("f")).filter(F.size("f") >= 5)
    kinds = ("string", "string", "long", "long", "double")
    return fields.select(*[F.col("f")[k].cast(t).alias(n) for k, (n, t) in enumerate(zip(("ref_name", "monomers", "st", "en", "ident"), kinds, strict=True))])


def blocks(spark: SparkSession, paths: Paths, header: bool = False) -> DataFrame:
    """st1, en1, st2, en2 of block tables, with or without a header."""
    return spark.read.csv(_paths(paths), sep="\t", header=header, schema="st1 long, en1 long, st2 long, en2 long")


def kmer_alignment(spark: SparkSession, paths: Paths, matches_only: bool = True) -> DataFrame:
    """left, right of k-mer alignments; a minus is a gap (null)."""
    rows = spark.read.csv(_paths(paths), sep="\t", schema="left string, right string", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    out = rows.select(*[F.when(F.col(c) != "-", F.col(c)).cast("long").alias(c) for c in ("left", "right")])
    return out.filter("left is not null and right is not null") if matches_only else out


def rare_prefixes(spark: SparkSession, paths: Paths, unset: int = 2147483647) -> DataFrame:
    """pos, len of rare-prefix tables, without the unset places."""
    return spark.read.csv(_paths(paths), sep="\t", header=True, schema="pos long, len long", enforceSchema=True).filter(F.col("len") < unset)


def pairs(spark: SparkSession, first: str, second: str, strict: bool = True) -> DataFrame:
    """pair_id, first, second from two files.

    ``strict`` takes files with exactly one record each, and raises otherwise; else
    records of one id are a pair: seq_id is that id, and pair_id a hash of it.
    """
    a, b = (sequences(spark, p) for p in (first, second))
    left, right = a.select("seq_id", F.col("seq").alias("first")), b.select("seq_id", F.col("seq").alias("second"))
    if not strict:
        return left.join(right, "seq_id").select(F.xxhash64("seq_id").alias("pair_id"), "first", "second", "seq_id")
    if a.count() != 1 or b.count() != 1:
        raise ValueError("each file must hold exactly one record")
    one = F.lit(1).cast("long").alias("pair_id")
    return left.select(one, "first").join(right.select(one, "second"), "pair_id")
