"""Row operators on small tables: hand-worked cases, odd inputs, files, streams, the command line."""

import glob
import random
import re
from functools import reduce

from pyspark.sql import functions as F

from strandline import cli
from strandline.functions import bases
from strandline.operators import align, analytics, cigar, kernels, kmers, simulate, suffix, traces
from strandline.plans import catalog
from strandline.sources import files, sinks
from strandline.streaming import pairs as stream

GOLD = "4112M2060I8233M2056D4112M"


def steps(spark, *texts):
    return cigar.parse(spark.createDataFrame(list(enumerate(texts)), "aln_id int, cigar string"))


def got(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_parse_and_summary(spark):
    rows = steps(spark, "89=1X6=3X76=", GOLD, "", None)
    assert [(r.len, r.op) for r in rows.filter("aln_id = 0").orderBy("ord").collect()] == [(89, "="), (1, "X"), (6, "="), (3, "X"), (76, "=")]
    assert got(cigar.totals(rows).filter("aln_id = 0")) == [(0, 171, 0, 4, 0, 0)]
    assert got(cigar.summary(rows).filter("aln_id = 1")) == [(1, "D", 2056, 1), (1, "I", 2060, 1), (1, "M", 16457, 3)]
    assert got(cigar.lengths(rows).filter("aln_id = 1")) == [(1, 18513, 18517)]
    assert got(cigar.render(rows))[1] == (1, GOLD)
    assert rows.select("aln_id").distinct().count() == 2


def test_conserved_regions(spark):
    rows = steps(spark, GOLD)
    assert got(analytics.conserved_regions(rows)) == [(0, 0, 0, 4112, 4112), (0, 4112, 6172, 12345, 14405)]
    assert len(got(analytics.conserved_regions(rows, include_tail=True))) == 3


def test_merge_splice_and_gaps(spark):
    rows = spark.createDataFrame([(1, 0, 2, "M"), (1, 1, 0, "D"), (1, 2, 3, "M"), (1, 3, 1, "I")], "aln_id int, ord int, len long, op string")
    assert got(cigar.render(cigar.merge(rows))) == [(1, "5M1I")]
    inner = spark.createDataFrame([(1, 3, 0, 1, "X"), (1, 3, 1, 2, "M")], "aln_id int, ord int, inner_ord int, len long, op string")
    assert got(cigar.render(cigar.splice(rows.filter("len > 0"), inner))) == [(1, "2M3M1X2M")]
    table = spark.createDataFrame([(1, "ACGT", "AGGTT", "1M1X2M1I"), (2, "AAC", "A", "1M2D")], "aln_id int, first string, second string, cigar string")
    assert got(cigar.gapped(table)) == [(1, "ACGT-", "AGGTT"), (2, "AAC", "A--")]
    wrong = table.unionByName(spark.createDataFrame([(3, "AC", "AG", "2M"), (4, "AC", "AG", "1M1X"), (5, "AC", "AC", "2X"), (6, "A", "A", "2M"), (7, "", "", "")], table.schema))
    assert [r.valid for r in cigar.check(wrong).orderBy("aln_id").collect()] == [True, True, False, True, False, False, True]


def brute_blocks(parsed, most_gap):
    """Stretches of = as (x0, x1, y0, y1), by walking the steps."""
    runs, x, y = [], 0, 0
    for n, op in parsed:
        dx, dy = (0 if op == "D" else n), (0 if op == "I" else n)
        if runs and runs[-1][0] == (op == "="):
            runs[-1] = (runs[-1][0], runs[-1][1], x + dx, runs[-1][3], y + dy)
        else:
            runs.append((op == "=", x, x + dx, y, y + dy))
        x, y = x + dx, y + dy
    if runs and not runs[0][0]:
        runs.pop(0)
    out, held = [], None
    for eq, a, b, c, d in runs:
        if not eq and max(b - a, d - c) > most_gap:
            if held:
                out.append(tuple(held))
            held = None
        elif held is None:
            held = [a, b, c, d]
        else:
            held[1], held[3] = b, d
    return out + [tuple(held)] if held else out


def test_blocks_of_steps(spark):
    rng = random.Random(5)
    texts = ["".join(f"{rng.randint(1, 9)}{rng.choice('=XID')}" for _ in range(rng.randint(1, 14))) for _ in range(60)]
    found: dict = {}
    for r in analytics.blocks_of_steps(steps(spark, *texts), 8).collect():
        found.setdefault(r.aln_id, []).append((r.st1, r.en1, r.st2, r.en2))
    for k, text in enumerate(texts):
        parsed = [(int(n), op) for n, op in re.findall(r"(\d+)(.)", text)]
        assert sorted(found.get(k, [])) == sorted(brute_blocks(parsed, 8)), text


def test_kmer_blocks_and_parts(spark):
    rows = [(1, k, *p) for k, p in enumerate([(0, None), (2, 5), (3, 6), (9, None), (12, 20), (None, 30), (None, 90), (40, 100)])]
    matches = spark.createDataFrame(rows, "aln_id int, ord int, left long, right long")
    assert got(analytics.blocks_of_kmers(matches, 10, 4)) == [(1, 2, 16, 5, 24), (1, 40, 44, 100, 104)]
    parts = got(analytics.match_parts(matches), "part")
    assert parts[0][2:] == (True, 2, 3, 5, 6) and parts[1][2:] == (False, 9, 9, None, None)


def test_overlap_and_coverage_against_cells(spark):
    rng = random.Random(6)
    make = lambda n: [(rng.randint(1, 2), k, a := rng.randint(0, 60), a + rng.randint(0, 20)) for k in range(n)]
    one, two = make(40), make(40)
    schema = "id int, name int, left long, right long"
    found = analytics.overlaps(spark.createDataFrame(one, schema), spark.createDataFrame(two, schema), 16)
    want = sorted((i, n, m, min(b, d) - max(a, c)) for i, n, a, b in one for j, m, c, d in two if i == j and min(b, d) > max(a, c))
    assert got(found) == want
    sizes = spark.createDataFrame([(1, 80), (2, 80), (3, 9)], "id int, size long")
    cells = {i: {c for j, _, a, b in one if j == i for c in range(a, b)} for i in (1, 2, 3)}
    want = [(i, (n + 1 - len(cells[i])) / (n + 1)) for i, n in ((1, 80), (2, 80), (3, 9))]
    assert got(analytics.uncovered(spark.createDataFrame(one, schema), sizes)) == want


def test_orthologues_both_ways(spark):
    rows = steps(spark, "5M3D2M4I1M")
    points = spark.createDataFrame([(0, p, str(p)) for p in (0, 4, 5, 7, 8, 10, 99)], "aln_id int, pos int, name string")
    assert [r.projected for r in analytics.orthologues(points, rows).orderBy("pos").collect()] == [0, 4, 5, 5, 5, 11, 12]
    assert [r.projected for r in analytics.orthologues(points, rows, 2).orderBy("pos").collect()] == [0, 4, 8, 10, 10, 10, 11]


def test_compare_counts_cells(spark):
    rng = random.Random(7)
    texts = ["".join(f"{rng.randint(1, 6)}{rng.choice('MXID')}" for _ in range(8)) for _ in range(12)]

    def cells(text):
        out, x, y = set(), 0, 0
        for n, op in re.findall(r"(\d+)(.)", text):
            n = int(n)
            if op == "M":
                out |= {(x + k, y + k) for k in range(n)}
            x, y = x + n * (op != "I"), y + n * (op != "D")
        return out

    pairs = spark.createDataFrame([(a, b) for a in range(12) for b in range(a)], "a_id int, b_id int")
    for r in analytics.compare(pairs, steps(spark, *texts)).collect():
        a, b = cells(texts[r.a_id]), cells(texts[r.b_id])
        assert (r.size_a, r.size_b, r.shared) == (len(a), len(b), len(a & b))
        assert r.ratio == (len(a & b) / min(len(a), len(b)) if a and b else None)


def test_relational_matches_equal_kernels(spark):
    rng = random.Random(8)
    table = [(k, "".join(rng.choices("ACG", k=rng.randint(0, 12))), "".join(rng.choices("ACG", k=rng.randint(0, 12)))) for k in range(40)]
    pairs = spark.createDataFrame(table, "pair_id long, first string, second string")
    sizes = pairs.select("pair_id", F.length("first").alias("n_first"))
    found = suffix.anchors(suffix.anchor_intervals(suffix.rare_matches(suffix.suffixes(pairs), sizes), sizes))
    mine: dict = {}
    for r in found.collect():
        mine.setdefault(r.pair_id, []).append((r.x, r.y, r.len, r.m, r.n))
    for k, a, b in table:
        assert sorted(mine.get(k, [])) == kernels.anchors_of(kernels.match_intervals(a, b)), (a, b)


def test_wide_matches_are_found(spark, tmp_path):
    """Passages of repeated text, whose least width with a match is over 4."""
    apart = lambda n, k: "".join("a" + chr(k + i) for i in range(n))
    texts = ["ab" * 7, "ab" * 6, apart(3, 0x4E00), apart(3, 0x5E00), apart(50, 0x6E00), apart(50, 0x7E00), apart(51, 0x8E00), apart(51, 0x9000), "", "q"]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    run = lambda name: catalog.queries()[name](spark, str(tmp_path)).collect()
    hits, mine, widths = {}, {}, set()
    for r in run("rare_match_classes"):
        hits.setdefault(r.pair_id, set()).add((r.m, r.n, r.side, r.pos, r.min_len, r.max_len))
    for r in run("anchor_scores"):
        mine.setdefault(r.pair_id, []).append((r.x, r.y, r.len, r.m, r.n))
    for k, (a, b) in enumerate(zip(texts, texts[1:], strict=False)):
        want = set()
        for (m, n), p, _, low, high in kernels.rare_matches(a, b):
            widths.add(m + n)
            want |= {(m, n, 1 + (q > len(a)), q - (q > len(a)) * (len(a) + 1), lo, hi) for q, lo, hi in zip(p.tolist(), low.tolist(), high.tolist(), strict=True)}
        assert hits.get(k, set()) == want
        assert sorted(mine.get(k, [])) == kernels.anchors_of(kernels.match_intervals(a, b))
    assert {6, 100} <= widths and max(widths) <= 101
    assert {r.pair_id for r in run("anchor_intervals")} == set(mine)


def test_whole_passages_are_hashed_and_compared(spark, tmp_path):
    texts = ["été naïf ÀÉ 日本語 straße", "ete naif AE nihongo strasse", "😀é" * 6, "é" * 11, "", "abc"]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    steps = {r.item_id: (r.n, int(r.after_sum), int(r.before_sum)) for r in catalog.queries()["kmer_hash_steps"](spark, str(tmp_path)).collect()}
    plain = lambda word: reduce(lambda h, c: (h * 239 + ord(c)) % bases.HASH_MODULUS, word, 0)
    hashes = {k: [plain(t[i : i + 11]) for i in range(len(t) - 10)] for k, t in enumerate(texts) if len(t) > 11}
    assert steps == {k: (len(h) - 1, sum(h[1:]), sum(h[:-1])) for k, h in hashes.items()}
    far = {r.pair_id: r.distance for r in catalog.queries()["edit_identity"](spark, str(tmp_path)).collect()}
    for k, (a, b) in enumerate(zip(texts, texts[1:], strict=False)):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            old, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        assert far[k] == row[-1]


def test_long_documents_are_hashed(spark, tmp_path):
    rng = random.Random(9)
    texts = ["", "xyz", "acgt", "".join(rng.choices("ACGTN ", k=260)), "".join(rng.choices("ACGT", k=20_000))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: r.h for r in catalog.queries()["seq_hash"](spark, str(tmp_path)).collect()}
    for k, text in enumerate(texts):
        h = 0
        for c in text.upper():
            h = (h * 239 + ord(c)) % bases.HASH_MODULUS if c in "ACGT" else h
        assert found[k] == h


def test_minimizers_against_windows(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choices("ACGT", k=n)) for n in (0, 4, 9, 40, 5000)]
    seqs = spark.createDataFrame(list(enumerate(texts)), "seq_id int, seq string")
    found: dict = {}
    for r in kmers.minimizers(seqs, 5, 6).orderBy("seq_id", "pos").collect():
        found.setdefault(r.seq_id, []).append((r.pos, r.kmer))
    flip = str.maketrans("ACGT", "TGCA")
    for k, text in enumerate(texts):
        words = [min(w := text[i : i + 5], w.translate(flip)[::-1]) for i in range(len(text) - 4)]
        windows = [min((w, i + a) for i, w in enumerate(words[a : a + 6])) for a in range(max(1, len(words) - 5))] if words else []
        picked = sorted({(i, w) for w, i in windows})
        want = [p for n, p in enumerate(picked) if not n or picked[n - 1][1] != p[1]]
        assert found.get(k, []) == want


def test_column_functions(spark):
    row = spark.createDataFrame([("aaCCgT-", "GATTACA")], "a string, b string").select(
        bases.reverse_complement(F.col("a")), bases.compress_runs(F.col("a")), bases.base4_value(F.col("b")), bases.canonical(F.col("b")),
        bases.part(F.col("b"), 1, 4), bases.wrap(F.col("b"), 3), bases.only_bases(F.col("a")), bases.flip_id(F.lit("-x")), bases.zero_pad(F.lit(7), 3),
        bases.mask(F.lit("a.b"), "."), bases.is_canonical(F.col("b")), bases.common_prefix(F.lit(""), F.lit("a")),
    ).first()
    value = int("".join({"A": "0", "C": "1", "G": "2", "T": "3"}[c] for c in "GATTACA"), 4)
    assert tuple(row) == ("-AcGGtt", "aCgT-", value, "GATTACA", "ATT", "GAT\nTAC\nA", False, "x", "007", "a_b", True, 0)


def test_simulated_alignments_are_true(spark):
    rng = random.Random(10)
    seqs = spark.createDataFrame([(k, "".join(rng.choices("ACGT", k=300 + k))) for k in range(4)], "seq_id int, seq string")
    for made in (simulate.mutate(seqs, 1, 0.05, 0.02, 0.02), simulate.delete_once(seqs, 1, 0.05, 100)):
        both = made.join(seqs, "seq_id").select(F.col("seq_id").alias("aln_id"), F.col("seq").alias("first"), F.col("mutated").alias("second"), "cigar")
        assert both.count() == 4 and all(r.valid for r in cigar.check(both).collect())
    units = F.sequence(F.lit(0), F.lit(280), F.lit(20))
    more = seqs.unionByName(spark.createDataFrame([(90, ""), (91, "ACGT"), (92, None)], seqs.schema)).withColumn("starts", F.when(F.col("seq_id") < 90, units))
    for events, duplicate in ((5, 0.5), (40, 0.5), (30, 1.0), (30, 0.0), (0, 0.5)):
        copies = simulate.copy_number(more, events, 2, duplicate=duplicate)
        rows = copies.join(more.select(F.col("seq_id").cast("string").alias("seq_id"), F.coalesce("seq", F.lit("")).alias("seq")), "seq_id").collect()
        assert len(rows) == 7
        for r in rows:
            assert kernels.is_valid([(int(n), op) for n, op in re.findall(r"(\d+)(.)", r.cigar)], r.seq, r.mutated)
            assert r.mutated.endswith(r.seq[280:]) and ("D" not in r.cigar or duplicate < 1) and ("I" not in r.cigar or duplicate > 0)
            assert (r.mutated == r.seq) if events == 0 or len(r.seq) < 300 else (len(r.mutated) != len(r.seq) or 0 < duplicate < 1)
    assert [tuple(r) for r in simulate.copy_number(more, 5, 2).orderBy("seq_id").collect()] == [tuple(r) for r in simulate.copy_number(more, 5, 2).orderBy("seq_id").collect()]


def test_empty_and_null_pairs(spark):
    pairs = spark.createDataFrame([(1, None, "AC"), (2, "", ""), (None, "A", None)], "pair_id long, first string, second string")
    assert sorted((r.cigar, r.valid) for r in align.align(pairs).collect()) == [("", True), ("1D", True), ("2I", True)]
    assert align.align(pairs.limit(0)).count() == 0
    assert align.bridges(pairs).count() == align.path_counts(pairs).count() == align.align_kmers(pairs).count() == 0


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">one first record\nACGT\nAC\n\nignored\n>two\nGG\r\nTT\r\n")
    (tmp_path / "b.fq").write_text("@q1 x\nACC\n+\n@@@\n@q2\nGGT\n+q2\nIII\n")
    a = files.fasta(spark, str(tmp_path / "a.fasta"))
    assert sorted((r.seq_id, r.seq) for r in a.collect()) == [("one", "ACGTAC"), ("two", "GGTT")]
    assert sorted((r.seq_id, r.seq) for r in files.fasta(spark, str(tmp_path / "a.fasta"), collapse_runs=True).collect()) == [("one", "ACGTAC"), ("two", "GT")]
    q = files.fastq(spark, str(tmp_path / "b.fq"))
    assert sorted((r.seq_id, r.seq, r.quality) for r in q.collect()) == [("q1", "ACC", "@@@"), ("q2", "GGT", "III")]
    (tmp_path / "c.fa").write_text(">two\nGGA\n>three\nA\n")
    assert [(r.first, r.second) for r in files.pairs(spark, str(tmp_path / "a.fasta"), str(tmp_path / "c.fa"), strict=False).collect()] == [("GGTT", "GGA")]
    sinks.fasta(a, str(tmp_path / "out"), width=4, compression="gzip")
    again = files.sequences(spark, glob.glob(str(tmp_path / "out/part-*")))
    assert sorted((r.seq_id, r.seq) for r in again.collect()) == [("one", "ACGTAC"), ("two", "GGTT")]
    both = files.sequences(spark, [str(tmp_path / "a.fasta"), str(tmp_path / "b.fq")])
    assert both.count() == 4
    (tmp_path / "genes.csv").write_text("pos,gene\n5,g1\n2,g2\n")
    assert sorted(tuple(r) for r in files.genes(spark, str(tmp_path / "genes.csv")).collect()) == [(2, "g2", "gray"), (5, "g1", "gray")]
    (tmp_path / "hors.txt").write_text("chr m1  0 170  99.5\nchr m2\t171 341 98\n")
    assert [r.st for r in files.units(spark, str(tmp_path / "hors.txt")).orderBy("st").collect()] == [0, 171]
    (tmp_path / "bridges.txt").write_text("#a comment\nstart_1,start_2,end_1,end_2\n1,2,3,4\n")
    assert [tuple(r) for r in files.bridges(spark, str(tmp_path / "bridges.txt")).collect()] == [(1, 2, 3, 4)]


def test_command_line(spark, tmp_path):
    rng = random.Random(11)
    first = "".join(rng.choices("ACGT", k=400))
    second = first[:150] + "".join(rng.choices("ACGT", k=40)) + first[150:300] + first[320:]
    for name, seq in (("a", first), ("b", second)):
        (tmp_path / f"{name}.fasta").write_text(f">{name}\n{seq}\n")
    out = str(tmp_path / "out")
    where = ["--first", str(tmp_path / "a.fasta"), "--second", str(tmp_path / "b.fasta")]
    run = lambda *argv: (lambda a: a.run(spark, a))(cli.parser().parse_args(argv))
    run("align", "-o", out, *where, "--debug", "--no_paths", "--bridges")
    text = files.cigars(spark, glob.glob(f"{out}/cigar/part-*")).filter("cigar <> ''").first().cigar
    parsed = [(int(n), op) for n, op in re.findall(r"(\d+)(.)", text)]
    assert kernels.is_valid(parsed, first, second)
    matches = files.matches(spark, f"{out}/shortest_matches")
    assert matches.count() > 0 and traces.match_segments(matches.withColumn("pair_id", F.lit(1))).count() >= matches.count()
    assert files.bridges(spark, f"{out}/bridges").count() > 0 and files.path_counts(spark, f"{out}/no_paths").count() > 0
    run("kmer-align", "-o", f"{out}/k", *where)
    assert files.kmer_alignment(spark, f"{out}/k/glob_alignment").count() > 0 and files.blocks(spark, f"{out}/k/blocks").count() > 0
    (tmp_path / "c.txt").write_text(text)
    (tmp_path / "genes.csv").write_text("pos,gene,color\n50,g,red\n")
    run("histogram", "-o", f"{out}/h", "-i", str(tmp_path / "c.txt"), "-l", "20")
    run("dotplot", "-o", f"{out}/d", "-i", str(tmp_path / "c.txt"), "--matches", f"{out}/shortest_matches", "--bridges", f"{out}/bridges", "--first-genes", str(tmp_path / "genes.csv"), "--second-genes", str(tmp_path / "genes.csv"))
    assert spark.read.csv(f"{out}/d/genes_1", header=True).count() == 2
    run("compare", "-i1", str(tmp_path / "c.txt"), "-i2", str(tmp_path / "c.txt"))
    run("simulate", "-o", f"{out}/s", "-s", str(tmp_path / "a.fasta"), "--del-len", "50")
    assert files.sequences(spark, glob.glob(f"{out}/s/mod/part-*")).count() == 1


def test_stream_of_pairs(spark, tmp_path):
    rows = [(k, "ACGTACGTTT" * 3, "ACGTACGTT" * 3) for k in range(5)]
    spark.createDataFrame(rows, stream.SCHEMA).write.parquet(str(tmp_path / "in"))
    query = stream.align_to(stream.read(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"), once=True)
    assert query.awaitTermination(120) and query.exception() is None
    done = spark.read.parquet(str(tmp_path / "out"))
    assert done.count() == 5 and done.filter("valid").count() == 5


def test_fastq_with_any_quality(spark, tmp_path):
    """Qualities that begin with @ or +, wrapped lines, a record cut short; small file blocks part them all over."""
    rng = random.Random(14)
    want, lines = {}, []
    for k in range(400):
        n = rng.randint(1, 90)
        seq, quality = "".join(rng.choices("ACGT", k=n)), "".join(rng.choices("@+IJ#", k=n))
        if k % 3 == 0:
            quality = "@" + quality[1:]
        want[f"r{k}"] = (seq, quality)
        lines += [f"@r{k} about", seq, "+", quality]
    (tmp_path / "a.fastq").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        found = files.fastq(spark, str(tmp_path / "a.fastq"))
        assert found.rdd.getNumPartitions() > 4
        assert {r.seq_id: (r.seq, r.quality) for r in found.collect()} == want and found.count() == len(want)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "b.fq").write_text("@w wrapped\nACGT\nAC\n+w\nIIII\n@I\n@x\r\nGG\r\n+\r\n@@\r\n@cut\nTTT\n+\nI")
    assert sorted(tuple(r)[:3] for r in files.fastq(spark, str(tmp_path / "b.fq")).collect()) == [("cut", "TTT", "I"), ("w", "ACGTAC", "IIII@I"), ("x", "GG", "@@")]


def test_last_of_equal_ids(spark, tmp_path):
    for folder, seq in (("one", "AAA"), ("two", "CCC")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "same name.fasta").write_text(f">s\nG\n>s\n{seq}\n")
    paths = [str(tmp_path / f / "same name.fasta") for f in ("one", "two")]
    assert [r.seq for r in files.sequences(spark, paths).collect()] == ["CCC"]
    assert [r.seq for r in files.sequences(spark, paths[::-1]).collect()] == ["AAA"]


def test_outputs_of_many_pairs(spark, tmp_path):
    rng = random.Random(3)
    seqs = {f"s{k}": "".join(rng.choices("ACGT", k=300)) for k in range(3)}
    (tmp_path / "a.fasta").write_text("".join(f">{k}\n{s}\n" for k, s in seqs.items()))
    (tmp_path / "b.fasta").write_text("".join(f">{k}\n{s[:100] + s[110:]}\n" for k, s in seqs.items()))
    where = ["--many", "--first", str(tmp_path / "a.fasta"), "--second", str(tmp_path / "b.fasta")]
    run = lambda *argv: (lambda a: a.run(spark, a))(cli.parser().parse_args(argv))
    run("align", "-o", f"{tmp_path}/out", *where, "--bridges", "--no_paths")
    run("kmer-align", "-o", f"{tmp_path}/k", *where, "--indexed")
    ids = {int(r.pair_id): r.seq_id for r in spark.read.csv(f"{tmp_path}/out/pairs", sep="\t", header=True).collect()}
    assert sorted(ids.values()) == sorted(seqs)
    for line in spark.read.text(f"{tmp_path}/out/cigar").collect():
        pair, text = line.value.split("\t")
        s = seqs[ids[int(pair)]]
        assert kernels.is_valid([(int(n), op) for n, op in re.findall(r"(\d+)(.)", text)], s, s[:100] + s[110:])
    for name in ("shortest_matches", "no_paths"):
        rows = spark.read.csv(f"{tmp_path}/out/{name}", sep="\t" if name == "shortest_matches" else ",", header=True)
        assert rows.columns[0] == "pair_id" and {int(r.pair_id) for r in rows.collect()} == set(ids)
    lines = [r.value for r in spark.read.text(f"{tmp_path}/out/bridges").collect()]
    assert sinks.BRIDGES_COMMENT in lines and "pair_id,start_1,start_2,end_1,end_2" in lines
    indexed = [r.value.split(" ", 1) for r in spark.read.text(f"{tmp_path}/k/glob_align").collect()]
    assert {int(i) for i, _ in indexed} == set(ids)
    for pair in ids:
        first = [re.match(r"\((\d+), (\d+)\)|-", text).groups() for i, text in indexed if int(i) == pair]
        numbers = sorted((int(n), int(p)) for n, p in first if n)
        assert [n for n, _ in numbers] == list(range(len(numbers))) and [p for _, p in numbers] == sorted(p for _, p in numbers)


def test_counts_of_any_size_are_read_back(spark, tmp_path):
    big = str(3**60)
    df = spark.createDataFrame([(1, 2, 3, big, big, 1, 2)], "start_1 long, start_2 long, len long, n_opt_paths_fwd string, n_opt_paths_rev string, n_count long, m_count long")
    sinks.path_counts(df, f"{tmp_path}/counts")
    assert files.path_counts(spark, f"{tmp_path}/counts").first().n_opt_paths_fwd == big
