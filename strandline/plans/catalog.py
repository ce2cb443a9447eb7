"""All queries over the sequence operators, with the SQL that gives the same rows.

Queries whose recurrences have no SQL stand without: tests hold those against
brute force.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bases
from ..operators import align, analytics, bridges, chains, cigar, kmers, lcs, ranks, refine, simulate, suffix, ties, traces
from ..sources import files, formats, sinks
from ..sources.shared import shared_dir
from . import tables

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP = "kmer_rare_shared"

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

DNA = "regexp_replace(upper(text), '[^ACGT]', '', 'g')"
#: K-mers of a table's texts in SQL.
KMERS = "SELECT {id} AS seq_id, i AS pos, substring(text, i + 1, {k}) AS kmer FROM {table}, LATERAL (SELECT unnest(range(0, greatest(0, length(text) - {k} + 1))) AS i)"
STEPS = """
s AS (
  SELECT l_orderkey AS aln_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS ord,
         CAST(l_quantity AS BIGINT) AS len, substr('MXID', CAST(l_linenumber % 4 + 1 AS INT), 1) AS op
  FROM lineitem
), t AS (
  SELECT *, x1 - dx AS x0, y1 - dy AS y0 FROM (
    SELECT *, sum(dx) OVER w AS x1, sum(dy) OVER w AS y1 FROM (
      SELECT *, CASE WHEN op = 'I' THEN 0 ELSE len END AS dx, CASE WHEN op = 'D' THEN 0 ELSE len END AS dy FROM s
    ) WINDOW w AS (PARTITION BY aln_id ORDER BY ord)
  )
)
"""
PAIRS = "p AS (SELECT a.item_id AS pair_id, a.text AS first, b.text AS second FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1)"
RELATED = """
p AS (
  SELECT item_id AS pair_id, text AS first, translate(substring(text, 1, 2 * t) || substring(text, t + 1, t) || substring(text, 2 * t + 1), 'q,', 'k;') AS second
  FROM (SELECT *, CAST(floor(length(text) / 3) AS BIGINT) AS t FROM benchmark)
)
"""
RANKED = f"""
{PAIRS}, sides AS (
  SELECT pair_id, 1 AS side, first AS seq FROM p UNION ALL SELECT pair_id, 2, second FROM p
), suf AS (
  SELECT pair_id, side, i AS pos, substring(seq, i + 1) AS suffix FROM sides, LATERAL (SELECT unnest(range(0, length(seq))) AS i)
), ranked AS (
  SELECT *, row_number() OVER w - 1 AS r, lead(suffix) OVER w AS after FROM suf WINDOW w AS (PARTITION BY pair_id ORDER BY suffix, side, pos)
), sa AS (
  SELECT pair_id, side, pos, r, CASE WHEN after IS NULL THEN 0 ELSE
    coalesce(list_min(list_filter(range(1, least(length(suffix), length(after)) + 1), lambda i: suffix[i] <> after[i])) - 1, least(length(suffix), length(after))) END AS lcp
  FROM ranked
)
"""
FIRST_LENGTHS = "fl AS (SELECT pair_id, length(first) AS n_first FROM p)"


#: Windows of all widths over common prefixes, a rank wider in each round.
EVERY_HIT = f"""
{RANKED}, {FIRST_LENGTHS}, sb AS MATERIALIZED (
  SELECT pair_id, side, pos, r, lcp, sum(CASE WHEN side = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY pair_id ORDER BY r) AS firsts FROM sa
), grow AS (
  SELECT pair_id, r, 2 AS w, lcp AS cur FROM sb WHERE lcp > 0
  UNION ALL
  SELECT g.pair_id, g.r, g.w + 1, least(g.cur, s.lcp)
  FROM grow g JOIN sb s ON s.pair_id = g.pair_id AND s.r = g.r + g.w - 1 JOIN fl ON fl.pair_id = g.pair_id WHERE s.lcp > 0 AND g.w < 2 * least(n_first, 50)
), every AS (
  SELECT g.*, greatest(least(coalesce(b.lcp, 0), cur), least(e.lcp, cur)) AS low, e.firsts - coalesce(b.firsts, 0) AS m
  FROM grow g JOIN sb e ON e.pair_id = g.pair_id AND e.r = g.r + g.w - 1 LEFT JOIN sb b ON b.pair_id = g.pair_id AND b.r = g.r - 1
), every_hit AS (
  SELECT h.pair_id, CAST(w AS INT) AS w, CAST(m AS INT) AS m, CAST(w - m AS INT) AS n, h.r AS clas, CAST(s.side AS INT) AS side, CAST(s.pos AS BIGINT) AS pos, low + 1 AS min_len, cur AS max_len
  FROM (SELECT *, unnest(range(r, r + w)) AS j FROM every WHERE cur > low AND least(m, w - m) >= 1 AND greatest(m, w - m) <= (w + 1) // 2) h
  JOIN sb s ON s.pair_id = h.pair_id AND s.r = h.j
)
"""
ALL_HITS = f"{EVERY_HIT}, hits AS (SELECT * FROM every_hit)"
#: Those of the least width that a pair has.
HITS = f"{EVERY_HIT}, hits AS (SELECT * FROM every_hit QUALIFY w = min(w) OVER (PARTITION BY pair_id))"
COLLAPSED = """placed AS (
  SELECT h.*, n_first, CASE WHEN side = 1 THEN pos ELSE pos + n_first + 1 END AS p FROM hits h JOIN fl USING (pair_id)
), ends AS (
  SELECT pair_id, n_first, m, n, p + min_len AS en, max(p) AS p, arg_max(clas, p) AS clas, arg_max(max_len, p) AS max_len FROM placed GROUP BY pair_id, n_first, m, n, p + min_len
), kept AS (
  SELECT pair_id, n_first, m, n, min(p) AS p, arg_min(clas, p) AS clas, max(en) - min(p) AS len FROM ends GROUP BY pair_id, n_first, m, n, p + max_len
), iv AS (
  SELECT pair_id, m, n, clas, arg_min(len, p) AS len,
    list_sort(coalesce(list(p) FILTER (p < n_first), [])) AS first_starts, list_sort(coalesce(list(p - n_first - 1) FILTER (p >= n_first), [])) AS second_starts
  FROM kept GROUP BY pair_id, m, n, clas
)
"""
INTERVALS = f"""
{HITS}, {COLLAPSED}"""


def of_related(sql: str) -> str:
    """The same over each passage and its changed copy."""
    return sql.replace(PAIRS, RELATED)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# -- sequences --------------------------------------------------------------------


@query("seq_normalise", f"SELECT doc_id, CAST(length({DNA}) AS BIGINT) AS n, md5({DNA}) AS letters, md5(translate({DNA}, 'ACGT', '0123')) AS digits FROM documents")
def seq_normalise(spark, sf_dir):
    d = tables.document_dna(spark, sf_dir)
    return d.select(F.col("seq_id").alias("doc_id"), F.length("seq").cast("long").alias("n"), F.md5("seq").alias("letters"), F.md5(bases.digits(F.col("seq"))).alias("digits"))


@query("seq_revcomp", f"SELECT doc_id, md5(reverse(translate({DNA}, 'ACGT', 'TGCA'))) AS other_strand FROM documents")
def seq_revcomp(spark, sf_dir):
    return tables.document_dna(spark, sf_dir).select(F.col("seq_id").alias("doc_id"), F.md5(bases.reverse_complement(F.col("seq"))).alias("other_strand"))


@query("seq_valid", f"SELECT doc_id, NOT regexp_matches(text, '[^ACGTacgt]') AS text_valid, starts_with({DNA}, 'AC') AS ac_first, ends_with({DNA}, 'T') AS t_last, substring({DNA}, 3, 2) = 'GA' AS ga_third FROM documents")
def seq_valid(spark, sf_dir):
    d = tables.documents(spark, sf_dir).withColumn("dna", bases.dna_letters(F.col("seq")))
    return d.select(F.col("seq_id").alias("doc_id"), bases.only_bases(F.col("seq")).alias("text_valid"), F.startswith("dna", F.lit("AC")).alias("ac_first"), F.endswith("dna", F.lit("T")).alias("t_last"), bases.occurs_at(F.col("dna"), 2, F.lit("GA")).alias("ga_third"))


@query("seq_homopolymer", f"""
WITH d AS (SELECT doc_id, {DNA} AS s FROM documents)
SELECT doc_id, md5(coalesce(array_to_string(list_transform(list_filter(range(1, length(s) + 1), lambda i: i = 1 OR s[i] <> s[i - 1]), lambda i: s[i]), ''), '')) AS collapsed FROM d
""")  # fmt: skip
def seq_homopolymer(spark, sf_dir):
    return tables.document_dna(spark, sf_dir).select(F.col("seq_id").alias("doc_id"), F.md5(bases.compress_runs(F.col("seq"))).alias("collapsed"))


@query("seq_prefix", """
WITH p AS (SELECT a.item_id AS pair_id, a.text AS a, b.text AS b FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1)
SELECT pair_id, CAST(CASE WHEN least(length(a), length(b)) = 0 THEN 0 ELSE coalesce(list_min(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: a[i] <> b[i])) - 1, least(length(a), length(b))) END AS INT) AS shared FROM p
""")  # fmt: skip
def seq_prefix(spark, sf_dir):
    return tables.passage_pairs(spark, sf_dir).select("pair_id", bases.common_prefix(F.col("first"), F.col("second")).cast("int").alias("shared"))


#: The polynomial hash of a list of letters in SQL.
HASH = "list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform({0}, lambda c: CAST(unicode(c) AS BIGINT))), lambda h, c: (h * 239 + c) % 36028797018963913)"


@query("seq_hash", f"SELECT doc_id, {HASH.format('letters')} AS h FROM (SELECT doc_id, list_filter(string_split({DNA}, ''), lambda c: c <> '') AS letters FROM documents)")
def seq_hash(spark, sf_dir):
    return tables.document_dna(spark, sf_dir).select(F.col("seq_id").alias("doc_id"), bases.polynomial_hash(F.col("seq")).alias("h"))


@query("seq_chunks", """
SELECT doc_id, CAST(i AS BIGINT) AS start, doc_id || '_' || i AS chunk_id, md5(substring(text, CAST(i + 1 AS BIGINT), 550)) AS chunk
FROM documents, LATERAL (SELECT unnest(range(0, greatest(length(text) - 51, 0) + 1, 500)) AS i) WHERE length(text) > 0
""")  # fmt: skip
def seq_chunks(spark, sf_dir):
    return kmers.chunks(tables.documents(spark, sf_dir), 500, 50).select(F.col("seq_id").alias("doc_id"), "start", "chunk_id", F.md5("chunk").alias("chunk"))


def _as_fasta(spark, sf_dir):
    """The documents' bases as FASTA files in the shared folder."""
    path = f"{shared_dir(spark)}/fasta-{uuid.uuid4().hex}"
    sinks.fasta(tables.document_dna(spark, sf_dir), path, width=70)
    return path


@query("fasta_round_trip", f"SELECT doc_id, CAST(length({DNA}) AS BIGINT) AS n, md5({DNA}) AS letters FROM documents")
def fasta_round_trip(spark, sf_dir):
    """Written as FASTA, read back by ranges of bytes."""
    rows = formats.register(spark).read.format("fasta").option("split", 1 << 18).load(_as_fasta(spark, sf_dir))
    return rows.select(F.col("seq_id").cast("long").alias("doc_id"), F.length("seq").cast("long").alias("n"), F.md5("seq").alias("letters"))


@query("fasta_pieces", f"""
SELECT doc_id, CAST(count(*) FILTER (c = 'G' OR c = 'C') AS BIGINT) AS strong, CAST(count(*) FILTER (c <> '') AS BIGINT) AS n, CAST(sum(CASE WHEN c = 'G' THEN i ELSE 0 END) AS BIGINT) AS g_places
FROM (SELECT doc_id, unnest(string_split({DNA}, '')) AS c, unnest(range(0, greatest(length({DNA}), 1))) AS i FROM documents) GROUP BY doc_id
""")  # fmt: skip
def fasta_pieces(spark, sf_dir):
    """Read in pieces of some hundred letters: G and C, letters, and the sum of the places of all G."""
    rows = files.fasta_pieces(spark, _as_fasta(spark, sf_dir), piece=280, split=1 << 18)
    letters = F.split("seq", "")
    places = F.aggregate(F.zip_with(letters, F.sequence(F.lit(0), F.size(letters) - 1), lambda c, i: F.when(c == "G", F.col("start") + i).otherwise(F.lit(0))), F.lit(0).cast("long"), lambda a, b: a + b)
    strong = F.length(F.regexp_replace("seq", "[^GC]", ""))
    found = rows.groupBy(F.col("seq_id").cast("long").alias("doc_id"))
    return found.agg(F.sum(strong).cast("long").alias("strong"), F.sum(F.length("seq")).cast("long").alias("n"), F.sum(places).alias("g_places"))


# -- k-mers -----------------------------------------------------------------------

DOC_KMERS, ITEM_KMERS = KMERS.format(id="doc_id", table="documents", k=24), KMERS.format(id="item_id", table="benchmark", k=24)
RARE = "SELECT seq_id, kmer, count(*) AS n FROM {0} GROUP BY seq_id, kmer HAVING count(*) <= 1"


@query("kmer_counts", f"WITH k AS ({KMERS.format(id='item_id', table='benchmark', k=12)}) SELECT seq_id AS item_id, kmer, count(*) AS n FROM k GROUP BY ALL")
def kmer_counts(spark, sf_dir):
    return kmers.counts(kmers.kmers(tables.passages(spark, sf_dir), 12)).withColumnRenamed("seq_id", "item_id")


@query("kmer_rare", f"WITH d AS ({DOC_KMERS}), r AS ({RARE.format('d')}) SELECT seq_id AS doc_id, count(*) AS n_rare FROM r GROUP BY seq_id")
def kmer_rare(spark, sf_dir):
    return kmers.rare_numbers(tables.documents(spark, sf_dir), 24).withColumnRenamed("seq_id", "doc_id")


@query("kmer_rare_shared", f"""
WITH d AS ({DOC_KMERS}), b AS ({ITEM_KMERS}), rd AS ({RARE.format("d")}), rb AS ({RARE.format("b")})
SELECT rd.seq_id AS doc_id, rb.seq_id AS item_id, count(*) AS n_shared FROM rd JOIN rb USING (kmer) GROUP BY ALL
""")  # fmt: skip
def kmer_rare_shared(spark, sf_dir):
    items = kmers.kmers(tables.passages(spark, sf_dir), 24)
    shared = kmers.shared_rare(kmers.likely(tables.documents(spark, sf_dir), 24, kmers.rare(items)), items)
    return shared.groupBy(F.col("first_id").alias("doc_id"), F.col("second_id").alias("item_id")).agg(F.count("*").alias("n_shared"))


def _shared_positions(spark, sf_dir):
    wanted = kmers.rare(kmers.kmers(tables.passages(spark, sf_dir), 24))
    return kmers.positions_of(kmers.likely(tables.documents(spark, sf_dir), 24, wanted), wanted)


@query("kmer_positions", f"WITH d AS ({DOC_KMERS}), b AS ({ITEM_KMERS}), rb AS ({RARE.format('b')}) SELECT seq_id AS doc_id, CAST(pos AS BIGINT) AS pos, kmer FROM d WHERE kmer IN (SELECT kmer FROM rb)")
def kmer_positions(spark, sf_dir):
    return _shared_positions(spark, sf_dir).withColumnRenamed("seq_id", "doc_id")


@query("kmer_coords", f"WITH d AS ({DOC_KMERS}), b AS ({ITEM_KMERS}), rb AS ({RARE.format('b')}) SELECT seq_id AS doc_id, kmer, array_to_string(list_sort(list(pos)), ',') AS positions FROM d WHERE kmer IN (SELECT kmer FROM rb) GROUP BY seq_id, kmer")
def kmer_coords(spark, sf_dir):
    lists = kmers.coordinate_lists(_shared_positions(spark, sf_dir))
    return lists.select(F.col("seq_id").alias("doc_id"), "kmer", bases.join_fields(F.col("positions")).alias("positions"))


@query("kmer_dotplot_pairs", f"""
WITH d AS ({DOC_KMERS}), b AS ({ITEM_KMERS})
SELECT d.seq_id AS doc_id, b.seq_id AS item_id, CAST(d.pos AS BIGINT) AS x, CAST(b.pos AS BIGINT) AS y, CAST(d.pos + 24 AS BIGINT) AS x_end, CAST(b.pos + 24 AS BIGINT) AS y_end FROM d JOIN b USING (kmer)
""")  # fmt: skip
def kmer_dotplot_pairs(spark, sf_dir):
    items = kmers.kmers(tables.passages(spark, sf_dir), 24)
    return kmers.dotplot_pairs(kmers.likely(tables.documents(spark, sf_dir), 24, items), items, 24).withColumnsRenamed({"first_id": "doc_id", "second_id": "item_id"})


def _minimizer_sql(words: str, name: str, w: int) -> str:
    """``words`` ends with k (seq_id, pos, kmer)."""
    return f"""
WITH {words}, w AS (
  SELECT seq_id, min({{'kmer': kmer, 'pos': pos}}) OVER f AS m, count(*) OVER f AS held, count(*) OVER (PARTITION BY seq_id) AS n, pos
  FROM k WINDOW f AS (PARTITION BY seq_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING)
), q AS (SELECT DISTINCT seq_id, m.pos AS pos, m.kmer AS kmer FROM w WHERE held = {w} OR (n < {w} AND held = n))
SELECT seq_id AS {name}, CAST(pos AS BIGINT) AS pos, kmer FROM (SELECT *, lag(kmer) OVER (PARTITION BY seq_id ORDER BY pos) AS before FROM q) WHERE kmer IS DISTINCT FROM before
"""


@query("minimizers", _minimizer_sql(f"k AS ({KMERS.format(id='item_id', table='benchmark', k=11)})", "item_id", 8))
def minimizers(spark, sf_dir):
    return kmers.minimizers(tables.passages(spark, sf_dir), 11, 8, strands=False).withColumnRenamed("seq_id", "item_id")


@query("kmer_canonical", f"""
WITH d AS (SELECT doc_id, {DNA} AS text FROM documents), k AS ({KMERS.format(id="doc_id", table="d", k=6)}),
c AS (SELECT kmer, least(kmer, reverse(translate(kmer, 'ACGT', 'TGCA'))) AS word FROM k)
SELECT word, CAST(list_reduce(list_transform(range(1, 7), lambda i: strpos('ACGT', word[i]) - 1), lambda a, b: a * 4 + b) AS BIGINT) AS value, count(*) AS n, count(*) FILTER (kmer = word) AS n_forward FROM c GROUP BY word
""")  # fmt: skip
def kmer_canonical(spark, sf_dir):
    found = kmers.kmers(tables.document_dna(spark, sf_dir), 6).select("kmer", bases.canonical(F.col("kmer")).alias("word"))
    counted = found.groupBy("word").agg(F.count("*").alias("n"), F.count_if(bases.is_canonical(F.col("kmer"))).alias("n_forward"))
    return counted.select("word", bases.base4_value(F.col("word")).alias("value"), "n", "n_forward")


@query("kmer_hash_steps", f"""
WITH w AS (SELECT item_id, i, length(text) AS n, {HASH.format("string_split(substring(text, CAST(i + 1 AS BIGINT), 11), '')")} AS h FROM benchmark, LATERAL (SELECT unnest(range(0, greatest(0, length(text) - 10))) AS i))
SELECT item_id, max(n) - 11 AS n, CAST(sum(h) FILTER (i > 0) AS VARCHAR) AS after_sum, CAST(sum(h) FILTER (i < n - 11) AS VARCHAR) AS before_sum FROM w WHERE n >= 12 GROUP BY item_id
""")  # fmt: skip
def kmer_hash_steps(spark, sf_dir):
    """Hashes of 11-letter windows that follow from their neighbours', one step to the right and one to the left: their sums."""
    # Words of one letter more hold both neighbours.
    rows = kmers.kmers(tables.passages(spark, sf_dir), 12).select("seq_id", F.substring("kmer", 1, 11).alias("a"), F.substring("kmer", 2, 11).alias("b"), F.substring("kmer", 1, 1).alias("x"), F.substring("kmer", 12, 1).alias("y"))
    after = bases.shift_right(bases.polynomial_hash(F.col("a")), F.col("x"), F.col("y"), 11)
    before = bases.shift_left(bases.polynomial_hash(F.col("b")), F.col("y"), F.col("x"), 11)
    total = lambda c: F.sum(c.cast("decimal(20,0)")).cast("string")
    return rows.groupBy(F.col("seq_id").alias("item_id")).agg(F.count("*").alias("n"), total(after).alias("after_sum"), total(before).alias("before_sum"))


STRANDS = f"""
d AS (SELECT doc_id, {DNA} AS text FROM documents), one AS ({KMERS.format(id="doc_id", table="d", k=13)}),
k AS (SELECT seq_id, pos, least(kmer, reverse(translate(kmer, 'ACGT', 'TGCA'))) AS kmer FROM one)
"""


@query("minimizers_dna", _minimizer_sql(STRANDS, "doc_id", 10))
def minimizers_dna(spark, sf_dir):
    return kmers.minimizers(tables.document_dna(spark, sf_dir), 13, 10).withColumnRenamed("seq_id", "doc_id")


@query("sliding_min", """
SELECT event_id, low FROM (SELECT event_id, min(value) OVER f AS low, count(*) OVER f AS held FROM events WINDOW f AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) WHERE held = 5
""")  # fmt: skip
def sliding_min(spark, sf_dir):
    return kmers.sliding_min(tables.table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value", 5).select("event_id", "low")


@query("running_mean", """
SELECT event_id, round(mean, 6) AS mean FROM (SELECT event_id, avg(value) OVER f AS mean, count(*) OVER f AS held FROM events WINDOW f AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) WHERE held = 5
""")  # fmt: skip
def running_mean(spark, sf_dir):
    return kmers.moving_average(tables.table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value", 5).select("event_id", F.round("mean", 6).alias("mean"))


# -- suffixes and matches ---------------------------------------------------------


def _ranked(spark, sf_dir, table=tables.passage_pairs):
    pairs = table(spark, sf_dir)
    return suffix.suffixes(pairs), pairs.select("pair_id", F.length("first").alias("n_first"))


@query("suffix_rank", f"WITH {RANKED} SELECT pair_id, CAST(side AS INT) AS side, CAST(pos AS BIGINT) AS pos, CAST(r AS BIGINT) AS r FROM sa")
def suffix_rank(spark, sf_dir):
    return ranks.ranks_in_pairs(ranks.suffix_index(tables.passage_pairs(spark, sf_dir)))


@query("lcp_adjacent", f"WITH {RANKED} SELECT pair_id, CAST(r AS BIGINT) AS r, CAST(lcp AS BIGINT) AS lcp FROM sa")
def lcp_adjacent(spark, sf_dir):
    return _ranked(spark, sf_dir)[0].select("pair_id", "r", "lcp")


@query("mutual_unique_matches", f"WITH RECURSIVE {EVERY_HIT} SELECT pair_id, CAST(clas AS BIGINT) AS clas, side, pos, CAST(min_len AS BIGINT) AS min_len, CAST(max_len AS BIGINT) AS max_len FROM every_hit WHERE w = 2")
def mutual_unique_matches(spark, sf_dir):
    # Counts of one: width 2 alone.
    return suffix.rare_matches(*_ranked(spark, sf_dir), max_count=1, all_widths=True).select("pair_id", "clas", "side", "pos", "min_len", "max_len")


@query("rare_match_classes", f"WITH RECURSIVE {HITS} SELECT pair_id, CAST(w AS INT) AS w, m, n, CAST(clas AS BIGINT) AS clas, side, pos, CAST(min_len AS BIGINT) AS min_len, CAST(max_len AS BIGINT) AS max_len FROM hits")
def rare_match_classes(spark, sf_dir):
    return suffix.rare_matches(*_ranked(spark, sf_dir)).select("pair_id", "w", "m", "n", "clas", "side", "pos", "min_len", "max_len")


def _intervals(spark, sf_dir):
    ranked, sizes = _ranked(spark, sf_dir)
    return suffix.anchor_intervals(suffix.rare_matches(ranked, sizes), sizes)


def _related_anchors(spark, sf_dir):
    """Anchors of all widths of each passage and its changed copy."""
    ranked, sizes = _ranked(spark, sf_dir, tables.related_pairs)
    return suffix.anchors(suffix.anchor_intervals(suffix.rare_matches(ranked, sizes, all_widths=True), sizes))


@query("anchor_intervals", f"WITH RECURSIVE {INTERVALS} SELECT pair_id, m, n, CAST(clas AS BIGINT) AS clas, CAST(len AS BIGINT) AS len, array_to_string(first_starts, ',') AS first_starts, array_to_string(second_starts, ',') AS second_starts FROM iv")
def anchor_intervals(spark, sf_dir):
    found = _intervals(spark, sf_dir)
    return found.select("pair_id", "m", "n", "clas", "len", bases.join_fields(F.col("first_starts")).alias("first_starts"), bases.join_fields(F.col("second_starts")).alias("second_starts"))


@query("anchor_scores", f"""
WITH RECURSIVE {INTERVALS}, ex AS (SELECT pair_id, len, m, n, unnest(first_starts) AS x, second_starts FROM iv), ey AS (SELECT pair_id, len, m, n, x, unnest(second_starts) AS y FROM ex)
SELECT pair_id, CAST(len AS BIGINT) AS len, m, n, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(len AS DOUBLE) / (m * n) AS score FROM ey
""")  # fmt: skip
def anchor_scores(spark, sf_dir):
    return suffix.anchors(_intervals(spark, sf_dir)).select("pair_id", "len", "m", "n", "x", "y", "score")


# -- alignment --------------------------------------------------------------------


#: A chain's score grows by an anchor at a time, the best way to each anchor at each length.
CHAINS = f"""
WITH RECURSIVE {INTERVALS}, ex AS (SELECT pair_id, len, m, n, unnest(first_starts) AS x, second_starts FROM iv), ey AS (SELECT pair_id, len, m, n, x, unnest(second_starts) AS y FROM ex),
a AS MATERIALIZED (SELECT pair_id, x, y, len, CAST(len AS DOUBLE) / (m * n) AS score FROM ey),
c AS (
  SELECT pair_id, x + len AS x_end, y + len AS y_end, score FROM a
  UNION ALL
  SELECT a.pair_id, a.x + a.len, a.y + a.len, max(c.score) + a.score FROM c JOIN a ON c.pair_id = a.pair_id AND c.x_end <= a.x AND c.y_end <= a.y GROUP BY a.pair_id, a.x, a.y, a.len, a.score
)
SELECT pair_id, max(score) AS score FROM c GROUP BY pair_id
"""


@query("chain_score", CHAINS)
def chain_score(spark, sf_dir):
    return chains.best_scores(suffix.anchors(_intervals(spark, sf_dir)))


#: The best chain itself: of equal predecessors the last anchor, of equal ends the first.
BEST_CHAIN = f"""
WITH RECURSIVE {INTERVALS}, ex AS (SELECT pair_id, len, m, n, unnest(first_starts) AS x, second_starts FROM iv), ey AS (SELECT pair_id, len, m, n, x, unnest(second_starts) AS y FROM ex),
a AS MATERIALIZED (SELECT *, CAST(len AS DOUBLE) / (m * n) AS weight, row_number() OVER (PARTITION BY pair_id ORDER BY x, y, len, m, n) AS k FROM ey),
c AS (
  SELECT pair_id, k, x + len AS x_end, y + len AS y_end, weight AS score FROM a
  UNION ALL
  SELECT a.pair_id, a.k, a.x + a.len, a.y + a.len, max(c.score) + a.weight FROM c JOIN a ON c.pair_id = a.pair_id AND c.x_end <= a.x AND c.y_end <= a.y GROUP BY a.pair_id, a.k, a.x, a.y, a.len, a.weight
), s AS MATERIALIZED (SELECT pair_id, k, x_end, y_end, max(score) AS score FROM c GROUP BY pair_id, k, x_end, y_end),
back AS MATERIALIZED (
  SELECT a.pair_id, a.k, max({{'score': s.score, 'k': s.k}}).k AS before FROM a JOIN s ON s.pair_id = a.pair_id AND s.x_end <= a.x AND s.y_end <= a.y GROUP BY a.pair_id, a.k
), walk AS (
  SELECT pair_id, max({{'score': score, 'k': -k}}).k * -1 AS k, 0 AS step FROM s GROUP BY pair_id
  UNION ALL
  SELECT w.pair_id, b.before, step + 1 FROM walk w JOIN back b ON b.pair_id = w.pair_id AND b.k = w.k
)
SELECT w.pair_id, row_number() OVER (PARTITION BY w.pair_id ORDER BY step DESC) - 1 AS ord, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(len AS BIGINT) AS len, CAST(m AS BIGINT) AS m, CAST(n AS BIGINT) AS n, score
FROM walk w JOIN a ON a.pair_id = w.pair_id AND a.k = w.k JOIN s ON s.pair_id = w.pair_id AND s.k = w.k
"""


@query("chain_anchors", BEST_CHAIN)
def chain_anchors(spark, sf_dir):
    return chains.best_chains(suffix.anchors(_intervals(spark, sf_dir)))


@query("shortest_matches", f"""
WITH RECURSIVE {of_related(ALL_HITS)}, {COLLAPSED}
SELECT pair_id, CAST(m AS BIGINT) AS first_freq, CAST(n AS BIGINT) AS second_freq, CAST(len AS BIGINT) AS len, array_to_string(first_starts, ',') AS first_starts, array_to_string(second_starts, ',') AS second_starts FROM iv
""")  # fmt: skip
def shortest_matches(spark, sf_dir):
    found = suffix.shortest_matches(tables.related_pairs(spark, sf_dir), all_widths=True)
    return found.withColumns({c: bases.join_fields(F.col(c)) for c in ("first_starts", "second_starts")})


@query("align_cigar")
def align_cigar(spark, sf_dir):
    return align.align(tables.related_pairs(spark, sf_dir)).select("pair_id", "cigar", "valid")


@query("align_cigar_primary")
def align_cigar_primary(spark, sf_dir):
    return align.align(tables.passage_pairs(spark, sf_dir)).select("pair_id", "cigar_primary", "valid")


@query("align_recursive")
def align_recursive(spark, sf_dir):
    return align.align(tables.passage_pairs(spark, sf_dir)).select("pair_id", "cigar_recursive", "valid")


@query("align_steps")
def align_steps(spark, sf_dir):
    """All steps of all refined alignments, every block by rows: no kernel takes any of them."""
    return refine.align_steps(tables.related_pairs(spark, sf_dir), leaf=0).filter(F.col("form") == refine.RECURSIVE).drop("form")


@query("align_validity", f"WITH {PAIRS} SELECT pair_id AS aln_id, CAST(length(first) AS BIGINT) AS target, CAST(length(second) AS BIGINT) AS query, true AS valid FROM p")
def align_validity(spark, sf_dir):
    """Every alignment uses up both sequences, by its own steps, and passes the relational check of letters."""
    pairs = tables.passage_pairs(spark, sf_dir)
    done = align.align(pairs).select(F.col("pair_id").alias("aln_id"), "cigar")
    checked = cigar.check(done.join(pairs.withColumnRenamed("pair_id", "aln_id"), "aln_id"))
    return checked.join(cigar.lengths(cigar.parse(done)), "aln_id").select("aln_id", "target", "query", "valid")


@query("align_gapped")
def align_gapped(spark, sf_dir):
    pairs = tables.related_pairs(spark, sf_dir)
    return cigar.gapped(align.align(pairs).select("pair_id", "cigar").join(pairs, "pair_id").withColumnRenamed("pair_id", "aln_id"))


#: Best scores as in BEST_CHAIN; then all steps that keep to them, and the anchors on best chains.
BEST_GRAPH = f"""
WITH RECURSIVE {of_related(ALL_HITS)}, {COLLAPSED},
ex AS (SELECT pair_id, len, m, n, unnest(first_starts) AS x, second_starts FROM iv), ey AS (SELECT pair_id, len, m, n, x, unnest(second_starts) AS y FROM ex),
a AS MATERIALIZED (SELECT *, CAST(len AS DOUBLE) / (m * n) AS weight, row_number() OVER (PARTITION BY pair_id ORDER BY x, y, len, m, n) AS k FROM ey),
c AS (
  SELECT pair_id, k, x + len AS x_end, y + len AS y_end, weight AS score FROM a
  UNION ALL
  SELECT a.pair_id, a.k, a.x + a.len, a.y + a.len, max(c.score) + a.weight FROM c JOIN a ON c.pair_id = a.pair_id AND c.x_end <= a.x AND c.y_end <= a.y GROUP BY a.pair_id, a.k, a.x, a.y, a.len, a.weight
), s AS MATERIALIZED (SELECT pair_id, k, x_end, y_end, max(score) AS score FROM c GROUP BY pair_id, k, x_end, y_end),
e AS MATERIALIZED (
  SELECT a.pair_id, p.k AS before, a.k FROM a JOIN s q ON q.pair_id = a.pair_id AND q.k = a.k JOIN s p ON p.pair_id = a.pair_id AND p.x_end <= a.x AND p.y_end <= a.y WHERE p.score + a.weight = q.score
), tips AS MATERIALIZED (SELECT pair_id, k FROM s QUALIFY score = max(score) OVER (PARTITION BY pair_id)),
inside AS (
  SELECT pair_id, k FROM tips
  UNION
  SELECT e.pair_id, e.before FROM inside i JOIN e ON e.pair_id = i.pair_id AND e.k = i.k
), f AS MATERIALIZED (SELECT e.* FROM e JOIN inside i ON i.pair_id = e.pair_id AND i.k = e.k)
"""
#: Ways by the number of steps.
PATH_COUNTS = f"""{BEST_GRAPH}, fwd AS (
  SELECT pair_id, k, CAST(1 AS HUGEINT) AS ways FROM inside i WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.pair_id = i.pair_id AND f.k = i.k)
  UNION ALL
  SELECT f.pair_id, f.k, CAST(sum(t.ways) AS HUGEINT) FROM fwd t JOIN f ON f.pair_id = t.pair_id AND f.before = t.k GROUP BY f.pair_id, f.k
), rev AS (
  SELECT pair_id, k, CAST(1 AS HUGEINT) AS ways FROM tips
  UNION ALL
  SELECT f.pair_id, f.before, CAST(sum(t.ways) AS HUGEINT) FROM rev t JOIN f ON f.pair_id = t.pair_id AND f.k = t.k GROUP BY f.pair_id, f.before
), ft AS (SELECT pair_id, k, sum(ways) AS ways FROM fwd GROUP BY pair_id, k), rt AS (SELECT pair_id, k, sum(ways) AS ways FROM rev GROUP BY pair_id, k)
SELECT a.pair_id, CAST(x AS BIGINT) AS start_1, CAST(y AS BIGINT) AS start_2, CAST(len AS BIGINT) AS len, CAST(CAST(coalesce(ft.ways, 0) AS HUGEINT) AS VARCHAR) AS n_opt_paths_fwd,
  CAST(CAST(coalesce(rt.ways, 0) AS HUGEINT) AS VARCHAR) AS n_opt_paths_rev, CAST(m AS BIGINT) AS n_count, CAST(n AS BIGINT) AS m_count
FROM a LEFT JOIN ft ON ft.pair_id = a.pair_id AND ft.k = a.k LEFT JOIN rt ON rt.pair_id = a.pair_id AND rt.k = a.k
"""


@query("optimal_path_counts", PATH_COUNTS)
def optimal_path_counts(spark, sf_dir):
    return ties.path_counts(_related_anchors(spark, sf_dir))


#: Each step of the graph is taken out in turn: a bridge if its right end is no longer reached from the source (0), either way along steps.
BRIDGES = f"""{BEST_GRAPH}, g AS MATERIALIZED (
  SELECT pair_id, before AS u, k AS v FROM f
  UNION ALL
  SELECT pair_id, 0, k FROM inside i WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.pair_id = i.pair_id AND f.k = i.k)
), steps AS MATERIALIZED (
  SELECT pair_id, u, v, u AS here, v AS there FROM g UNION ALL SELECT pair_id, u, v, v, u FROM g
), reached AS (
  SELECT pair_id, u, v, CAST(0 AS BIGINT) AS here FROM g
  UNION
  SELECT r.pair_id, r.u, r.v, s.there FROM reached r JOIN steps s ON s.pair_id = r.pair_id AND s.here = r.here WHERE s.u <> r.u OR s.v <> r.v
)
SELECT g.pair_id, CAST(coalesce(l.x + l.len, 0) AS BIGINT) AS start_1, CAST(coalesce(l.y + l.len, 0) AS BIGINT) AS start_2, CAST(q.x AS BIGINT) AS end_1, CAST(q.y AS BIGINT) AS end_2
FROM g JOIN a q ON q.pair_id = g.pair_id AND q.k = g.v LEFT JOIN a l ON l.pair_id = g.pair_id AND l.k = g.u
WHERE NOT EXISTS (SELECT 1 FROM reached r WHERE r.pair_id = g.pair_id AND r.u = g.u AND r.v = g.v AND r.here = g.v)
"""


@query("chain_bridges", BRIDGES)
def chain_bridges(spark, sf_dir):
    return bridges.bridges(_related_anchors(spark, sf_dir))


@query("rare_prefix_summary", f"""
WITH RECURSIVE {of_related(HITS)}, o AS (
  SELECT pair_id, m, n, min_len, row_number() OVER (PARTITION BY pair_id, m, n ORDER BY side, pos) AS place, count(*) OVER (PARTITION BY pair_id, m, n) AS total FROM hits
)
SELECT pair_id, CAST(m AS BIGINT) AS m, CAST(n AS BIGINT) AS n, CAST(avg(min_len) AS DOUBLE) AS mean, count(*) FILTER (min_len > 10000) AS n_long FROM o WHERE place <= total // 2 GROUP BY pair_id, m, n
""")  # fmt: skip
def rare_prefix_summary(spark, sf_dir):
    ranked, sizes = _ranked(spark, sf_dir, tables.related_pairs)
    return kmers.rare_prefix_summary(suffix.rare_prefixes(suffix.rare_matches(ranked, sizes), sizes), ["pair_id", "m", "n"])


#: Shared words that occur once on either side: the second side's number of each (from 1) in the order of the first, positions of both, and levels
#: from the least ends of increasing runs of each length, as words are added one by one.
ONCE = f"""{RELATED}, f AS ({KMERS.format(id="pair_id", table="(SELECT pair_id, first AS text FROM p)", k=7)}), g AS ({KMERS.format(id="pair_id", table="(SELECT pair_id, second AS text FROM p)", k=7)}),
one AS (SELECT seq_id, kmer, min(pos) AS x FROM f GROUP BY ALL HAVING count(*) = 1), two AS (SELECT seq_id, kmer, min(pos) AS y FROM g GROUP BY ALL HAVING count(*) = 1),
both_sides AS (SELECT seq_id AS pair_id, x, y, row_number() OVER (PARTITION BY seq_id ORDER BY y) AS j FROM one JOIN two USING (seq_id, kmer)),
o AS MATERIALIZED (SELECT pair_id, list(x ORDER BY x) AS xs, list(y ORDER BY y) AS ys, list(j ORDER BY x) AS js FROM both_sides GROUP BY pair_id),
r AS (
  SELECT pair_id, 1 AS k, CAST([] AS BIGINT[]) AS ends, CAST([] AS BIGINT[]) AS lv FROM o
  UNION ALL
  SELECT r.pair_id, k + 1, list_concat(list_filter(ends, lambda e: e < js[k]), [CAST(js[k] AS BIGINT)], list_slice(list_filter(ends, lambda e: e > js[k]), 2, len(ends) + 1)),
    list_append(lv, len(list_filter(ends, lambda e: e < js[k])) + 1)
  FROM r JOIN o ON r.pair_id = o.pair_id WHERE k <= len(js)
), graded AS MATERIALIZED (SELECT o.*, r.lv, len(r.ends) AS top FROM r JOIN o ON r.pair_id = o.pair_id WHERE k = len(js) + 1)"""
#: Back from both ends, a word at a time: a match, else a word of the first list if no level is lost by it, else one of the second.
LCS = f"""{ONCE}, t AS (
  SELECT pair_id, len(js) AS i, len(js) AS j, top AS here, 0 AS step, CAST(NULL AS VARCHAR) AS move FROM graded
  UNION ALL
  SELECT pair_id, i - CAST(move <> 'right' AS BIGINT), j - CAST(move <> 'left' AS BIGINT), here - CAST(move = 'both' AS BIGINT), step + 1, move FROM (
    SELECT t.pair_id, i, j, here, step, CASE WHEN i > 0 AND j > 0 AND js[i] = j THEN 'both'
      WHEN i > 0 AND (j = 0 OR here = 0 OR len(list_filter(range(1, i), lambda q: lv[q] = here AND js[q] <= j)) > 0) THEN 'left' ELSE 'right' END AS move
    FROM t JOIN graded ON t.pair_id = graded.pair_id WHERE i > 0 OR j > 0
  )
), k AS (
  SELECT t.pair_id, max(step) OVER (PARTITION BY t.pair_id) - step AS ord, CASE WHEN move <> 'right' THEN xs[i + 1] END AS left_pos, CASE WHEN move <> 'left' THEN ys[j + 1] END AS right_pos, move
  FROM t JOIN graded ON t.pair_id = graded.pair_id WHERE move IS NOT NULL
), e AS (SELECT *, move = 'both' AS eq, lag(move = 'both') OVER (PARTITION BY pair_id ORDER BY ord) AS was FROM k),
runs AS (SELECT *, 1 + sum(CAST(was IS NOT NULL AND was <> eq AS INT)) OVER (PARTITION BY pair_id ORDER BY ord) AS part FROM e),
parts AS (SELECT pair_id, part, bool_and(eq) AS eq, min(left_pos) AS st1, max(left_pos) AS en1, min(right_pos) AS st2, max(right_pos) AS en2 FROM runs GROUP BY pair_id, part)"""


@query("kmer_lcs", f"WITH RECURSIVE {LCS} SELECT pair_id, CAST(ord AS BIGINT) AS ord, CAST(left_pos AS BIGINT) AS \"left\", CAST(right_pos AS BIGINT) AS \"right\" FROM k")
def kmer_lcs(spark, sf_dir):
    return lcs.align_kmers(tables.related_pairs(spark, sf_dir), k=7)


@query("kmer_lcs_length", f"""
WITH RECURSIVE {RELATED}, f AS ({KMERS.format(id="pair_id", table="(SELECT pair_id, first AS text FROM p)", k=7)}), g AS ({KMERS.format(id="pair_id", table="(SELECT pair_id, second AS text FROM p)", k=7)}),
one AS (SELECT seq_id, kmer, min(pos) AS x FROM f GROUP BY ALL HAVING count(*) = 1), two AS (SELECT seq_id, kmer, min(pos) AS y FROM g GROUP BY ALL HAVING count(*) = 1),
o AS MATERIALIZED (SELECT seq_id AS pair_id, list(y ORDER BY x) AS ys FROM one JOIN two USING (seq_id, kmer) GROUP BY seq_id),
-- The least ends of increasing runs of each length, as words are added one by one.
r AS (
  SELECT pair_id, 1 AS k, CAST([] AS BIGINT[]) AS ends FROM o
  UNION ALL
  SELECT r.pair_id, k + 1, list_concat(list_filter(ends, lambda e: e < ys[k]), [CAST(ys[k] AS BIGINT)], list_slice(list_filter(ends, lambda e: e > ys[k]), 2, len(ends) + 1))
  FROM r JOIN o ON r.pair_id = o.pair_id WHERE k <= len(ys)
)
SELECT r.pair_id, CAST(len(ys) AS BIGINT) AS shared, CAST(len(ends) AS BIGINT) AS matched FROM r JOIN o ON r.pair_id = o.pair_id WHERE k = len(ys) + 1
""")  # fmt: skip
def kmer_lcs_length(spark, sf_dir):
    """Words that occur once on either side, and how many of them align."""
    return lcs.lengths(tables.related_pairs(spark, sf_dir), k=7)


@query("kmer_align_parts", f"WITH RECURSIVE {LCS} SELECT pair_id AS aln_id, CAST(part AS BIGINT) AS part, eq AS is_match, CAST(st1 AS BIGINT) AS st1, CAST(en1 AS BIGINT) AS en1, CAST(st2 AS BIGINT) AS st2, CAST(en2 AS BIGINT) AS en2 FROM parts WHERE eq OR part > 1")
def kmer_align_parts(spark, sf_dir):
    found = lcs.align_kmers(tables.related_pairs(spark, sf_dir), k=7).withColumnRenamed("pair_id", "aln_id")
    return analytics.match_parts(found)


@query("kmer_align_blocks", f"""
WITH RECURSIVE {LCS}, w AS (SELECT *, sum(CAST(NOT eq AND greatest(coalesce(en1 - st1, 0), coalesce(en2 - st2, 0)) > 20 AS INT)) OVER (PARTITION BY pair_id ORDER BY part) AS block FROM parts)
SELECT pair_id AS aln_id, CAST(min(st1) AS BIGINT) AS st1, CAST(max(en1) + 7 AS BIGINT) AS en1, CAST(min(st2) AS BIGINT) AS st2, CAST(max(en2) + 7 AS BIGINT) AS en2 FROM w WHERE eq GROUP BY pair_id, block
""")  # fmt: skip
def kmer_align_blocks(spark, sf_dir):
    found = lcs.align_kmers(tables.related_pairs(spark, sf_dir), k=7).withColumnRenamed("pair_id", "aln_id")
    return analytics.blocks_of_kmers(found, 20, 7)


@query("kmer_path")
def kmer_path(spark, sf_dir):
    return align.kmer_path(tables.related_pairs(spark, sf_dir), k=7)


#: DuckDB's distance is one of bytes: every letter outside ASCII becomes a control character of its own.
ODD = "odd AS (SELECT coalesce(string_agg(c, '' ORDER BY c), '') AS letters, coalesce(string_agg(chr(CAST(k AS INT)), '' ORDER BY c), '') AS stand_ins FROM (SELECT c, row_number() OVER (ORDER BY c) AS k FROM (SELECT DISTINCT unnest(string_split(text, '')) AS c FROM benchmark) WHERE unicode(c) > 127))"


@query("edit_distance", f"WITH {PAIRS}, {ODD} SELECT pair_id, CAST(levenshtein(translate(first, letters, stand_ins), translate(second, letters, stand_ins)) AS BIGINT) AS distance FROM p, odd")
def edit_distance(spark, sf_dir):
    return align.edit_identity(tables.passage_pairs(spark, sf_dir)).select("pair_id", "distance")


@query("edit_identity")
def edit_identity(spark, sf_dir):
    return align.edit_identity(tables.passage_pairs(spark, sf_dir))


@query("simulate_mutations")
def simulate_mutations(spark, sf_dir):
    d = tables.document_dna(spark, sf_dir).filter(F.length("seq") > 0)
    return simulate.mutate(d, seed=3, mismatch=0.01, deletion=0.005, insertion=0.005)


@query("simulate_deletion")
def simulate_deletion(spark, sf_dir):
    return simulate.delete_once(tables.document_dna(spark, sf_dir), seed=3, rate=0.02, length=200)


@query("simulate_copies")
def simulate_copies(spark, sf_dir):
    d = tables.document_dna(spark, sf_dir).withColumn("starts", F.sequence(F.lit(0), F.greatest(F.length("seq") - 1, F.lit(0)), F.lit(40)))
    return simulate.copy_number(d, events=6, seed=3)


# -- alignments as rows -----------------------------------------------------------


@query("cigar_format", f"WITH {STEPS} SELECT aln_id, string_agg(len || op, '' ORDER BY ord) AS cigar FROM s GROUP BY aln_id")
def cigar_format(spark, sf_dir):
    return cigar.render(tables.order_steps(spark, sf_dir))


@query("cigar_parse", f"WITH {STEPS} SELECT aln_id, CAST(ord AS INT) AS ord, len, op FROM s")
def cigar_parse(spark, sf_dir):
    return cigar.parse(cigar.render(tables.order_steps(spark, sf_dir)))


@query("cigar_rle", f"""
WITH {STEPS}, c AS (SELECT *, CASE WHEN op = lag(op) OVER (PARTITION BY aln_id ORDER BY ord) THEN 0 ELSE 1 END AS new FROM s),
g AS (SELECT *, sum(new) OVER (PARTITION BY aln_id ORDER BY ord) AS island FROM c)
SELECT aln_id, CAST(island - 1 AS INT) AS ord, CAST(sum(len) AS BIGINT) AS len, min(op) AS op FROM g GROUP BY aln_id, island
""")  # fmt: skip
def cigar_rle(spark, sf_dir):
    return cigar.merge(tables.order_steps(spark, sf_dir))


@query("cigar_summary", f"WITH {STEPS} SELECT aln_id, op, CAST(sum(len) AS BIGINT) AS bases, count(*) AS configurations FROM s GROUP BY aln_id, op")
def cigar_summary(spark, sf_dir):
    return cigar.summary(tables.order_steps(spark, sf_dir))


@query("cigar_totals", f"WITH {STEPS} SELECT aln_id, " + ", ".join(f"CAST(coalesce(sum(len) FILTER (op = '{op}'), 0) AS BIGINT) AS {n}" for op, n in (("=", "n_eq"), ("M", "n_m"), ("X", "n_x"), ("I", "n_i"), ("D", "n_d"))) + " FROM s GROUP BY aln_id")
def cigar_totals(spark, sf_dir):
    return cigar.totals(tables.order_steps(spark, sf_dir))


@query("cigar_lengths", f"WITH {STEPS} SELECT aln_id, CAST(sum(dx) AS BIGINT) AS target, CAST(sum(dy) AS BIGINT) AS query FROM t GROUP BY aln_id")
def cigar_lengths(spark, sf_dir):
    return cigar.lengths(tables.order_steps(spark, sf_dir))


@query("cigar_mutability", f"WITH {STEPS}, g AS (SELECT aln_id, coalesce(sum(len) FILTER (op = 'M'), 0)::DOUBLE AS m, sum(dx)::DOUBLE AS a, sum(dy)::DOUBLE AS b FROM t GROUP BY aln_id) SELECT aln_id, CASE WHEN a > 0 AND b > 0 THEN round(1 - (m / a + m / b) / 2, 9) END AS mutability FROM g")
def cigar_mutability(spark, sf_dir):
    return cigar.mutability(tables.order_steps(spark, sf_dir)).select("aln_id", F.round("mutability", 9).alias("mutability"))


@query("cigar_trace", f"WITH {STEPS} SELECT aln_id, CAST(ord AS INT) AS ord, len, op, CAST(x0 AS BIGINT) AS x0, CAST(y0 AS BIGINT) AS y0, CAST(x1 AS BIGINT) AS x1, CAST(y1 AS BIGINT) AS y1 FROM t")
def cigar_trace(spark, sf_dir):
    return cigar.trace(tables.order_steps(spark, sf_dir))


#: All order lines as one alignment: orders one after another, 64 places for the lines of each.
LONG_STEPS = STEPS + """, l AS (
  SELECT aln_id * 64 + ord AS ord, len, op, sum(dx) OVER w AS x1, sum(dy) OVER w AS y1, sum(dx) OVER w - dx AS x0, sum(dy) OVER w - dy AS y0
  FROM (SELECT *, x1 - x0 AS dx, y1 - y0 AS dy FROM t) WINDOW w AS (ORDER BY aln_id, ord)
)
"""


@query("cigar_trace_long", f"WITH {LONG_STEPS} SELECT CAST(1 AS BIGINT) AS aln_id, CAST(ord AS BIGINT) AS ord, len, op, CAST(x0 AS BIGINT) AS x0, CAST(y0 AS BIGINT) AS y0, CAST(x1 AS BIGINT) AS x1, CAST(y1 AS BIGINT) AS y1 FROM l")
def cigar_trace_long(spark, sf_dir):
    return cigar.trace(tables.one_long_alignment(spark, sf_dir))


@query("cigar_vertices", f"WITH {STEPS} SELECT aln_id, 0 AS ord, CAST(0 AS BIGINT) AS x, CAST(0 AS BIGINT) AS y FROM s GROUP BY aln_id UNION ALL SELECT aln_id, CAST(ord + 1 AS INT), CAST(x1 AS BIGINT), CAST(y1 AS BIGINT) FROM t")
def cigar_vertices(spark, sf_dir):
    return cigar.vertices(tables.order_steps(spark, sf_dir))


def _indel_sql() -> str:
    parts = ["count(*) FILTER (op = 'X') AS n_mism", "coalesce(sum(len) FILTER (op = 'X'), 0) AS len_mism", "coalesce(sum(len) FILTER (NOT (op IN ('I', 'D') AND len > 20)), 0) AS norm_len"]
    for letter, name in (("I", "insertions"), ("D", "deletions")):
        for kind, test in (("short", "<="), ("long", ">")):
            where = f"FILTER (op = '{letter}' AND len {test} 20)"
            parts += [f"count(*) {where} AS n_{kind}_{name}", f"coalesce(sum(len) {where}, 0) AS len_{kind}_{name}"]
        parts.append(f"coalesce(max(len) FILTER (op = '{letter}' AND len > 20), 0) AS max_{name[:-1]}")
    return f"WITH {STEPS} SELECT aln_id, " + ", ".join("CAST(" + p.replace(" AS ", " AS BIGINT) AS ") for p in parts) + " FROM s GROUP BY aln_id"


@query("cigar_indel_stats", _indel_sql())
def cigar_indel_stats(spark, sf_dir):
    return cigar.indel_statistics(tables.order_steps(spark, sf_dir), 20)


@query("cigar_indel_hist", f"WITH {STEPS} SELECT op, CAST(floor(len / 10.0) * 10 AS BIGINT) AS bin_start, count(*) AS n FROM s WHERE op IN ('I', 'D') GROUP BY ALL")
def cigar_indel_hist(spark, sf_dir):
    return cigar.indel_histogram(tables.order_steps(spark, sf_dir), 10, ())


@query("square_blocks", f"""
WITH {STEPS}, c AS (SELECT *, lead(op) OVER w AS op2, lead(len) OVER w AS len2 FROM s WINDOW w AS (PARTITION BY aln_id ORDER BY ord))
SELECT aln_id, len, count(*) AS n FROM c WHERE op IN ('I', 'D') AND op2 IN ('I', 'D') AND op <> op2 AND len = len2 GROUP BY aln_id, len
""")  # fmt: skip
def square_blocks(spark, sf_dir):
    return cigar.square_blocks(tables.order_steps(spark, sf_dir))


@query("hor_multiplicity", f"""
WITH {STEPS}, f AS (SELECT aln_id, len, x0, round_even(len / 7.0, 0) AS mult FROM t WHERE op IN ('I', 'D')),
g AS (
  SELECT aln_id, CAST(mult AS BIGINT) AS mult, count(*) AS n, array_to_string(list_sort(list(len)), ',') AS lens, array_to_string(list_sort(list(CAST(x0 AS BIGINT))), ',') AS positions
  FROM f WHERE mult <> 0 AND abs(len - mult * 7) / 7 < 0.05 GROUP BY aln_id, mult
)
SELECT aln_id, mult, n, CAST(round_even(n / sum(n) OVER (PARTITION BY aln_id) * 100, 0) AS INT) AS percent,
  round(sum(n * mult) OVER (PARTITION BY aln_id) / sum(n) OVER (PARTITION BY aln_id), 9) AS mean_mult, lens, positions FROM g
""")  # fmt: skip
def hor_multiplicity(spark, sf_dir):
    found = cigar.unit_multiplicity(tables.order_steps(spark, sf_dir), 7)
    return found.select("aln_id", "mult", "n", "percent", F.round("mean_mult", 9).alias("mean_mult"), bases.join_fields(F.col("lens")).alias("lens"), bases.join_fields(F.col("positions")).alias("positions"))


@query("poisson_fit", f"""
WITH {STEPS}, f AS (SELECT round_even(len / 7.0, 0) AS mult, len FROM s WHERE op IN ('I', 'D')), a AS (SELECT avg(mult) AS mean FROM f WHERE mult <> 0 AND abs(len - mult * 7) / 7 < 0.05)
SELECT CAST(k AS INT) AS k, round(exp(1 - mean) * pow(mean - 1, k - 1) / factorial(CAST(k - 1 AS INT)), 9) AS p FROM a, (SELECT unnest(range(1, 7)) AS k)
""")  # fmt: skip
def poisson_fit(spark, sf_dir):
    mean = cigar.unit_multiples(tables.order_steps(spark, sf_dir), 7).agg(F.avg("mult").alias("mean"))
    return mean.select("mean", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("k")).select("k", F.round(bases.shifted_poisson(F.col("k"), F.col("mean")), 9).alias("p"))


# -- analytics --------------------------------------------------------------------


@query("conserved_regions", f"""
WITH {STEPS}, b AS (SELECT *, op IN ('I', 'D') AND len > 30 AS big FROM t),
g AS (SELECT *, sum(big::INT) OVER (PARTITION BY aln_id ORDER BY ord) - big::INT AS island FROM b),
r AS (
  SELECT aln_id, island, min(x0) FILTER (NOT big) AS first_start, min(y0) FILTER (NOT big) AS second_start, max(x1) FILTER (NOT big) AS first_end, max(y1) FILTER (NOT big) AS second_end, bool_or(big) AS closed
  FROM g GROUP BY aln_id, island
)
SELECT aln_id, CAST(first_start AS BIGINT) AS first_start, CAST(second_start AS BIGINT) AS second_start, CAST(first_end AS BIGINT) AS first_end, CAST(second_end AS BIGINT) AS second_end
FROM r WHERE closed AND least(first_end - first_start, second_end - second_start) > 20
""")  # fmt: skip
def conserved_regions(spark, sf_dir):
    return analytics.conserved_regions(tables.order_steps(spark, sf_dir), 30, 20)


@query("cigar_blocks", f"""
WITH {STEPS}, e AS (SELECT aln_id, ord, CASE WHEN op = 'D' THEN 0 ELSE len END AS ex, CASE WHEN op = 'I' THEN 0 ELSE len END AS ey, op = 'M' AS eq FROM s),
c AS (SELECT *, sum(ex) OVER w - ex AS x0, sum(ex) OVER w AS x1, sum(ey) OVER w - ey AS y0, sum(ey) OVER w AS y1, CASE WHEN eq = lag(eq) OVER w THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY aln_id ORDER BY ord)),
d AS (SELECT *, sum(new) OVER (PARTITION BY aln_id ORDER BY ord) AS part FROM c),
p AS (SELECT aln_id, part, bool_and(eq) AS eq, min(x0) AS x0, max(x1) AS x1, min(y0) AS y0, max(y1) AS y1 FROM d GROUP BY aln_id, part),
q AS (SELECT *, NOT eq AND greatest(x1 - x0, y1 - y0) > 25 AS wide FROM p WHERE eq OR part > 1),
k AS (SELECT *, sum(wide::INT) OVER (PARTITION BY aln_id ORDER BY part) - wide::INT AS block FROM q)
SELECT aln_id, CAST(min(x0) AS BIGINT) AS st1, CAST(max(x1) AS BIGINT) AS en1, CAST(min(y0) AS BIGINT) AS st2, CAST(max(y1) AS BIGINT) AS en2 FROM k WHERE NOT wide GROUP BY aln_id, block
""")  # fmt: skip
def cigar_blocks(spark, sf_dir):
    rows = tables.order_steps(spark, sf_dir).withColumn("op", F.when(F.col("op") == "M", "=").otherwise(F.col("op")))
    return analytics.blocks_of_steps(rows, 25)


@query("orthologue_projection", f"""
WITH {STEPS}, g AS (SELECT l_orderkey AS aln_id, l_partkey || '/' || l_linenumber AS name, CAST(p_size * 3 AS BIGINT) AS pos FROM lineitem JOIN part ON l_partkey = p_partkey),
e AS (SELECT aln_id, max(y1) AS last FROM t GROUP BY aln_id),
n AS (SELECT DISTINCT g.aln_id, g.name, g.pos, (SELECT min(x1) FROM t WHERE t.aln_id = g.aln_id AND t.x1 > g.pos AND t.x1 > t.x0) AS x1 FROM g)
SELECT n.aln_id, n.name, n.pos, count(*) AS times, round(max(CASE WHEN n.x1 IS NULL THEN e.last::DOUBLE ELSE t.y0 + (n.pos - t.x0)::DOUBLE * (t.y1 - t.y0)::DOUBLE / (t.x1 - t.x0)::DOUBLE END), 6) AS projected
FROM g JOIN n ON g.aln_id = n.aln_id AND g.name = n.name AND g.pos = n.pos JOIN e ON e.aln_id = n.aln_id LEFT JOIN t ON t.aln_id = n.aln_id AND t.x1 = n.x1 AND t.x1 > t.x0 GROUP BY ALL
""")  # fmt: skip
def orthologue_projection(spark, sf_dir):
    lines, parts = tables.table(spark, sf_dir, "lineitem"), tables.table(spark, sf_dir, "part")
    points = lines.join(parts, lines.l_partkey == parts.p_partkey).select(F.col("l_orderkey").alias("aln_id"), F.concat_ws("/", F.col("l_partkey").cast("string"), F.col("l_linenumber").cast("string")).alias("name"), (F.col("p_size") * 3).alias("pos"))
    put = analytics.orthologues(points, tables.order_steps(spark, sf_dir))
    return put.groupBy("aln_id", "name", "pos").agg(F.count("*").alias("times"), F.round(F.max("projected"), 6).alias("projected"))


@query("cigar_compare", f"""
WITH {STEPS}, m AS (SELECT aln_id, x0 - y0 AS diagonal, x0, x1 FROM t WHERE op = 'M'), z AS (SELECT aln_id, sum(x1 - x0) AS size FROM m GROUP BY aln_id),
o AS (SELECT DISTINCT aln_id AS a_id, aln_id + 1 AS b_id FROM s),
h AS (
  SELECT o.a_id, o.b_id, sum(least(a.x1, b.x1) - greatest(a.x0, b.x0)) AS shared
  FROM o JOIN m a ON a.aln_id = o.a_id JOIN m b ON b.aln_id = o.b_id AND b.diagonal = a.diagonal AND a.x0 < b.x1 AND b.x0 < a.x1 GROUP BY ALL
)
SELECT o.a_id, o.b_id, CAST(coalesce(za.size, 0) AS BIGINT) AS size_a, CAST(coalesce(zb.size, 0) AS BIGINT) AS size_b, CAST(coalesce(h.shared, 0) AS BIGINT) AS shared,
  round(coalesce(h.shared, 0)::DOUBLE / nullif(least(coalesce(za.size, 0), coalesce(zb.size, 0)), 0)::DOUBLE, 9) AS ratio
FROM o LEFT JOIN h ON h.a_id = o.a_id AND h.b_id = o.b_id LEFT JOIN z za ON za.aln_id = o.a_id LEFT JOIN z zb ON zb.aln_id = o.b_id
""")  # fmt: skip
def cigar_compare(spark, sf_dir):
    rows = tables.order_steps(spark, sf_dir)
    pairs = rows.select(F.col("aln_id").alias("a_id"), (F.col("aln_id") + 1).alias("b_id")).distinct()
    return analytics.compare(pairs, rows).withColumn("ratio", F.round("ratio", 9))


SEGMENTS = "SELECT l_suppkey AS id, l_orderkey AS name, l_partkey AS a, l_partkey + CAST(l_quantity AS BIGINT) AS b FROM lineitem WHERE l_returnflag = '{0}'"


@query("segment_overlap", f"""
WITH r AS ({SEGMENTS.format("R")}), o AS ({SEGMENTS.format("A")})
SELECT r.id, r.name AS a_name, count(*) AS n, CAST(sum(least(r.b, o.b) - greatest(r.a, o.a)) AS BIGINT) AS overlap FROM r JOIN o ON r.id = o.id AND r.a < o.b AND o.a < r.b GROUP BY ALL
""")  # fmt: skip
def segment_overlap(spark, sf_dir):
    found = analytics.overlaps(tables.part_segments(spark, sf_dir, "R"), tables.part_segments(spark, sf_dir, "A"), 64)
    return found.groupBy("id", "a_name").agg(F.count("*").alias("n"), F.sum("overlap").alias("overlap"))


@query("segment_relations", f"""
WITH r AS ({SEGMENTS.format("R")}), o AS ({SEGMENTS.format("A")})
SELECT r.id, r.name, r.a AS a_left, o.a AS b_left, r.b AS a_right, o.b AS b_right, greatest(0, o.a - r.b, r.a - o.b) AS gap, 1000000 - r.b AS flipped_left, 1000000 - r.a AS flipped_right FROM r JOIN o USING (id, name)
""")  # fmt: skip
def segment_relations(spark, sf_dir):
    a, b = (tables.part_segments(spark, sf_dir, flag).withColumnsRenamed({"left": f"{p}_left", "right": f"{p}_right"}) for flag, p in (("R", "a"), ("A", "b")))
    both = a.join(b, ["id", "name"]).withColumn("size", F.lit(1_000_000).cast("long"))
    left, right = analytics.flip_segment("a_left", "a_right", "size")
    return both.select("*", analytics.gap_between("a_left", "a_right", "b_left", "b_right").alias("gap"), left.alias("flipped_left"), right.alias("flipped_right")).drop("size")


@query("plot_segments", f"""
WITH RECURSIVE {of_related(INTERVALS)}, ex AS (SELECT pair_id, len, m, n, unnest(first_starts) AS x0, second_starts FROM iv WHERE len >= 1), ey AS (SELECT pair_id, len, m, n, x0, unnest(second_starts) AS y0 FROM ex),
b AS (SELECT *, CASE WHEN len > 80 THEN 80 WHEN len > 50 THEN 50 WHEN len > 20 THEN 20 ELSE 1 END AS bucket FROM ey)
SELECT pair_id, '(' || m || ', ' || n || '), length > ' || bucket AS legend, CAST(m AS BIGINT) AS first_freq, CAST(n AS BIGINT) AS second_freq, CAST(bucket AS INT) AS bucket,
  CAST(x0 AS BIGINT) AS x0, CAST(y0 AS BIGINT) AS y0, CAST(x0 + len AS BIGINT) AS x1, CAST(y0 + len AS BIGINT) AS y1 FROM b
""")  # fmt: skip
def plot_segments(spark, sf_dir):
    return traces.match_segments(suffix.shortest_matches(tables.related_pairs(spark, sf_dir)))


@query("plot_genes")
def plot_genes(spark, sf_dir):
    pairs = tables.related_pairs(spark, sf_dir)
    steps = cigar.parse(align.align(pairs), "pair_id")
    genes = pairs.select(F.col("pair_id").alias("aln_id"), F.explode(F.sequence(F.lit(0), F.length("first"), F.lit(50))).alias("pos")).withColumn("gene", F.concat(F.lit("g"), F.col("pos").cast("string")))
    return traces.gene_marks(genes, steps).unionByName(traces.gene_marks(genes, steps, 2))


@query("coverage_uncovered", f"""
WITH r AS ({SEGMENTS.format("R")}), z AS (SELECT id, max(b) AS size FROM r GROUP BY id), c AS (SELECT DISTINCT id, unnest(range(a, b)) AS cell FROM r)
SELECT z.id, round((z.size + 1 - count(c.cell))::DOUBLE / (z.size + 1)::DOUBLE, 9) AS uncovered FROM z LEFT JOIN c ON c.id = z.id GROUP BY z.id, z.size
""")  # fmt: skip
def coverage_uncovered(spark, sf_dir):
    rows = tables.part_segments(spark, sf_dir, "R")
    sizes = rows.groupBy("id").agg(F.max("right").alias("size"))
    return analytics.uncovered(rows, sizes).withColumn("uncovered", F.round("uncovered", 9))


@query("interval_buckets", """
SELECT CAST(l_linenumber AS INT) AS first_freq, CAST(l_linenumber % 3 + 1 AS INT) AS second_freq, CASE WHEN q > 40 THEN 40 WHEN q > 20 THEN 20 WHEN q > 10 THEN 10 ELSE 5 END AS bucket, count(*) AS n, CAST(sum(q) AS BIGINT) AS total
FROM (SELECT l_linenumber, CAST(l_quantity AS BIGINT) AS q FROM lineitem) WHERE q >= 5 GROUP BY ALL
""")  # fmt: skip
def interval_buckets(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("int").alias("first_freq"), (F.col("l_linenumber") % 3 + 1).cast("int").alias("second_freq"), F.col("l_quantity").cast("long").alias("len"))
    return analytics.interval_buckets(rows, (10, 40, 5, 20)).groupBy("first_freq", "second_freq", "bucket").agg(F.count("*").alias("n"), F.sum("len").alias("total"))
