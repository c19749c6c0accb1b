"""Interval, window-track and sequence-statistics queries.

Stand-ins on the driver tables: a line item is an interval on chromosome
l_suppkey, an order is a gene, a document is a sequence.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import assembly, intervals
from .registry import query, table

SIZE = 1000

INTERVALS_SQL = """
iv AS (
  SELECT l_suppkey AS chrom, l_returnflag AS category, l_orderkey AS s,
         l_orderkey + CAST(l_quantity AS BIGINT) AS e FROM lineitem
)"""


def merged_sql(by: str) -> str:
    return f"""
reach AS (
  SELECT {by}, s, e, max(e) OVER (PARTITION BY {by} ORDER BY s, e
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM iv
), island AS (
  SELECT {by}, s, e, sum(CASE WHEN far IS NULL OR s > far THEN 1 ELSE 0 END)
         OVER (PARTITION BY {by} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM reach
), merged AS (
  SELECT {by}, min(s) AS s, max(e) AS e FROM island GROUP BY {by}, k
)"""


def line_intervals(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("chrom"),
        F.col("l_returnflag").alias("category"),
        F.col("l_orderkey").alias("start"),
        (F.col("l_orderkey") + F.col("l_quantity").cast("long")).alias("end"),
    )


@query(
    "merged_intervals",
    f"WITH {INTERVALS_SQL}, {merged_sql('chrom')} SELECT chrom, s AS start, e AS \"end\" FROM merged",
)
def merged_intervals(spark, sf):
    return intervals.merge_intervals(line_intervals(spark, sf), ["chrom"])


OVERLAP_SQL = f"""
cut AS (
  SELECT category, chrom, s, e, unnest(generate_series(s // {SIZE}, (e - 1) // {SIZE})) AS win FROM merged
), covered AS (
  SELECT category, chrom, win,
         CAST(sum(least(e, (win + 1) * {SIZE}) - greatest(s, win * {SIZE})) AS BIGINT) AS bp
  FROM cut GROUP BY ALL
)"""


@query(
    "window_overlap",
    f"""WITH {INTERVALS_SQL}, {merged_sql('category, chrom')}, {OVERLAP_SQL}
    SELECT category, chrom, win AS "window", bp FROM covered""",
)
def window_overlap(spark, sf):
    by = ["category", "chrom"]
    return intervals.interval_overlap(intervals.merge_intervals(line_intervals(spark, sf), by), by, SIZE)


@query(
    "window_tracks",
    f"""WITH {INTERVALS_SQL}, {merged_sql('category, chrom')}, len AS (
      SELECT chrom, max(s) AS n FROM iv GROUP BY chrom
    ), cut AS (
      SELECT category, m.chrom, s, least(e, n) AS e FROM merged m JOIN len USING (chrom)
    ), cut2 AS (
      SELECT *, unnest(generate_series(s // {SIZE}, (e - 1) // {SIZE})) AS win FROM cut WHERE e > s
    ), covered AS (
      SELECT chrom, win, category,
             sum(least(e, (win + 1) * {SIZE}) - greatest(s, win * {SIZE})) AS bp FROM cut2 GROUP BY ALL
    ), wide AS (
      SELECT chrom, win, sum(bp) FILTER (category = 'A') AS a, sum(bp) FILTER (category = 'N') AS n,
             sum(bp) FILTER (category = 'R') AS r FROM covered GROUP BY ALL
    ), gene AS (
      SELECT chrom, (s + e) // 2 // {SIZE} AS win, count(*) AS genes
      FROM iv JOIN len USING (chrom) WHERE (s + e) // 2 < n GROUP BY ALL
    ), base AS (
      SELECT chrom, n, unnest(generate_series(0, (n - 1) // {SIZE})) AS win FROM len WHERE n > 0
    )
    SELECT chrom, win + 1 AS window_index, win * {SIZE} AS window_start,
           least((win + 1) * {SIZE}, base.n) AS window_end,
           least((win + 1) * {SIZE}, base.n) - win * {SIZE} AS window_bp,
           coalesce(genes, 0) AS gene_count,
           CAST(coalesce(a, 0) AS BIGINT) AS gypsy_bp, round(coalesce(a, 0) / window_bp, 9) AS gypsy_fraction,
           CAST(coalesce(wide.n, 0) AS BIGINT) AS copia_bp, round(coalesce(wide.n, 0) / window_bp, 9) AS copia_fraction,
           CAST(coalesce(r, 0) AS BIGINT) AS dna_bp, round(coalesce(r, 0) / window_bp, 9) AS dna_fraction
    FROM base LEFT JOIN gene USING (chrom, win) LEFT JOIN wide USING (chrom, win)""",
)
def window_tracks(spark, sf):
    lines = line_intervals(spark, sf)
    lengths = lines.groupBy("chrom").agg(F.max("start").alias("length_bp"))
    tracks = intervals.window_tracks(
        lengths, lines, lines, ["chrom"], SIZE, {"A": "gypsy", "N": "copia", "R": "dna"}
    )
    fractions = [c for c in tracks.columns if c.endswith("_fraction")]
    return tracks.withColumns({c: F.round(c, 9) for c in fractions})


@query(
    "point_in_window",
    """SELECT o_custkey % 7 AS chrom, o_orderkey // 500 AS "window", count(*) AS n FROM orders GROUP BY ALL""",
)
def point_in_window(spark, sf):
    points = table(spark, sf, "orders").withColumn("chrom", F.col("o_custkey") % 7)
    return intervals.point_in_window(points, ["chrom"], F.col("o_orderkey"), 500)


def documents(spark, sf):
    return table(spark, sf, "documents")


N50_SQL = """
SELECT lang, max(n) AS n50 FROM (
  SELECT lang, n, sum(n) OVER (PARTITION BY lang ORDER BY n DESC RANGE UNBOUNDED PRECEDING) AS upto,
         sum(n) OVER (PARTITION BY lang) AS total
  FROM (SELECT lang, n_chars AS n FROM documents)
) WHERE upto * 2 >= total GROUP BY lang"""


@query("n50_by_lang", N50_SQL)
def n50_by_lang(spark, sf):
    return assembly.n50(documents(spark, sf), ["lang"], "n_chars")


PIECES_SQL = """
seqs AS (SELECT lang, doc_id, text AS seq FROM documents),
pieces AS (
  SELECT * FROM (SELECT lang, unnest(string_split_regex(seq, '[Nn]+')) AS p FROM seqs) WHERE length(p) > 0
), sized AS (
  SELECT lang, 's' AS kind, length(seq) AS n FROM seqs
  UNION ALL SELECT lang, 'c', length(p) FROM pieces
), halves AS (
  SELECT lang, kind, max(n) AS n50 FROM (
    SELECT lang, kind, n, sum(n) OVER (PARTITION BY lang, kind ORDER BY n DESC RANGE UNBOUNDED PRECEDING) AS upto,
           sum(n) OVER (PARTITION BY lang, kind) AS total FROM sized
  ) WHERE upto * 2 >= total GROUP BY lang, kind
), runs AS (
  SELECT lang, count(*) AS seq_n, sum(length(seq)) AS bp, max(length(seq)) AS longest,
         count(*) FILTER (length(seq) >= 2000) AS big,
         sum(length(seq) - length(replace(replace(seq, 'N', ''), 'n', ''))) AS ns,
         sum(length(regexp_extract_all(seq, '[Nn]+'))) AS run_n FROM seqs GROUP BY lang
)"""


@query(
    "assembly_stats",
    f"""WITH {PIECES_SQL}
    SELECT lang, CAST(bp AS BIGINT) AS assembled_genome_size_bp, seq_n AS number_scaffolds,
           longest AS longest_scaffold_bp, big AS number_pseudochromosomes, CAST(ns AS BIGINT) AS total_n_bases,
           round(100.0 * CAST(ns AS DOUBLE) / CAST(bp AS DOUBLE), 9) AS assembly_gap_percent,
           CAST(run_n AS BIGINT) AS number_n_runs,
           (SELECT count(*) FROM pieces p WHERE p.lang = runs.lang) AS inferred_contig_count,
           (SELECT n50 FROM halves h WHERE h.lang = runs.lang AND kind = 's') AS scaffold_n50_bp,
           (SELECT n50 FROM halves h WHERE h.lang = runs.lang AND kind = 'c') AS inferred_contig_n50_bp
    FROM runs""",
)
def assembly_stats(spark, sf):
    stats = assembly.assembly_stats(documents(spark, sf), ["lang"], "text", min_bp=2000)
    return stats.withColumn("assembly_gap_percent", F.round("assembly_gap_percent", 9))


@query(
    "sequence_lengths",
    """SELECT doc_id, length(text) AS length_bp, round(length(text) / 1000000.0, 3) AS length_mb FROM documents""",
)
def sequence_lengths(spark, sf):
    return assembly.sequence_lengths(documents(spark, sf), ["doc_id"], "text")


@query(
    "gap_runs",
    """WITH r AS (SELECT lang, unnest(regexp_extract_all(text, '[Nn]+')) AS run FROM documents)
    SELECT lang, length(run) AS run_bp, count(*) AS n FROM r GROUP BY ALL""",
)
def gap_runs(spark, sf):
    runs = assembly.gap_runs(documents(spark, sf), ["lang"], "text")
    return runs.groupBy("lang", "run_bp").agg(F.count("*").alias("n"))


@query(
    "contigs",
    """WITH p AS (
      SELECT lang, unnest(string_split_regex(text, '[Nn]+')) AS p FROM documents
    ) SELECT lang, length(p) AS contig_bp, count(*) AS n FROM p WHERE length(p) > 0 GROUP BY ALL""",
)
def contigs(spark, sf):
    pieces = assembly.contig_lengths(documents(spark, sf), ["lang"], "text")
    return pieces.groupBy("lang", "contig_bp").agg(F.count("*").alias("n"))


@query(
    "gc_fraction",
    """SELECT doc_id, CASE WHEN a + g > 0 THEN round(g / (a + g), 9) END AS gc_fraction FROM (
      SELECT doc_id, length(regexp_replace(text, '[^GCgc]', '', 'g')) AS g,
             length(regexp_replace(text, '[^ATat]', '', 'g')) AS a FROM documents)""",
)
def gc_fraction(spark, sf):
    return documents(spark, sf).select("doc_id", F.round(S.gc_fraction(F.col("text")), 9).alias("gc_fraction"))


@query(
    "window_gc",
    """WITH ascii AS (
      SELECT doc_id, regexp_replace(text, '[^ -~]', '', 'g') AS t FROM documents
    ), w AS (
      SELECT doc_id, t, unnest(generate_series(0, (length(t) - 1) // 500)) AS win FROM ascii WHERE length(t) > 0
    ), c AS (
      SELECT doc_id, win, length(regexp_replace(substr(t, win * 500 + 1, 500), '[^GCgc]', '', 'g')) AS g,
             length(regexp_replace(substr(t, win * 500 + 1, 500), '[^ATat]', '', 'g')) AS a FROM w
    ) SELECT doc_id, win AS "window", CASE WHEN a + g > 0 THEN round(g / (a + g), 9) END AS gc_fraction FROM c""",
)
def window_gc(spark, sf):
    letters = documents(spark, sf).select("doc_id", F.regexp_replace("text", "[^ -~]", "").alias("sequence"))
    return intervals.window_gc(letters, ["doc_id"], 500).withColumn("gc_fraction", F.round("gc_fraction", 9))


@query(
    "type_sniff",
    """WITH h AS (
      SELECT doc_id, substr(regexp_replace(text, '[^A-Za-z]', '', 'g'), 1, 100000) AS h FROM documents
    ), c AS (
      SELECT doc_id, length(h) AS n, length(regexp_replace(h, '[^ACGTUNRYKMSWBDHVacgtunrykmswbdhv]', '', 'g')) AS u,
             length(regexp_replace(h, '[^EFILPQZefilpqz]', '', 'g')) AS p FROM h
    ) SELECT doc_id, CASE WHEN n = 0 THEN 'EMPTY' WHEN u / n >= 0.95 AND p / n <= 0.01 THEN 'NUCLEOTIDE'
             ELSE 'PROTEIN_OR_NONNUCLEOTIDE' END AS type,
             CASE WHEN n = 0 THEN 0.0 ELSE round(u / n, 9) END AS fraction FROM c""",
)
def type_sniff(spark, sf):
    judged = documents(spark, sf).select("doc_id", S.sequence_type(F.col("text")).alias("s"))
    return judged.select("doc_id", "s.type", F.round("s.fraction", 9).alias("fraction"))


@query(
    "clean_sequence",
    r"""WITH u AS (
      SELECT doc_id, replace(upper(replace(text, 'ß', 'SS')), 'U', 'T') AS c, regexp_replace(upper(replace(text, 'ß', 'SS')), '\*', '', 'g') AS p FROM documents
    ) SELECT doc_id, length(c) AS cds_letters, length(p) AS protein_letters,
      CASE WHEN c = '' THEN 'EMPTY' WHEN NOT regexp_full_match(c, '[ACGTNRYKMSWBDHV]+') THEN 'INVALID_LETTERS' END AS cds_issue,
      CASE WHEN p = '' THEN 'EMPTY' WHEN NOT regexp_full_match(p, '[A-Z*.-]+') THEN 'INVALID_LETTERS' END AS protein_issue
      FROM u""",
)
def clean_sequence(spark, sf):
    text = F.col("text")
    cleaned = documents(spark, sf).select(
        "doc_id",
        S.clean_sequence(text, "cds").alias("c"),
        S.clean_sequence(text, "protein", "all").alias("p"),
    )
    return cleaned.select(
        "doc_id",
        F.length("c.sequence").cast("long").alias("cds_letters"),
        F.length("p.sequence").cast("long").alias("protein_letters"),
        F.col("c.issue").alias("cds_issue"),
        F.col("p.issue").alias("protein_issue"),
    )


@query(
    "rename_sequences",
    """SELECT doc_id, lang, lang || '_seq' || lpad(CAST(row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS VARCHAR), 6, '0')
       AS new_id FROM documents""",
)
def rename_sequences(spark, sf):
    seqs = documents(spark, sf).select("doc_id", "lang")
    return assembly.rename_sequences(seqs, ["lang"], F.col("lang"), [F.col("doc_id")])


@query(
    "sequence_file_stats",
    f"""WITH half AS ({N50_SQL}), firsts AS (
      SELECT lang, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS first_ids FROM (
        SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents
      ) WHERE k <= 10 GROUP BY lang
    ) SELECT lang, count(*) AS sequences, CAST(sum(n_chars) AS BIGINT) AS total_bp, max(n_chars) AS longest_bp,
             any_value(n50) AS n50_bp, any_value(first_ids) AS first_ids
      FROM documents JOIN half USING (lang) JOIN firsts USING (lang) GROUP BY lang""",
)
def sequence_file_stats(spark, sf):
    return assembly.sequence_file_stats(documents(spark, sf), ["lang"], "doc_id", "n_chars", "doc_id")


@query("category_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY ALL")
def category_counts(spark, sf):
    return assembly.category_counts(table(spark, sf, "events"), "event_type")


@query(
    "feature_summary",
    """SELECT *, round(CASE WHEN genes > 0 THEN proteins / genes END, 3) AS transcripts_per_gene,
         CASE WHEN proteins <> cds OR longest > proteins THEN 'CHECK' ELSE 'PASS' END AS status FROM (
      SELECT l_suppkey AS species, count(*) FILTER (l_returnflag = 'A') AS genes,
             count(*) FILTER (l_returnflag IN ('N', 'R')) AS proteins, count(*) FILTER (l_returnflag <> 'A') AS cds,
             count(*) FILTER (l_returnflag = 'R') AS longest FROM lineitem GROUP BY ALL)""",
)
def feature_summary(spark, sf):
    lines = table(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "species")
    counts = {"genes": ["A"], "proteins": ["N", "R"], "cds": ["R", "N"], "longest": ["R"]}
    return assembly.annotation_checks(assembly.feature_summary(lines, ["species"], "l_returnflag", counts))


@query(
    "duplicate_ids",
    "SELECT l_partkey, l_suppkey, count(*) AS occurrences FROM lineitem GROUP BY ALL HAVING count(*) > 1",
)
def duplicate_ids(spark, sf):
    return assembly.duplicate_ids(table(spark, sf, "lineitem"), ["l_partkey", "l_suppkey"])
