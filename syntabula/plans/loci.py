"""Locus and identifier queries.

Stand-ins on the driver tables: an order is a gene on chromosome o_custkey, a line
item is a coding segment of transcript l_orderkey.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import ids, values
from ..operators import loci
from .homology import lines, rounded
from .registry import missing_sql, missing_where, query, table


def orders(spark, sf):
    return table(spark, sf, "orders")


@query(
    "gene_order",
    """SELECT o_custkey AS chrom, o_orderkey AS gene_id,
       row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS "order" FROM orders""",
)
def gene_order(spark, sf):
    genes = orders(spark, sf).select(
        F.col("o_custkey").alias("chrom"), F.col("o_orderkey").alias("gene_id"), F.col("o_orderdate").alias("start")
    )
    return loci.gene_order(genes, ["chrom"], ["start", "gene_id"]).drop("start")


@query("genome_sort", "SELECT o_orderkey, o_custkey, o_orderdate FROM orders")
def genome_sort(spark, sf):
    genes = orders(spark, sf).select("o_orderkey", "o_custkey", "o_orderdate")
    return loci.genome_sort(genes, F.col("o_custkey"), ["o_orderdate", "o_orderkey"])


@query(
    "genome_sort_order",
    """SELECT 'genome' AS layout, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_violations FROM orders UNION ALL
      SELECT 'by_key', count(*), count(*) FILTER ((o_custkey, o_orderdate, o_orderkey) < before) FROM (SELECT o_custkey, o_orderdate, o_orderkey,
        lag((o_custkey, o_orderdate, o_orderkey)) OVER (ORDER BY o_orderkey) AS before FROM orders)""",
)
def genome_sort_order(spark, sf):
    """The sorted genes leave no row below the one before; the same rows by key leave many."""
    genes = orders(spark, sf).select("o_orderkey", "o_custkey", "o_orderdate")
    key = [F.col(c) for c in ("o_custkey", "o_orderdate", "o_orderkey")]
    layouts = {"genome": loci.genome_sort(genes, key[0], ["o_orderdate", "o_orderkey"]), "by_key": genes.orderBy("o_orderkey")}
    parts = []
    for name, rows in layouts.items():
        for found, bad in ((genes, 0), (loci.order_violations(rows, key), 1)):
            parts.append(found.select(F.lit(name).alias("layout"), F.lit(bad).alias("bad")))
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy("layout").agg(F.count_if(F.col("bad") == 0).alias("n_rows"), F.count_if(F.col("bad") == 1).alias("n_violations"))


@query(
    "sort_order_issues",
    """SELECT a.o_orderkey, a.o_orderstatus, a.o_orderdate FROM orders a JOIN orders b ON a.o_orderkey = b.o_orderkey + 1
       WHERE a.o_orderstatus < b.o_orderstatus OR (a.o_orderstatus = b.o_orderstatus AND a.o_orderdate < b.o_orderdate)""",
)
def sort_order_issues(spark, sf):
    rows = orders(spark, sf).select("o_orderkey", "o_orderstatus", "o_orderdate")
    return loci.sort_order_issues(rows, [], "o_orderkey", ["o_orderstatus", "o_orderdate"])


@query(
    "contiguous_order_check",
    """SELECT l_orderkey, count(*) AS rows, count(DISTINCT l_linenumber) AS distinct_orders, min(l_linenumber) AS min_order,
      max(l_linenumber) AS max_order, min(l_linenumber) = 1 AND max(l_linenumber) = count(*)
        AND count(*) = count(DISTINCT l_linenumber) AS contiguous FROM lineitem GROUP BY ALL""",
)
def contiguous_order_check(spark, sf):
    return loci.contiguous_order_check(lines(spark, sf), ["l_orderkey"], "l_linenumber")


#: Transcripts of this status get an unknown id: their coding rows have no transcript, and they no coding rows.
PARTIAL = "o_orderstatus <> 'P'"
UNKNOWN_PARTIAL_SQL = missing_sql("orders", "o_orderkey", PARTIAL)


@query(
    "representative_transcript",
    f"""WITH c AS (
      SELECT l_orderkey AS transcript_id, CAST(sum(CAST(l_quantity AS BIGINT) + 1) AS BIGINT) AS cds_length,
        min(l_suppkey) AS gene, min(l_returnflag) AS seqid, min(l_partkey) AS s,
        max(l_partkey + CAST(l_quantity AS BIGINT)) AS e, min(l_linestatus) AS strand,
        min(l_returnflag) = max(l_returnflag) AND min(l_linestatus) = max(l_linestatus) AS single FROM lineitem GROUP BY ALL
    ), t AS (SELECT * FROM {UNKNOWN_PARTIAL_SQL}
    ), m AS (
      SELECT coalesce(t.o_orderkey, c.transcript_id) AS transcript_id,
        CASE WHEN t.o_orderkey IS NOT NULL THEN o_custkey ELSE gene END AS gene_id,
        CASE WHEN t.o_orderkey IS NOT NULL THEN o_orderpriority ELSE seqid END AS seqid,
        CASE WHEN t.o_orderkey IS NOT NULL THEN o_custkey ELSE s END AS start,
        CASE WHEN t.o_orderkey IS NOT NULL THEN o_custkey + CAST(o_totalprice AS BIGINT) ELSE e END AS "end",
        CASE WHEN t.o_orderkey IS NOT NULL THEN o_orderstatus ELSE c.strand END AS strand,
        coalesce(cds_length, 0) AS cds_length FROM t FULL JOIN c ON t.o_orderkey = c.transcript_id
      WHERE t.o_orderkey IS NOT NULL OR single
    ) SELECT transcript_id, CAST(gene_id AS VARCHAR) AS gene_id, seqid, start, "end", strand, cds_length, span FROM (
      SELECT *, "end" - start + 1 AS span, row_number() OVER (PARTITION BY gene_id
        ORDER BY cds_length DESC, "end" - start + 1 DESC, transcript_id) AS k FROM m) WHERE k = 1""".replace(
        "CAST(o_totalprice AS BIGINT)", "CAST(floor(o_totalprice) AS BIGINT)"
    ),
)
def representative_transcript(spark, sf):
    transcripts = missing_where(orders(spark, sf), "o_orderkey", PARTIAL).select(
        F.col("o_orderkey").alias("transcript_id"),
        F.col("o_custkey").cast("string").alias("gene_id"),
        F.col("o_orderpriority").alias("seqid"),
        F.col("o_custkey").alias("start"),
        (F.col("o_custkey") + F.floor("o_totalprice")).alias("end"),
        F.col("o_orderstatus").alias("strand"),
    )
    cds = lines(spark, sf).select(
        F.col("l_orderkey").alias("transcript_id"),
        F.col("l_suppkey").alias("gene_id"),
        F.col("l_returnflag").alias("seqid"),
        F.col("l_partkey").alias("start"),
        (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("end"),
        F.col("l_linestatus").alias("strand"),
    )
    # Gene numbers compare as numbers in the SQL's min(); keep them so until the end.
    typed = transcripts.withColumn("gene_id", F.col("gene_id").cast("long"))
    best = loci.representative_transcript(typed, cds)
    return best.withColumn("gene_id", F.col("gene_id").cast("string"))


URGENT_SQL = missing_sql("orders", "o_custkey", "o_orderpriority = '1-URGENT'")


def _matches(spark, sf):
    transcripts = table(spark, sf, "customer").select(
        F.concat(F.lit("transcript:c"), F.col("c_custkey").cast("string"), F.lit(".t1")).alias("transcript_id")
    )
    proteins = missing_where(orders(spark, sf), "o_custkey", "o_orderpriority = '1-URGENT'").select(
        F.concat(
            F.lit("c"), F.col("o_custkey").cast("string"), F.lit(".p"), F.col("o_orderkey").cast("string")
        ).alias("protein_id"),
        F.col("o_orderkey").alias("ord"),
    )
    return loci.match_by_variants(transcripts, proteins)


@query(
    "match_by_variants",
    f"""SELECT 'transcript:c' || c_custkey || '.t1' AS transcript_id, 'c' || c_custkey || '.p' || min(o_orderkey) AS protein_id,
       'c' || c_custkey AS variant FROM customer JOIN {URGENT_SQL} ON o_custkey = c_custkey GROUP BY c_custkey""",
)
def match_by_variants(spark, sf):
    return _matches(spark, sf)[0]


@query(
    "unmatched_transcripts",
    f"""SELECT 'transcript:c' || c_custkey || '.t1' AS transcript_id FROM customer
       WHERE c_custkey NOT IN (SELECT o_custkey FROM {URGENT_SQL})""",
)
def unmatched_transcripts(spark, sf):
    return _matches(spark, sf)[1]


@query(
    "ambiguous_variants",
    f"""SELECT 'c' || o_custkey AS variant, 'c' || o_custkey || '.p' || min(o_orderkey) AS protein_id
       FROM {URGENT_SQL} GROUP BY o_custkey HAVING count(*) > 1""",
)
def ambiguous_variants(spark, sf):
    return _matches(spark, sf)[2]


RESTRICT_SQL = """
m AS (SELECT l_returnflag, l_suppkey, 'chr' || l_suppkey AS new_id FROM lineitem
      GROUP BY ALL HAVING count(*) FILTER (l_quantity = 50) > 1)"""


def _restricted(spark, sf):
    df = lines(spark, sf)
    id_map = (
        df.groupBy("l_returnflag", "l_suppkey")
        .agg(F.count_if(F.col("l_quantity") == 50).alias("n"))
        .filter("n > 1")
        .select("l_returnflag", "l_suppkey", F.concat(F.lit("chr"), F.col("l_suppkey").cast("string")).alias("new_id"))
    )
    return loci.restrict_to_chromosomes(df, id_map, ["l_returnflag"], "l_suppkey", "new_id")


@query(
    "restrict_to_chromosomes",
    f"WITH {RESTRICT_SQL} SELECT l_returnflag, l_orderkey, l_linenumber, new_id FROM lineitem JOIN m USING (l_returnflag, l_suppkey)",
)
def restrict_to_chromosomes(spark, sf):
    return _restricted(spark, sf)[0].select("l_returnflag", "l_orderkey", "l_linenumber", "new_id")


@query(
    "retention_counts",
    f"""WITH {RESTRICT_SQL} SELECT l_returnflag, count(*) AS total, count(new_id) AS kept,
      round(count(new_id) * 100 / count(*), 8) AS retention_percent
    FROM lineitem LEFT JOIN m USING (l_returnflag, l_suppkey) GROUP BY ALL""",
)
def retention_counts(spark, sf):
    return rounded(_restricted(spark, sf)[1], "retention_percent")


@query(
    "validate_coordinates",
    f"""SELECT l_orderkey, l_linenumber, l_partkey AS chrom, CASE
      WHEN p_partkey IS NULL THEN 'BED_CHROMOSOME_NOT_IN_GENOME' WHEN l_orderkey - 50 < 0 THEN 'NEGATIVE_BED_START'
      WHEN l_quantity - 5 <= 0 THEN 'BED_END_NOT_GREATER_THAN_START'
      WHEN l_orderkey - 55 + CAST(l_quantity AS BIGINT) > p_size * 1000 THEN 'BED_END_EXCEEDS_CHROMOSOME'
      WHEN l_returnflag = 'N' THEN 'INVALID_BED_STRAND' END AS issue
    FROM lineitem LEFT JOIN {missing_sql("part", "p_partkey", "p_size > 2")} ON l_partkey = p_partkey""",
)
def validate_coordinates(spark, sf):
    genes = lines(spark, sf).select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_partkey").alias("chrom"),
        (F.col("l_orderkey") - 50).alias("start"),
        (F.col("l_orderkey") - 55 + F.col("l_quantity").cast("long")).alias("end"),
        F.when(F.col("l_returnflag") == "A", "+").when(F.col("l_returnflag") == "R", "-").otherwise("?").alias("strand"),
    )
    lengths = missing_where(table(spark, sf, "part"), "p_partkey", "p_size > 2").select(
        F.col("p_partkey").alias("chrom"), (F.col("p_size") * 1000).alias("length_bp")
    )
    return loci.validate_coordinates(genes, lengths, by=[]).select("l_orderkey", "l_linenumber", "chrom", "issue")


@query(
    "id_set_diff",
    """WITH a AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'A'),
    b AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag <> 'A')
    SELECT *, 'A_ONLY' AS issue FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
    UNION ALL SELECT *, 'B_ONLY' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
)
def id_set_diff(spark, sf):
    df = lines(spark, sf)
    return loci.id_set_diff(
        df.filter("l_returnflag = 'A'"), df.filter("l_returnflag <> 'A'"), ["l_suppkey", "l_partkey"], "A_ONLY", "B_ONLY"
    )


@query(
    "missing_prefix",
    """SELECT p_partkey, p_name, 'BED_ID_MISSING_SPECIES_PREFIX' AS issue FROM part
       WHERE NOT starts_with(p_brand, substr(p_brand, 1, 6) || '1')""",
)
def missing_prefix(spark, sf):
    part = table(spark, sf, "part")
    renamed = part.withColumn("id", F.regexp_replace("p_brand", r"^(.{6})1", "$1_"))
    wrong = loci.missing_prefix(renamed, F.substring("p_brand", 1, 6), "id", "BED_ID_MISSING_SPECIES_PREFIX")
    return wrong.select("p_partkey", "p_name", "issue")


@query(
    "id_sets",
    """WITH a AS (SELECT l_partkey FROM lineitem WHERE l_quantity <= 3), b AS (SELECT l_partkey FROM lineitem WHERE l_quantity > 3)
    SELECT 'intersect' AS op, l_partkey FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
    UNION ALL SELECT 'difference', l_partkey FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
    UNION ALL SELECT 'union', l_partkey FROM (SELECT * FROM a UNION SELECT * FROM b)""",
)
def id_sets(spark, sf):
    df = lines(spark, sf)
    a, b = df.filter("l_quantity <= 3"), df.filter("l_quantity > 3")
    out = None
    for op in ("intersect", "difference", "union"):
        part = loci.id_sets(a, b, ["l_partkey"], op).withColumn("op", F.lit(op))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "genes_per_chromosome",
    f"""SELECT n_nationkey AS nation, count(s_suppkey) AS genes FROM nation
       LEFT JOIN {missing_sql("supplier", "s_nationkey", "s_acctbal > 5000")} ON s_nationkey = n_nationkey GROUP BY ALL""",
)
def genes_per_chromosome(spark, sf):
    genes = missing_where(table(spark, sf, "supplier"), "s_nationkey", "s_acctbal > 5000").withColumnRenamed("s_nationkey", "nation")
    chroms = table(spark, sf, "nation").withColumnRenamed("n_nationkey", "nation")
    return loci.genes_per_chromosome(genes, chroms, ["nation"])


@query(
    "span_totals",
    """WITH u AS (SELECT l_returnflag, l_partkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS span, count(*) AS n FROM lineitem GROUP BY ALL)
    SELECT l_returnflag, count(*) AS chromosomes_used, CAST(sum(p_size) AS BIGINT) AS genome_bp,
      CAST(sum(span) AS BIGINT) AS gene_span_bp, CAST(sum(n) AS BIGINT) AS genes
    FROM u JOIN part ON l_partkey = p_partkey GROUP BY ALL""",
)
def span_totals(spark, sf):
    genes = lines(spark, sf).select(
        "l_returnflag",
        F.col("l_partkey").alias("chrom"),
        F.col("l_orderkey").alias("start"),
        (F.col("l_orderkey") + F.col("l_quantity").cast("long")).alias("end"),
    )
    flags = genes.select("l_returnflag", "chrom").distinct()
    lengths = flags.join(
        table(spark, sf, "part").select(F.col("p_partkey").alias("chrom"), F.col("p_size").cast("long").alias("length_bp")),
        "chrom",
    )
    return loci.span_totals(genes, lengths, ["l_returnflag"])


@query(
    "md5_match",
    """WITH a AS (SELECT doc_id AS id_a, md5(upper(replace(CASE WHEN lang = 'en' THEN text ELSE text || '*' END, 'ß', 'SS'))) AS md5 FROM documents),
    b AS (SELECT doc_id AS id_b, md5(upper(replace(text, 'ß', 'SS'))) AS md5 FROM documents)
    SELECT id_a, min(id_b) AS id_b, md5, any_value(n_a) AS n_a, count(*) AS n_b
    FROM a JOIN b USING (md5) JOIN (SELECT md5, count(*) AS n_a FROM a GROUP BY ALL) USING (md5) GROUP BY id_a, md5""",
)
def md5_match(spark, sf):
    docs = table(spark, sf, "documents")
    changed = F.when(F.col("lang") == "en", F.col("text")).otherwise(F.concat("text", F.lit("*")))
    a = docs.withColumn("text", changed).withColumnRenamed("doc_id", "id_a")
    return loci.md5_match(a, docs.withColumnRenamed("doc_id", "id_b"), "id_a", "id_b", "text", "text")


@query(
    "id_columns",
    r"""SELECT c_custkey, 'TOM_' || c_name AS prefixed,
      'customer#' || chr(1) || lpad(CAST(length(CAST(c_custkey AS VARCHAR)) AS VARCHAR), 5, '0') || c_custkey AS natural_key,
      CAST(c_custkey AS INTEGER) AS chromosome_number, c_nationkey AS described_number,
      c_custkey - 1 AS start0, c_custkey + 1 AS start1,
      CASE WHEN c_nationkey < 10 THEN c_nationkey ELSE 0 END AS ploidy,
      CASE WHEN c_nationkey = 4 THEN 'TETRAPLOID' WHEN c_acctbal < 0 THEN 'OUTGROUP' ELSE 'DIPLOID' END AS ploidy_group
    FROM customer""",
)
def id_columns(spark, sf):
    name, nation = F.col("c_name"), F.col("c_nationkey").cast("string")
    ploidy = F.when(F.col("c_nationkey") < 10, F.concat(nation, F.lit("x"))).otherwise(nation)
    return table(spark, sf, "customer").select(
        "c_custkey",
        ids.prefix_id(F.lit("TOM"), F.concat(F.lit(" gene:"), name)).alias("prefixed"),
        ids.natural_key(name).alias("natural_key"),
        ids.chromosome_number(name).alias("chromosome_number"),
        ids.chromosome_number(name, F.concat(F.lit("Some plant, Chromosome "), nation, F.lit(" of it"))).alias("described_number"),
        ids.to_half_open(F.col("c_custkey")).alias("start0"),
        ids.to_closed(F.col("c_custkey")).alias("start1"),
        ids.ploidy_number(ploidy).alias("ploidy"),
        ids.ploidy_group(ploidy, F.col("c_acctbal") < 0).alias("ploidy_group"),
    )


@query(
    "feature_ids",
    """SELECT o_orderkey, 'G' || o_custkey AS gene_id, CASE WHEN o_orderstatus = 'F' THEN 'T' || o_orderkey ELSE 'P' || o_custkey END AS transcript_id
       FROM orders""",
)
def feature_ids(spark, sf):
    key, cust = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    gtf = F.concat(F.lit('gene_id "G'), cust, F.lit('"; transcript_id "transcript:T'), key, F.lit('";'))
    gff = F.concat(F.lit("ID=C"), key, F.lit(";Parent=transcript:P"), cust, F.lit(",P0; gene = gene:G"), cust)
    text = F.when(F.col("o_orderstatus") == "F", gtf).otherwise(gff)
    parsed = orders(spark, sf).select("o_orderkey", ids.parse_attributes(text).alias("a"))
    return parsed.select(
        "o_orderkey",
        ids.gene_id(F.col("a")).alias("gene_id"),
        ids.transcript_id(F.col("a"), F.lit("CDS")).alias("transcript_id"),
    )


@query(
    "repeat_categories",
    """SELECT l_returnflag, CASE l_returnflag WHEN 'A' THEN 'gypsy' WHEN 'N' THEN 'dna' END AS category, count(*) AS n
       FROM lineitem GROUP BY ALL""",
)
def repeat_categories(spark, sf):
    flag = F.col("l_returnflag")
    name = F.when(flag == "A", "LTR/Gypsy").when(flag == "N", "DNA/hAT-Ac").otherwise("LINE/L1")
    return lines(spark, sf).groupBy("l_returnflag", ids.classify_repeat(name).alias("category")).agg(F.count("*").alias("n"))


@query(
    "number_class",
    """WITH e AS (SELECT event_id, CASE event_type WHEN 'click' THEN '' WHEN 'view' THEN 'NaN' WHEN 'purchase' THEN '-inf'
        ELSE CASE WHEN value < 50 THEN CAST(-value AS VARCHAR) WHEN value < 100 THEN 'x1' ELSE CAST(value AS VARCHAR) END END AS raw,
        event_type, value FROM events)
    SELECT event_id, CASE WHEN raw = '' THEN 'missing' WHEN raw = 'NaN' THEN 'nan' WHEN raw = '-inf' THEN 'infinite'
      WHEN raw = 'x1' THEN 'nonnumeric' ELSE 'finite' END AS class,
      CASE WHEN raw NOT IN ('', 'NaN', '-inf', 'x1') THEN CASE WHEN value < 50 THEN -value ELSE value END END AS value,
      raw NOT IN ('', 'NaN', '-inf', 'x1') AND value < 50 AND value > 1e-12 AS negative FROM e""",
)
def number_class(spark, sf):
    kind, value = F.col("event_type"), F.col("value")
    text = F.when(value < 50, (-value).cast("string")).when(value < 100, "x1").otherwise(value.cast("string"))
    raw = F.when(kind == "click", "").when(kind == "view", "NaN").when(kind == "purchase", "-inf").otherwise(text)
    return table(spark, sf, "events").select("event_id", values.classify_number(raw).alias("c")).select(
        "event_id", "c.class", "c.value", "c.negative"
    )


@query(
    "list_parse",
    """SELECT l_orderkey, count(*) FILTER (l_linenumber <> 3) AS n_values, CAST(sum(CASE WHEN l_linenumber <> 3 THEN l_quantity ELSE 0 END) AS DOUBLE) AS total,
       count(*) AS n_genes FROM lineitem GROUP BY ALL""",
)
def list_parse(spark, sf):
    quantity = F.when(F.col("l_linenumber") == 3, "inf").otherwise(F.col("l_quantity").cast("string"))
    cells = lines(spark, sf).groupBy("l_orderkey").agg(
        F.concat(F.lit(" _"), F.concat_ws("_", F.collect_list(quantity)), F.lit("__")).alias("ks"),
        F.concat(F.lit("["), F.concat_ws("; ", F.collect_list(F.concat(F.lit("'g_"), F.col("l_partkey").cast("string"), F.lit("'")))), F.lit("]")).alias("genes"),
    )
    parsed = cells.select(
        "l_orderkey",
        values.parse_value_list(F.col("ks")).alias("v"),
        values.parse_gene_list(F.col("genes")).alias("g"),
    )
    return parsed.select(
        "l_orderkey",
        F.size("v").cast("long").alias("n_values"),
        F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("total"),
        F.size("g").cast("long").alias("n_genes"),
    )
