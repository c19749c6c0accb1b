"""Hit, pair and block queries.

Stand-ins on the driver tables: a line item is a hit of gene l_partkey on gene
l_suppkey, an order is a collinear block, a return flag is a comparison.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hits, pairs
from .registry import missing_sql, missing_where, query, table


def rounded(df, *names, digits=8):
    return df.withColumns({c: F.round(c, digits) for c in names})


def lines(spark, sf):
    return table(spark, sf, "lineitem")


HIT_NAMES = {
    "l_partkey": "qseqid",
    "l_suppkey": "sseqid",
    "l_quantity": "pident",
    "l_discount": "evalue",
    "l_extendedprice": "bitscore",
}


def line_hits(spark, sf):
    df = lines(spark, sf)
    for old, new in HIT_NAMES.items():
        df = df.withColumnRenamed(old, new)
    return df


@query(
    "best_pair_hit",
    """SELECT l_partkey AS qseqid, l_suppkey AS sseqid, l_discount AS evalue, l_extendedprice AS bitscore,
      l_quantity AS pident, l_orderkey, l_linenumber FROM (
      SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_discount, l_extendedprice DESC,
        l_quantity DESC, l_orderkey, l_linenumber) AS k FROM lineitem) WHERE k = 1""",
)
def best_pair_hit(spark, sf):
    wanted = ["qseqid", "sseqid", "evalue", "bitscore", "pident", "l_orderkey", "l_linenumber"]
    return hits.best_pair_hit(line_hits(spark, sf).select(*wanted), ties=["l_orderkey", "l_linenumber"])


@query(
    "swap_union",
    """SELECT l_partkey AS qseqid, l_suppkey AS sseqid, l_orderkey AS qstart, l_linenumber AS sstart FROM lineitem
       WHERE l_returnflag = 'A'
    UNION ALL SELECT l_suppkey, l_partkey, l_linenumber, l_orderkey FROM lineitem WHERE l_returnflag <> 'A'""",
)
def swap_union(spark, sf):
    found = line_hits(spark, sf)
    forward = found.filter("l_returnflag = 'A'").select(
        "qseqid", "sseqid", F.col("l_orderkey").alias("qstart"), F.col("l_linenumber").alias("sstart")
    )
    reverse = found.filter("l_returnflag <> 'A'").select(
        "qseqid", "sseqid", F.col("l_orderkey").alias("qstart"), F.col("l_linenumber").alias("sstart")
    )
    return hits.swap_union(forward, reverse)


@query("distinct_hits", "SELECT DISTINCT l_partkey, l_returnflag, l_quantity FROM lineitem")
def distinct_hits(spark, sf):
    return hits.distinct_hits(lines(spark, sf).select("l_partkey", "l_returnflag", "l_quantity"))


@query(
    "hit_threshold",
    """SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem
       WHERE l_quantity >= 30 AND l_extendedprice >= 50000""",
)
def hit_threshold(spark, sf):
    kept = hits.hit_threshold(lines(spark, sf), "l_quantity", "l_extendedprice", 30, 50000)
    return kept.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")


@query(
    "validate_hits",
    f"""SELECT l_returnflag,
      p.p_partkey IS NULL OR s.s_suppkey IS NULL AS invalid_id,
      l_quantity > 40 AS malformed, count(*) AS n
    FROM lineitem LEFT JOIN {missing_sql("part", "p_partkey", "p_size > 10")} p ON l_partkey = p_partkey
      LEFT JOIN {missing_sql("supplier", "s_suppkey", "s_acctbal > 0")} s ON l_suppkey = s_suppkey GROUP BY ALL""",
)
def validate_hits(spark, sf):
    found = line_hits(spark, sf).withColumns(
        {
            "pident": F.col("pident") * 2.5,
            "mismatch": F.lit(0),
            "gapopen": F.lit(0),
            "length": F.col("l_linenumber"),
            "qstart": F.col("l_orderkey") + 1,
            "qend": F.col("l_orderkey") + 1,
            "sstart": F.col("l_orderkey") + 1,
            "send": F.col("l_orderkey") + 1,
        }
    )
    ids1 = missing_where(table(spark, sf, "part"), "p_partkey", "p_size > 10").select("p_partkey")
    ids2 = missing_where(table(spark, sf, "supplier"), "s_suppkey", "s_acctbal > 0").select("s_suppkey")
    checked = hits.validate_hits(found, ids1, ids2)
    return checked.groupBy("l_returnflag", "invalid_id", "malformed").agg(F.count("*").alias("n"))


@query(
    "homology_qc",
    """SELECT l_returnflag, count(*) AS homology_rows, count(DISTINCT (l_partkey, l_suppkey)) AS unique_gene_pairs,
      count(DISTINCT l_partkey) AS unique_queries, count(DISTINCT l_suppkey) AS unique_subjects,
      round(avg(l_quantity), 8) AS mean_percent_identity, round(avg(l_extendedprice), 4) AS mean_bitscore,
      count(*) FILTER (l_discount = 0) AS zero_evalue_rows, count(*) FILTER (l_partkey = l_suppkey) AS self_identity_rows,
      count(*) - count(DISTINCT (l_partkey, l_suppkey)) AS duplicate_gene_pairs,
      max(l_partkey) AS n1, max(l_suppkey) AS n2,
      round(count(DISTINCT l_partkey) / max(l_partkey), 8) AS query_gene_coverage,
      round(count(DISTINCT l_suppkey) / max(l_suppkey), 8) AS subject_gene_coverage
    FROM lineitem GROUP BY ALL""",
)
def homology_qc(spark, sf):
    found = line_hits(spark, sf)
    totals = found.groupBy("l_returnflag").agg(F.max("qseqid").alias("n1"), F.max("sseqid").alias("n2"))
    qc = hits.homology_qc(found, ["l_returnflag"], totals)
    qc = rounded(qc, "mean_bitscore", digits=4)
    return rounded(qc, "mean_percent_identity", "query_gene_coverage", "subject_gene_coverage")


CANDIDATES_SQL = f"""
w AS (SELECT c_mktsegment AS species, c_custkey AS seq_id FROM {missing_sql("customer", "c_custkey", "c_acctbal > 0")}),
f AS (SELECT DISTINCT c_mktsegment AS species, o_orderpriority AS path, o_custkey AS seq_id
      FROM orders JOIN customer ON o_custkey = c_custkey),
t AS (SELECT species, count(*) AS protein_ids FROM w GROUP BY ALL),
c AS (SELECT f.species, path, count(*) AS cds_ids, count(w.seq_id) AS intersection
      FROM f LEFT JOIN w USING (species, seq_id) GROUP BY ALL),
scored AS (SELECT species, path, cds_ids, intersection, protein_ids,
       protein_ids - intersection AS protein_missing_from_cds, cds_ids - intersection AS extra_cds_ids,
       intersection / protein_ids AS recall FROM c JOIN t USING (species))"""


def candidate_ids(spark, sf):
    customers = table(spark, sf, "customer")
    wanted = missing_where(customers, "c_custkey", "c_acctbal > 0").select(
        F.col("c_mktsegment").alias("species"), F.col("c_custkey").alias("seq_id")
    )
    found = (
        table(spark, sf, "orders")
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("c_mktsegment").alias("species"),
            F.col("o_orderpriority").alias("path"),
            F.col("o_custkey").alias("seq_id"),
        )
    )
    return wanted, found


@query(
    "score_id_overlap",
    f"""WITH {CANDIDATES_SQL}
    SELECT species, path, cds_ids, intersection, protein_ids, protein_missing_from_cds, extra_cds_ids,
      round(recall, 8) AS protein_recall,
      protein_missing_from_cds = 0 AND extra_cds_ids = 0 AS exact,
      CAST(row_number() OVER (PARTITION BY species ORDER BY protein_missing_from_cds + extra_cds_ids > 0,
        recall DESC, intersection DESC, extra_cds_ids, path) AS INTEGER) AS rank,
      CAST(sum(CASE WHEN protein_missing_from_cds + extra_cds_ids = 0 THEN 1 ELSE 0 END)
        OVER (PARTITION BY species) AS BIGINT) AS exact_candidates FROM scored""",
)
def score_id_overlap(spark, sf):
    return rounded(hits.score_id_overlap(*candidate_ids(spark, sf)), "protein_recall")


@query(
    "best_candidate_file",
    f"""WITH {CANDIDATES_SQL}
    SELECT species, path, intersection, cds_ids FROM (SELECT *, row_number() OVER (PARTITION BY species
      ORDER BY intersection DESC, cds_ids DESC, path) AS k FROM scored) WHERE k = 1""",
)
def best_candidate_file(spark, sf):
    scored = hits.score_id_overlap(*candidate_ids(spark, sf)).select("species", "path", "intersection", "cds_ids")
    return hits.best_candidate_file(scored, "species", "intersection", "cds_ids", "path")


NATIONS_SQL = """
np AS (
  SELECT o_orderpriority AS comparison, c_nationkey AS a, s_nationkey AS b,
         o_orderpriority IN ('1-URGENT', '2-HIGH') AS self
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN supplier ON l_suppkey = s_suppkey
)"""


def nation_pairs(spark, sf):
    orders, customers = table(spark, sf, "orders"), table(spark, sf, "customer")
    suppliers = table(spark, sf, "supplier")
    return (
        lines(spark, sf)
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            F.col("o_orderpriority").alias("comparison"),
            F.col("c_nationkey").alias("a"),
            F.col("s_nationkey").alias("b"),
        )
    )


def _unordered(spark, sf):
    is_self = F.col("comparison").isin("1-URGENT", "2-HIGH")
    return pairs.unordered_pairs(nation_pairs(spark, sf), ["comparison"], "a", "b", is_self)


@query(
    "unordered_pairs",
    f"""WITH {NATIONS_SQL} SELECT DISTINCT comparison, CASE WHEN self THEN least(a, b) ELSE a END AS a,
      CASE WHEN self THEN greatest(a, b) ELSE b END AS b FROM np WHERE a <> b""",
)
def unordered_pairs(spark, sf):
    return _unordered(spark, sf)[0]


@query(
    "unordered_pair_counts",
    f"""WITH {NATIONS_SQL}, c AS (
      SELECT comparison, any_value(self) AS self, count(*) AS raw, count(*) FILTER (a = b) AS same,
        count(DISTINCT CASE WHEN a <> b THEN (CASE WHEN self THEN least(a, b) ELSE a END) * 1000
          + (CASE WHEN self THEN greatest(a, b) ELSE b END) END) AS kept FROM np GROUP BY comparison)
    SELECT comparison, raw AS raw_assignments, same AS self_pairs_removed,
      CASE WHEN self THEN 0 ELSE raw - same - kept END AS repeated_assignments_removed,
      CASE WHEN self THEN raw - same - kept ELSE 0 END AS reverse_duplicates_removed,
      kept AS retained_pairs FROM c""",
)
def unordered_pair_counts(spark, sf):
    return _unordered(spark, sf)[1]


@query(
    "unique_pairs",
    """SELECT l_returnflag AS comparison, l_partkey AS reference_gene, l_suppkey AS target_gene,
       l_linenumber AS reference_chr, l_linestatus AS target_chr, l_orderkey AS block_row FROM (
       SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_partkey, l_suppkey
         ORDER BY l_linenumber, l_linestatus, l_orderkey) AS k FROM lineitem) WHERE k = 1""",
)
def unique_pairs(spark, sf):
    return pairs.unique_pairs(line_pairs(spark, sf))


def line_pairs(spark, sf):
    return lines(spark, sf).select(
        F.col("l_returnflag").alias("comparison"),
        F.col("l_partkey").alias("reference_gene"),
        F.col("l_suppkey").alias("target_gene"),
        F.col("l_linenumber").alias("reference_chr"),
        F.col("l_linestatus").alias("target_chr"),
        F.col("l_orderkey").alias("block_row"),
    )


@query(
    "unique_pairs4",
    """SELECT DISTINCT l_returnflag AS comparison, l_partkey AS reference_gene, l_linenumber AS reference_chr,
       l_suppkey AS target_gene, l_linestatus AS target_chr FROM lineitem""",
)
def unique_pairs4(spark, sf):
    return pairs.unique_pairs4(line_pairs(spark, sf))[0]


@query(
    "pair_conflicts",
    """SELECT l_returnflag AS comparison, l_partkey AS gene, CAST(min(l_linenumber) AS VARCHAR) AS first_chr,
         CAST(max(l_linenumber) AS VARCHAR) AS last_chr, 'reference' AS side
       FROM lineitem GROUP BY ALL HAVING min(l_linenumber) <> max(l_linenumber)
    UNION ALL SELECT l_returnflag, l_suppkey, min(l_linestatus), max(l_linestatus), 'target'
       FROM lineitem GROUP BY ALL HAVING min(l_linestatus) <> max(l_linestatus)""",
)
def pair_conflicts(spark, sf):
    typed = line_pairs(spark, sf).withColumn("reference_chr", F.col("reference_chr").cast("string"))
    return pairs.unique_pairs4(typed)[1]


@query(
    "block_pairs",
    """SELECT l_orderkey AS block_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INTEGER) AS pair_index,
       CAST(l_partkey AS VARCHAR) AS reference_gene, 'S_' || l_suppkey AS target_gene FROM lineitem""",
)
def block_pairs(spark, sf):
    cells = lines(spark, sf).groupBy(F.col("l_orderkey").alias("block_id")).agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("g")
    )
    blocks = cells.select(
        "block_id",
        F.concat(
            F.lit("['"), F.concat_ws("', '", F.transform("g", lambda e: e["l_partkey"].cast("string"))), F.lit("']")
        ).alias("block1"),
        F.concat_ws(" ", F.transform("g", lambda e: F.concat(F.lit("S_"), e["l_suppkey"].cast("string")))).alias("block2"),
    )
    return pairs.block_pairs(blocks, ["block_id"])[0]


@query(
    "chunk_assign",
    """SELECT *, (position - 1) // 100 + 1 AS chunk, (position - 1) // 100 * 100 + 1 AS chunk_start,
        least(((position - 1) // 100 + 1) * 100, total) AS chunk_end FROM (
      SELECT o_orderstatus, o_orderkey,
        row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) AS position,
        count(*) OVER (PARTITION BY o_orderstatus) AS total FROM orders)""".replace("SELECT *,", "SELECT o_orderstatus, o_orderkey, position,", 1),
)
def chunk_assign(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderstatus", "o_orderkey", "o_orderdate")
    order = [F.col("o_orderdate"), F.col("o_orderkey")]
    return pairs.chunk_assign(orders, ["o_orderstatus"], order, 100).drop("o_orderdate")


@query(
    "presence_check",
    f"""SELECT comparison, gene, 'protein' AS missing_from FROM (
      SELECT DISTINCT l_returnflag AS comparison, unnest([l_partkey, l_suppkey]) AS gene FROM lineitem)
    WHERE gene NOT IN (SELECT p_partkey FROM {missing_sql("part", "p_partkey", "p_size > 5")})""",
)
def presence_check(spark, sf):
    ids = missing_where(table(spark, sf, "part"), "p_partkey", "p_size > 5").select(F.col("p_partkey").alias("gene"))
    return pairs.presence_check(line_pairs(spark, sf), ["comparison"], ["reference_gene", "target_gene"], ids, "protein")


COMPLETE_SQL = f"""
want AS (SELECT DISTINCT l_linestatus, l_partkey, l_suppkey FROM {missing_sql("lineitem", "l_partkey", "l_tax <= 0.04")}),
have AS (SELECT l_linestatus, l_partkey, l_suppkey, count(*) AS n FROM {missing_sql("lineitem", "l_partkey", "l_discount >= 0.05")} GROUP BY ALL),
both_sides AS (SELECT coalesce(w.l_linestatus, h.l_linestatus) AS l_linestatus,
  coalesce(w.l_partkey, h.l_partkey) AS l_partkey, coalesce(w.l_suppkey, h.l_suppkey) AS l_suppkey,
  w.l_partkey IS NOT NULL AS wanted, h.n AS n
  FROM want w FULL JOIN have h ON w.l_linestatus = h.l_linestatus AND w.l_partkey = h.l_partkey AND w.l_suppkey = h.l_suppkey)"""


def _completeness(spark, sf):
    df = lines(spark, sf)
    return pairs.completeness_check(
        missing_where(df, "l_partkey", "l_tax <= 0.04"),
        missing_where(df, "l_partkey", "l_discount >= 0.05"),
        ["l_linestatus"],
        ["l_partkey", "l_suppkey"],
    )


@query(
    "completeness",
    f"""WITH {COMPLETE_SQL} SELECT l_linestatus, count(*) FILTER (wanted) AS expected,
      CAST(sum(n) AS BIGINT) AS observed_rows, CAST(sum(n - 1) AS BIGINT) AS duplicates,
      count(*) FILTER (NOT wanted) AS unexpected, count(*) FILTER (n IS NULL) AS missing,
      round(count(*) FILTER (wanted AND n IS NOT NULL) / count(*) FILTER (wanted), 8) AS completion_fraction
    FROM both_sides GROUP BY ALL""",
)
def completeness(spark, sf):
    return rounded(_completeness(spark, sf)[0], "completion_fraction")


@query(
    "completeness_issues",
    f"""WITH {COMPLETE_SQL} SELECT l_linestatus, l_partkey, l_suppkey,
      CASE WHEN n IS NULL THEN 'missing' ELSE 'unexpected' END AS issue FROM both_sides WHERE n IS NULL OR NOT wanted""",
)
def completeness_issues(spark, sf):
    return _completeness(spark, sf)[1]


@query(
    "order_check",
    f"""WITH g1 AS (SELECT l_partkey AS gene, min(l_linenumber) AS o FROM {missing_sql("lineitem", "l_partkey", "l_quantity > 10")} GROUP BY ALL),
    g2 AS (SELECT s_suppkey AS gene, s_nationkey AS o FROM {missing_sql("supplier", "s_suppkey", "s_acctbal > 0")})
    SELECT l_returnflag, count(*) AS pairs, count(*) FILTER (g1.o IS NULL OR g2.o IS NULL) AS unknown_gene_pairs,
      count(*) FILTER (g1.o IS NOT NULL AND g2.o IS NOT NULL AND (l_linenumber <> g1.o OR l_linenumber <> g2.o)) AS order_mismatches
    FROM lineitem LEFT JOIN g1 ON l_partkey = g1.gene LEFT JOIN g2 ON l_suppkey = g2.gene GROUP BY ALL""",
)
def order_check(spark, sf):
    df = lines(spark, sf)
    genes1 = missing_where(df, "l_partkey", "l_quantity > 10").groupBy(F.col("l_partkey").alias("gene")).agg(F.min("l_linenumber").alias("order"))
    genes2 = missing_where(table(spark, sf, "supplier"), "s_suppkey", "s_acctbal > 0").select(
        F.col("s_suppkey").alias("gene"), F.col("s_nationkey").alias("order")
    )
    stated = df.select(
        "l_returnflag",
        F.col("l_partkey").alias("gene1"),
        F.col("l_linenumber").alias("order1"),
        F.col("l_suppkey").alias("gene2"),
        F.col("l_linenumber").alias("order2"),
    )
    return pairs.order_check(stated, ["l_returnflag"], genes1, genes2)


def line_blocks(spark, sf):
    """(blocks, pairs) with the order as block and the return flag as comparison."""
    df = lines(spark, sf)
    status = F.when(F.max("l_linestatus") == "F", "plus").when(F.min("l_linestatus") == "O", "minus").otherwise("mixed")
    blocks = df.groupBy("l_returnflag", F.col("l_orderkey").alias("block_id")).agg(
        F.max("l_extendedprice").alias("score"),
        F.min("l_tax").alias("pvalue"),
        F.max("l_linenumber").alias("n"),
        status.alias("orientation"),
    )
    members = df.select(
        "l_returnflag",
        F.col("l_orderkey").alias("block_id"),
        F.col("l_partkey").alias("gene1"),
        F.col("l_suppkey").alias("gene2"),
    )
    return blocks, members


@query(
    "collinearity_qc",
    """WITH b AS (
      SELECT l_returnflag, l_orderkey, count(*) AS size, max(l_extendedprice) AS score, min(l_tax) AS p,
        max(l_linenumber) AS n, CASE WHEN max(l_linestatus) = 'F' THEN 'plus' WHEN min(l_linestatus) = 'O' THEN 'minus'
        ELSE 'mixed' END AS o FROM lineitem GROUP BY ALL
    ), bq AS (
      SELECT l_returnflag, count(*) AS block_count, min(size) AS minimum_block_size, max(size) AS maximum_block_size,
        round(avg(size), 8) AS mean_block_size, round(avg(score), 4) AS mean_block_score, round(avg(p), 8) AS mean_block_pvalue,
        count(*) FILTER (o = 'plus') AS plus_blocks, count(*) FILTER (o = 'minus') AS minus_blocks,
        count(*) FILTER (o = 'mixed') AS other_orientation_blocks, count(*) FILTER (size <> n) AS block_size_mismatches,
        CAST(list_sort(list(size))[count(*) // 2 + 1] AS DOUBLE) AS median_block_size FROM b GROUP BY ALL
    ), pq AS (
      SELECT l_returnflag, count(*) AS collinear_gene_pairs, count(DISTINCT (l_partkey, l_suppkey)) AS unique_collinear_gene_pairs,
        count(*) - count(DISTINCT (l_partkey, l_suppkey)) AS duplicate_gene_pairs,
        count(*) FILTER (l_partkey = l_suppkey) AS same_gene_pairs, count(DISTINCT l_partkey) AS species1_genes_in_blocks,
        count(DISTINCT l_suppkey) AS species2_genes_in_blocks, max(l_partkey) AS n1, max(l_suppkey) AS n2,
        round(count(DISTINCT l_partkey) / max(l_partkey), 8) AS species1_block_gene_coverage,
        round(count(DISTINCT l_suppkey) / max(l_suppkey), 8) AS species2_block_gene_coverage FROM lineitem GROUP BY ALL
    ) SELECT * FROM bq JOIN pq USING (l_returnflag)""",
)
def collinearity_qc(spark, sf):
    blocks, members = line_blocks(spark, sf)
    totals = members.groupBy("l_returnflag").agg(F.max("gene1").alias("n1"), F.max("gene2").alias("n2"))
    qc = pairs.collinearity_qc(blocks, members, ["l_returnflag"], totals)
    qc = rounded(qc, "mean_block_score", digits=4)
    return rounded(
        qc, "mean_block_size", "mean_block_pvalue", "species1_block_gene_coverage", "species2_block_gene_coverage"
    )


@query(
    "repeated_pairs",
    """SELECT l_returnflag, count(*) AS total_pairs, count(DISTINCT (l_partkey, l_suppkey)) AS unique_pairs,
      count(*) - count(DISTINCT (l_partkey, l_suppkey)) AS repeated_pairs,
      round((count(*) - count(DISTINCT (l_partkey, l_suppkey))) / count(*), 8) AS repeated_fraction
    FROM lineitem GROUP BY ALL""",
)
def repeated_pairs(spark, sf):
    counted = pairs.repeated_pairs(lines(spark, sf), ["l_returnflag"], "l_partkey", "l_suppkey")
    return rounded(counted, "repeated_fraction")


@query(
    "parameter_sensitivity",
    """WITH s AS (
      SELECT l_suppkey, l_returnflag, count(DISTINCT l_orderkey) AS blocks, count(*) AS pairs FROM lineitem GROUP BY ALL
    ), w AS (
      SELECT l_suppkey, max(blocks) FILTER (l_returnflag = 'A') AS strict_blocks, max(blocks) FILTER (l_returnflag = 'R') AS sensitive_blocks,
        max(pairs) FILTER (l_returnflag = 'A') AS strict_pairs, max(pairs) FILTER (l_returnflag = 'R') AS sensitive_pairs FROM s GROUP BY ALL
    ), c AS (
      SELECT *, sensitive_blocks / strict_blocks AS br, (sensitive_blocks - strict_blocks) / strict_blocks * 100 AS bc,
        sensitive_pairs / strict_pairs AS pr, (sensitive_pairs - strict_pairs) / strict_pairs * 100 AS pc FROM w
    ) SELECT l_suppkey, strict_blocks, sensitive_blocks, strict_pairs, sensitive_pairs, round(br, 8) AS blocks_ratio,
      round(bc, 8) AS blocks_percent_change, round(pr, 8) AS pairs_ratio, round(pc, 8) AS pairs_percent_change,
      CASE WHEN greatest(abs(bc), abs(pc)) >= 50 THEN 'HIGH_SENSITIVITY' WHEN greatest(abs(bc), abs(pc)) >= 20
        THEN 'MODERATE_SENSITIVITY' WHEN bc IS NOT NULL THEN 'STABLE' END AS review_flag FROM c""",
)
def parameter_sensitivity(spark, sf):
    summary = lines(spark, sf).groupBy("l_suppkey", "l_returnflag").agg(
        F.count_distinct("l_orderkey").alias("blocks"), F.count("*").alias("pairs")
    )
    wide = pairs.parameter_sensitivity(summary, ["l_suppkey"], "l_returnflag", ["blocks", "pairs"], "A", "R")
    return rounded(wide, *[c for c in wide.columns if c.endswith(("ratio", "change"))])


@query(
    "merge_summary",
    """SELECT l_returnflag, count(*) AS rows, count(DISTINCT (l_partkey, l_suppkey)) AS unique_pairs,
      count(*) AS finite_l_tax, count(*) FILTER (l_discount > 0) AS finite_ks FROM lineitem GROUP BY ALL""",
)
def merge_summary(spark, sf):
    df = lines(spark, sf).withColumn("ks", F.when(F.col("l_discount") > 0, F.ln("l_discount")).otherwise(F.lit(float("nan"))))
    return pairs.merge_summary(df, ["l_returnflag"], ["l_partkey", "l_suppkey"], ["l_tax", "ks"])


@query(
    "block_summary",
    """SELECT l_partkey AS block_id, count(*) AS length, round(avg(l_discount * 30), 8) AS ks_average,
      round(median(l_discount * 30), 8) AS ks_median, min(l_suppkey) AS chr1, min(l_linenumber) AS chr2,
      min(l_orderkey) AS start1, max(l_orderkey) AS end1, min(l_linenumber) AS start2, max(l_linenumber) AS end2
    FROM lineitem GROUP BY ALL""",
)
def block_summary(spark, sf):
    members = lines(spark, sf).select(
        F.col("l_partkey").alias("block_id"),
        (F.col("l_discount") * 30).alias("ks"),
        F.col("l_suppkey").alias("chr1"),
        F.col("l_linenumber").alias("chr2"),
        F.col("l_orderkey").alias("start1"),
        F.col("l_linenumber").alias("start2"),
    )
    return rounded(pairs.block_summary(members, None, ["block_id"]), "ks_average", "ks_median")


@query(
    "latest_runs",
    """WITH r AS (
      SELECT CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS step, o_custkey % 25 AS a, o_custkey % 23 AS b,
        o_orderkey AS run_order, o_totalprice FROM orders
    ) SELECT step, a, b, run_order, o_totalprice FROM (
      SELECT *, row_number() OVER (PARTITION BY least(a, b), greatest(a, b) ORDER BY step DESC, run_order DESC) AS k FROM r
    ) WHERE k = 1""",
)
def latest_runs(spark, sf):
    runs = table(spark, sf, "orders").select(
        (F.col("o_custkey") % 25).alias("a"),
        (F.col("o_custkey") % 23).alias("b"),
        F.col("o_orderkey").alias("run_order"),
        "o_totalprice",
        "o_orderstatus",
    )
    first = runs.filter("o_orderstatus = 'F'").drop("o_orderstatus")
    second = runs.filter("o_orderstatus <> 'F'").drop("o_orderstatus")
    return pairs.latest_runs([first, second], "a", "b")


@query(
    "undirected_lookup",
    """WITH runs AS (
      SELECT c_nationkey + CASE WHEN o_orderpriority = '1-URGENT' AND c_nationkey < s_nationkey THEN 0 ELSE 1000 END AS q,
        s_nationkey AS s, min(l_orderkey) AS run FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL
    ), want AS (SELECT CAST(c_nationkey AS BIGINT) AS a, c_custkey % 25 AS b FROM customer GROUP BY ALL)
    SELECT a, b, coalesce(f.q, r.q, a) AS stored_query, coalesce(f.s, r.s, b) AS stored_subject, coalesce(f.run, r.run) AS run,
      CASE WHEN f.q IS NOT NULL THEN 'FORWARD' WHEN r.q IS NOT NULL THEN 'REVERSE_AVAILABLE' ELSE 'NONE' END AS orientation,
      CASE WHEN f.q IS NULL AND r.q IS NULL THEN 'MISSING' ELSE 'AVAILABLE' END AS status
    FROM want LEFT JOIN runs f ON a = f.q AND b = f.s LEFT JOIN runs r ON a = r.s AND b = r.q""",
)
def undirected_lookup(spark, sf):
    df = lines(spark, sf)
    # All other runs belong to nations that no one asks for.
    shifted = F.when((F.col("o_orderpriority") == "1-URGENT") & (F.col("c_nationkey") < F.col("s_nationkey")), 0).otherwise(1000)
    runs = (
        df.join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy((F.col("c_nationkey") + shifted).cast("long").alias("q"), F.col("s_nationkey").cast("long").alias("s"))
        .agg(F.min("l_orderkey").alias("run"))
    )
    wanted = (
        table(spark, sf, "customer")
        .select(F.col("c_nationkey").cast("long").alias("a"), (F.col("c_custkey") % 25).alias("b"))
        .distinct()
    )
    return pairs.undirected_lookup(wanted, runs, "a", "b", "q", "s")


BUYERS_SQL = missing_sql("customer", "c_nationkey", "c_acctbal > 9000")
SELLERS_SQL = missing_sql("supplier", "s_nationkey", "s_acctbal > 5000")


def _manifests(spark, sf):
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("nation"), "n_name")
    buyers = missing_where(table(spark, sf, "customer"), "c_nationkey", "c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("nation")).agg(
        F.count("*").alias("customers")
    )
    sellers = missing_where(table(spark, sf, "supplier"), "s_nationkey", "s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("nation")).agg(
        F.count("*").alias("suppliers")
    )
    return nations, buyers, sellers


@query(
    "join_manifests",
    f"""SELECT n_nationkey AS nation, n_name, customers, suppliers FROM nation
      JOIN (SELECT c_nationkey, count(*) AS customers FROM {BUYERS_SQL} GROUP BY ALL) ON n_nationkey = c_nationkey
      JOIN (SELECT s_nationkey, count(*) AS suppliers FROM {SELLERS_SQL} GROUP BY ALL) ON n_nationkey = s_nationkey""",
)
def join_manifests(spark, sf):
    nations, buyers, sellers = _manifests(spark, sf)
    return pairs.join_manifests(nations, [buyers, sellers], ["nation"])[0]


@query(
    "manifest_gaps",
    f"""SELECT n_nationkey AS nation, 0 AS manifest FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM {BUYERS_SQL})
    UNION ALL SELECT n_nationkey, 1 FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM {SELLERS_SQL})""",
)
def manifest_gaps(spark, sf):
    nations, buyers, sellers = _manifests(spark, sf)
    return pairs.join_manifests(nations, [buyers, sellers], ["nation"])[1]


@query(
    "concat_sequences",
    """SELECT seq_id, count(*) AS occurrences FROM (SELECT text AS seq_id FROM documents UNION ALL
      SELECT text FROM benchmark UNION ALL SELECT text FROM conversations) GROUP BY ALL HAVING count(*) > 1""",
)
def concat_sequences(spark, sf):
    parts = [table(spark, sf, t).select(F.col("text").alias("seq_id")) for t in ("documents", "benchmark", "conversations")]
    return pairs.concat_sequences(parts)[1]
