"""Evidence and quality queries.

Stand-ins on the driver tables: label quality and toxicity are two evidence sources
for document ids; nations are comparisons.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence, quality
from . import synteny
from .homology import rounded
from .registry import missing_sql, missing_where, query, table


def _sources(spark, sf):
    labels = table(spark, sf, "labels").withColumnRenamed("doc_id", "protein_id")
    return labels.filter("quality = 1"), labels.filter("toxic = 1")


LABELS_SQL = "l AS (SELECT doc_id, max(quality) = 1 AS a, max(toxic) = 1 AS b FROM labels GROUP BY ALL HAVING max(quality) = 1 OR max(toxic) = 1)"


@query(
    "evidence_overlap",
    f"""WITH {LABELS_SQL}, t AS (SELECT count(*) AS t FROM documents), c AS (
      SELECT count(*) FILTER (a) AS a, count(*) FILTER (b) AS b, count(*) FILTER (a AND b) AS ab, count(*) AS u FROM l),
    r AS (SELECT 'all_proteins' AS category, t AS n FROM t UNION ALL SELECT 'strict', a FROM c UNION ALL SELECT 'domain', b FROM c
      UNION ALL SELECT 'both', ab FROM c UNION ALL SELECT 'strict_only', a - ab FROM c UNION ALL SELECT 'domain_only', b - ab FROM c
      UNION ALL SELECT 'union', u FROM c UNION ALL SELECT 'unsupported', t - u FROM c, t)
    SELECT category, n, round(n * 100 / t, 8) AS pct FROM r, t""",
)
def evidence_overlap(spark, sf):
    total = table(spark, sf, "documents").agg(F.count("*").alias("total"))
    return rounded(evidence.evidence_overlap(*_sources(spark, sf), total), "pct")


@query(
    "evidence_table",
    f"""WITH {LABELS_SQL} SELECT doc_id AS protein_id, CASE WHEN a THEN 'YES' ELSE 'NO' END AS strict,
      CASE WHEN b THEN 'YES' ELSE 'NO' END AS domain, 'YES' AS supported FROM l""",
)
def evidence_table(spark, sf):
    return evidence.evidence_table(*_sources(spark, sf))


def _nation_peaks(spark, sf):
    return table(spark, sf, "supplier").select(
        F.col("s_nationkey").cast("string").alias("Comparison ID"),
        F.round(F.col("s_acctbal") / 5000, 6).alias("Ks Peak (center)"),
        F.col("s_name").alias("Component"),
    )


PEAKS_SQL = "pk AS (SELECT CAST(s_nationkey AS VARCHAR) AS comparison, s_name AS component_id, round(s_acctbal / 5000, 6) AS peak_ks FROM supplier)"


@query(
    "standardise_peaks",
    f"""WITH {PEAKS_SQL} SELECT *, 'VALIDATED' AS validation_class, '' AS ci_lower, '' AS ci_upper,
      'Ks Peak (center)' AS source_peak_column FROM pk""",
)
def standardise_peaks(spark, sf):
    return evidence.standardise_peaks(_nation_peaks(spark, sf))[0]


@query(
    "peak_issues",
    f"""WITH {PEAKS_SQL} SELECT comparison, peak_ks, 'OUTSIDE_RANGE' AS issue FROM pk WHERE peak_ks <= 0 OR peak_ks > 3
    UNION ALL SELECT comparison, peak_ks, 'DUPLICATE_PEAK' FROM pk GROUP BY ALL HAVING count(*) > 1""",
)
def peak_issues(spark, sf):
    return evidence.standardise_peaks(_nation_peaks(spark, sf))[1]


@query(
    "peak_summary",
    """SELECT CAST(s_nationkey AS VARCHAR) AS comparison, CAST(count(*) AS INTEGER) AS validated_peak_count,
      string_agg(CAST(s_suppkey + 0.5 AS VARCHAR), ',' ORDER BY s_suppkey) AS validated_peaks,
      string_agg('VALIDATED', ',') AS validation_classes FROM supplier GROUP BY ALL""",
)
def peak_summary(spark, sf):
    peaks = table(spark, sf, "supplier").select(
        F.col("s_nationkey").cast("string").alias("comparison"), (F.col("s_suppkey") + 0.5).alias("peak_ks")
    )
    return evidence.peak_summary(evidence.standardise_peaks(peaks)[0])


@query(
    "overall_metrics",
    """SELECT 'orders' AS metric, CAST(count(*) AS DOUBLE) AS value FROM orders UNION ALL
      SELECT 'open', CAST(count(*) FILTER (o_orderstatus = 'O') AS DOUBLE) FROM orders UNION ALL
      SELECT 'customers', CAST(count(DISTINCT o_custkey) AS DOUBLE) FROM orders UNION ALL
      SELECT 'largest', max(o_totalprice) FROM orders""",
)
def overall_metrics(spark, sf):
    return quality.overall_metrics(
        table(spark, sf, "orders"),
        {
            "orders": F.count("*"),
            "open": F.count_if(F.col("o_orderstatus") == "O"),
            "customers": F.count_distinct("o_custkey"),
            "largest": F.max("o_totalprice"),
        },
    )


@query(
    "source_dimension_check",
    """SELECT 'line' AS analysis, count(*) AS source_rows, 3 AS expected_comparisons, 3 AS observed_comparisons, 'A,N,R' AS comparison_set,
        'PASS' AS status FROM lineitem
      UNION ALL SELECT 'status', count(*), 3, 0, '', 'FAIL' FROM orders""",
)
def source_dimension_check(spark, sf):
    sources = {
        "line": table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "comparison"),
        "status": table(spark, sf, "orders").withColumnRenamed("o_orderstatus", "comparison"),
    }
    return quality.source_dimension_check(sources, ["A", "N", "R"])


RUNS_SQL = """
c AS (SELECT c_custkey AS comparison, c_mktsegment FROM customer),
d AS (SELECT o_custkey AS comparison, CASE WHEN count(*) FILTER (o_orderstatus = 'F') > 0 THEN 'PASS' ELSE 'OPEN' END AS run,
  count(*) AS anchor_pairs, min(o_totalprice) > 5000 AS present FROM orders GROUP BY ALL),
f AS (SELECT o_custkey AS comparison, CASE WHEN max(o_orderpriority) = '5-LOW' THEN 'low' ELSE '' END AS why
  FROM orders WHERE o_totalprice > 250000 GROUP BY ALL),
r AS (SELECT c.comparison, c_mktsegment, coalesce(anchor_pairs, 0) AS anchor_pairs,
  CASE WHEN run = 'PASS' AND present THEN 'PASS' WHEN run = 'PASS' OR why IS NOT NULL THEN 'FAIL' ELSE 'MISSING' END AS status,
  CASE WHEN run = 'PASS' AND present THEN '' WHEN run = 'PASS' THEN 'RECORDED_ANCHOR_FILE_MISSING'
    WHEN why IS NOT NULL THEN CASE WHEN why = '' THEN 'UNKNOWN_FAILURE' ELSE why END ELSE 'NO_RUN_COMPLETION_RECORD' END AS reason
  FROM c LEFT JOIN d USING (comparison) LEFT JOIN f USING (comparison))"""


def _runs(spark, sf):
    orders = table(spark, sf, "orders").withColumnRenamed("o_custkey", "comparison")
    expected = table(spark, sf, "customer").select(F.col("c_custkey").alias("comparison"), "c_mktsegment")
    complete = orders.groupBy("comparison").agg(
        F.when(F.count_if(F.col("o_orderstatus") == "F") > 0, "PASS").otherwise("OPEN").alias("status"),
        F.count("*").alias("anchor_pairs"),
        (F.min("o_totalprice") > 5000).alias("anchor_present"),
    )
    failed = orders.filter("o_totalprice > 250000").groupBy("comparison").agg(
        F.when(F.max("o_orderpriority") == "5-LOW", "low").otherwise("").alias("reason")
    )
    return quality.run_status(expected, complete, failed)


@query("run_status", f"WITH {RUNS_SQL} SELECT * FROM r")
def run_status(spark, sf):
    return _runs(spark, sf)


@query(
    "run_status_summary",
    f"""WITH {RUNS_SQL} SELECT c_mktsegment, count(*) AS expected, count(*) FILTER (status = 'PASS') AS pass,
      count(*) FILTER (status = 'FAIL') AS fail, count(*) FILTER (status = 'MISSING') AS missing,
      CAST(sum(anchor_pairs) AS BIGINT) AS anchor_pairs FROM r GROUP BY ALL""",
)
def run_status_summary(spark, sf):
    return quality.run_status_summary(_runs(spark, sf), ["c_mktsegment"])


INTEGRATED_SQL = f"""{synteny.RANKED_SQL},
cls AS (SELECT comparison, count(*) FILTER ({synteny.class_sql('balanced')} = 'strong_1to2_candidate') AS strong,
  count(*) FILTER ({synteny.class_sql('balanced')} = 'weak_second_partner') AS weak FROM cl GROUP BY ALL),
mc AS (SELECT comparison, count(*) AS mapped_anchor_pairs, count(DISTINCT (ref_chr, tgt_chr)) AS chromosome_pairs FROM mp GROUP BY ALL),
pk AS (SELECT l_returnflag AS comparison, l_linestatus, round(avg(l_discount), 6) AS peak FROM lineitem GROUP BY ALL),
p2 AS (SELECT comparison, list_sort(list(peak)) AS p FROM pk GROUP BY ALL),
de AS (SELECT comparison, count(DISTINCT ref_gene) AS a, count(DISTINCT tgt_gene) AS b FROM up GROUP BY ALL)"""


@query(
    "integrate_evidence",
    f"""WITH {INTEGRATED_SQL} SELECT comparison, mapped_anchor_pairs, chromosome_pairs, 'genes=' || a || ';partners=' || b AS gene_level_summary,
      strong AS strong_chromosomes, weak AS weak_chromosomes, p[1] AS ks_component_1, p[2] AS ks_component_2, CAST(len(p) AS INTEGER) AS ks_component_count
    FROM mc JOIN p2 USING (comparison) JOIN de USING (comparison) JOIN cls USING (comparison)""",
)
def integrate_evidence(spark, sf):
    mapped = synteny.mapped(spark, sf)
    pairs = synteny.stored_pairs(spark, sf)
    macro = mapped.groupBy("comparison", "ref_chr", "tgt_chr").agg(F.count("*").alias("n")).groupBy("comparison").agg(
        F.sum("n").alias("mapped_anchor_pairs"), F.count("*").alias("chromosome_pairs")
    )
    depth = pairs.groupBy("comparison").agg(
        F.count_distinct("ref_gene").alias("genes"), F.lit("").alias("blank"), F.count_distinct("tgt_gene").alias("partners")
    )
    multi = synteny.ms.multisynteny_summary(synteny._classes(pairs, spark, sf, "balanced"), pairs, rule="balanced")
    peaks = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("comparison"), "l_linestatus").agg(
        F.round(F.avg("l_discount"), 6).alias("peak_ks")
    )
    joined = evidence.integrate_evidence(
        peaks,
        macro,
        depth,
        multi.withColumn("stale", F.lit(0)),
        macro_fields=["mapped_anchor_pairs", "chromosome_pairs"],
        multi_fields={"stale": "strong_chromosomes", "weak_chromosomes": "weak_chromosomes"},
    )
    return evidence.repair_fields(joined, multi, {"strong_chromosomes": "strong_chromosomes"})


@query(
    "final_annotation_table",
    f"""WITH f AS (SELECT n_nationkey AS species, n_name FROM nation),
    p AS (SELECT c_nationkey AS species, avg(c_acctbal) AS c, count(*) AS n FROM {missing_sql("customer", "c_nationkey", "c_acctbal > 9000")} GROUP BY ALL),
    g AS (SELECT s_nationkey AS species, avg(s_acctbal) AS c, count(*) AS n FROM {missing_sql("supplier", "s_nationkey", "s_acctbal > 5000")} GROUP BY ALL)
    SELECT species, n_name, round(p.c, 6) AS protein_complete, p.n AS protein_n, round(g.c, 6) AS genome_complete, g.n AS genome_n,
      CASE WHEN p.c IS NULL AND g.c IS NULL THEN 'FAIL_PARSE_PROTEIN_BUSCO;FAIL_PARSE_GENOME_BUSCO'
        WHEN p.c IS NULL THEN 'FAIL_PARSE_PROTEIN_BUSCO' WHEN g.c IS NULL THEN 'FAIL_PARSE_GENOME_BUSCO' ELSE 'PASS' END AS status
    FROM f LEFT JOIN p USING (species) LEFT JOIN g USING (species)""",
)
def final_annotation_table(spark, sf):
    def completeness(name, key, balance, least):
        scored = missing_where(table(spark, sf, name), key, f"{balance} > {least}").groupBy(F.col(key).alias("species"))
        other = [F.lit(0.0).alias(c) for c in ("single", "duplicated", "fragmented", "missing")]
        return scored.agg(F.avg(balance).alias("complete"), F.count("*").alias("n"), *other)

    features = table(spark, sf, "nation").select(F.col("n_nationkey").alias("species"), "n_name")
    full = evidence.final_annotation_table(
        features,
        completeness("customer", "c_nationkey", "c_acctbal", 9000),
        completeness("supplier", "s_nationkey", "s_acctbal", 5000),
    )
    kept = full.select("species", "n_name", "protein_complete", "protein_n", "genome_complete", "genome_n", "status")
    return rounded(kept, "protein_complete", "genome_complete", digits=6)
