"""Synteny and multisynteny queries.

Stand-ins on the driver tables: customers are reference genes and suppliers target
genes, nations are their chromosomes, a line item is an anchor pair and its return
flag the comparison.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals, multisynteny as ms, synteny as sy
from ..operators.scale import dealt, partitions_of
from ..session import cut_lineage
from .homology import lines, rounded
from .registry import missing_sql, missing_where, query, table

MIN_N, REL, GAP = 20, 0.875, 0.01


def mapped_sql(customers: str, suppliers: str) -> str:
    return f"""
cu AS {customers},
su AS {suppliers},
mp AS (
  SELECT l_returnflag AS comparison, c_custkey AS ref_gene, c_nationkey AS ref_chr, c_custkey + CAST(0.5 AS DOUBLE) AS ref_mid,
    s_suppkey AS tgt_gene, s_nationkey AS tgt_chr, s_suppkey + CAST(0.5 AS DOUBLE) AS tgt_mid
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN cu ON o_custkey = c_custkey JOIN su ON l_suppkey = s_suppkey
)"""


MAPPED_SQL = mapped_sql(
    missing_sql("customer", "c_custkey", "c_acctbal > -900"), missing_sql("supplier", "s_suppkey", "s_acctbal > -900")
)

STRONG_SQL = f"""{MAPPED_SQL},
mx AS (SELECT comparison, ref_chr, tgt_chr, count(*) AS n FROM mp GROUP BY ALL),
st AS (
  SELECT *, n >= {MIN_N} AND n >= CAST({REL} AS DOUBLE) * max(n) OVER (PARTITION BY comparison, ref_chr) AS ref_strong,
    n >= {MIN_N} AND n >= CAST({REL} AS DOUBLE) * max(n) OVER (PARTITION BY comparison, tgt_chr) AS tgt_strong FROM mx
)"""


def _loci(spark, sf, whole=False):
    """Genes of both sides; some of them miss from the tables unless whole."""
    customers, suppliers = table(spark, sf, "customer"), table(spark, sf, "supplier")
    if not whole:
        customers = missing_where(customers, "c_custkey", "c_acctbal > -900")
        suppliers = missing_where(suppliers, "s_suppkey", "s_acctbal > -900")
    return (
        customers.select(
            F.col("c_custkey").alias("gene"), F.col("c_nationkey").alias("chrom"), (F.col("c_custkey") + 0.5).alias("midpoint")
        ),
        suppliers.select(
            F.col("s_suppkey").alias("gene"), F.col("s_nationkey").alias("chrom"), (F.col("s_suppkey") + 0.5).alias("midpoint")
        ),
    )


def _partitions(spark, sf):
    """Partitions for the anchor pairs, of which each line item gives one at most."""
    return partitions_of(table(spark, sf, "lineitem"))


def _map(spark, sf, whole=False):
    turned = F.col("l_linestatus") == "O"
    n = _partitions(spark, sf)
    stored = (
        dealt(lines(spark, sf), ["l_orderkey"], n)
        .join(dealt(table(spark, sf, "orders"), ["o_orderkey"], n), F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("l_returnflag").alias("comparison"),
            F.when(turned, F.col("l_suppkey")).otherwise(F.col("o_custkey")).alias("gene1"),
            F.when(turned, F.col("o_custkey")).otherwise(F.col("l_suppkey")).alias("gene2"),
            turned.alias("turned"),
        )
    )
    return sy.map_pairs(stored, *_loci(spark, sf, whole), stored_reversed=F.col("turned"), unplaced=whole)


def mapped(spark, sf, whole=False):
    return _map(spark, sf, whole)[0]


def matrix(spark, sf):
    return sy.anchor_matrix(mapped(spark, sf))


def strong(spark, sf):
    return sy.strong_partners(matrix(spark, sf), min_n=MIN_N, rel=REL)


def axis(spark, sf, side):
    """Every nation as a chromosome of every comparison, ranked by its key."""
    flags = F.explode(F.array(*[F.lit(f) for f in "ANR"]))
    return table(spark, sf, "nation").select(
        flags.alias("comparison"), F.col("n_nationkey").alias(f"{side}_chr"), (F.col("n_nationkey") + 1).alias("rank")
    )


def lengths(spark, sf, side):
    """Chromosome lengths: one past the largest key of the nation."""
    genes = _loci(spark, sf)[0 if side == "ref" else 1]
    flags = F.explode(F.array(*[F.lit(f) for f in "ANR"]))
    spans = genes.groupBy("chrom").agg((F.max("gene") + 1).alias("length_bp"))
    return spans.select(flags.alias("comparison"), F.col("chrom").alias(f"{side}_chr"), "length_bp")


@query("map_pairs", f"WITH {MAPPED_SQL} SELECT * FROM mp")
def map_pairs(spark, sf):
    return mapped(spark, sf)


@query(
    "map_pair_counts",
    f"""WITH {MAPPED_SQL} SELECT l_returnflag AS comparison, count(*) AS raw_anchor_count,
      count(*) FILTER (c_custkey IS NOT NULL AND s_suppkey IS NOT NULL) AS mapped_anchor_count,
      count(*) FILTER (c_custkey IS NULL) AS unmapped_reference, count(*) FILTER (s_suppkey IS NULL) AS unmapped_target,
      round(count(*) FILTER (c_custkey IS NOT NULL AND s_suppkey IS NOT NULL) / count(*), 8) AS mapping_fraction
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN cu ON o_custkey = c_custkey
      LEFT JOIN su ON l_suppkey = s_suppkey GROUP BY ALL""",
)
def map_pair_counts(spark, sf):
    return rounded(_map(spark, sf)[1], "mapping_fraction")


@query("anchor_matrix", f"WITH {STRONG_SQL} SELECT * FROM mx")
def anchor_matrix(spark, sf):
    return matrix(spark, sf)


AXIS_SQL = "ax AS (SELECT comparison, n_nationkey AS chr, n_nationkey + 1 AS rank FROM nation, (SELECT unnest(['A','N','R']) AS comparison))"


@query(
    "dense_matrix",
    f"""WITH {STRONG_SQL}, {AXIS_SQL} SELECT r.comparison, r.chr AS ref_chr, r.rank AS ref_rank, t.chr AS tgt_chr,
      t.rank AS tgt_rank, coalesce(n, 0) AS n FROM ax r JOIN ax t USING (comparison)
      LEFT JOIN mx ON mx.comparison = r.comparison AND mx.ref_chr = r.chr AND mx.tgt_chr = t.chr""",
)
def dense_matrix(spark, sf):
    return sy.dense_matrix(matrix(spark, sf), axis(spark, sf, "ref"), axis(spark, sf, "tgt"), "n")


@query(
    "wide_matrix",
    f"""WITH {STRONG_SQL}, {AXIS_SQL} SELECT comparison, chr AS ref_chr, rank AS ref_rank,
      {", ".join(f'coalesce(max(n) FILTER (tgt_chr = {i}), 0) AS "{i}"' for i in range(25))}
    FROM ax LEFT JOIN (SELECT comparison AS c, ref_chr, tgt_chr, n FROM mx) ON c = comparison AND ref_chr = chr GROUP BY ALL""",
)
def wide_matrix(spark, sf):
    return sy.wide_matrix(dense_matrix(spark, sf), range(25), "n")


@query("strong_partners", f"WITH {STRONG_SQL} SELECT * FROM st")
def strong_partners(spark, sf):
    return strong(spark, sf)


@query(
    "rearrangement_pairs",
    f"""WITH {STRONG_SQL}, k AS (SELECT *, count(*) FILTER (ref_strong) OVER (PARTITION BY comparison, ref_chr) AS kr,
      count(*) FILTER (tgt_strong) OVER (PARTITION BY comparison, tgt_chr) AS kt FROM st)
    SELECT comparison, ref_chr, tgt_chr, n FROM k WHERE (ref_strong AND kr > 1) OR (tgt_strong AND kt > 1)""",
)
def rearrangement_pairs(spark, sf):
    return sy.rearrangement_pairs(strong(spark, sf))


@query(
    "rearrangement_candidates",
    f"""WITH {STRONG_SQL}, c AS (
      SELECT comparison, CAST(ref_chr AS VARCHAR) AS focal_chr, CAST(tgt_chr AS VARCHAR) AS p, 'reference' AS focal_side FROM st WHERE ref_strong
      UNION ALL SELECT comparison, CAST(tgt_chr AS VARCHAR), CAST(ref_chr AS VARCHAR), 'target' FROM st WHERE tgt_strong)
    SELECT comparison, focal_chr, focal_side, count(*) AS strong_partner_count, string_agg(p, ',' ORDER BY p) AS strong_partner_chromosomes,
      'POTENTIAL_SPLIT_FUSION_TRANSLOCATION_OR_DUPLICATION' AS interpretation FROM c GROUP BY ALL HAVING count(*) > 1""",
)
def rearrangement_candidates(spark, sf):
    return sy.rearrangement_candidates(strong(spark, sf))


COMPONENT_SQL = f"""WITH RECURSIVE {STRONG_SQL},
ed AS (
  SELECT comparison, 'R:' || ref_chr AS a, 'T:' || tgt_chr AS b FROM st WHERE ref_strong
  UNION ALL SELECT comparison, 'T:' || tgt_chr, 'R:' || ref_chr FROM st WHERE ref_strong
), reach AS (
  SELECT DISTINCT comparison, a AS node, a AS other FROM ed
  UNION SELECT r.comparison, r.node, e.b FROM reach r JOIN ed e ON e.comparison = r.comparison AND e.a = r.other
), lab AS (SELECT comparison, node, min(other) AS label FROM reach GROUP BY ALL),
sup AS (
  SELECT r.comparison, r.label, CAST(sum(n) AS BIGINT) AS support FROM st
    JOIN lab r ON r.comparison = st.comparison AND r.node = 'R:' || ref_chr
    JOIN lab t ON t.comparison = st.comparison AND t.node = 'T:' || tgt_chr AND t.label = r.label GROUP BY ALL
), comp AS (
  SELECT comparison, label, count(*) FILTER (node[1] = 'R') AS ref_count, count(*) FILTER (node[1] = 'T') AS tgt_count,
    string_agg(node[3:], ',' ORDER BY CAST(node[3:] AS INTEGER)) FILTER (node[1] = 'R') AS ref_chromosomes,
    string_agg(node[3:], ',' ORDER BY CAST(node[3:] AS INTEGER)) FILTER (node[1] = 'T') AS tgt_chromosomes
  FROM lab GROUP BY ALL
), ranked AS (
  SELECT comparison, ref_count, tgt_count, ref_chromosomes, tgt_chromosomes, support, ref_count || ':' || tgt_count AS ratio,
    CAST(row_number() OVER (PARTITION BY comparison ORDER BY support DESC, ref_count DESC, tgt_count DESC) AS INTEGER) AS component_rank
  FROM comp JOIN sup USING (comparison, label)
)"""


@query("component_ratio", f"{COMPONENT_SQL} SELECT * FROM ranked")
def component_ratio(spark, sf):
    return sy.component_ratio(strong(spark, sf))


@query(
    "modal_ratio",
    f"""{COMPONENT_SQL}, s AS (SELECT comparison, ratio, ref_count, tgt_count, CAST(sum(support) AS BIGINT) AS support FROM ranked GROUP BY ALL)
    SELECT comparison, ratio AS modal_ratio, support FROM (SELECT *, row_number() OVER (PARTITION BY comparison
      ORDER BY support DESC, ref_count, tgt_count) AS k FROM s) WHERE k = 1""",
)
def modal_ratio(spark, sf):
    return sy.modal_ratio(sy.component_ratio(strong(spark, sf)))


PLOIDY = {"A": ("2x", "4x"), "N": ("4x", "2x"), "R": ("2x", "2x")}


@query(
    "synteny_ratio",
    f"""WITH {STRONG_SQL}, d AS (
      SELECT comparison, 'r' AS side, ref_chr AS c, count(*) FILTER (ref_strong) AS d FROM st GROUP BY ALL
      UNION ALL SELECT comparison, 't', tgt_chr, count(*) FILTER (tgt_strong) FROM st GROUP BY ALL
    ), m AS (SELECT comparison, side, CAST(median(d) AS DOUBLE) AS med, count(*) % 2 = 1 AS odd FROM d GROUP BY ALL
    ), x AS (SELECT *, CASE WHEN odd THEN CAST(CAST(med AS INTEGER) AS VARCHAR) ELSE CAST(med AS VARCHAR) END AS txt FROM m)
    SELECT r.comparison, r.med AS ref_median_depth, t.med AS tgt_median_depth,
      CASE r.comparison WHEN 'N' THEN '4x' ELSE '2x' END AS ref_ploidy, CASE r.comparison WHEN 'A' THEN '4x' ELSE '2x' END AS tgt_ploidy,
      CASE r.comparison WHEN 'A' THEN r.txt || ':' || t.txt WHEN 'N' THEN t.txt || ':' || r.txt END AS interpreted_ratio
    FROM x r JOIN x t USING (comparison) WHERE r.side = 'r' AND t.side = 't'""",
)
def synteny_ratio(spark, sf):
    flags = lines(spark, sf).select(F.col("l_returnflag").alias("comparison")).distinct()
    ploidy = flags.select(
        "comparison",
        F.when(F.col("comparison") == "N", "4x").otherwise("2x").alias("ref_ploidy"),
        F.when(F.col("comparison") == "A", "4x").otherwise("2x").alias("tgt_ploidy"),
    )
    return sy.synteny_ratio(strong(spark, sf), ploidy)


@query(
    "order_targets",
    f"""WITH {STRONG_SQL}, {AXIS_SQL}, s AS (
      SELECT comparison, tgt_chr, ref_chr, n, ref_chr + 1 AS rank, row_number() OVER (PARTITION BY comparison, tgt_chr ORDER BY n DESC, ref_chr) AS k,
        sum(n) OVER (PARTITION BY comparison, tgt_chr) AS total,
        sum((ref_chr + 1) * n) OVER (PARTITION BY comparison, tgt_chr) AS w FROM mx
    ), r AS (
      SELECT ax.comparison, ax.chr AS tgt_chr, coalesce(ref_chr, 0) AS strongest_ref_chr, coalesce(n, 0) AS strongest_anchors,
        CAST(coalesce(total, 0) AS BIGINT) AS total_anchors, coalesce(CAST(w AS DOUBLE) / CAST(total AS DOUBLE), 25.0 + ax.chr) AS wp,
        coalesce(s.rank, 1) AS strongest_rank
      FROM ax LEFT JOIN s ON s.comparison = ax.comparison AND s.tgt_chr = ax.chr AND k = 1
    ) SELECT comparison, tgt_chr, strongest_ref_chr, strongest_anchors, total_anchors, round(wp, 8) AS weighted_position, strongest_rank,
        CAST(row_number() OVER (PARTITION BY comparison ORDER BY strongest_rank, wp, strongest_anchors DESC, tgt_chr) AS INTEGER) AS plot_rank FROM r""",
)
def order_targets(spark, sf):
    targets = axis(spark, sf, "tgt").select("comparison", "tgt_chr", F.col("tgt_chr").alias("number"))
    return rounded(sy.order_targets(matrix(spark, sf), axis(spark, sf, "ref"), targets), "weighted_position")


LENGTHS_SQL = """
rl AS (SELECT c_nationkey AS chr, max(c_custkey) + 1 AS len FROM cu GROUP BY ALL),
tl AS (SELECT s_nationkey AS chr, max(s_suppkey) + 1 AS len FROM su GROUP BY ALL),
fl AS (SELECT unnest(['A','N','R']) AS comparison)"""

ORIENT_SQL = f"""
ori AS (
  SELECT fl.comparison, tl.chr AS tgt_chr, coalesce(n, 0) AS anchors_used,
    CASE WHEN coalesce(n, 0) < 5 OR isnan(r) THEN 0.0 ELSE coalesce(r, 0.0) END AS correlation FROM fl CROSS JOIN tl
  LEFT JOIN (SELECT comparison, tgt_chr, count(*) AS n, corr(ref_chr + 1 + ref_mid / rl.len, tgt_mid / t2.len) AS r FROM mp
    JOIN rl ON rl.chr = ref_chr JOIN tl t2 ON t2.chr = tgt_chr GROUP BY ALL) c ON c.comparison = fl.comparison AND c.tgt_chr = tl.chr
)"""


def _orientation(spark, sf):
    return sy.orientation(
        mapped(spark, sf), axis(spark, sf, "ref"), lengths(spark, sf, "ref"), lengths(spark, sf, "tgt")
    )


@query(
    "orientation",
    f"""WITH {MAPPED_SQL}, {LENGTHS_SQL}, {ORIENT_SQL} SELECT comparison, tgt_chr, anchors_used, round(correlation, 8) AS correlation,
      CASE WHEN correlation < 0 THEN '-' ELSE '+' END AS orientation FROM ori""",
)
def orientation(spark, sf):
    return rounded(_orientation(spark, sf), "correlation")


def nation_lengths(spark, sf):
    """Nations as chromosomes of their region, as long as they have customers."""
    return (
        table(spark, sf, "customer")
        .groupBy(F.col("c_nationkey").alias("chrom"))
        .agg(F.count("*").alias("length_bp"))
        .join(table(spark, sf, "nation"), F.col("chrom") == F.col("n_nationkey"))
        .select("n_regionkey", "chrom", F.col("n_nationkey").alias("rank"), "length_bp")
    )


def layout_sql(usable: str, gap: str, name: str, middle: str) -> str:
    return f"""
cl AS (SELECT n_regionkey, c_nationkey AS chrom, count(*) AS len FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
cw AS (
  SELECT *, {usable} AS room, row_number() OVER w - 1 AS i, sum(len) OVER (PARTITION BY n_regionkey) AS total,
    coalesce(sum(len) OVER (PARTITION BY n_regionkey ORDER BY chrom ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM cl WINDOW w AS (PARTITION BY n_regionkey ORDER BY chrom)
), {name} AS (
  SELECT n_regionkey, chrom, chrom AS rank, len AS length_bp, room * before / total + {gap} * i AS s, room * len / total AS w FROM cw
)"""


LINEAR_SQL = layout_sql(
    f"CAST(1 AS DOUBLE) - CAST({GAP} AS DOUBLE) * (count(*) OVER (PARTITION BY n_regionkey) - 1)", f"CAST({GAP} AS DOUBLE)", "lay", "midpoint"
)
RADIAL_SQL = layout_sql("2 * pi() - radians(2.0) * count(*) OVER (PARTITION BY n_regionkey)", "radians(2.0)", "lay", "center")


@query(
    "running_layout",
    f"""WITH {LINEAR_SQL} SELECT n_regionkey, chrom, rank, length_bp, round(s, 8) AS start, round(s + w, 8) AS "end",
      round(s + w / 2, 8) AS midpoint, round(w, 8) AS width FROM lay""",
)
def running_layout(spark, sf):
    return rounded(sy.running_layout(nation_lengths(spark, sf), ["n_regionkey"], GAP), "start", "end", "midpoint", "width")


@query(
    "radial_layout",
    f"""WITH {RADIAL_SQL} SELECT n_regionkey, chrom, rank, length_bp, round(s, 8) AS start, round(s + w, 8) AS "end",
      round(s + w / 2, 8) AS center, round(w, 8) AS width FROM lay""",
)
def radial_layout(spark, sf):
    return rounded(sy.radial_layout(nation_lengths(spark, sf), ["n_regionkey"], 2.0), "start", "end", "center", "width")


@query(
    "window_angles",
    f"""WITH {RADIAL_SQL}, win AS (SELECT *, unnest(generate_series(0, (length_bp - 1) // 10)) AS "window" FROM lay)
    SELECT n_regionkey, chrom, "window", "window" * 10 AS window_start, least("window" * 10 + 10, length_bp) AS window_end,
      least("window" * 10 + 10, length_bp) - "window" * 10 AS window_bp,
      round(s + w * ("window" * 10 + least("window" * 10 + 10, length_bp)) / length_bp / 2, 8) AS theta,
      round(w * (least("window" * 10 + 10, length_bp) - "window" * 10) / length_bp, 8) AS theta_width FROM win""",
)
def window_angles(spark, sf):
    chroms = nation_lengths(spark, sf)
    windows = intervals.make_windows(chroms, ["n_regionkey", "chrom"], 10)
    layout = sy.radial_layout(chroms, ["n_regionkey"], 2.0)
    return rounded(sy.window_angles(windows, layout, ["n_regionkey"]), "theta", "theta_width")


@query(
    "adjacent_pairs",
    """SELECT * FROM (SELECT n_regionkey, n_name AS upper, lead(n_name) OVER w AS lower, CAST(row_number() OVER w AS INTEGER) AS edge_rank
      FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey)) WHERE lower IS NOT NULL""",
)
def adjacent_pairs(spark, sf):
    return sy.adjacent_pairs(table(spark, sf, "nation"), ["n_regionkey"], "n_name", "n_nationkey")


@query(
    "every_nth_sample",
    """WITH i AS (SELECT o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS i,
      count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
    SELECT o_orderstatus, o_orderkey FROM i WHERE n <= 500 OR i IN (
      SELECT k * i.n // 500 FROM (SELECT unnest(generate_series(0, 499)) AS k))""",
)
def every_nth_sample(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderstatus", "o_orderkey")
    return sy.every_nth_sample(rows, ["o_orderstatus"], [F.col("o_orderkey")], 500)


TRACKS_SQL = f"""
fx AS (SELECT fl.comparison, 'ref' AS side, chr, len FROM fl CROSS JOIN rl UNION ALL SELECT fl.comparison, 'tgt', chr, len FROM fl CROSS JOIN tl),
tr AS (
  SELECT comparison, side, chr, len, CAST(1 AS DOUBLE) - CAST({GAP} AS DOUBLE) * (count(*) OVER (PARTITION BY comparison, side) - 1) AS room,
    sum(len) OVER (PARTITION BY comparison, side) AS total,
    coalesce(sum(len) OVER (PARTITION BY comparison, side ORDER BY chr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    row_number() OVER (PARTITION BY comparison, side ORDER BY chr) - 1 AS i FROM fx
), tk AS (SELECT comparison, side, chr, len, room * before / total + CAST({GAP} AS DOUBLE) * i AS s, room * len / total AS w FROM tr)"""


@query(
    "link_positions",
    f"""WITH {MAPPED_SQL}, {LENGTHS_SQL}, {ORIENT_SQL}, {TRACKS_SQL}
    SELECT mp.*, round(r.s + least(1, greatest(0, ref_mid / r.len)) * r.w, 7) AS x_ref,
      round(t.s + CASE WHEN correlation < 0 THEN 1 - least(1, greatest(0, tgt_mid / t.len)) ELSE least(1, greatest(0, tgt_mid / t.len)) END * t.w, 7) AS x_tgt
    FROM mp JOIN tk r ON r.comparison = mp.comparison AND r.side = 'ref' AND r.chr = ref_chr
      JOIN tk t ON t.comparison = mp.comparison AND t.side = 'tgt' AND t.chr = tgt_chr
      JOIN ori o ON o.comparison = mp.comparison AND o.tgt_chr = mp.tgt_chr""",
)
def link_positions(spark, sf):
    def track(side):
        chroms = lengths(spark, sf, side).withColumnRenamed(f"{side}_chr", "chrom").withColumn("rank", F.col("chrom"))
        return sy.running_layout(chroms, ["comparison"], GAP)

    links = sy.link_positions(mapped(spark, sf), track("ref"), track("tgt"), _orientation(spark, sf))
    return rounded(links, "x_ref", "x_tgt", digits=7)


# Multisynteny

UNIQUE_SQL = "up AS (SELECT DISTINCT comparison, ref_chr, ref_gene, tgt_chr, tgt_gene FROM mp)"
PAIRS_SQL = f"""{MAPPED_SQL},
{UNIQUE_SQL}"""


def unique_pairs(spark, sf, whole=False):
    """Each pair once; whole: of all genes, those without a chromosome too."""
    columns = ["comparison", "ref_chr", "ref_gene", "tgt_chr", "tgt_gene"]
    return dealt(mapped(spark, sf, whole).select(*columns), columns, _partitions(spark, sf)).distinct()


def stored_pairs(spark, sf):
    """Written once, for queries that read the pairs several times."""
    return cut_lineage(unique_pairs(spark, sf))


DEPTH_SQL = f"""{PAIRS_SQL}, dp AS (
  SELECT comparison, ref_chr, ref_gene, count(DISTINCT tgt_gene) AS genes, count(DISTINCT tgt_chr) AS chroms,
    string_agg(DISTINCT CAST(tgt_chr AS VARCHAR), ',' ORDER BY CAST(tgt_chr AS VARCHAR)) AS target_chromosomes FROM up GROUP BY ALL
)"""


# Every customer, supplier and line item takes part, and the partner genes are listed.
WHOLE_DEPTH_SQL = f"""{mapped_sql("(SELECT * FROM customer)", "(SELECT * FROM supplier)")},
{UNIQUE_SQL}, dp AS (
  SELECT comparison, ref_chr, ref_gene, count(DISTINCT tgt_gene) AS genes, count(DISTINCT tgt_chr) AS chroms,
    string_agg(DISTINCT CAST(tgt_chr AS VARCHAR), ',' ORDER BY CAST(tgt_chr AS VARCHAR)) AS target_chromosomes,
    string_agg(DISTINCT CAST(tgt_gene AS VARCHAR), ',' ORDER BY CAST(tgt_gene AS VARCHAR)) AS target_genes FROM up GROUP BY ALL
)"""


@query(
    "partner_depth",
    f"""WITH {WHOLE_DEPTH_SQL} SELECT comparison, ref_chr, ref_gene, genes AS partner_gene_count, chroms AS partner_chromosome_count,
      target_chromosomes, target_genes,
      CASE WHEN genes > 2 THEN '>2' ELSE CAST(genes AS VARCHAR) END AS partner_depth_class,
      CASE WHEN chroms > 2 THEN '>2_chr' ELSE chroms || '_chr' END AS chromosome_depth_class,
      genes >= 2 AND chroms >= 2 AS two_on_distinct_chr FROM dp""",
)
def partner_depth(spark, sf):
    return ms.partner_depth(unique_pairs(spark, sf, whole=True), gene_list=True, partitions=_partitions(spark, sf))


@query(
    "depth_summary",
    f"""WITH {DEPTH_SQL}, s AS (
      SELECT comparison, count(DISTINCT ref_gene) AS a, count(*) FILTER (genes = 1) AS g1, count(*) FILTER (genes = 2) AS g2,
        count(*) FILTER (genes > 2) AS g3, count(*) FILTER (genes >= 2 AND chroms >= 2) AS gd, count(*) FILTER (chroms = 2) AS c2,
        count(*) FILTER (chroms >= 2) AS c3 FROM dp GROUP BY ALL
    ), o AS (SELECT count(*) AS o FROM customer)
    SELECT comparison, a AS genes_with_any_partner, g1 AS genes_with_1_partner, g2 AS genes_with_2_partners, g3 AS genes_with_gt2_partners,
      gd AS genes_ge2_on_distinct_chr, c2 AS genes_exactly_2_chr, c3 AS genes_ge2_chr, o AS ordered_genes, o - a AS genes_with_0_partners,
      round(a / o, 8) AS fraction_any_partner, round(g1 / a, 8) AS fraction_1_partner, round(g2 / a, 8) AS fraction_2_partners,
      round(g3 / a, 8) AS fraction_gt2_partners, round(gd / a, 8) AS fraction_ge2_distinct_chr FROM s, o""",
)
def depth_summary(spark, sf):
    flags = F.explode(F.array(*[F.lit(f) for f in "ANR"]))
    totals = table(spark, sf, "customer").agg(F.count("*").alias("ordered_genes")).withColumn("comparison", flags)
    # Totals are those of named comparisons.
    pairs = unique_pairs(spark, sf).where(F.col("comparison").isNotNull())
    depth = ms.partner_depth(pairs, chromosome_list=False, partitions=_partitions(spark, sf))
    summary = ms.depth_summary(depth, totals, negative_zero="error")
    return rounded(summary, *[c for c in summary.columns if c.startswith("fraction")])


SUPPORT_SQL = f"""{PAIRS_SQL},
sp AS (SELECT comparison, ref_chr, tgt_chr, count(DISTINCT ref_gene) AS ref_genes, count(DISTINCT tgt_gene) AS tgt_genes, count(*) AS gene_pairs FROM up GROUP BY ALL)"""


@query(
    "chromosome_support",
    f"""WITH {SUPPORT_SQL} SELECT sp.*, ordered_genes, round(ref_genes / ordered_genes, 8) AS ref_fraction
      FROM sp JOIN (SELECT c_nationkey, count(*) AS ordered_genes FROM customer GROUP BY ALL) ON c_nationkey = ref_chr""",
)
def chromosome_support(spark, sf):
    flags = F.explode(F.array(*[F.lit(f) for f in "ANR"]))
    ordered = (
        table(spark, sf, "customer")
        .groupBy(F.col("c_nationkey").alias("ref_chr"))
        .agg(F.count("*").alias("ordered_genes"))
        .withColumn("comparison", flags)
    )
    return rounded(ms.chromosome_support(unique_pairs(spark, sf), ordered=ordered), "ref_fraction")


RANKED_SQL = f"""{SUPPORT_SQL},
rk AS (
  SELECT sp.*, CAST(row_number() OVER (PARTITION BY comparison, ref_chr ORDER BY ref_genes DESC, gene_pairs DESC, tgt_chr) AS INTEGER) AS target_rank,
    total AS ref_chr_genes FROM sp JOIN (SELECT comparison, ref_chr, count(DISTINCT ref_gene) AS total FROM up GROUP BY ALL) USING (comparison, ref_chr)
), t2 AS (
  SELECT comparison, ref_chr, max(ref_chr_genes) AS ref_chr_genes, max(tgt_chr) FILTER (target_rank = 1) AS top1_chr,
    max(ref_genes) FILTER (target_rank = 1) AS top1_genes, max(tgt_chr) FILTER (target_rank = 2) AS top2_chr,
    coalesce(max(ref_genes) FILTER (target_rank = 2), 0) AS top2_genes FROM rk GROUP BY ALL
), gs AS (
  SELECT comparison, ref_chr, ref_gene, count(DISTINCT tgt_chr) AS target_chromosomes, bool_or(tgt_chr = top1_chr) AS on_top1,
    coalesce(bool_or(tgt_chr = top2_chr), false) AS on_top2 FROM up JOIN t2 USING (comparison, ref_chr) GROUP BY ALL
), cl AS (
  SELECT *, top2_genes / top1_genes AS ratio, u / ref_chr_genes AS uf, d / ref_chr_genes AS df FROM t2 JOIN (
    SELECT comparison, ref_chr, count(*) FILTER (on_top1 OR on_top2) AS u, count(*) FILTER (on_top1 AND on_top2) AS d,
      count(*) FILTER (target_chromosomes = 2) AS e2, count(*) FILTER (target_chromosomes >= 2) AS g2 FROM gs GROUP BY ALL
  ) USING (comparison, ref_chr)
)"""


def _ranked(pairs, spark, sf):
    return ms.ranked_partners(ms.chromosome_support(pairs), pairs, axis(spark, sf, "tgt"))


@query("ranked_partners", f"WITH {RANKED_SQL} SELECT *, round(ref_genes / ref_chr_genes, 8) AS support_fraction FROM rk")
def ranked_partners(spark, sf):
    return rounded(_ranked(unique_pairs(spark, sf), spark, sf), "support_fraction")


@query("top2_partners", f"WITH {RANKED_SQL} SELECT * FROM t2")
def top2_partners(spark, sf):
    return ms.top2_partners(_ranked(unique_pairs(spark, sf), spark, sf))


@query(
    "gene_support_class",
    f"""WITH {RANKED_SQL} SELECT *, CASE WHEN on_top1 AND on_top2 THEN 'both_top1_top2' WHEN on_top1 THEN 'top1_only'
      WHEN on_top2 THEN 'top2_only' ELSE 'other_target_chr' END AS support_class FROM gs""",
)
def gene_support_class(spark, sf):
    pairs = unique_pairs(spark, sf)
    return ms.gene_support_class(pairs, ms.top2_partners(_ranked(pairs, spark, sf)))


def _classes(pairs, spark, sf, rule):
    top2 = ms.top2_partners(_ranked(pairs, spark, sf))
    return ms.two_partner_class(top2, ms.gene_support_class(pairs, top2), rule=rule)


def class_sql(rule: str) -> str:
    names = ms.RULES[rule]
    return f"""CASE WHEN top2_chr IS NULL THEN '{names["single"]}' WHEN ratio >= 0.5 AND uf >= 0.7 THEN '{names["strong"]}'
      WHEN ratio >= {names["moderate_at"]} THEN '{names["moderate"]}' ELSE '{names["weak"]}' END"""


def class_columns_sql(rule: str) -> str:
    return f"""SELECT comparison, ref_chr, ref_chr_genes, top1_chr, top1_genes, top2_chr, top2_genes, u AS union_genes, d AS dual_genes,
      e2 AS genes_exactly_2_chr, g2 AS genes_ge2_chr, round(top1_genes / ref_chr_genes, 8) AS top1_fraction,
      round(top2_genes / ref_chr_genes, 8) AS top2_fraction, round(ratio, 8) AS second_to_first_ratio,
      round(uf, 8) AS union_fraction, round(df, 8) AS dual_fraction, {class_sql(rule)} AS pattern_class FROM cl"""


CLASS_FRACTIONS = ("top1_fraction", "top2_fraction", "second_to_first_ratio", "union_fraction", "dual_fraction")


@query("two_partner_class", f"WITH {RANKED_SQL} {class_columns_sql('secondary')}")
def two_partner_class(spark, sf):
    return rounded(_classes(stored_pairs(spark, sf), spark, sf, "secondary"), *CLASS_FRACTIONS)


@query("two_partner_class_balanced", f"WITH {RANKED_SQL} {class_columns_sql('balanced')}")
def two_partner_class_balanced(spark, sf):
    return rounded(_classes(stored_pairs(spark, sf), spark, sf, "balanced"), *CLASS_FRACTIONS)


@query(
    "multisynteny_summary",
    f"""WITH {RANKED_SQL}, pc AS (SELECT *, {class_sql('secondary')} AS pc FROM cl), g AS (
      SELECT comparison, count(*) AS ref_genes, count(*) FILTER (c = 2) AS e2, count(*) FILTER (c >= 2) AS g2 FROM (
        SELECT comparison, ref_gene, count(DISTINCT tgt_chr) AS c FROM up GROUP BY ALL) GROUP BY ALL
    ), s AS (SELECT comparison, count(*) AS ref_chromosomes, count(*) FILTER (pc = 'strong_1to2_candidate') AS strong_chromosomes,
      count(*) FILTER (pc = 'moderate_secondary_partner') AS moderate_chromosomes, count(*) FILTER (pc = 'weak_secondary_partner') AS weak_chromosomes,
      count(*) FILTER (pc = 'single_dominant_partner') AS single_chromosomes,
      round(count(*) FILTER (pc = 'strong_1to2_candidate') / count(*), 8) AS strong_fraction,
      round(median(ratio), 8) AS median_second_to_first_ratio, round(median(uf), 8) AS median_union_fraction,
      round(median(df), 8) AS median_dual_fraction FROM pc GROUP BY ALL)
    SELECT s.*, ref_genes, e2 AS genes_exactly_2_chr, g2 AS genes_ge2_chr, round(g2 / ref_genes, 8) AS fraction_ge2_chr
    FROM s JOIN g USING (comparison)""",
)
def multisynteny_summary(spark, sf):
    pairs = stored_pairs(spark, sf)
    summary = ms.multisynteny_summary(_classes(pairs, spark, sf, "secondary"), pairs)
    return rounded(summary, *[c for c in summary.columns if c.startswith("median") or "fraction" in c])
