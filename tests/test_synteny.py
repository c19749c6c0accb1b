import math

import pytest
from pyspark.sql import functions as F

from syntabula.operators import multisynteny as ms, synteny as sy


def matrix(spark, cells):
    return spark.createDataFrame([("c", r, t, n) for (r, t), n in cells.items()], "comparison string, ref_chr string, tgt_chr string, n long")


def test_strong_partner_limits(spark):
    cells = {("a", str(n)): n for n in (100, 30, 24, 19)} | {("b", f"x{n}"): n for n in (60, 20, 15)}
    strong = sy.strong_partners(matrix(spark, cells)).filter("ref_strong").collect()
    assert sorted((r["ref_chr"], r["n"]) for r in strong) == [("a", 30), ("a", 100), ("b", 20), ("b", 60)]


def test_rearrangements(spark, rows):
    strong = sy.strong_partners(matrix(spark, {("a", "x"): 50, ("a", "y"): 40, ("b", "y"): 100, ("b", "z"): 3}))
    assert rows(sy.rearrangement_pairs(strong), "ref_chr", "tgt_chr") == [("a", "x"), ("a", "y"), ("b", "y")]
    assert rows(sy.rearrangement_candidates(strong), "focal_chr", "strong_partner_chromosomes", "focal_side") == [
        ("a", "x,y", "reference"),
        ("y", "a,b", "target"),
    ]


def test_components(spark):
    chain = {(str(i), str(i)): 100 for i in range(30)} | {(str(i + 1), str(i)): 90 for i in range(29)}
    other = {("r1", "t1"): 500, ("r1", "t2"): 400, ("r2", "t9"): 50, ("r2", "t1"): 5}
    got = sy.component_ratio(sy.strong_partners(matrix(spark, chain | other))).orderBy("component_rank").collect()
    assert [(r["ratio"], r["support"]) for r in got] == [("30:30", 30 * 100 + 29 * 90), ("1:2", 900), ("1:1", 50)]
    assert got[0]["ref_chromosomes"] == ",".join(str(i) for i in range(30))
    assert got[1]["tgt_chromosomes"] == "t1,t2"
    assert sy.modal_ratio(spark.createDataFrame(got)).first()["modal_ratio"] == "30:30"


def test_synteny_ratio_text(spark):
    strong = sy.strong_partners(matrix(spark, {("a", "x"): 50, ("a", "y"): 50, ("b", "z"): 50, ("b", "w"): 50, ("c", "q"): 1}))
    ploidy = spark.createDataFrame([("c", "2x", "4x")], "comparison string, ref_ploidy string, tgt_ploidy string")
    row = sy.synteny_ratio(strong, ploidy).first()
    assert (row["ref_median_depth"], row["tgt_median_depth"], row["interpreted_ratio"]) == (2.0, 1.0, "2:1")


def test_target_order(spark):
    ref = spark.createDataFrame([("c", "r1", 1), ("c", "r2", 2)], "comparison string, ref_chr string, rank long")
    targets = spark.createDataFrame([("c", str(i), i) for i in (1, 2, 3, 10)], "comparison string, tgt_chr string, number long")
    cells = matrix(spark, {("r2", "1"): 9, ("r1", "1"): 1, ("r1", "2"): 5, ("r2", "2"): 5, ("r1", "10"): 7, ("zz", "3"): 99})
    got = sy.order_targets(cells, ref, targets).orderBy("plot_rank").collect()
    # 3 has anchors only outside the axis: first reference, position past the axis.
    assert [r["tgt_chr"] for r in got] == ["10", "2", "3", "1"]
    assert [r["weighted_position"] for r in got] == [1.0, 1.5, 5.0, 1.9]


def test_orientation(spark):
    ref = spark.createDataFrame([("c", "r", 1)], "comparison string, ref_chr string, rank long")
    ref_len = spark.createDataFrame([("c", "r", 100)], "comparison string, ref_chr string, length_bp long")
    tgt_len = spark.createDataFrame([("c", t, 100) for t in "uvwx"], "comparison string, tgt_chr string, length_bp long")
    data = [("c", "r", float(i), "u", 50.0 - i) for i in range(6)] + [("c", "r", float(i), "v", 9.0 - i) for i in range(4)]
    data += [("c", "r", float(i), "w", 5.0) for i in range(7)]
    mapped = spark.createDataFrame(data, "comparison string, ref_chr string, ref_mid double, tgt_chr string, tgt_mid double")
    got = {r["tgt_chr"]: (r["anchors_used"], round(r["correlation"], 9), r["orientation"]) for r in sy.orientation(mapped, ref, ref_len, tgt_len).collect()}
    assert got == {"u": (6, -1.0, "-"), "v": (4, 0.0, "+"), "w": (7, 0.0, "+"), "x": (0, 0.0, "+")}


def test_layouts(spark):
    chroms = spark.createDataFrame([("s", "a", 1, 30), ("s", "b", 2, 60)], "species string, chrom string, rank long, length_bp long")
    line = {r["chrom"]: r for r in sy.running_layout(chroms, ["species"], 0.1).collect()}
    assert math.isclose(line["a"]["end"], 0.3) and math.isclose(line["b"]["start"], 0.4) and math.isclose(line["b"]["end"], 1.0)
    circle = {r["chrom"]: r for r in sy.radial_layout(chroms, ["species"], 10.0).collect()}
    usable = 2 * math.pi - 2 * math.radians(10)
    assert math.isclose(circle["b"]["start"], usable / 3 + math.radians(10)) and math.isclose(circle["a"]["center"], usable / 6)
    with pytest.raises(Exception, match="gap too large"):
        sy.running_layout(chroms, ["species"], 1.0).collect()


def test_link_clamps_and_flips(spark):
    row = spark.range(1).select(
        sy.link_x(F.lit(150.0), F.lit(100), F.lit(0.2), F.lit(0.4)).alias("over"),
        sy.link_x(F.lit(25.0), F.lit(100), F.lit(0.0), F.lit(1.0), F.lit("-")).alias("flipped"),
    ).first()
    assert tuple(row) == (0.4, 0.75)


def test_map_pairs(spark, rows):
    data = [("c", "g1", "h1", False), ("c", "h2", "g2", True), ("c", "g9", "h1", False), ("c", "g1", "h9", False)]
    anchors = spark.createDataFrame(data, "comparison string, gene1 string, gene2 string, turned boolean")
    ref = spark.createDataFrame([("g1", "r1", 5.0), ("g2", "r2", 6.0)], "gene string, chrom string, midpoint double")
    tgt = spark.createDataFrame([("h1", "t1", 7.0), ("h2", "t2", 8.0)], "gene string, chrom string, midpoint double")
    mapped, counts = sy.map_pairs(anchors, ref, tgt, stored_reversed=F.col("turned"))
    assert rows(sy.anchor_matrix(mapped), "ref_chr", "tgt_chr", "n") == [("r1", "t1", 1), ("r2", "t2", 1)]
    assert tuple(counts.first()) == ("c", 4, 2, 1, 1, 0.5)


def gene_pairs(spark, cells):
    return spark.createDataFrame(
        [("c", r, g, t, h) for r, g, t, h in cells], "comparison string, ref_chr string, ref_gene string, tgt_chr string, tgt_gene string"
    )


def classes(spark, first, second, both, other):
    """Class of one reference chromosome, by rule, from gene counts per target."""
    cells = [("r", f"a{i}", "t1", f"x{i}") for i in range(first)] + [("r", f"b{i}", "t2", f"y{i}") for i in range(second)]
    cells += [("r", f"d{i}", t, f"{t}z{i}") for i in range(both) for t in ("t1", "t2")]
    cells += [("r", f"o{i}", f"u{i}", f"w{i}") for i in range(other)]
    pairs = gene_pairs(spark, cells)
    names = sorted({c[2] for c in cells})
    order = spark.createDataFrame([("c", t, i) for i, t in enumerate(names)], "comparison string, tgt_chr string, rank long")
    top2 = ms.top2_partners(ms.ranked_partners(ms.chromosome_support(pairs), pairs, order))
    genes = ms.gene_support_class(pairs, top2)
    return {rule: ms.two_partner_class(top2, genes, rule=rule).first() for rule in ms.RULES}


def test_two_partner_rules(spark):
    strong = classes(spark, 10, 5, 0, 5)
    assert {r["pattern_class"] for r in strong.values()} == {"strong_1to2_candidate"}
    assert strong["balanced"]["second_to_first_ratio"] == 0.5 and strong["balanced"]["union_fraction"] == 0.75
    wide = classes(spark, 10, 5, 0, 15)
    assert [wide[r]["pattern_class"] for r in ("secondary", "balanced")] == ["moderate_secondary_partner", "moderate_balanced_two_partner"]
    weak = classes(spark, 10, 3, 0, 17)
    assert [weak[r]["pattern_class"] for r in ("secondary", "balanced")] == ["moderate_secondary_partner", "weak_second_partner"]
    alone = classes(spark, 4, 0, 0, 0)
    assert [alone[r]["pattern_class"] for r in ("secondary", "balanced")] == ["single_dominant_partner", "single_target"]
    dual = classes(spark, 1, 1, 2, 0)["secondary"]
    assert (dual["union_genes"], dual["dual_genes"], dual["genes_exactly_2_chr"]) == (4, 2, 2)


def test_partner_depth_and_summary(spark):
    pairs = gene_pairs(
        spark,
        [("r", "g1", "t1", "h1"), ("r", "g1", "t1", "h1"), ("r", "g2", "t1", "h1"), ("r", "g2", "t2", "h2"), ("r", "g3", "t2", "h1")]
        + [("r", "g3", "t2", f"k{i}") for i in range(4)],
    )
    depth = ms.partner_depth(pairs, gene_list=True)
    got = {r["ref_gene"]: r for r in depth.collect()}
    assert [got[g]["partner_depth_class"] for g in ("g1", "g2", "g3")] == ["1", "2", ">2"]
    assert [got[g]["two_on_distinct_chr"] for g in ("g1", "g2", "g3")] == [False, True, False]
    assert got["g2"]["target_chromosomes"] == "t1,t2" and got["g2"]["target_genes"] == "h1,h2"
    few = spark.createDataFrame([("c", 2)], "comparison string, ordered_genes long")
    row = ms.depth_summary(depth, few).first()
    assert (row["genes_with_any_partner"], row["genes_with_0_partners"]) == (3, 0)
    assert row["genes_with_1_partner"] + row["genes_with_2_partners"] + row["genes_with_gt2_partners"] == 3
    with pytest.raises(Exception, match="more syntenic than ordered"):
        ms.depth_summary(depth, few, negative_zero="error").collect()


def test_published_fractions_are_consistent(spark):
    """Counts of a published comparison give its published fractions."""
    data = [(f"g{i}", 1) for i in range(1130)] + [(f"h{i}", 2) for i in range(18)] + [(f"k{i}", 3) for i in range(4)]
    depth = spark.createDataFrame(data, "ref_gene string, partner_gene_count long").selectExpr(
        "'c' AS comparison", "'r' AS ref_chr", "ref_gene", "partner_gene_count", "1 AS partner_chromosome_count", "false AS two_on_distinct_chr"
    )
    totals = spark.createDataFrame([("c", 49357)], "comparison string, ordered_genes long")
    row = ms.depth_summary(depth, totals).first()
    assert (row["genes_with_any_partner"], row["genes_with_0_partners"]) == (1152, 48205)
    got = [f"{row[c]:.8f}" for c in ("fraction_any_partner", "fraction_1_partner", "fraction_2_partners", "fraction_gt2_partners")]
    assert got == ["0.02334015", "0.98090278", "0.01562500", "0.00347222"]


def test_unknown_chromosomes_are_an_error(spark):
    """A chromosome that the order table lacks must not vanish."""
    from syntabula.operators import multisynteny as ms
    from syntabula.operators import synteny

    support = spark.createDataFrame([("c", "r1", "t9", 5, 9), ("c", "r1", "t1", 3, 4)], "comparison string, ref_chr string, tgt_chr string, ref_genes long, gene_pairs long")
    pairs = spark.createDataFrame([("c", "r1", "g")], "comparison string, ref_chr string, ref_gene string")
    order = spark.createDataFrame([("c", "t1", 1)], "comparison string, tgt_chr string, rank int")
    with pytest.raises(Exception, match="target chromosome without rank: t9"):
        ms.ranked_partners(support, pairs, order).collect()
    refs = spark.createDataFrame([("c", "r1", 1)], "comparison string, ref_chr string, rank int")
    with pytest.raises(Exception, match="support off the axes: r1 t9"):
        synteny.dense_matrix(support, refs, order, "gene_pairs").collect()


def test_partner_depth_takes_the_partitions_that_rows_need(spark, rows):
    pairs = gene_pairs(spark, [("r", f"g{i % 7}", f"t{i % 3}", f"h{i % 11}") for i in range(200)])
    depth = ms.partner_depth(pairs, gene_list=True, partitions=23)
    assert rows(depth) == rows(ms.partner_depth(pairs, gene_list=True))
    assert depth.rdd.getNumPartitions() == 23


def test_partner_depth_keeps_every_pair(spark, tmp_path):
    """Genes of any balance or without a chromosome and pairs without a comparison count; partner genes are listed."""
    from syntabula.plans import load, synteny as plans
    from tools.check_queries import compare

    customers = spark.createDataFrame([(1, 7, -950.0), (2, None, 10.0), (3, 7, None)], "c_custkey long, c_nationkey int, c_acctbal double")
    suppliers = spark.createDataFrame([(8, 4, -999.0), (9, None, 5.0), (10, 5, 0.0)], "s_suppkey long, s_nationkey int, s_acctbal double")
    orders = spark.createDataFrame([(i, i) for i in (1, 2, 3, 4)], "o_orderkey long, o_custkey long")
    lines = [(1, 8, "A"), (1, 8, "A"), (1, 10, "A"), (1, 9, None), (2, 9, "N"), (2, 10, "N"), (3, 8, None), (3, 10, None), (4, 8, "A"), (3, 11, "A")]
    lineitem = spark.createDataFrame([(*r, s) for r in lines for s in "OF"], "l_orderkey long, l_suppkey long, l_returnflag string, l_linestatus string")
    for name, df in {"customer": customers, "supplier": suppliers, "orders": orders, "lineitem": lineitem}.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    found = {(r.comparison, r.ref_gene): r for r in plans.partner_depth(spark, str(tmp_path)).collect()}
    assert {k: (r.ref_chr, r.partner_gene_count, r.partner_chromosome_count, r.target_chromosomes, r.target_genes) for k, r in found.items()} == {
        ("A", 1): (7, 2, 2, "4,5", "10,8"),
        (None, 1): (7, 1, 0, None, "9"),
        ("N", 2): (None, 2, 1, "5", "10,9"),
        (None, 3): (7, 2, 2, "4,5", "10,8"),
    }
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in tmp_path.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}/*.parquet'")
    got = plans.partner_depth(spark, str(tmp_path)).toPandas()
    assert compare(got, con.sql(load()[1]["partner_depth"]).df()) == ""
