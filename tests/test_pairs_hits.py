import pytest
from pyspark.sql import functions as F

from syntabula.operators import hits, pairs


def test_best_hit_does_not_depend_on_row_order(spark):
    data = [("q", "s", 1e-20, 100.0, 90.0, 1), ("q", "s", 1e-30, 80.0, 50.0, 2), ("q", "s", 1e-30, 80.0, 60.0, 3), ("q", "s", 1e-30, 80.0, 60.0, 4)]
    schema = "qseqid string, sseqid string, evalue double, bitscore double, pident double, qstart long"
    for rows in (data, data[::-1]):
        assert hits.best_pair_hit(spark.createDataFrame(rows, schema).repartition(3)).collect()[0]["qstart"] == 3


def test_swap_union(spark, rows):
    schema = "qseqid string, sseqid string, qstart long, qend long, sstart long, send long"
    forward = spark.createDataFrame([("a", "b", 1, 2, 3, 4)], schema)
    reverse = spark.createDataFrame([("b", "a", 3, 4, 1, 2)], schema)
    assert hits.distinct_hits(hits.swap_union(forward, reverse)).collect() == forward.collect()


def test_threshold_includes_its_limits(spark):
    df = spark.createDataFrame([(30.0, 50.0), (29.99, 90.0), (90.0, 49.9)], "pident double, qcovhsp double")
    assert hits.hit_threshold(df).count() == 1


def test_unordered_pairs_with_one_hot_pair(spark, rows):
    data = [("s", "x", "y")] * 30 + [("s", "y", "x")] * 3 + [("s", "z", "z")] * 2 + [("p", "x", "y"), ("p", "y", "x"), ("p", "x", "y")]
    df = spark.createDataFrame(data, "c string, a string, b string")
    kept, counts = pairs.unordered_pairs(df, ["c"], "a", "b", F.col("c") == "s")
    assert rows(kept) == [("p", "x", "y"), ("p", "y", "x"), ("s", "x", "y")]
    got = {r["c"]: tuple(r)[1:] for r in counts.collect()}
    assert got == {"s": (35, 2, 0, 32, 1), "p": (3, 0, 1, 0, 2)}


def test_unique_pairs_and_conflicts(spark, rows):
    schema = "comparison string, reference_gene string, reference_chr string, target_gene string, target_chr string, block_row long"
    df = spark.createDataFrame(
        [("c", "g", "c2", "h", "d1", 1), ("c", "g", "c1", "h", "d1", 9), ("c", "g", "c1", "h", "d1", 5)], schema
    )
    assert rows(pairs.unique_pairs(df), "reference_chr", "block_row") == [("c1", 5)]
    distinct, conflicts = pairs.unique_pairs4(df)
    assert distinct.count() == 2 and rows(conflicts, "gene", "side") == [("g", "reference")]


def test_block_pairs(spark, rows):
    df = spark.createDataFrame([(1, "['a','b']", "x y"), (2, "a", "x,y"), (3, "nan", "")], "id long, block1 string, block2 string")
    found, bad = pairs.block_pairs(df, ["id"])
    assert rows(found) == [(1, 1, "a", "x"), (1, 2, "b", "y")] and rows(bad) == [(2, 1, 2)]


def test_completeness(spark, rows):
    want = spark.createDataFrame([("c", "a"), ("c", "b")], "c string, k string")
    have = spark.createDataFrame([("c", "a"), ("c", "a"), ("c", "z")], "c string, k string")
    counts, odd = pairs.completeness_check(want, have, ["c"], ["k"])
    assert tuple(counts.first()) == ("c", 2, 3, 1, 1, 1, 0.5)
    assert rows(odd) == [("c", "b", "missing"), ("c", "z", "unexpected")]


def test_collinearity_qc_takes_the_upper_median(spark):
    blocks = spark.createDataFrame(
        [("c", i, 10.0 * i, 0.1, n, "plus" if i % 2 else "minus") for i, n in enumerate((4, 6, 8, 10))],
        "comparison string, block_id long, score double, pvalue double, n long, orientation string",
    )
    members = spark.createDataFrame(
        [("c", i, f"g{i}_{j}", f"h{j}") for i, n in enumerate((4, 6, 8, 9)) for j in range(n)],
        "comparison string, block_id long, gene1 string, gene2 string",
    )
    totals = spark.createDataFrame([("c", 100, 10)], "comparison string, n1 long, n2 long")
    row = pairs.collinearity_qc(blocks, members, ["comparison"], totals).first()
    assert row["median_block_size"] == 8 and row["block_size_mismatches"] == 1
    assert row["species1_block_gene_coverage"] == 0.27 and row["species2_block_gene_coverage"] == 0.9


def test_block_summary_with_list(spark):
    df = spark.createDataFrame(
        [("b", i, f"g{i}", f"h{i}", "c1", "d1", 10 * i, 7 * i) for i in (2, 1, 3)],
        "block string, pair_index long, gene1 string, gene2 string, chr1 string, chr2 string, start1 long, start2 long",
    )
    ks = spark.createDataFrame([("g1", "h1", 0.5), ("g2", "h2", 0.1), ("g3", "h3", 0.9)], "gene1 string, gene2 string, ks double")
    row = pairs.block_summary(df, ks, ["block"], with_list=True).first()
    assert (row["length"], row["ks_median"], row["ks"], row["start1"], row["end2"]) == (3, 0.5, "0.5_0.1_0.9", 10, 21)


def test_sensitivity_flags(spark):
    schema = "comparison string, s string, blocks long, pairs long"
    df = spark.createDataFrame(
        [("a", "strict", 10, 100), ("a", "sensitive", 15, 100), ("b", "strict", 10, 100), ("b", "sensitive", 12, 90), ("c", "strict", 10, 10), ("c", "sensitive", 10, 11)],
        schema,
    )
    got = {r["comparison"]: r["review_flag"] for r in pairs.parameter_sensitivity(df, ["comparison"], "s", ["blocks", "pairs"]).collect()}
    assert got == {"a": "HIGH_SENSITIVITY", "b": "MODERATE_SENSITIVITY", "c": "STABLE"}


def test_runs(spark, rows):
    first = spark.createDataFrame([("A", "B", "old", 1), ("C", "D", "only", 1)], "a string, b string, run string, run_order long")
    second = spark.createDataFrame([("B", "A", "new", 1)], "a string, b string, run string, run_order long")
    latest = pairs.latest_runs([first, second], "a", "b").select("a", "b", "run")
    assert rows(latest, "run") == [("new",), ("only",)]
    wanted = spark.createDataFrame([("A", "B"), ("C", "D"), ("A", "D")], "x string, y string")
    found = pairs.undirected_lookup(wanted, latest, "x", "y", "a", "b")
    assert rows(found, "x", "y", "stored_query", "run", "orientation", "status") == [
        ("A", "B", "B", "new", "REVERSE_AVAILABLE", "AVAILABLE"),
        ("A", "D", "A", None, "NONE", "MISSING"),
        ("C", "D", "C", "only", "FORWARD", "AVAILABLE"),
    ]


def test_candidate_scores(spark):
    ids = spark.createDataFrame([("S", i) for i in "abc"], "species string, seq_id string")
    files = [("S", "exact", i) for i in "abc"] + [("S", "more", i) for i in "abcd"] + [("S", "less", "a")]
    got = {r["path"]: r for r in hits.score_id_overlap(ids, spark.createDataFrame(files, "species string, path string, seq_id string")).collect()}
    assert [got[p]["rank"] for p in ("exact", "more", "less")] == [1, 2, 3]
    assert got["exact"]["exact_candidates"] == 1 and got["more"]["extra_cds_ids"] == 1


@pytest.mark.parametrize("length,issue", [(10, False), (0, True)])
def test_validate_hits(spark, length, issue):
    row = {"qseqid": "a", "sseqid": "b", "pident": 99.0, "length": length, "mismatch": 0, "gapopen": 0}
    row |= {"qstart": 1, "qend": 9, "sstart": 1, "send": 9, "evalue": 0.0, "bitscore": 5.0}
    ids = spark.createDataFrame([("a",)], "id string")
    checked = hits.validate_hits(spark.createDataFrame([row]), ids, ids).first()
    assert checked["invalid_id"] and checked["malformed"] is issue


def test_null_score_never_wins(spark):
    schema = "qseqid string, sseqid string, evalue double, bitscore double, pident double, qstart long"
    data = [("q", "s", 1e-9, None, 99.0, 1), ("q", "s", 1e-9, 50.0, 10.0, 2), ("q", "s", None, 90.0, 99.0, 3)]
    assert hits.best_pair_hit(spark.createDataFrame(data, schema)).collect()[0]["qstart"] == 2


def test_pair_with_a_missing_gene_is_no_self_pair(spark):
    df = spark.createDataFrame([("c", 1, None), ("c", 2, 1), ("c", 1, 2), ("c", 3, 3)], "c string, a long, b long")
    kept, counts = pairs.unordered_pairs(df, ["c"], "a", "b", F.lit(True))
    assert [tuple(r) for r in kept.collect()] == [("c", 1, 2)]
    row = counts.collect()[0]
    assert (row["raw_assignments"], row["self_pairs_removed"], row["retained_pairs"]) == (4, 1, 1)


def test_comparison_without_pairs_keeps_its_row(spark):
    blocks = spark.createDataFrame([("x", 1, 1.0, 0.1, 2, "plus"), ("y", 2, 1.0, 0.1, 0, "minus")], "c string, block_id long, score double, pvalue double, n long, orientation string")
    members = spark.createDataFrame([("x", 1, 10, 20), ("x", 1, 11, 20)], "c string, block_id long, gene1 long, gene2 long")
    totals = spark.createDataFrame([("x", 50, 60), ("y", 50, 60), ("z", 1, 1)], "c string, n1 long, n2 long")
    got = {r["c"]: r for r in pairs.collinearity_qc(blocks, members, ["c"], totals).collect()}
    assert set(got) == {"x", "y", "z"} and got["x"]["species1_genes_in_blocks"] == 2 and got["x"]["species2_genes_in_blocks"] == 1
    assert got["y"]["collinear_gene_pairs"] == 0 and got["y"]["block_count"] == 1 and got["z"]["block_count"] == 0
    found = spark.createDataFrame([("x", 1, 2, 90.0, 5.0, 0.0)], "c string, qseqid long, sseqid long, pident double, bitscore double, evalue double")
    qc = {r["c"]: r for r in hits.homology_qc(found, ["c"], totals).collect()}
    assert qc["x"]["unique_queries"] == 1 and qc["y"]["homology_rows"] == 0 and qc["z"]["query_gene_coverage"] == 0
