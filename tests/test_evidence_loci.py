import pytest
from pyspark.sql import functions as F

from syntabula.operators import assembly, evidence, loci, quality


def test_overlap_matches_published_percentages(spark):
    ids = spark.range(25145).select(F.col("id").alias("protein_id"))
    strict, domain = ids.filter("protein_id < 17798"), ids.filter("protein_id >= 100")
    total = spark.createDataFrame([(28313,)], "total long")
    got = {r["category"]: (r["n"], f"{r['pct']:.2f}") for r in evidence.evidence_overlap(strict, domain, total).collect()}
    assert got["both"] == (17698, "62.51") and got["union"] == (25145, "88.81")
    assert got["strict_only"][0] + got["domain_only"][0] + got["both"][0] == got["union"][0]
    assert got["unsupported"][0] == 28313 - 25145
    with pytest.raises(Exception, match="more supported"):
        evidence.evidence_overlap(strict, domain, spark.createDataFrame([(5,)], "total long")).collect()


def test_assembly_stats(spark):
    seqs = spark.createDataFrame([("s1", "ACGTNNNNACnA"), ("s2", "NNAC"), ("s3", "GG")], "seq_id string, sequence string")
    row = assembly.assembly_stats(seqs, min_bp=4).first()
    assert (row["assembled_genome_size_bp"], row["number_scaffolds"], row["scaffold_n50_bp"]) == (18, 3, 12)
    assert (row["total_n_bases"], row["number_n_runs"], row["number_pseudochromosomes"]) == (7, 3, 2)
    assert (row["inferred_contig_count"], row["inferred_contig_n50_bp"]) == (5, 2)
    metrics = {r["metric"]: r["value"] for r in assembly.as_metrics(assembly.assembly_stats(seqs)).collect()}
    assert metrics["longest_scaffold_bp"] == 12.0
    assert assembly.gap_runs(seqs, ["seq_id"]).count() == 3 and assembly.contig_lengths(seqs, ["seq_id"]).count() == 5


def test_assembly_without_letters(spark):
    seqs = spark.createDataFrame([("s1", "NNNN")], "seq_id string, sequence string")
    row = assembly.assembly_stats(seqs).first()
    assert (row["inferred_contig_count"], row["inferred_contig_n50_bp"], row["assembly_gap_percent"]) == (0, 0, 100.0)


def test_published_lengths_give_the_published_n50(spark):
    bp = [27309083, 29629758, 30539573, 23793664, 21249483, 27690849, 26614034, 25366689, 25741366]
    df = spark.createDataFrame([(n,) for n in bp], "length_bp long")
    assert assembly.n50(df, [], "length_bp").first()["n50"] == 26614034 and sum(bp) == 237934499


def test_standardise_peaks(spark, rows):
    df = spark.createDataFrame([("c1", 0.5, "R", 7.0), ("c1", 0.2, "P", 8.0), ("c2", 3.5, "", 9.0)], ["Comparison-ID", "Peak Ks!", "class", "other"])
    found, issues = evidence.standardise_peaks(df)
    assert rows(found, "comparison", "peak_ks", "validation_class") == [("c1", 0.2, "P"), ("c1", 0.5, "R"), ("c2", 3.5, "VALIDATED")]
    assert rows(issues) == [("c2", 3.5, "OUTSIDE_RANGE")]
    assert evidence.peak_summary(found).filter("comparison = 'c1'").first()["validated_peaks"] == "0.2,0.5"


def test_scored_alias(spark):
    df = spark.createDataFrame([("c1", 0.5, 70.0), ("c2", 0.7, 80.0)], ["my contrast", "ks centre value", "plain"])
    found = evidence.resolve_aliases(df, evidence.ALIASES, scored="peak_ks")
    assert found["comparison"] == "my contrast" and found["peak_ks"] == "ks centre value"
    assert evidence.resolve_aliases(df.select("my contrast", "plain"), evidence.ALIASES, scored="peak_ks")["peak_ks"] is None
    with pytest.raises(quality.GateError):
        evidence.resolve_aliases(spark.createDataFrame([(1, 2)], ["a b", "a_b"]), evidence.ALIASES)


def test_integrate_and_repair(spark):
    peaks = spark.createDataFrame([("c", 0.9), ("c", 0.2), ("c", 1.5)], "comparison string, peak_ks double")
    macro = spark.createDataFrame([("c", 5), ("d", 6)], "comparison string, pairs long")
    depth = spark.createDataFrame([("c", 3, "", "PASS")], "comparison string, genes long, note string, status string")
    multi = spark.createDataFrame([("c", 1, 4)], "comparison string, strong long, weak long")
    out = evidence.integrate_evidence(peaks, macro, depth, multi, macro_fields=["pairs"], multi_fields={"weak": "strong_chromosomes"})
    got = {r["comparison"]: r for r in evidence.repair_fields(out, multi, {"strong_chromosomes": "strong"}).collect()}
    assert (got["c"]["ks_component_1"], got["c"]["ks_component_2"], got["c"]["ks_component_count"]) == (0.2, 0.9, 3)
    assert got["c"]["gene_level_summary"] == "genes=3;status=PASS" and got["c"]["strong_chromosomes"] == 1
    assert got["d"]["ks_component_1"] is None and got["d"]["ks_component_count"] == 0


def test_gates(spark):
    df = spark.createDataFrame([(1, "PASS"), (2, "FAIL"), (3, None)], "i long, status string")
    with pytest.raises(quality.GateError, match="2 rows"):
        quality.expect(df, F.col("status") == "PASS", "status")
    assert quality.expect(df, F.col("i") > 0, "positive") is df
    quality.expect_none(df.filter("i > 9"), "none")


def test_status_and_sources(spark, rows):
    expected = spark.createDataFrame([(k,) for k in "abcd"], "comparison string")
    complete = spark.createDataFrame(
        [("a", "PASS", 5, True), ("b", "PASS", 5, False), ("c", "OPEN", 1, True)],
        "comparison string, status string, anchor_pairs long, anchor_present boolean",
    )
    failed = spark.createDataFrame([("c", "")], "comparison string, reason string")
    runs = quality.run_status(expected, complete, failed)
    assert rows(runs, "comparison", "status", "reason") == [
        ("a", "PASS", ""),
        ("b", "FAIL", "RECORDED_ANCHOR_FILE_MISSING"),
        ("c", "FAIL", "UNKNOWN_FAILURE"),
        ("d", "MISSING", "NO_RUN_COMPLETION_RECORD"),
    ]
    assert tuple(quality.run_status_summary(runs).first()) == (4, 1, 2, 1, 11)
    checked = quality.source_dimension_check({"x": expected, "y": complete}, ["a", "b", "d"])
    assert rows(checked, "analysis", "comparison_set", "status") == [("x", "a,b,d", "PASS"), ("y", "a,b", "FAIL")]


def test_annotation_table(spark, rows):
    features = spark.createDataFrame([("s1", 5), ("s2", 6)], "species string, genes long")
    schema = "species string, complete double, single double, duplicated double, fragmented double, missing double, n double"
    protein = spark.createDataFrame([("s1", 98.0, 90.0, 8.0, 1.0, 1.0, 2026.0)], schema)
    genome = spark.createDataFrame([("s1", 99.0, 90.0, 9.0, 1.0, 0.0, 2026.0), ("s2", None, None, None, None, None, None)], schema)
    out = evidence.final_annotation_table(features, protein, genome)
    assert rows(out, "species", "status") == [("s1", "PASS"), ("s2", "FAIL_PARSE_PROTEIN_BUSCO;FAIL_PARSE_GENOME_BUSCO")]


def test_representatives(spark, rows):
    schema = "transcript_id string, gene_id string, seqid string, start long, end long, strand string"
    transcripts = spark.createDataFrame([("t1", "g1", "c", 1, 100, "+"), ("t2", "g1", "c", 1, 90, "+"), ("t4", "", "c", 1, 9, "+")], schema)
    cds = spark.createDataFrame(
        [("t1", "g1", "c", 1, 10, "+"), ("t2", "g1", "c", 1, 10, "+"), ("t2", "g1", "c", 20, 29, "+"), ("t3", "g3", "c", 5, 9, "-"), ("t3", "g3", "c", 20, 30, "-")]
        + [("t5", "g5", "c", 5, 9, "-"), ("t5", "g5", "d", 5, 9, "-")],
        schema,
    )
    got = loci.representative_transcript(transcripts, cds)
    assert rows(got, "gene_id", "transcript_id", "start", "end", "cds_length") == [
        ("g1", "t2", 1, 90, 20),
        ("g3", "t3", 5, 30, 16),
        ("t4", "t4", 1, 9, 0),
    ]


def test_matching(spark, rows):
    transcripts = spark.createDataFrame([("a.t1",), ("b",), ("lost",)], "transcript_id string")
    proteins = spark.createDataFrame([("a.p1", 1), ("x|b", 2), ("y|b", 3)], "protein_id string, ord long")
    matched, unmatched, ambiguous = loci.match_by_variants(transcripts, proteins)
    assert rows(matched) == [("a.t1", "a.p1", "a"), ("b", "x|b", "b")]
    assert rows(unmatched) == [("lost",)] and rows(ambiguous) == [("b", "x|b")]


def test_coordinates_and_order(spark, rows):
    lengths = spark.createDataFrame([("s", "c", 100)], "species string, chrom string, length_bp long")
    data = [("d", 0, 5, "+"), ("c", -1, 5, "+"), ("c", 5, 5, "+"), ("c", 5, 101, "+"), ("c", 5, 100, "x"), ("c", 0, 100, ".")]
    genes = spark.createDataFrame([("s", *r) for r in data], "species string, chrom string, start long, end long, strand string")
    got = [r["issue"] for r in loci.validate_coordinates(genes, lengths).orderBy("chrom", "start", "end", "strand").collect()]
    assert sorted(got, key=str) == sorted(
        ["BED_CHROMOSOME_NOT_IN_GENOME", "NEGATIVE_BED_START", "BED_END_NOT_GREATER_THAN_START", "BED_END_EXCEEDS_CHROMOSOME", "INVALID_BED_STRAND", None],
        key=str,
    )
    table = spark.createDataFrame([("s", 1, 5), ("s", 2, 3), ("s", 3, 9)], "species string, ord long, start long")
    assert rows(loci.sort_order_issues(table, ["species"], "ord", ["start"]), "ord") == [(2,)]
    orders = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 3), ("e", 1), ("e", 1)], "c string, order long")
    assert rows(loci.contiguous_order_check(orders, ["c"]), "c", "contiguous") == [("a", True), ("b", False), ("e", False)]


def test_md5_match_stays_linear(spark, rows):
    a = spark.createDataFrame([(f"a{i}", "ACGT") for i in range(30)] + [("u", "GG")], "id_a string, sequence string")
    b = spark.createDataFrame([(f"b{i}", "acgt") for i in range(30)], "id_b string, sequence string")
    got = loci.md5_match(a, b, "id_a", "id_b").collect()
    assert len(got) == 30 and {(r["id_b"], r["n_a"], r["n_b"]) for r in got} == {("b0", 30, 30)}


def test_order_violations_across_partitions(spark):
    from pyspark.sql import functions as F
    from syntabula.operators import loci

    ordered = spark.range(0, 1000, 1, 7).select((F.col("id") / 3).cast("int").alias("v"))
    assert loci.order_violations(ordered, [F.col("v")]).count() == 0
    # Each partition is in order; each begins below the end of the one before.
    steps = spark.range(0, 700, 1, 7).select((F.col("id") % 100).alias("v"))
    assert [r["v"] for r in loci.order_violations(steps, [F.col("v")]).collect()] == [0] * 6
    nulls = spark.createDataFrame([(None,), (1,), (None,), (None,), (1,)], "v int").coalesce(1)
    assert [r["v"] for r in loci.order_violations(nulls, [F.col("v")]).collect()] == [None]
    assert loci.order_violations(ordered.where("v < 0"), [F.col("v")]).count() == 0
