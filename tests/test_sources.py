import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from syntabula.operators.quality import GateError
from syntabula.sources import blocks, fasta, features, hits, tables


def put(folder, name, text):
    path = folder / name
    if name.endswith(".gz"):
        path.write_bytes(gzip.compress(text.encode()))
    else:
        path.write_bytes(text.encode())
    return str(path)


def test_fasta(spark, rows, tmp_path):
    path = put(tmp_path, "a.fa", ">s1 first > one\nACgt\r\nNN\n>s2\n\nAC GT\n>s3 empty\n")
    seqs = fasta.read_fasta(spark, path)
    assert rows(seqs, "seq_id", "description", "sequence") == [
        ("s1", "first > one", "ACgtNN"),
        ("s2", "", "ACGT"),
        ("s3", "empty", ""),
    ]
    assert rows(fasta.sequence_order(seqs), "seq_id", "ord") == [("s1", 1), ("s2", 2), ("s3", 3)]
    assert fasta.read_fasta(spark, put(tmp_path, "b.fa.gz", ">x\nAA\nCC\n")).first()["sequence"] == "AACC"
    with pytest.raises(GateError):
        fasta.read_fasta(spark, put(tmp_path, "c.fa", ">x\nA\n>x\nC\n"), unique=True)


def test_fasta_order_over_file_splits(spark, tmp_path):
    path = put(tmp_path, "many.fa", "".join(f">s{i}\n{'ACGT' * 30}\n{'GG' * 20}\n" for i in range(2000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        seqs = fasta.read_fasta(spark, path)
        assert seqs.rdd.getNumPartitions() > 3
        got = {r["seq_id"]: r["ord"] for r in fasta.sequence_order(seqs).collect()}
        lengths = [tuple(r) for r in seqs.select(F.length("sequence")).distinct().collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {f"s{i}": i + 1 for i in range(2000)}
    assert lengths == [(160,)]


def test_write_fasta(spark, tmp_path):
    df = spark.createDataFrame([("a", "A" * 60), ("b", "C" * 61)], "seq_id string, sequence string")
    fasta.write_fasta(df, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part*")))
    assert ">a\n" + "A" * 60 + "\n" in text and ">b\n" + "C" * 60 + "\nC\n" in text
    back = fasta.read_fasta(spark, str(tmp_path / "out"))
    assert {r["seq_id"]: len(r["sequence"]) for r in back.collect()} == {"a": 60, "b": 61}


def test_gff(spark, rows, tmp_path):
    text = (
        '#c\n\nchr1\tx\tgene\t11\t20\t.\t+\t.\tgene_id "g1"; note "a=b";\n'
        "chr1\tx\tmRNA\t11\t20\t.\t+\t.\tID=t1;Parent=gene:g1,g2;ID=t9\n"
        "chr1\tx\tgene\tten\t20\t.\t+\t.\tID=g\nchr1\tshort\n"
    )
    good, bad = features.read_gff(spark, put(tmp_path, "a.gff", text))
    found = {r["feature"]: r for r in good.collect()}
    assert found["gene"]["attributes"]["gene_id"] == "g1"
    assert found["mRNA"]["attributes"] == {"ID": "t1", "Parent": "gene:g1,g2"}
    assert rows(bad, "issue") == [("FEWER_THAN_NINE_FIELDS",), ("NON_INTEGER_COORDINATE",)]
    assert rows(features.gene_loci(good), "chrom", "start", "end") == [("chr1", 10, 20)]


def test_bed(spark, rows, tmp_path):
    path = put(tmp_path, "a.bed", "c1\t0\t10\tg1\t0\t+\nc1\tx\t10\tg2\t0\t+\nc1 5 9 g3 -\n")
    good, bad = features.read_bed(spark, path)
    assert rows(good, "chrom", "start", "end", "gene_id", "strand") == [("c1", 0, 10, "g1", "+")]
    assert rows(bad, "issue") == [("BED_COLUMN_COUNT_NOT_SIX",), ("NON_INTEGER_BED_COORDINATE",)]
    loose, _ = features.read_bed(spark, path, strict6=False)
    assert rows(loose, "gene_id", "strand") == [("g1", "+"), ("g3", "-")]


def test_repeats_map_lens(spark, rows, tmp_path):
    text = (
        "   SW  perc\nscore div\n\n"
        "  463   1.3  0.6  1.7  c1   11   20  (5) + A LTR/Gypsy 1 2\n"
        "  463   1.3  0.6  1.7  c1   30   20  (5) + A LTR/Copia 1 2\n"
        "  463   1.3  0.6  1.7  c1   1    9  (5) + A DNA/hAT 1 2\n"
        "  463   1.3  0.6  1.7  c1   1    9  (5) + A DNAX 1 2\n"
    )
    found = features.read_repeat_out(spark, put(tmp_path, "r.out", text))
    assert rows(found, "chrom", "start", "end", "category") == [
        ("c1", 0, 9, "dna"),
        ("c1", 0, 9, None),
        ("c1", 10, 20, "gypsy"),
    ]
    good, bad = features.read_chromosome_map(spark, put(tmp_path, "m.tsv", "genome_id\trepeatmasker_id\ng1\tChr1\nx\n"))
    assert rows(good) == [("g1", "Chr1", "chr1")] and bad.count() == 1
    lens, issues = features.read_lens(spark, put(tmp_path, "l", "c1 100 5\nc2 10.0 0\nc1 1 1\nc3 5\n"))
    assert rows(lens, "chrom", "length_bp", "ordered_genes") == [("c1", 1, 1), ("c1", 100, 5), ("c2", 10, 0)]
    assert rows(issues, "issue") == [("DUPLICATE",), ("MALFORMED",), ("NOT_POSITIVE",)]


def test_hits(spark, rows, tmp_path):
    line = "q\ts\t90.5\t10\t1\t0\t1\t10\t1\t10\t1e-20\t55.5\n"
    good, bad = hits.read_hits12(spark, put(tmp_path, "h", line + "q\ts\n" + line.replace("90.5", "x")))
    assert rows(good, "pident", "evalue") == [(90.5, 1e-20)] and bad.count() == 2
    eleven = "q\ts\t30.0\t10\t20\t30\t1e-5\t50\t50.0\t40\tsome title\n"
    good, _ = hits.read_hits11(spark, put(tmp_path, "h11", eleven))
    assert good.first()["stitle"] == "some title"
    domains = hits.read_domain_hits(spark, put(tmp_path, "d", "p1\tm\t5\tPfam\tx\np2\tm\n"))
    assert rows(domains) == [("p1", "Pfam")]


def test_collinearity(spark, rows, tmp_path):
    text = (
        "# params\n# mg = 40,40\n"
        "# Alignment 1: score=1248 pvalue=0.1029 N=2 chr1&chr2 plus\ng1 1 h1 5 1\ng2 2 h2 6 -1\n"
        "# Alignment 2: score=10 pvalue=0.5 N=1 chr1&chr3 minus\ng3 x h3 6 1\n# note\ng3 3 h3 7 1\n"
        "# Alignment bad header\ng9 1 h9 1 1\n"
    )
    found, pairs, rejects = blocks.read_collinearity(spark, put(tmp_path, "c", text))
    assert rows(found, "block_id", "score", "n", "chr_pair", "orientation") == [
        (1, 1248.0, 2, "chr1&chr2", "plus"),
        (2, 10.0, 1, "chr1&chr3", "minus"),
    ]
    assert rows(pairs, "block_id", "gene1", "order1", "gene2", "order2") == [
        (1, "g1", 1, "h1", 5),
        (1, "g2", 2, "h2", 6),
        (2, "g3", 3, "h3", 7),
    ]
    assert rows(rejects, "issue") == [("HEADER",), ("ROW",)]


def test_anchors(spark, rows, tmp_path):
    path = put(tmp_path, "a", "###\ng1\th1\t9\n# c\ng2\th2\n###\ng3\th3\nlonely\n")
    assert rows(blocks.read_anchors(spark, path), "block_no", "gene1", "gene2") == [
        (1, "g1", "h1"),
        (1, "g2", "h2"),
        (2, "g3", "h3"),
    ]


def test_blockinfo(spark, tmp_path):
    values = {c: "1" for c in blocks.BLOCKINFO} | {"ks": "0.1_0.2_", "block1": '"g1,g2"', "block2": "h1 h2"}
    text = ",".join(blocks.BLOCKINFO) + "\n" + ",".join(values[c] for c in blocks.BLOCKINFO) + "\n"
    row = blocks.read_blockinfo(spark, put(tmp_path, "b.csv", text)).first()
    assert (row["length"], row["block1"], row["ks"]) == (1.0, "g1,g2", "0.1_0.2_")
    with pytest.raises(GateError):
        blocks.read_blockinfo(spark, put(tmp_path, "x.csv", "id\n1\n"))


def test_tables(spark, rows, tmp_path):
    path = put(tmp_path, "t.tsv", "\ufeffa\tb\nx\t1\nNA\t2.5\ny\tbad\n")
    df = tables.read_table(spark, path, types={"b": "double"}, required=["a"])
    assert rows(df) == [("x", 1.0), ("y", None), (None, 2.5)]
    tables.write_table(spark.createDataFrame([("x", 2.675)], "a string, v double").coalesce(1), str(tmp_path / "w"), digits={"v": 2})
    text = "".join(p.read_text() for p in (tmp_path / "w").glob("part*"))
    assert text == "a\tv\nx\t2.67\n"


def test_reports(spark, rows, tmp_path):
    put(tmp_path, "k1.txt", "status=PASS\nx\nq = a=b\nstatus=FAIL\n")
    pairs = tables.read_key_values(spark, str(tmp_path / "k1.txt"))
    assert rows(tables.pivot_keys(pairs, ["status", "q", "none"]), "status", "q", "none") == [("FAIL", "a=b", None)]
    put(tmp_path, "b1", "C:1.0%[S:1.0%,D:0.0%],F:1%,M:98%,n:10\n C:98.7%[S:17.8%,D:80.9%],F:0.3%,M:1.0%,n:1614")
    put(tmp_path, "b2", "nothing")
    found = tables.read_busco(spark, [str(tmp_path / "b1"), str(tmp_path / "b2")])
    assert rows(found, "complete", "duplicated", "n") == [(98.7, 80.9, 1614.0), (None, None, None)]
    lines = [
        {"assemblyUnit": "Primary Assembly", "genbankAccession": "G1", "refseqAccession": "R1"},
        {"assemblyUnit": "Primary Assembly", "sequenceName": "n2"},
        {"assemblyUnit": "other", "genbankAccession": "G3"},
    ]
    report = put(tmp_path, "r.jsonl", "\n".join(json.dumps(x) for x in lines + lines))
    assert rows(tables.read_assembly_report(spark, report)) == [("G1",), ("n2",)]
    inventory = tables.file_inventory(spark, report).first()
    content = (tmp_path / "r.jsonl").read_bytes()
    assert inventory["bytes"] == len(content) and inventory["sha256"] == hashlib.sha256(content).hexdigest()


def test_locus_tables(spark, rows, tmp_path):
    loci = spark.createDataFrame(
        [("S", "c2", "g1", 5, 9, "+"), ("S", "c10", "g2", 0, 3, "-"), ("S", "c2", "g3", 1, 4, "+")],
        "species string, chrom string, gene_id string, start long, end long, strand string",
    )
    lengths = spark.createDataFrame([("S", "c2", 50), ("S", "c10", 60), ("S", "c3", 7)], "species string, chrom string, length_bp long")
    out = tables.locus_tables(loci, lengths)
    assert [tuple(r) for r in out["lens"].collect()] == [("S", "c2", 50, 2), ("S", "c10", 60, 1)]
    assert [(r["gene_id"], r["start"], r["order"]) for r in out["genes"].collect()] == [("g3", 2, 1), ("g1", 6, 2), ("g2", 1, 1)]
    tables.write_locus_tables(loci, lengths, str(tmp_path / "o"))
    assert (tmp_path / "o" / "genes" / "species=S").is_dir()


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lines_are_split_once(spark, rows):
    """Filters on cells must not repeat the work per row: the split stands once in the plan."""
    cells = "a b 99.5 10 1 0 1 2 3 4 1e-5 20".split()
    good, bad, short = "\t".join(cells), "\t".join([*cells[:-1], "none"]), "\t".join(cells[:11])
    lines = spark.createDataFrame([(v, "f", 0, 0) for v in (good + "\r", bad, short, "", None)], "value string, path string, block long, row long")
    found, rejected = hits.parse_hits(lines, hits.HIT12)
    assert [tuple(r) for r in found.collect()] == [("a", "b", 99.5, 10, 1, 0, 1, 2, 3, 4, 1e-5, 20.0)]
    assert rows(rejected, "value") == [(v,) for v in sorted([bad, short])]
    assert plan_of(found).count("split(") == plan_of(rejected).count("split(") == 1
    for df in (features.parse_gff(lines)[0], features.parse_repeats(lines), *features.parse_bed(lines)):
        assert plan_of(df).count("split(value") + plan_of(df).count("split(trim(regexp_replace(value") == 1
        assert plan_of(df).count("regexp_replace(value") <= 1


def test_repeats_at_awkward_numbers(spark, rows):
    row = "  {}  1.0 0 0 c1 {} {} (9) + rep DNA/L1 1"
    values = [row.format(*v) for v in (("+5", "007", "9"), ("5", "7.5", "9"), ("SW", "7", "9"), ("5", "9", "8"), ("5", "x", "9"))]
    lines = spark.createDataFrame([(v, "f") for v in [*values, "short 1 2", None]], "value string, path string")
    assert rows(features.parse_repeats(lines)) == [("c1", 6, 9, "DNA/L1", "dna")]


def test_anchor_records_are_written_once(spark):
    from __spark_entry__ import queries

    plan = plan_of(queries()["parsed_anchors"](spark, "/root/testdata/sf0.001"))
    assert "collect_list" not in plan and plan.count("split(trim(") == 1
