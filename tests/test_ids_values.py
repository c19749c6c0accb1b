from pyspark.sql import functions as F

from syntabula.functions import ids, sequence as S, values as V


def one(spark, expr, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    return [r["x"] for r in df.select("i", expr(F.col("t")).alias("x")).orderBy("i").collect()]


def test_ids(spark):
    assert one(spark, ids.normalize_id, " gene:g1 ", "g:x") == ["g1", "g:x"]
    assert one(spark, ids.id_variants, "transcript:a|b.t1", "x.p12", "y.protein3 z", "q.t1") == [
        ["a|b.t1", "a|b", "a", "b.t1"],
        ["x.p12", "x"],
        ["y.protein3 z", "y.protein3"],
        ["q.t1", "q"],
    ]
    assert one(spark, lambda c: ids.prefix_id(F.lit("AB"), c), "g1", "AB_g1", "gene:g2") == ["AB_g1", "AB_g1", "AB_g2"]


def test_natural_key(spark):
    names = ["chr10", "chr2", "Chr1", "chrX", "chr02b", "a", "12345678901234567890123", "9"]
    keys = one(spark, ids.natural_key, *names)
    assert [n for _, n in sorted(zip(keys, names))] == ["9", "12345678901234567890123", "a", "Chr1", "chr2", "chr02b", "chr10", "chrX"]


def test_chromosome_number(spark):
    assert one(spark, ids.chromosome_number, "chr_07", "x-12", "seq9", "none") == [7, 12, 9, None]
    found = one(spark, lambda c: ids.chromosome_number(c, F.lit("Plant chromosome: 4, whole")), "chr9")
    assert found == [4]
    whole = one(spark, lambda c: ids.chromosome_number(c, rule="whole_header"), "CP1 some Chromosome 3", "chr_8 x", "x9")
    assert whole == [3, 8, None]


def test_attributes(spark):
    text = 'gene_id "g1"; transcript_id "t1"; ID=i1; Parent = p1,p2; ID=i2; gene_id=late'
    got = one(spark, ids.parse_attributes, text, "", 'k "a"; k "b"')
    assert got == [{"gene_id": "g1", "transcript_id": "t1", "ID": "i1", "Parent": "p1,p2"}, {}, {"k": "b"}]
    parsed = spark.createDataFrame([("ID=gene:x,y;Parent=transcript:t5",)], "t string").select(ids.parse_attributes(F.col("t")).alias("a"))
    row = parsed.select(
        ids.transcript_id(F.col("a"), F.lit("mRNA")).alias("own"),
        ids.transcript_id(F.col("a"), F.lit("CDS")).alias("child"),
        ids.gene_id(F.col("a")).alias("gene"),
    ).first()
    assert tuple(row) == ("x", "t5", "t5")


def test_labels(spark):
    assert one(spark, ids.classify_repeat, "LTR/Gypsy", "LTR/Copia", "DNA", "DNA/x", "DNAX") == ["gypsy", "copia", "dna", "dna", None]
    assert one(spark, ids.ploidy_number, "4x", "x4", "10x") == [4, 0, 10]
    assert one(spark, lambda c: ids.ploidy_group(c, F.lit(True)), "4x", "2x") == ["TETRAPLOID", "OUTGROUP"]


def test_numbers(spark):
    got = one(spark, V.classify_number, "", " 1.5e-3 ", "nan", "-Inf", "x", "-1e-13", "-1", None, "1e999", "1d", "0x1")
    assert [r["class"] for r in got] == [
        "missing", "finite", "nan", "infinite", "nonnumeric", "finite", "finite", "missing", "infinite", "nonnumeric", "nonnumeric",
    ]
    assert [r["negative"] for r in got][5:7] == [False, True] and got[1]["value"] == 0.0015


def test_lists(spark):
    assert one(spark, V.parse_value_list, "0.1__2_nan_inf_-1e-13_") == [[0.1, 2.0, 0.0]]
    assert one(spark, V.parse_gene_list, "['a_1', \"b\"]", "a,b;c|d e", "NA", None, "(x)") == [
        ["a_1", "b"],
        ["a", "b", "c", "d", "e"],
        [],
        [],
        ["x"],
    ]
    assert one(spark, lambda c: V.parse_gene_list(c, "_"), "a_b") == [["a", "b"]]


def test_literal_gene_lists(spark):
    long = [f"g {i},{i}" for i in range(20_000)]
    cases = {
        """['a b', "c,d"]""": ["a b", "c,d"],
        """("it's", 'x"y' , 'p\\'q', '[r]',)""": ["it's", 'x"y', "p'q", "[r]"],
        "[12, -3, '0']": ["12", "-3", "0"],
        "['', ' s ']": ["s"],
        "[]": [],
        "['a' 'b']": ["a", "b"],
        "['a b, c]": ["a", "b", "c"],
        "[g1, g 2]": ["g1", "g", "2"],
        "['a',,'b']": ["a", "b"],
        "'a b'": ["a", "b"],
        str(long): long,
        f"['{'x ' * 50_000}y']": ["x " * 50_000 + "y"],
    }
    assert one(spark, V.parse_gene_list, *cases) == list(cases.values())


def test_sequences(spark):
    assert one(spark, S.gc_fraction, "ACGTNN", "NNN", "ggca") == [0.5, None, 0.75]
    kinds = one(spark, S.sequence_type, "ACGTN-acgtu", "MEFILPQ", "--", "A" * 99 + "E")
    assert [k["type"] for k in kinds] == ["NUCLEOTIDE", "PROTEIN_OR_NONNUCLEOTIDE", "EMPTY", "NUCLEOTIDE"]
    assert [tuple(r) for r in one(spark, S.clean_sequence, "mk*l**", "**", "M1")] == [("MK*L", None), ("", "EMPTY"), ("M1", "INVALID_LETTERS")]
    assert [tuple(r) for r in one(spark, lambda c: S.clean_sequence(c, stops="all"), "mk*l**")] == [("MKL", None)]
    assert [tuple(r) for r in one(spark, lambda c: S.clean_sequence(c, "cds"), "acu", "AC*")] == [("ACT", None), ("AC*", "INVALID_LETTERS")]
