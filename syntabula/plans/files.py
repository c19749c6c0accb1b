"""Parsers and printers of the file formats, on text built from the driver tables.

Each query writes a table as lines of one format, some of them malformed, and parses
them again; the SQL reads the same table directly.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values
from ..operators import quality
from ..session import cut_lineage
from ..sources import blocks, fasta, features, hits, tables
from .homology import lines
from .registry import query, table


def records(df, value, path="file", row=None):
    """Lines as a reader would give them: value, path, block and row."""
    return df.select(
        value.alias("value"), F.lit(path).alias("path") if isinstance(path, str) else path.alias("path"),
        F.lit(0).cast("long").alias("block"), (F.monotonically_increasing_id() if row is None else row).alias("row"),
    )


def text(*parts, sep="\t"):
    return F.concat_ws(sep, *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


class _Line:
    """Line-item columns by short names; made when asked for, so that importing needs no session."""

    NAMES = {
        "order": "l_orderkey", "line": "l_linenumber", "part": "l_partkey", "supplier": "l_suppkey", "flag": "l_returnflag", "status": "l_linestatus",
    }

    def __getattr__(self, name):
        return F.col(self.NAMES[name])


L = _Line()


def _gff(spark, sf):
    end = F.when(L.flag == "R", F.concat(F.lit("x"), L.order.cast("string"))).otherwise((L.order + 9).cast("string"))
    whole = text(L.part, "lab", "gene", L.order, end, ".", L.status, ".", F.concat(F.lit("ID=g"), L.supplier.cast("string"), F.lit(";Name=n"), L.line.cast("string")))
    short = text(L.part, "lab", "gene", L.order, end)
    comment = F.concat(F.lit("# "), L.order.cast("string"))
    value = F.when(L.line == 7, comment).when((L.flag == "A") & (L.line == 1), short).otherwise(whole)
    return features.parse_gff(records(lines(spark, sf), value))


@query(
    "parsed_gff",
    """SELECT CAST(l_partkey AS VARCHAR) AS seqid, 'gene' AS feature, l_orderkey AS start, l_orderkey + 9 AS "end", l_linestatus AS strand,
      'g' || l_suppkey AS id, 'n' || l_linenumber AS name
    FROM lineitem WHERE l_linenumber <> 7 AND l_returnflag <> 'R' AND NOT (l_returnflag = 'A' AND l_linenumber = 1)""",
)
def parsed_gff(spark, sf):
    rows = _gff(spark, sf)[0]
    return rows.select("seqid", "feature", "start", "end", "strand", F.col("attributes")["ID"].alias("id"), F.col("attributes")["Name"].alias("name"))


@query(
    "rejected_gff",
    """SELECT CASE WHEN l_returnflag = 'A' AND l_linenumber = 1 THEN 'FEWER_THAN_NINE_FIELDS' ELSE 'NON_INTEGER_COORDINATE' END AS issue, count(*) AS n
    FROM lineitem WHERE l_linenumber <> 7 AND (l_returnflag = 'R' OR (l_returnflag = 'A' AND l_linenumber = 1)) GROUP BY ALL""",
)
def rejected_gff(spark, sf):
    return _gff(spark, sf)[1].groupBy("issue").agg(F.count("*").alias("n"))


def _bed(spark, sf):
    start = F.when(L.flag == "R", F.lit("?")).otherwise(L.order.cast("string"))
    six = text(L.part, start, L.order + L.line, F.concat(F.lit("g"), L.supplier.cast("string")), "0", F.when(L.status == "O", "+").otherwise("-"))
    value = F.when(L.line == 6, text(L.part, start, L.order + L.line)).otherwise(F.concat(six, F.lit("\r")))
    return features.parse_bed(records(lines(spark, sf), value))


@query(
    "parsed_bed",
    """SELECT CAST(l_partkey AS VARCHAR) AS chrom, l_orderkey AS start, l_orderkey + l_linenumber AS "end", 'g' || l_suppkey AS gene_id,
      CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS strand FROM lineitem WHERE l_linenumber <> 6 AND l_returnflag <> 'R'""",
)
def parsed_bed(spark, sf):
    return _bed(spark, sf)[0].select("chrom", "start", "end", "gene_id", "strand")


@query(
    "rejected_bed",
    """SELECT CASE WHEN l_linenumber = 6 THEN 'BED_COLUMN_COUNT_NOT_SIX' ELSE 'NON_INTEGER_BED_COORDINATE' END AS issue, count(*) AS n
    FROM lineitem WHERE l_linenumber = 6 OR l_returnflag = 'R' GROUP BY ALL""",
)
def rejected_bed(spark, sf):
    return _bed(spark, sf)[1].groupBy("issue").agg(F.count("*").alias("n"))


@query(
    "parsed_repeats",
    """SELECT 'c' || l_partkey AS chrom, l_orderkey - 1 AS start, l_orderkey + l_linenumber AS "end", 'DNA/L' || l_linenumber AS repeat_class, 'dna' AS category
    FROM lineitem WHERE l_returnflag <> 'N'""",
)
def parsed_repeats(spark, sf):
    score = F.when(L.flag == "N", "SW").otherwise(L.order.cast("string"))
    row = text(score, "1.0", "0", "0", F.concat(F.lit("c"), L.part.cast("string")), L.order, L.order + L.line, "(9)", "+", "rep", F.concat(F.lit("DNA/L"), L.line.cast("string")), "1", sep="   ")
    return features.parse_repeats(records(lines(spark, sf), F.concat(F.lit("  "), row)))


def _hit_lines(spark, sf):
    cells = [L.part, L.supplier, L.line * 10, L.order, L.line, L.line - 1, L.order + 1, L.order + 2, L.order + 3, L.order + 4, F.lit("1e-5"), F.when(L.flag == "R", "none").otherwise(L.order.cast("string"))]
    return records(lines(spark, sf), F.when(L.line == 7, text(*cells[:11])).otherwise(text(*cells)))


@query(
    "parsed_hits",
    """SELECT CAST(l_partkey AS VARCHAR) AS qseqid, CAST(l_suppkey AS VARCHAR) AS sseqid, CAST(l_linenumber * 10 AS DOUBLE) AS pident,
      l_orderkey AS length, l_orderkey + 4 AS send, CAST(0.00001 AS DOUBLE) AS evalue, CAST(l_orderkey AS DOUBLE) AS bitscore
    FROM lineitem WHERE l_linenumber <> 7 AND l_returnflag <> 'R'""",
)
def parsed_hits(spark, sf):
    good = hits.parse_hits(_hit_lines(spark, sf), hits.HIT12)[0]
    return good.select("qseqid", "sseqid", "pident", "length", "send", "evalue", "bitscore")


@query("rejected_hits", "SELECT count(*) AS n FROM lineitem WHERE l_linenumber = 7 OR l_returnflag = 'R'")
def rejected_hits(spark, sf):
    return hits.parse_hits(_hit_lines(spark, sf), hits.HIT12)[1].agg(F.count("*").alias("n"))


@query(
    "parsed_coverage_hits",
    """SELECT CAST(l_partkey AS VARCHAR) AS qseqid, l_orderkey + 1 AS qlen, CAST(l_linenumber AS DOUBLE) AS qcovhsp, 'title ' || l_suppkey AS stitle FROM lineitem""",
)
def parsed_coverage_hits(spark, sf):
    cells = [L.part, L.supplier, L.line, L.order, L.order + 1, L.order + 2, F.lit("0.0"), L.line, L.line, L.line, F.concat(F.lit("title "), L.supplier.cast("string"))]
    good = hits.parse_hits(records(lines(spark, sf), text(*cells)), hits.HIT11)[0]
    return good.select("qseqid", "qlen", "qcovhsp", "stitle")


@query(
    "parsed_domain_hits",
    "SELECT 'p' || l_partkey AS protein_id, l_returnflag AS application, count(*) AS n FROM lineitem WHERE l_linenumber <> 2 GROUP BY ALL",
)
def parsed_domain_hits(spark, sf):
    name = F.concat(F.lit("p"), L.part.cast("string"))
    value = F.when(L.line == 2, text(name, "x")).otherwise(text(name, "md5", L.order, L.flag, "tail"))
    found = hits.parse_domain_hits(records(lines(spark, sf), value))
    return found.groupBy("protein_id", "application").agg(F.count("*").alias("n"))


def _block_records(spark, sf):
    """One record per order: a header and a line per item; line number 5 is malformed."""
    second = F.when(L.line == 5, F.lit("bad")).otherwise(L.supplier.cast("string"))
    item = text(F.concat(F.lit("a"), L.part.cast("string")), L.line, F.concat(F.lit("b"), L.supplier.cast("string")), second, "1", sep=" ")
    grouped = lines(spark, sf).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(L.line.alias("k"), item.alias("v")))).alias("g"))
    header = F.concat(L.order.cast("string"), F.lit(": score=12.5 pvalue=0.25 N="), F.size("g").cast("string"), F.lit(" c1&c2 plus"))
    header = F.when(L.order % 10 == 3, F.concat(F.lit("broken "), L.order.cast("string"))).otherwise(header)
    return records(grouped, F.concat(header, F.lit("\n"), F.array_join(F.transform("g", lambda x: x["v"]), "\n"), F.lit("\n\n")))


@query(
    "parsed_blocks",
    """SELECT l_orderkey AS block_id, count(*) AS n, CAST(12.5 AS DOUBLE) AS score, CAST(0.25 AS DOUBLE) AS pvalue, 'c1&c2' AS chr_pair, 'plus' AS orientation,
      count(*) FILTER (l_linenumber <> 5) AS pairs, CAST(sum(l_suppkey) FILTER (l_linenumber <> 5) AS BIGINT) AS order2
    FROM lineitem WHERE l_orderkey % 10 <> 3 GROUP BY ALL""",
)
def parsed_blocks(spark, sf):
    found, pairs, _ = blocks.parse_blocks(_block_records(spark, sf))
    members = pairs.groupBy("block_id").agg(F.count("*").alias("pairs"), F.sum("order2").alias("order2"))
    head = found.select("block_id", "n", "score", "pvalue", "chr_pair", "orientation")
    return head.join(members, "block_id", "left").withColumn("pairs", F.coalesce("pairs", F.lit(0).cast("long")))


@query(
    "rejected_blocks",
    """SELECT 'HEADER' AS issue, count(DISTINCT l_orderkey) AS n FROM lineitem WHERE l_orderkey % 10 = 3 HAVING count(*) > 0
    UNION ALL SELECT 'ROW', count(*) FROM lineitem WHERE l_orderkey % 10 <> 3 AND l_linenumber = 5 HAVING count(*) > 0""",
)
def rejected_blocks(spark, sf):
    return blocks.parse_blocks(_block_records(spark, sf))[2].groupBy("issue").agg(F.count("*").alias("n"))


@query(
    "parsed_anchors",
    """SELECT l_returnflag AS path, CAST(dense_rank() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey) - 1 AS BIGINT) AS block_no,
      'a' || l_partkey AS gene1, 'b' || l_suppkey AS gene2 FROM lineitem WHERE l_linenumber <> 4""",
)
def parsed_anchors(spark, sf):
    item = F.when(L.line == 4, F.lit("#note")).otherwise(text(F.concat(F.lit("a"), L.part.cast("string")), F.concat(F.lit("b"), L.supplier.cast("string")), "50", sep="\t"))
    grouped = (
        lines(spark, sf).groupBy("l_returnflag", "l_orderkey")
        .agg(F.array_sort(F.collect_list(F.struct(L.line.alias("k"), item.alias("v")))).alias("g"))
        .filter(F.exists("g", lambda x: x["k"] != 4))
    )
    value = F.concat(F.lit("\n"), F.array_join(F.transform("g", lambda x: x["v"]), "\n"))
    # Numbering reads the records several times, so they are written once, as a file would be.
    return blocks.parse_anchors(cut_lineage(records(grouped, value, L.flag, L.order)))


@query(
    "parsed_blockinfo",
    """SELECT CAST(l_orderkey AS VARCHAR) AS id, CASE WHEN count(*) <> 2 THEN CAST(count(*) AS DOUBLE) END AS length,
      CAST(sum(l_quantity) AS DOUBLE) AS ks_total, string_agg('g ' || l_partkey || ',' || l_linenumber, ';' ORDER BY l_linenumber, l_partkey) AS genes1,
      string_agg('h' || l_suppkey, ';' ORDER BY l_linenumber, l_suppkey) AS genes2 FROM lineitem GROUP BY l_orderkey""",
)
def parsed_blockinfo(spark, sf):
    """Orders as block summaries: one list cell literal, with blanks and commas within quotes, the other joined by blanks."""
    ordered = lambda item: F.transform(F.array_sort(F.collect_list(item)), lambda x: x["v"])
    first = F.struct(L.line.alias("k"), L.part.alias("p"), F.concat(F.lit("'g "), L.part.cast("string"), F.lit(","), L.line.cast("string"), F.lit("'")).alias("v"))
    second = F.struct(L.line.alias("k"), L.supplier.alias("p"), F.concat(F.lit("h"), L.supplier.cast("string")).alias("v"))
    cells = lines(spark, sf).groupBy("l_orderkey").agg(
        F.when(F.count("*") == 2, "two").otherwise(F.count("*").cast("string")).alias("length"),
        F.concat(F.lit("["), F.array_join(ordered(first), ", "), F.lit("]")).alias("block1"),
        F.array_join(ordered(second), " ").alias("block2"),
        F.array_join(F.collect_list(F.col("l_quantity").cast("string")), "_").alias("ks"),
    )
    others = [F.lit("1").alias(c) for c in blocks.BLOCKINFO if c not in ("id", "length", "block1", "block2", "ks")]
    parsed = blocks.parse_blockinfo(cells.select(L.order.cast("string").alias("id"), "length", "block1", "block2", "ks", *others))
    total = F.aggregate(values.parse_value_list(F.col("ks")), F.lit(0.0), lambda a, x: a + x)
    genes = [F.array_join(values.parse_gene_list(F.col(f"block{i}")), ";").alias(f"genes{i}") for i in (1, 2)]
    return parsed.select("id", "length", total.alias("ks_total"), *genes)


@query(
    "parsed_assembly_report",
    """SELECT DISTINCT CASE WHEN l_linenumber > 2 THEN 'G' || l_partkey WHEN l_linenumber = 2 THEN 'R' || l_partkey ELSE 's' || l_suppkey END AS seq_id
      FROM lineitem WHERE l_returnflag <> 'N' AND l_linenumber NOT IN (3, 7)""",
)
def parsed_assembly_report(spark, sf):
    """Line items as JSON lines: fields left out, blank ids (3) and broken objects (7) among them."""
    unit = F.when(L.flag == "N", "alt").otherwise("Primary Assembly").alias("assemblyUnit")
    name = lambda letter, col: F.concat(F.lit(letter), col.cast("string"))
    genbank = F.when(L.line == 3, " ").when(L.line > 2, name("G", L.part)).alias("genbankAccession")
    refseq = F.when(L.line >= 2, name("R", L.part)).alias("refseqAccession")
    whole = F.to_json(F.struct(unit, genbank, refseq, name("s", L.supplier).alias("sequenceName"), L.order.alias("length")))
    value = F.when(L.line == 7, F.lit('{"assemblyUnit": "Primary')).otherwise(whole)
    return tables.parse_assembly_report(lines(spark, sf).select(value.alias("value")))


def _lens(spark, sf):
    part = table(spark, sf, "part")
    count = F.when(F.col("p_size") == 1, F.lit("0")).otherwise(F.col("p_size").cast("string"))
    name = F.when(F.col("p_size") == 2, F.lit("twice")).otherwise(F.concat(F.lit("c"), F.col("p_partkey").cast("string")))
    value = F.when(F.col("p_size") == 3, text(name, "5", sep=" ")).otherwise(text(name, F.col("p_partkey") * 10 + 10, count, sep=" "))
    return features.parse_lens(records(part, value))


@query(
    "parsed_lens",
    """SELECT CASE WHEN p_size = 2 THEN 'twice' ELSE 'c' || p_partkey END AS chrom, p_partkey * 10 + 10 AS length_bp,
      CAST(CASE WHEN p_size = 1 THEN 0 ELSE p_size END AS BIGINT) AS ordered_genes FROM part WHERE p_size <> 3""",
)
def parsed_lens(spark, sf):
    return _lens(spark, sf)[0].select("chrom", "length_bp", "ordered_genes")


@query(
    "lens_issues",
    """SELECT 'MALFORMED' AS issue, count(*) AS n FROM part WHERE p_size = 3 HAVING count(*) > 0
    UNION ALL SELECT 'NOT_POSITIVE', count(*) FROM part WHERE p_size = 1 HAVING count(*) > 0
    UNION ALL SELECT 'DUPLICATE', 1 FROM part WHERE p_size = 2 HAVING count(*) > 1""",
)
def lens_issues(spark, sf):
    return _lens(spark, sf)[1].groupBy("issue").agg(F.count("*").alias("n"))


@query(
    "parsed_chromosome_map",
    "SELECT 'G' || p_partkey AS genome_id, 'Chr' || p_size AS repeat_id, 'chr' || p_size AS display FROM part WHERE p_size % 5 <> 0",
)
def parsed_chromosome_map(spark, sf):
    both = text(F.concat(F.lit("G"), F.col("p_partkey").cast("string")), F.concat(F.lit(" Chr"), F.col("p_size").cast("string")))
    value = F.when(F.col("p_size") % 5 == 0, text(F.col("p_partkey"))).otherwise(both)
    return features.parse_chromosome_map(records(table(spark, sf, "part"), value))[0]


@query(
    "parsed_key_values",
    """SELECT path, key, value FROM (SELECT l_returnflag AS path, 'k' || l_linenumber AS key, l_orderkey || '=x' AS value,
      row_number() OVER (PARTITION BY l_returnflag, l_linenumber ORDER BY l_orderkey DESC) AS r FROM lineitem) WHERE r = 1""",
)
def parsed_key_values(spark, sf):
    value = F.concat(F.lit(" k"), L.line.cast("string"), F.lit(" = "), L.order.cast("string"), F.lit("=x "))
    return tables.parse_key_values(records(lines(spark, sf), value, L.flag, L.order))


@query(
    "parsed_completeness",
    """SELECT CAST(p_partkey AS VARCHAR) AS path, CASE WHEN p_size > 5 THEN CAST(p_size AS DOUBLE) + 0.5 END AS complete,
      CASE WHEN p_size > 5 THEN CAST(p_partkey AS DOUBLE) END AS n FROM part""",
)
def parsed_completeness(spark, sf):
    size = F.col("p_size").cast("string")
    line = F.concat(F.lit("old C:1.0%[S:1.0%,D:0.0%],F:0.0%,M:99.0%,n:1\n\tC:"), size, F.lit(".5%[S:90.0%,D:1.5%],F:3.0%,M:4.0%,n:"), F.col("p_partkey").cast("string"))
    value = F.when(F.col("p_size") > 5, line).otherwise(F.lit("no summary"))
    texts = table(spark, sf, "part").select(value.alias("value"), F.col("p_partkey").cast("string").alias("path"))
    return tables.parse_busco(texts).select("path", "complete", "n")


@query(
    "printed_and_parsed_fasta",
    """SELECT 'd' || doc_id AS seq_id, length(regexp_replace(coalesce(text, ''), '[\\s\\v]+', '', 'g')) AS length,
      md5(regexp_replace(coalesce(text, ''), '[\\s\\v]+', '', 'g')) AS md5 FROM documents""",
)
def printed_and_parsed_fasta(spark, sf):
    text = F.coalesce("text", F.lit(""))
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("seq_id")
    seqs = table(spark, sf, "documents").select(name, F.regexp_replace(text, r"[\s\x0B]+", "").alias("sequence"))
    back = fasta.parse_fasta(records(fasta.fasta_records(seqs), F.col("value")))
    return back.select("seq_id", F.length("sequence").cast("long").alias("length"), F.md5("sequence").alias("md5"))


@query(
    "typed_cells",
    """SELECT CAST(l_orderkey AS VARCHAR) AS name, CASE WHEN l_returnflag = 'A' THEN l_suppkey END AS number, CASE WHEN l_returnflag <> 'R' THEN l_linestatus END AS sign
    FROM lineitem""",
)
def typed_cells(spark, sf):
    number = F.when(L.flag == "A", F.concat(F.lit(" "), L.supplier.cast("string"))).when(L.flag == "N", "n/a").otherwise("NA")
    cells = lines(spark, sf).select(L.order.cast("string").alias("name"), number.alias("number"), F.when(L.flag == "R", "NA").otherwise(L.status).alias("sign"))
    return tables.typed_cells(cells, {"number": "long"}, required=["name"])


@query(
    "shown_cells",
    """SELECT l_orderkey, l_linenumber, printf('%.1f', CAST(l_linenumber AS DOUBLE) / 8 + CAST(l_orderkey AS DOUBLE) / 4) AS shown,
      printf('%.3f', CAST(l_suppkey AS DOUBLE) / 16) AS third FROM lineitem""",
)
def shown_cells(spark, sf):
    found = lines(spark, sf).select(
        "l_orderkey", "l_linenumber", (L.line.cast("double") / 8 + L.order.cast("double") / 4).alias("shown"), (L.supplier.cast("double") / 16).alias("third")
    )
    return tables.shown_cells(found, {"shown": 1, "third": 3})


@query(
    "locus_tables",
    """SELECT l_returnflag AS species, CAST(l_linenumber AS VARCHAR) AS chrom, count(*) AS ordered_genes, any_value(l_linenumber) * 1000 AS length_bp
    FROM lineitem GROUP BY ALL""",
)
def locus_tables(spark, sf):
    df = lines(spark, sf)
    loci = df.select(
        L.flag.alias("species"), L.line.cast("string").alias("chrom"), text(L.order, L.part, L.supplier, sep="_").alias("gene_id"), L.order.alias("start"),
        (L.order + 5).alias("end"), F.lit("+").alias("strand"),
    )
    lengths = df.select(L.flag.alias("species"), L.line.cast("string").alias("chrom"), (L.line * 1000).cast("long").alias("length_bp")).distinct()
    return tables.locus_tables(loci, lengths)["lens"].select("species", "chrom", "ordered_genes", "length_bp")


@query(
    "gate_issues",
    """SELECT l_returnflag, count(*) AS failed FROM lineitem WHERE NOT (l_quantity >= 5 AND l_discount < 0.09) GROUP BY ALL""",
)
def gate_issues(spark, sf):
    broken = quality.failing(lines(spark, sf), (F.col("l_quantity") >= 5) & (F.col("l_discount") < 0.09))
    return broken.groupBy("l_returnflag").agg(F.count("*").alias("failed"))
