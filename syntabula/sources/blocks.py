"""Collinear blocks, anchors and block summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.quality import require_columns
from ..operators.scale import with_rank
from .tables import read_table
from .text import field, once, text_records, whole_number

# Fixed value: the text after `# Alignment `.
HEADER = r"^\s*(\d+):\s+score=(\S+)\s+pvalue=(\S+)\s+N=(\d+)\s+(\S+)\s+(\S+)"
# Fixed value: columns of a block summary.
BLOCKINFO = (
    "id", "chr1", "chr2", "start1", "end1", "start2", "end2", "pvalue", "length", "ks_median", "ks_average",
    "homo1", "homo2", "homo3", "homo4", "homo5", "block1", "block2", "ks", "tandem_ratio",
    "density1", "density2", "class1", "class2",
)
BLOCKINFO_NUMBERS = ("pvalue", "length", "ks_median", "ks_average", "tandem_ratio", "start1", "end1", "start2", "end2")


def read_collinearity(spark: SparkSession, path) -> tuple[DataFrame, DataFrame, DataFrame]:
    """parse_blocks() of files."""
    return parse_blocks(text_records(spark, path, "# Alignment "))


def parse_blocks(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(blocks, pairs, rejects) of `# Alignment` files; a record is one whole block.

    blocks: path, block_id, score, pvalue, n, chr_pair, orientation. pairs: path,
    block_id, gene1, order1, gene2, order2, cls. Rejects are malformed headers and
    malformed rows. Text before the first block is a preamble of comment lines.
    """
    records = records.withColumn("value", F.regexp_replace("value", "\r", ""))
    header = F.substring_index("value", "\n", 1)
    known = records.withColumn("_h", header).withColumn("_ok", F.col("_h").rlike(HEADER))

    def part(i: int):
        return F.regexp_extract("_h", HEADER, i)

    number = part(1).try_cast("long")
    blocks = known.filter("_ok").select(
        "path",
        number.alias("block_id"),
        part(2).try_cast("double").alias("score"),
        part(3).try_cast("double").alias("pvalue"),
        part(4).try_cast("long").alias("n"),
        part(5).alias("chr_pair"),
        part(6).alias("orientation"),
    )
    rows = (
        known.filter("_ok")
        .select("path", number.alias("block_id"), F.posexplode(F.split("value", "\n")).alias("_i", "line"))
        .filter((F.col("_i") > 0) & (F.trim("line") != "") & ~F.startswith(F.trim("line"), F.lit("#")))
        .withColumn("_f", F.split(F.trim("line"), r"\s+"))
        .select(
            "path",
            "block_id",
            "line",
            field("_f", 0).alias("gene1"),
            whole_number(field("_f", 1)).alias("order1"),
            field("_f", 2).alias("gene2"),
            whole_number(field("_f", 3)).alias("order2"),
            field("_f", 4).try_cast("double").alias("cls"),
        )
    )
    sound = F.col("order1").isNotNull() & F.col("order2").isNotNull() & F.col("cls").isNotNull()
    preamble = F.startswith(F.trim("_h"), F.lit("#")) | (F.trim("value") == "")
    bad_headers = known.filter(~F.col("_ok") & ~preamble).select("path", F.col("_h").alias("line"), F.lit("HEADER").alias("issue"))
    bad_rows = rows.filter(~sound).select("path", "line", F.lit("ROW").alias("issue"))
    return blocks, rows.filter(sound).drop("line"), bad_headers.unionByName(bad_rows)


def read_anchors(spark: SparkSession, path) -> DataFrame:
    """parse_anchors() of files."""
    return parse_anchors(text_records(spark, path, "###"))


def parse_anchors(records: DataFrame) -> DataFrame:
    """path, block_no, gene1, gene2. `###` opens a block; other `#` lines are skipped."""
    records = records.withColumn("value", F.regexp_replace("value", "\r", ""))
    # Numbered before exploding: one row per block. Text before the first mark is block 0.
    numbered = with_rank(records, ["path"], [F.col("block"), F.col("row")], "_n")
    lines = numbered.select("path", (F.col("_n") - 1).alias("block_no"), F.explode(F.split("value", "\n")).alias("line"))
    lines = lines.filter((F.trim("line") != "") & ~F.startswith(F.col("line"), F.lit("#")))
    return (
        once(lines, F.split(F.trim("line"), r"\s+"), "_f")
        .filter(F.size("_f") >= 2)
        .select("path", "block_no", field("_f", 0).alias("gene1"), field("_f", 1).alias("gene2"))
    )


def read_blockinfo(spark: SparkSession, path) -> DataFrame:
    """parse_blockinfo() of a CSV file."""
    return parse_blockinfo(read_table(spark, path, ",", null_values=()))


def parse_blockinfo(cells: DataFrame) -> DataFrame:
    """Text cells of block summaries with the numbers cast; list cells stay text for parse_value_list and parse_gene_list."""
    df = require_columns(cells, BLOCKINFO)
    return df.withColumns({c: F.trim(F.col(c)).try_cast("double") for c in BLOCKINFO_NUMBERS})
