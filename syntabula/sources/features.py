"""Annotation, locus and repeat files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.ids import classify_repeat, parse_attributes
from .text import data_lines, field, once, text_records, whole_number


def read_gff(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """parse_gff() of files."""
    return parse_gff(text_records(spark, path))


def parse_gff(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nine columns with the attributes as a map; too few fields or non-integer
    coordinates are rejects."""
    parts = once(data_lines(records), F.split("value", "\t"), "_f")
    parts = once(parts, F.struct(whole_number(field("_f", 3)).alias("start"), whole_number(field("_f", 4)).alias("end")), "_n")
    start, end = F.col("_n")["start"], F.col("_n")["end"]
    issue = F.when(F.size("_f") < 9, "FEWER_THAN_NINE_FIELDS").when(start.isNull() | end.isNull(), "NON_INTEGER_COORDINATE")
    judged = parts.withColumn("issue", issue)
    names = {0: "seqid", 1: "source", 2: "feature", 5: "score", 6: "strand", 7: "phase"}
    rows = judged.filter(F.col("issue").isNull()).select(
        *[field("_f", i).alias(n) for i, n in names.items()],
        start.alias("start"),
        end.alias("end"),
        parse_attributes(field("_f", 8)).alias("attributes"),
        "path",
    )
    return rows, judged.filter(F.col("issue").isNotNull()).select("path", "value", "issue")


def gene_loci(features: DataFrame, feature: str = "gene") -> DataFrame:
    """Rows of one feature type as half-open loci."""
    return features.filter(F.lower("feature") == feature).select(
        F.col("seqid").alias("chrom"), (F.col("start") - 1).alias("start"), "end", "strand", "attributes"
    )


def read_bed(spark: SparkSession, path, strict6: bool = True) -> tuple[DataFrame, DataFrame]:
    """parse_bed() of files."""
    return parse_bed(text_records(spark, path), strict6)


def parse_bed(records: DataFrame, strict6: bool = True) -> tuple[DataFrame, DataFrame]:
    """chrom, start, end, gene_id, score, strand (half-open).

    strict6 wants exactly six tab fields. Otherwise four are enough, blanks may
    separate them, and the strand is looked for in column 6, then 5, else `+`.
    """
    lines = data_lines(records)
    tabs = F.split("value", "\t")
    if strict6:
        parts = once(lines, tabs, "_f")
        wrong = F.when(F.size("_f") != 6, "BED_COLUMN_COUNT_NOT_SIX")
        strand = field("_f", 5)
    else:
        blanks = F.split(F.trim("value"), r"\s+")
        parts = once(lines, F.when(F.size(tabs) < 4, blanks).otherwise(tabs), "_f")
        wrong = F.when(F.size("_f") < 4, "FEWER_THAN_FOUR_FIELDS")
        strand = (
            F.when(field("_f", 5).isin("+", "-"), field("_f", 5))
            .when(field("_f", 4).isin("+", "-"), field("_f", 4))
            .otherwise("+")
        )
    parts = once(parts, F.struct(whole_number(field("_f", 1)).alias("start"), whole_number(field("_f", 2)).alias("end")), "_n")
    start, end = F.col("_n")["start"], F.col("_n")["end"]
    judged = parts.withColumn("issue", F.coalesce(wrong, F.when(start.isNull() | end.isNull(), "NON_INTEGER_BED_COORDINATE")))
    rows = judged.filter(F.col("issue").isNull()).select(
        field("_f", 0).alias("chrom"),
        start.alias("start"),
        end.alias("end"),
        field("_f", 3).alias("gene_id"),
        field("_f", 4).alias("score"),
        strand.alias("strand"),
        "path",
        "block",
        "row",
    )
    return rows, judged.filter(F.col("issue").isNotNull()).select("path", "value", "issue")


def read_repeat_out(spark: SparkSession, path) -> DataFrame:
    """parse_repeats() of files."""
    return parse_repeats(text_records(spark, path))


def parse_repeats(records: DataFrame) -> DataFrame:
    """chrom, start, end, repeat_class, category of the rows whose first field is an integer."""
    parts = once(records, F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " "), "_f")
    parts = parts.filter((F.size("_f") >= 11) & whole_number(field("_f", 0)).isNotNull())
    place = F.struct((whole_number(field("_f", 5)) - 1).alias("start"), whole_number(field("_f", 6)).alias("end"))
    return (
        once(parts, place, "_n")
        .filter(F.col("_n")["end"] > F.col("_n")["start"])
        .select(
            field("_f", 4).alias("chrom"),
            F.col("_n")["start"].alias("start"),
            F.col("_n")["end"].alias("end"),
            field("_f", 10).alias("repeat_class"),
            classify_repeat(field("_f", 10)).alias("category"),
        )
    )


def read_chromosome_map(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """parse_chromosome_map() of files."""
    return parse_chromosome_map(text_records(spark, path))


def parse_chromosome_map(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """genome_id, repeat_id, display; rows without exactly two columns are rejects."""
    parts = once(data_lines(records), F.split("value", "\t"), "_f")
    rows = parts.filter(F.size("_f") == 2).select(
        F.trim(field("_f", 0)).alias("genome_id"),
        F.trim(field("_f", 1)).alias("repeat_id"),
        F.lower(F.trim(field("_f", 1))).alias("display"),
    )
    header = (F.col("genome_id") == "genome_id") & (F.col("repeat_id") == "repeatmasker_id")
    return rows.filter(~header), parts.filter(F.size("_f") != 2).select("path", "value")


def read_lens(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """parse_lens() of files."""
    return parse_lens(text_records(spark, path))


def parse_lens(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """chrom, length_bp, ordered_genes per file, and issues: short rows, repeated
    chromosomes, counts that are not positive."""
    parts = once(data_lines(records, comment=None), F.split(F.trim("value"), r"\s+"), "_f")
    rows = parts.filter(F.size("_f") >= 3).select(
        "path",
        field("_f", 0).alias("chrom"),
        F.floor(field("_f", 1).try_cast("double")).alias("length_bp"),
        F.floor(field("_f", 2).try_cast("double")).alias("ordered_genes"),
    )
    short = parts.filter(F.size("_f") < 3).select("path", F.col("value").alias("chrom"), F.lit("MALFORMED").alias("issue"))
    low = rows.filter(~F.coalesce((F.col("length_bp") > 0) & (F.col("ordered_genes") > 0), F.lit(False))).select(
        "path", "chrom", F.lit("NOT_POSITIVE").alias("issue")
    )
    twice = (
        rows.groupBy("path", "chrom").count().filter("count > 1").select("path", "chrom", F.lit("DUPLICATE").alias("issue"))
    )
    return rows, short.unionByName(low).unionByName(twice)
