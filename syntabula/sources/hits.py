"""Hit tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .text import field, once, text_records, whole_number, without_return

HIT12 = {
    "qseqid": "string", "sseqid": "string", "pident": "double", "length": "long", "mismatch": "long", "gapopen": "long",
    "qstart": "long", "qend": "long", "sstart": "long", "send": "long", "evalue": "double", "bitscore": "double",
}
HIT11 = {
    "qseqid": "string", "sseqid": "string", "pident": "double", "length": "long", "qlen": "long", "slen": "long",
    "evalue": "double", "bitscore": "double", "qcovhsp": "double", "scovhsp": "double", "stitle": "string",
}


def parse_hits(records: DataFrame, columns: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Typed rows of as many cells as columns, and the malformed lines."""
    lines = once(records, without_return(F.col("value")), "value").filter(F.trim("value") != "")
    parts = once(lines, F.split("value", "\t"), "_f")

    def cell(i: int, kind: str):
        if kind == "string":
            return field("_f", i)
        return whole_number(field("_f", i)) if kind == "long" else F.trim(field("_f", i)).try_cast(kind)

    typed = once(parts, F.struct(*[cell(i, k).alias(c) for i, (c, k) in enumerate(columns.items())]), "_t")
    sound = F.size("_f") == len(columns)
    for c in columns:
        sound = sound & F.col("_t")[c].isNotNull()
    good = F.coalesce(sound, F.lit(False))
    return typed.filter(good).select(*[F.col("_t")[c].alias(c) for c in columns]), typed.filter(~good).select("path", "value")


def read_hits12(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """Twelve-column hits and the malformed lines."""
    return parse_hits(text_records(spark, path), HIT12)


def read_hits11(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """Eleven-column hits with coverages and the malformed lines."""
    return parse_hits(text_records(spark, path), HIT11)


def read_domain_hits(spark: SparkSession, path) -> DataFrame:
    """parse_domain_hits() of files."""
    return parse_domain_hits(text_records(spark, path))


def parse_domain_hits(records: DataFrame) -> DataFrame:
    """protein_id and application of the rows with at least four columns."""
    parts = once(records, F.split(without_return(F.col("value")), "\t"), "_f")
    return parts.filter(F.size("_f") >= 4).select(field("_f", 0).alias("protein_id"), field("_f", 3).alias("application"))
