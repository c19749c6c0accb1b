"""FASTA in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.sequence import wrap_sequence
from ..operators.quality import expect_none
from ..operators.scale import with_rank
from .text import FILE_ORDER, text_records


def read_fasta(spark: SparkSession, path, unique: bool = False) -> DataFrame:
    """parse_fasta() of files."""
    return parse_fasta(text_records(spark, path, "\n>"), unique)


def parse_fasta(records: DataFrame, unique: bool = False) -> DataFrame:
    """seq_id, description, sequence and the place in the file, one row per record.

    Records are split on a line-starting `>`, so a `>` inside a description is
    text. A record is one value, at most 2 GB. unique=True checks the ids of every
    file and raises on repeats.
    """
    record = F.regexp_replace("value", "\r", "")
    parts = records.withColumn("_r", F.regexp_replace(record, "^>", ""))
    header = F.substring_index("_r", "\n", 1)
    # What follows the first line break; nothing when there is none.
    body = F.when(F.instr("_r", "\n") > 0, F.expr("substr(_r, instr(_r, '\n') + 1)")).otherwise("")
    seqs = parts.filter(F.trim("_r") != "").select(
        F.regexp_extract(header, r"^\s*(\S*)", 1).alias("seq_id"),
        F.trim(F.regexp_replace(header, r"^\s*\S*", "")).alias("description"),
        F.regexp_replace(body, r"\s+", "").alias("sequence"),
        *FILE_ORDER,
    )
    if unique:
        twice = seqs.groupBy("path", "seq_id").count().filter("count > 1")
        expect_none(twice, "duplicate sequence ids")
    return seqs


def sequence_order(seqs: DataFrame) -> DataFrame:
    """path, seq_id, ord: 1-based position in the file. Sequences are left behind first."""
    light = seqs.select("seq_id", *FILE_ORDER)
    return with_rank(light, ["path"], [F.col("block"), F.col("row")], "ord").select("path", "seq_id", "ord")


def fasta_records(df: DataFrame, seq_id: str = "seq_id", sequence: str = "sequence", width: int = 60) -> DataFrame:
    """One text value per record: the header and the wrapped sequence."""
    return df.select(F.concat(F.lit(">"), F.col(seq_id), F.lit("\n"), wrap_sequence(F.col(sequence), width)).alias("value"))


def write_fasta(df: DataFrame, path: str, seq_id: str = "seq_id", sequence: str = "sequence", width: int = 60) -> None:
    fasta_records(df, seq_id, sequence, width).write.mode("overwrite").text(path)
