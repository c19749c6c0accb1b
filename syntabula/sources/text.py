"""Text readers shared by the format readers.

Every reader takes a path, a glob or a list of them; compressed files work by their
extension. Readers that can meet malformed rows return (rows, rejects). Each reader is
text_records() and a parser; parsers take any table of value, path, block and row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Sorts rows in file order: blocks of a file by offset, rows within a block by id.
FILE_ORDER = ("path", "block", "row")


def text_records(spark: SparkSession, path, separator: str | None = None) -> DataFrame:
    """value and its place in the file; one row per line, or per separator."""
    reader = spark.read if separator is None else spark.read.option("lineSep", separator)
    return reader.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def once(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Column name, added or replaced, whose value is computed once per row.

    A filter on a plain column moves below it and repeats its whole expression, and every
    cell of a split line repeats the split. Nothing moves below an explode.
    """
    held = F.explode(F.array(value)).alias(name)
    return df.select(*[held if c == name else c for c in df.columns], *([] if name in df.columns else [held]))


def without_return(value: Column) -> Column:
    """Text without a carriage return at its end; the pattern is tried only where there is one."""
    return F.when(value.contains("\r"), F.regexp_replace(value, "\r$", "")).otherwise(value)


def data_lines(records: DataFrame, comment: str | None = "#") -> DataFrame:
    """Non-blank lines without their carriage return and without comment lines."""
    lines = once(records, without_return(F.col("value")), "value")
    lines = lines.filter(F.trim("value") != "")
    return lines if comment is None else lines.filter(~F.startswith(F.col("value"), F.lit(comment)))


def whole_number(col: Column) -> Column:
    """Integer of a text cell, NULL when it is none."""
    return F.when(F.trim(col).rlike(r"^[+-]?\d+$"), F.trim(col).try_cast("long"))


def field(parts: str, i: int) -> Column:
    return F.get(F.col(parts), F.lit(i))
