"""Header tables, status files and reports, in and out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.ids import natural_key
from ..operators.loci import gene_order
from ..operators.quality import require_columns
from .text import text_records

# Fixed value: the completeness line.
BUSCO = (
    r"C:\s*([0-9.]+)%\s*\[\s*S:\s*([0-9.]+)%\s*,\s*D:\s*([0-9.]+)%\s*\]\s*,\s*F:\s*([0-9.]+)%\s*,\s*M:\s*([0-9.]+)%\s*,\s*n:\s*([0-9]+)"
)
BUSCO_PARTS = ("complete", "single", "duplicated", "fragmented", "missing", "n")


def read_table(
    spark: SparkSession,
    path,
    sep: str = "\t",
    types: dict[str, str] | None = None,
    required: Sequence[str] = (),
    null_values: Sequence[str] = ("NA",),
) -> DataFrame:
    """Header table as text columns, with the wanted columns cast.

    Cells in null_values and cells that do not cast become NULL. Missing required
    columns are an error.
    """
    df = spark.read.option("header", True).option("sep", sep).option("inferSchema", False).csv(path)
    return typed_cells(df, types, required, null_values)


def typed_cells(
    df: DataFrame, types: dict[str, str] | None = None, required: Sequence[str] = (), null_values: Sequence[str] = ("NA",)
) -> DataFrame:
    """Text columns with null values taken out and the wanted columns cast; see read_table()."""
    require_columns(df, [*required, *(types or {})])
    cells = {c: F.when(~F.col(f"`{c}`").isin(list(null_values)), F.col(f"`{c}`")) for c in df.columns} if null_values else {}
    if cells:
        df = df.withColumns(cells)
    return df.withColumns({c: F.trim(F.col(f"`{c}`")).try_cast(t) for c, t in (types or {}).items()})


def fixed(col: Column, digits: int) -> Column:
    """Text with a fixed number of decimals, rounding the exact binary value, half to even; NULL and NaN stay NULL."""
    value = col.cast("double")
    return F.when(~F.isnan(value), F.call_function("format_number", value, F.lit("0." + "0" * digits if digits else "0")))


def shown_cells(df: DataFrame, digits: dict[str, int] | None = None) -> DataFrame:
    """df with the columns of digits as text of so many decimals."""
    return df.withColumns({c: fixed(F.col(c), n) for c, n in digits.items()}) if digits else df


def write_table(
    df: DataFrame, path: str, sep: str = "\t", digits: dict[str, int] | None = None, null_value: str = "NA"
) -> None:
    """TSV or CSV with a header; digits fixes the decimals of columns."""
    shown_cells(df, digits).write.mode("overwrite").option("header", True).option("sep", sep).option("nullValue", null_value).csv(path)


def read_key_values(spark: SparkSession, path) -> DataFrame:
    """parse_key_values() of files."""
    return parse_key_values(text_records(spark, path))


def parse_key_values(records: DataFrame) -> DataFrame:
    """path, key, value of `key=value` lines; the last line of a key wins."""
    lines = records.filter(F.col("value").contains("="))
    return (
        lines.select(
            "path",
            "block",
            "row",
            F.trim(F.substring_index("value", "=", 1)).alias("key"),
            F.trim(F.expr("substr(value, instr(value, '=') + 1)")).alias("value"),
        )
        .groupBy("path", "key")
        .agg(F.max_by("value", F.struct("block", "row")).alias("value"))
    )


def pivot_keys(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per file with the given keys as columns."""
    return pairs.groupBy("path").agg(*[F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in keys])


def read_busco(spark: SparkSession, path) -> DataFrame:
    """Completeness parts of each file's last summary line; NULLs without one. Files are short reports."""
    return parse_busco(spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path")))


def parse_busco(texts: DataFrame) -> DataFrame:
    """The same for whole texts: value, path."""
    return texts.select(
        "path",
        *[
            F.try_element_at(F.regexp_extract_all("value", F.lit(BUSCO), F.lit(i)), F.lit(-1)).try_cast("double").alias(name)
            for i, name in enumerate(BUSCO_PARTS, start=1)
        ],
    )


def read_assembly_report(spark: SparkSession, path) -> DataFrame:
    """parse_assembly_report() of JSON-lines files."""
    return parse_assembly_report(spark.read.text(path))


def parse_assembly_report(records: DataFrame) -> DataFrame:
    """Distinct sequence ids of the primary assembly, one JSON object in each value; what is no object has none."""
    names = ["assemblyUnit", "genbankAccession", "refseqAccession", "sequenceName"]
    fields = records.select(F.from_json("value", ", ".join(f"{n} string" for n in names)).alias("r")).select("r.*")
    seq_id = F.coalesce("genbankAccession", "refseqAccession", "sequenceName")
    return (
        fields.filter(F.col("assemblyUnit") == "Primary Assembly")
        .select(seq_id.alias("seq_id"))
        .filter(F.trim("seq_id") != "")
        .distinct()
    )


def file_inventory(spark: SparkSession, path) -> DataFrame:
    """path, bytes, sha256 of every file; a file is hashed as one value (at most 2 GB)."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def locus_tables(loci: DataFrame, lengths: DataFrame) -> dict[str, DataFrame]:
    """Half-open loci (species, chrom, gene_id, start, end, strand) to three tables.

    genes: 1-based with the order along the chromosome; lens: chromosome, bp, gene
    count in natural order; id_map: all of it with the original id.
    """
    closed = gene_order(loci, ["species", "chrom"]).withColumn("start", F.col("start") + 1)
    counts = loci.groupBy("species", "chrom").agg(F.count("*").alias("ordered_genes"))
    lens = lengths.select("species", "chrom", "length_bp").join(counts, ["species", "chrom"])
    genes = closed.select("species", "chrom", "gene_id", "start", "end", "strand", "order", F.col("gene_id").alias("original_id"))
    return {
        "genes": genes.orderBy("species", natural_key(F.col("chrom")), "order"),
        "lens": lens.orderBy("species", natural_key(F.col("chrom"))),
        "id_map": genes.select("species", "chrom", "gene_id", "original_id", "start", "end", "strand", "order"),
    }


def write_locus_tables(loci: DataFrame, lengths: DataFrame, folder: str) -> None:
    """The three locus tables as TSV folders below `folder`, one partition per species."""
    for name, df in locus_tables(loci, lengths).items():
        df.write.mode("overwrite").partitionBy("species").option("header", name == "id_map").option("sep", "\t").csv(
            f"{folder}/{name}"
        )
