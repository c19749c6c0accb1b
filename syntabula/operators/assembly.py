"""Assembly, sequence-set and annotation statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import sequence as S

COARSE = 1 << 16


def n50(df: DataFrame, by: Sequence[str], length: str, name: str = "n50", count: str | None = None) -> DataFrame:
    """Smallest length of the descending running sum that reaches half the total.

    Lengths collapse to (length, count) first. The crossing is found among coarse
    length buckets and then among the lengths of the crossing bucket only, so no
    window holds more than 2**16 rows of a group. count names a column for the
    number of lengths.
    """
    if not by:
        return n50(df.withColumn("_all", F.lit(1)), ["_all"], length, name, count).drop("_all")
    keys = list(by)
    known = F.col(length).isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    # Stated here, so that both uses of `sized` plan alike and share one shuffle.
    sized = (
        df.filter(known)
        .groupBy(*keys, F.col(length).cast("long").alias("_len"))
        .agg(F.count("*").alias("_n"))
        .withColumn("_bp", F.col("_n") * F.col("_len"))
        .withColumn("_c", F.floor(F.col("_len") / COARSE))
    )
    down = W.partitionBy(*keys).orderBy(F.desc("_c"))
    crossing = (
        sized.groupBy(*keys, "_c")
        .agg(F.sum("_bp").alias("_bp"), F.sum("_n").alias("_n"))
        .withColumn("_above", F.coalesce(F.sum("_bp").over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_total", F.sum("_bp").over(W.partitionBy(*keys)))
        .withColumn("_count", F.sum("_n").over(W.partitionBy(*keys)))
        .filter((F.col("_above") + F.col("_bp")) * 2 >= F.col("_total"))
        .groupBy(*keys)
        .agg(F.max_by(F.struct("_c", "_above", "_total", "_count"), "_c").alias("_x"))
    )
    fine = W.partitionBy(*keys).orderBy(F.desc("_len")).rowsBetween(W.unboundedPreceding, W.currentRow)
    found = (
        sized.join(crossing, keys)
        .filter(F.col("_c").eqNullSafe(F.col("_x._c")))
        .withColumn("_upto", F.sum("_bp").over(fine) + F.col("_x._above"))
        .filter(F.col("_upto") * 2 >= F.col("_x._total"))
        .groupBy(*keys)
        .agg(F.max("_len").alias(name), F.max("_x._count").alias("_count"))
    )
    return found.select(*keys, name, *([F.col("_count").alias(count)] if count else []))


def sequence_lengths(seqs: DataFrame, by: Sequence[str], sequence: str = "sequence") -> DataFrame:
    bp = F.length(sequence).cast("long")
    return seqs.select(*by, bp.alias("length_bp"), F.round(bp / 1_000_000, 3).alias("length_mb"))


def gap_runs(seqs: DataFrame, by: Sequence[str], sequence: str = "sequence") -> DataFrame:
    """One row per run of N, with its length."""
    return seqs.select(*by, F.explode(S.n_runs(F.col(sequence))).alias("_run")).select(
        *by, F.length("_run").cast("long").alias("run_bp")
    )


def contig_lengths(seqs: DataFrame, by: Sequence[str], sequence: str = "sequence") -> DataFrame:
    """One row per stretch between runs of N, with its length."""
    return seqs.select(*by, F.explode(S.contigs(F.col(sequence))).alias("_piece")).select(
        *by, F.length("_piece").cast("long").alias("contig_bp")
    )


def assembly_stats(
    seqs: DataFrame, by: Sequence[str] = (), sequence: str = "sequence", min_bp: int = 1_000_000
) -> DataFrame:
    """One row per assembly: sizes, N50s, gaps and contigs."""
    if not by:
        return assembly_stats(seqs.withColumn("_all", F.lit(1)), ["_all"], sequence, min_bp).drop("_all")
    keys = list(by)
    seq = F.col(sequence)
    measured = seqs.select(
        *keys,
        F.length(seq).cast("long").alias("_bp"),
        S.count_letters(seq, "N").cast("long").alias("_n"),
        F.size(S.n_runs(seq)).alias("_runs"),
    )
    totals = measured.groupBy(*keys).agg(
        F.sum("_bp").alias("assembled_genome_size_bp"),
        F.count("*").alias("number_scaffolds"),
        F.max("_bp").alias("longest_scaffold_bp"),
        F.count_if(F.col("_bp") >= min_bp).alias("number_pseudochromosomes"),
        F.sum("_n").alias("total_n_bases"),
        F.try_divide(F.sum("_n") * 100, F.sum("_bp")).alias("assembly_gap_percent"),
        F.sum("_runs").alias("number_n_runs"),
    )
    contigs = contig_lengths(seqs, keys, sequence)
    zero = F.lit(0).cast("long")
    return (
        totals.join(n50(measured.select(*keys, "_bp"), keys, "_bp", "scaffold_n50_bp"), keys, "left")
        .join(n50(contigs, keys, "contig_bp", "inferred_contig_n50_bp", "inferred_contig_count"), keys, "left")
        .withColumn("scaffold_n50_bp", F.coalesce("scaffold_n50_bp", zero))
        .withColumn("inferred_contig_n50_bp", F.coalesce("inferred_contig_n50_bp", zero))
        .withColumn("inferred_contig_count", F.coalesce("inferred_contig_count", zero))
    )


def as_metrics(row: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Wide statistics row to (metric, value) rows."""
    values = [c for c in row.columns if c not in by]
    wide = row.select(*by, *[F.col(c).cast("double").alias(c) for c in values])
    return wide.unpivot(list(by), values, "metric", "value")


def sequence_file_stats(records: DataFrame, by: Sequence[str], seq_id: str, length: str, order: str) -> DataFrame:
    """Per file: count, total bp, N50, longest, and the first ten ids in file order."""
    keys = list(by)
    # Ten per partial aggregate are enough to know the first ten of the file.
    firsts = first_ids(records, keys, seq_id, order, 10)
    return (
        records.groupBy(*keys)
        .agg(
            F.count("*").alias("sequences"),
            F.sum(length).alias("total_bp"),
            F.max(length).alias("longest_bp"),
        )
        .join(n50(records, keys, length, "n50_bp"), keys, "left")
        .join(firsts, keys, "left")
    )


def first_ids(df: DataFrame, by: Sequence[str], seq_id: str, order: str, n: int) -> DataFrame:
    """The n lowest-ordered ids per group, joined by commas.

    A limited window (row_number <= n) keeps n rows per partition before the
    shuffle (WindowGroupLimit), so a hot group stays small.
    """
    rank = F.row_number().over(W.partitionBy(*by).orderBy(order))
    top = df.select(*by, seq_id, order).withColumn("_rank", rank).filter(F.col("_rank") <= n)
    entries = F.array_sort(F.collect_list(F.struct("_rank", seq_id)))
    return top.groupBy(*by).agg(
        F.concat_ws(",", F.transform(entries, lambda e: e[seq_id].cast("string"))).alias("first_ids")
    )


def category_counts(df: DataFrame, col: str, name: str = "n") -> DataFrame:
    """Rows per value, most frequent first, then by value."""
    return df.groupBy(col).agg(F.count("*").alias(name)).orderBy(F.desc(name), F.asc(col))


def feature_summary(
    df: DataFrame, by: Sequence[str], feature: str, counts: dict[str, Sequence[str]]
) -> DataFrame:
    """Wide counts per group; counts maps a column name to the feature values it counts."""
    return df.groupBy(*by).agg(
        *[F.count_if(F.col(feature).isin(list(values))).alias(name) for name, values in counts.items()]
    )


def annotation_checks(summary: DataFrame) -> DataFrame:
    """transcripts_per_gene and status from genes, proteins, cds, longest."""
    odd = (F.col("proteins") != F.col("cds")) | (F.col("longest") > F.col("proteins"))
    return summary.withColumn(
        "transcripts_per_gene", F.round(F.try_divide("proteins", "genes"), 3)
    ).withColumn("status", F.when(odd, "CHECK").otherwise("PASS"))


def duplicate_ids(df: DataFrame, by: Sequence[str], name: str = "occurrences") -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias(name)).filter(F.col(name) > 1)


def rename_sequences(
    seqs: DataFrame, by: Sequence[str], code: Column, order: Sequence[Column]
) -> DataFrame:
    """new_id CODE_seq000001, ... in the given order, next to the old columns."""
    from .scale import with_rank

    ranked = with_rank(seqs, by, order, "_rank")
    return ranked.withColumn(
        "new_id", F.concat(code, F.lit("_seq"), F.format_string("%06d", F.col("_rank")))
    ).drop("_rank")
