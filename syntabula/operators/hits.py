"""Homology-hit tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from .scale import distinct_in, first_per_group

HIT12 = (
    "qseqid", "sseqid", "pident", "length", "mismatch", "gapopen",
    "qstart", "qend", "sstart", "send", "evalue", "bitscore",
)

SWAPPED = {
    "qseqid": "sseqid", "sseqid": "qseqid",
    "qstart": "sstart", "qend": "send", "sstart": "qstart", "send": "qend",
}


def swap_union(forward: DataFrame, reverse: DataFrame, swapped: dict[str, str] = SWAPPED) -> DataFrame:
    """Forward hits and reverse hits turned round, so column 1 is always species 1."""
    turned = reverse.select(*[F.col(swapped.get(c, c)).alias(c) for c in forward.columns])
    return forward.unionByName(turned)


def distinct_hits(hits: DataFrame) -> DataFrame:
    return hits.distinct()


def hit_threshold(
    hits: DataFrame, ident: str = "pident", cover: str = "qcovhsp", min_ident: float = 30, min_cov: float = 50
) -> DataFrame:
    return hits.filter((F.col(ident) >= min_ident) & (F.col(cover) >= min_cov))


def best_pair_hit(
    hits: DataFrame,
    key: Sequence[str] = ("qseqid", "sseqid"),
    order: Sequence[tuple[str, str]] = (("evalue", "asc"), ("bitscore", "desc"), ("pident", "desc")),
    ties: Sequence[str] = (),
) -> DataFrame:
    """One hit per pair: lowest e-value, then highest bitscore, then identity.

    ties names columns that settle what is left, so the choice never depends on
    row order.
    """
    rest = ties or [c for c in hits.columns if c not in key and c not in {o for o, _ in order}]
    return first_per_group(hits, list(key), [*order, *[(c, "asc") for c in rest]])


def validate_hits(
    hits: DataFrame, ids1: DataFrame, ids2: DataFrame, query: str = "qseqid", subject: str = "sseqid"
) -> DataFrame:
    """Adds invalid_id and malformed flags. ids1 and ids2 are one-column id tables."""
    known1 = ids1.select(F.col(ids1.columns[0]).alias(query)).distinct().withColumn("_in1", F.lit(True))
    known2 = ids2.select(F.col(ids2.columns[0]).alias(subject)).distinct().withColumn("_in2", F.lit(True))
    low = [F.col(c) < 0 for c in ("mismatch", "gapopen", "evalue", "bitscore")]
    unset = [F.col(c) <= 0 for c in ("length", "qstart", "qend", "sstart", "send")]
    malformed = ~F.col("pident").between(0, 100)
    for rule in low + unset:
        malformed = malformed | rule
    return (
        hits.join(known1, query, "left")
        .join(known2, subject, "left")
        .withColumn("invalid_id", F.col("_in1").isNull() | F.col("_in2").isNull())
        .withColumn("malformed", malformed)
        .select(*hits.columns, "invalid_id", "malformed")
    )


def homology_qc(
    hits: DataFrame,
    by: Sequence[str],
    totals: DataFrame,
    query: str = "qseqid",
    subject: str = "sseqid",
    ident: str = "pident",
    score: str = "bitscore",
    evalue: str = "evalue",
) -> DataFrame:
    """One QC row per group; totals has by, n1 and n2, the gene totals behind the coverages.

    Rows collapse to pairs first, so the distinct counts work on pairs.
    """
    keys = list(by)
    pairs = hits.groupBy(*keys, query, subject).agg(
        F.count("*").alias("_n"),
        F.sum(ident).alias("_ident"),
        F.sum(score).alias("_score"),
        F.count_if(F.col(evalue) == 0).alias("_zero"),
    )
    counted = pairs.groupBy(*keys).agg(
        F.sum("_n").alias("homology_rows"),
        F.count("*").alias("unique_gene_pairs"),
        (F.sum("_ident") / F.sum("_n")).alias("mean_percent_identity"),
        (F.sum("_score") / F.sum("_n")).alias("mean_bitscore"),
        F.sum("_zero").alias("zero_evalue_rows"),
        F.sum(F.when(F.col(query) == F.col(subject), F.col("_n")).otherwise(0)).alias("self_identity_rows"),
    )
    # A group without hits keeps its row, with counts of zero.
    joined = totals.select(*keys, "n1", "n2").join(counted, keys, "full")
    for column, name in ((query, "unique_queries"), (subject, "unique_subjects")):
        joined = joined.join(distinct_in(pairs, keys, column, name), keys, "left")
    counts = ("homology_rows", "unique_gene_pairs", "zero_evalue_rows", "self_identity_rows", "unique_queries", "unique_subjects")
    return joined.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in counts}).withColumns(
        {
            "duplicate_gene_pairs": F.col("homology_rows") - F.col("unique_gene_pairs"),
            "query_gene_coverage": F.try_divide("unique_queries", "n1"),
            "subject_gene_coverage": F.try_divide("unique_subjects", "n2"),
        }
    )


def score_id_overlap(
    ids: DataFrame, candidates: DataFrame, species: str = "species", seq_id: str = "seq_id", path: str = "path"
) -> DataFrame:
    """How well each candidate file covers a species' ids, ranked best first.

    exact_candidates counts the files whose id set is the same; callers want 1.
    """
    wanted = ids.select(species, seq_id).distinct()
    found = candidates.select(species, path, seq_id).distinct()
    totals = wanted.groupBy(species).agg(F.count("*").alias("protein_ids"))
    scored = (
        found.join(wanted.withColumn("_hit", F.lit(1)), [species, seq_id], "left")
        .groupBy(species, path)
        .agg(F.count("*").alias("cds_ids"), F.count("_hit").alias("intersection"))
        .join(totals, species)
        .withColumns(
            {
                "protein_missing_from_cds": F.col("protein_ids") - F.col("intersection"),
                "extra_cds_ids": F.col("cds_ids") - F.col("intersection"),
                "protein_recall": F.col("intersection") / F.col("protein_ids"),
            }
        )
        .withColumn("exact", (F.col("protein_missing_from_cds") == 0) & (F.col("extra_cds_ids") == 0))
    )
    # One row per candidate file by now.
    best = W.partitionBy(species).orderBy(
        F.desc("exact"), F.desc("protein_recall"), F.desc("intersection"), "extra_cds_ids", path
    )
    return scored.withColumn("rank", F.row_number().over(best)).withColumn(
        "exact_candidates", F.count_if("exact").over(W.partitionBy(species))
    )


def best_candidate_file(
    candidates: DataFrame, species: str, score: str, size: str, path: str
) -> DataFrame:
    """Best-scored file per species; larger size, then path, settles ties."""
    return first_per_group(candidates, [species], [(score, "desc"), (size, "desc"), (path, "asc")])
