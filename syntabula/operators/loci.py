"""Gene loci: order, representatives, id matching and validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.ids import id_variants
from ..session import cut_lineage
from .scale import dealt, expect_known, first_per_group, partitions_of, with_rank


def gene_order(loci: DataFrame, by: Sequence[str], order: Sequence[str] = ("start", "end", "gene_id")) -> DataFrame:
    """1..n along every chromosome."""
    return with_rank(loci, by, [F.col(c) for c in order], "order")


def genome_sort(loci: DataFrame, chrom_rank: Column, order: Sequence[str] = ("start", "end", "gene_id")) -> DataFrame:
    return loci.orderBy(chrom_rank, *order)


def order_violations(rows: DataFrame, key: Sequence[Column]) -> DataFrame:
    """Rows of a sorted table that sort below the row before them, also across partitions.

    Nulls come first; equal rows are in order. A task holds one partition of rows as it
    was; partitions are tied together by their last keys, one row for each.
    """
    placed = cut_lineage(rows.withColumns({"_key": F.struct(*key), "_at": F.monotonically_increasing_id()}))
    placed = placed.withColumn("_slice", F.shiftright("_at", 33))
    ends = placed.groupBy("_slice").agg(F.max_by("_key", "_at").alias("_last"))
    carried = ends.select("_slice", F.lag("_last").over(Window.orderBy("_slice")).alias("_carried"))
    inside = F.lag("_key").over(Window.partitionBy("_slice").orderBy("_at"))
    before = F.coalesce("_inside", "_carried")
    found = placed.withColumn("_inside", inside).join(carried, "_slice")
    return found.filter(F.col("_key") < before).drop("_key", "_at", "_slice", "_inside", "_carried")


def sort_order_issues(loci: DataFrame, by: Sequence[str], ord_col: str, key: Sequence[str]) -> DataFrame:
    """Rows that sort below the row before them in the file.

    ord_col counts rows without gaps, so the row before is found by an equi-join
    on its number instead of a window over the whole file.
    """
    before = loci.select(
        *by, (F.col(ord_col) + 1).alias(ord_col), F.struct(*key).alias("_before")
    )
    return loci.join(before, [*by, ord_col]).filter(F.struct(*key) < F.col("_before")).drop("_before")


def contiguous_order_check(loci: DataFrame, by: Sequence[str], order: str = "order") -> DataFrame:
    """Per chromosome: are the orders exactly 1..n?"""
    seen = loci.groupBy(*by, order).agg(F.count("*").alias("_n"))
    return (
        seen.groupBy(*by)
        .agg(
            F.sum("_n").alias("rows"),
            F.count("*").alias("distinct_orders"),
            F.min(order).alias("min_order"),
            F.max(order).alias("max_order"),
        )
        .withColumn(
            "contiguous",
            (F.col("min_order") == 1) & (F.col("max_order") == F.col("rows")) & (F.col("rows") == F.col("distinct_orders")),
        )
    )


def representative_transcript(transcripts: DataFrame, cds: DataFrame) -> DataFrame:
    """One transcript per gene: longest CDS, then longest span, then id.

    Both tables have transcript_id, gene_id, seqid, start, end, strand (1-based,
    closed). A transcript known only from its CDS is rebuilt when they lie on one
    sequence and strand.
    """
    pieces = cds.groupBy("transcript_id").agg(
        F.sum(F.col("end") - F.col("start") + 1).alias("cds_length"),
        F.struct(
            F.min("gene_id").alias("gene_id"),
            F.min("seqid").alias("seqid"),
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            F.min("strand").alias("strand"),
        ).alias("_c"),
        ((F.min("seqid") == F.max("seqid")) & (F.min("strand") == F.max("strand"))).alias("_single"),
    )
    whole = transcripts.select("transcript_id", F.struct("gene_id", "seqid", "start", "end", "strand").alias("_t"))
    model = F.coalesce("_t", F.when(F.col("_single"), F.col("_c")))
    models = (
        whole.join(pieces, "transcript_id", "full_outer")
        .withColumn("_m", model)
        .filter(F.col("_m").isNotNull())
        .select(
            "transcript_id",
            F.coalesce(F.when(F.col("_m.gene_id").cast("string") != "", F.col("_m.gene_id")), F.col("transcript_id")).alias("gene_id"),
            "_m.seqid",
            "_m.start",
            "_m.end",
            "_m.strand",
            F.coalesce("cds_length", F.lit(0)).alias("cds_length"),
            (F.col("_m.end") - F.col("_m.start") + 1).alias("span"),
        )
    )
    return first_per_group(models, ["gene_id"], [("cds_length", "desc"), ("span", "desc"), ("transcript_id", "asc")])


def match_by_variants(
    transcripts: DataFrame, proteins: DataFrame, transcript: str = "transcript_id", protein: str = "protein_id", ord_col: str = "ord"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Transcripts to proteins through id spellings.

    Returns (matched, unmatched transcripts, spellings owned by several proteins).
    The first protein in file order owns a spelling; a transcript takes its most
    literal spelling that is owned.
    """
    owned = (
        proteins.select(protein, ord_col, F.explode(id_variants(F.col(protein))).alias("variant"))
        .groupBy("variant")
        .agg(
            F.min_by(protein, ord_col).alias(protein),
            F.min(protein).alias("_lo"),
            F.max(protein).alias("_hi"),
        )
    )
    ambiguous = owned.filter("_lo <> _hi").select("variant", protein)
    tried = transcripts.select(transcript).distinct().select(
        transcript, F.posexplode(id_variants(F.col(transcript))).alias("_pos", "variant")
    )
    matched = (
        tried.join(owned, "variant")
        .groupBy(transcript)
        .agg(F.min_by(F.struct(protein, "variant"), "_pos").alias("_m"))
        .select(transcript, F.col("_m")[protein].alias(protein), F.col("_m.variant").alias("variant"))
    )
    unmatched = transcripts.select(transcript).distinct().join(matched, transcript, "left_anti")
    return matched, unmatched, ambiguous


def restrict_to_chromosomes(
    features: DataFrame, id_map: DataFrame, by: Sequence[str], seq_col: str, new_col: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Features on listed sequences, renamed if the map has new_col; and retention counts.

    id_map has one row per (by, seq_col).
    """
    flag = id_map.select(*by, seq_col, *([new_col] if new_col else [])).withColumn("_listed", F.lit(True))
    joined = features.join(flag, [*by, seq_col], "left")
    counts = joined.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count("_listed").alias("kept"),
        (F.count("_listed") * 100 / F.count("*")).alias("retention_percent"),
    )
    kept = joined.filter(F.col("_listed")).drop("_listed")
    return kept, counts


def validate_coordinates(
    loci: DataFrame,
    lengths: DataFrame,
    by: Sequence[str] = ("species",),
    chrom: str = "chrom",
    start: str = "start",
    end: str = "end",
    strand: str = "strand",
    length: str = "length_bp",
) -> DataFrame:
    """Adds issue: the first broken rule, or NULL."""
    known = lengths.select(*by, chrom, F.col(length).alias("_len"))
    issue = (
        F.when(F.col("_len").isNull(), "BED_CHROMOSOME_NOT_IN_GENOME")
        .when(F.col(start) < 0, "NEGATIVE_BED_START")
        .when(F.col(end) <= F.col(start), "BED_END_NOT_GREATER_THAN_START")
        .when(F.col(end) > F.col("_len"), "BED_END_EXCEEDS_CHROMOSOME")
        .when(~F.col(strand).isin("+", "-", "."), "INVALID_BED_STRAND")
    )
    joined = loci.join(known, [*by, chrom], "left")
    return joined.select(*loci.columns, issue.alias("issue"))


def id_set_diff(a: DataFrame, b: DataFrame, key: Sequence[str], a_only: str, b_only: str) -> DataFrame:
    """Ids of a not in b and of b not in a, with the issue that names the side; nulls are equal, as in EXCEPT.

    One pass over both sides: an id's rows meet in one of as many tasks as rows need.
    """
    sides = [df.select(*key, F.lit(side == "a").alias("_a")) for df, side in ((a, "a"), (b, "b"))]
    both = dealt(sides[0].unionByName(sides[1]), key, partitions_of(*sides))
    seen = both.groupBy(*key).agg(F.min("_a").alias("_low"), F.max("_a").alias("_high"))
    return seen.filter(F.col("_low") == F.col("_high")).select(*key, F.when(F.col("_low"), a_only).otherwise(b_only).alias("issue"))


def missing_prefix(ids: DataFrame, code: Column, col: str, issue: str) -> DataFrame:
    return ids.filter(~F.startswith(F.col(col), F.concat(code, F.lit("_")))).withColumn("issue", F.lit(issue))


def id_sets(a: DataFrame, b: DataFrame, key: Sequence[str], op: str) -> DataFrame:
    """Set operation on distinct ids: intersect, difference or union."""
    left, right = a.select(*key), b.select(*key)
    if op == "intersect":
        return left.intersect(right)
    if op == "difference":
        return left.subtract(right)
    return left.union(right).distinct()


def genes_per_chromosome(loci: DataFrame, chroms: DataFrame, by: Sequence[str]) -> DataFrame:
    """Gene count per listed chromosome; 0 marks an empty one."""
    counts = loci.groupBy(*by).agg(F.count("*").alias("genes"))
    return chroms.select(*by).distinct().join(counts, list(by), "left").withColumn("genes", F.coalesce("genes", F.lit(0)))


def span_totals(loci: DataFrame, lengths: DataFrame, by: Sequence[str], chrom: str = "chrom", length: str = "length_bp") -> DataFrame:
    """Genome bp of the chromosomes in use and summed gene spans, per group; a chromosome without length is an error."""
    used = loci.groupBy(*by, chrom).agg(
        F.sum(F.col("end") - F.col("start")).alias("_span"), F.count("*").alias("_genes")
    )
    return (
        expect_known(used, lengths.select(*by, chrom, length), [*by, chrom], "chromosome without length")
        .groupBy(*by)
        .agg(
            F.count("*").alias("chromosomes_used"),
            F.sum(length).alias("genome_bp"),
            F.sum("_span").alias("gene_span_bp"),
            F.sum("_genes").alias("genes"),
        )
    )


def md5_match(a: DataFrame, b: DataFrame, id_a: str, id_b: str, seq_a: str = "sequence", seq_b: str = "sequence") -> DataFrame:
    """Each id of a whose sequence, ignoring case, also occurs in b.

    id_b is the lowest id of b with that sequence; n_a and n_b say how many ids
    share it on either side, so copies stay linear instead of becoming all pairs.
    """
    left = a.select(F.col(id_a), F.md5(F.upper(seq_a)).alias("md5"))
    right = b.select(F.col(id_b), F.md5(F.upper(seq_b)).alias("md5"))
    classes = (
        right.groupBy("md5")
        .agg(F.min(id_b).alias(id_b), F.count("*").alias("n_b"))
        .join(left.groupBy("md5").agg(F.count("*").alias("n_a")), "md5")
    )
    return left.join(classes, "md5").select(id_a, id_b, "md5", "n_a", "n_b")
