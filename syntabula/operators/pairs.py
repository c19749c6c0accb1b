"""Gene pairs, collinear blocks and comparison runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.values import parse_gene_list
from .scale import dealt, distinct_in, exact_quantiles, first_per_group, partitions_of, with_rank


def unordered_pairs(
    pairs: DataFrame, by: Sequence[str], a: str, b: str, is_self: Column
) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs without x=x; self comparisons ignore the order within a pair.

    A pair with a missing gene is never a pair with itself: it counts in the raw number only.

    Returns (pairs, counts per group: raw, self, repeated, reverse, retained).
    """
    keys = list(by)
    flagged = pairs.select(*keys, F.col(a).alias("_a"), F.col(b).alias("_b"), is_self.alias("_self"))
    turned = F.col("_self") & (F.col("_a") > F.col("_b"))
    named = flagged.select(
        *keys,
        "_self",
        F.when(turned, F.col("_b")).otherwise(F.col("_a")).alias(a),
        F.when(turned, F.col("_a")).otherwise(F.col("_b")).alias(b),
    )
    seen = named.groupBy(*keys, "_self", a, b).agg(F.count("*").alias("_n"))
    kept = seen.filter(F.col(a) != F.col(b)).select(*keys, a, b)
    same = F.col(a) == F.col(b)
    again = F.when(~same, F.col("_n") - 1).otherwise(0)
    counts = seen.groupBy(*keys).agg(
        F.sum("_n").alias("raw_assignments"),
        F.sum(F.when(same, F.col("_n")).otherwise(0)).alias("self_pairs_removed"),
        F.sum(F.when(~F.col("_self"), again).otherwise(0)).alias("repeated_assignments_removed"),
        F.sum(F.when(F.col("_self"), again).otherwise(0)).alias("reverse_duplicates_removed"),
        F.count_if(~same).alias("retained_pairs"),
    )
    return kept, counts


def block_pairs(
    blocks: DataFrame, keep: Sequence[str], block1: str = "block1", block2: str = "block2", list_sep: str = r"[\s,;|]+"
) -> tuple[DataFrame, DataFrame]:
    """Blocks with gene-list cells to one row per gene pair.

    Returns (pairs with pair_index, blocks whose two lists differ in length).
    """
    parsed = blocks.withColumn("_g1", parse_gene_list(F.col(block1), list_sep)).withColumn(
        "_g2", parse_gene_list(F.col(block2), list_sep)
    )
    sizes = F.size("_g1") == F.size("_g2")
    pairs = parsed.filter(sizes).select(
        *keep, F.posexplode(F.arrays_zip(F.col("_g1").alias("g1"), F.col("_g2").alias("g2"))).alias("_i", "_p")
    )
    bad = parsed.filter(~sizes).select(
        *keep, F.size("_g1").alias("n_block1"), F.size("_g2").alias("n_block2")
    )
    return (
        pairs.select(
            *keep,
            (F.col("_i") + 1).alias("pair_index"),
            F.col("_p.g1").alias("reference_gene"),
            F.col("_p.g2").alias("target_gene"),
        ),
        bad,
    )


def unique_pairs(
    pairs: DataFrame,
    key: Sequence[str] = ("comparison", "reference_gene", "target_gene"),
    order: Sequence[str] = ("reference_chr", "target_chr", "block_row"),
) -> DataFrame:
    """First row per gene pair in chromosome and block order."""
    return first_per_group(pairs, list(key), [(c, "asc") for c in order])


def unique_pairs4(
    pairs: DataFrame,
    by: Sequence[str] = ("comparison",),
    ref: tuple[str, str] = ("reference_gene", "reference_chr"),
    tgt: tuple[str, str] = ("target_gene", "target_chr"),
) -> tuple[DataFrame, DataFrame]:
    """Distinct (gene, chromosome) pairs and the genes found on two chromosomes."""
    keys = list(by)
    distinct = pairs.select(*keys, *ref, *tgt).distinct()

    def conflicts(gene: str, chrom: str, side: str) -> DataFrame:
        return (
            distinct.groupBy(*keys, F.col(gene).alias("gene"))
            .agg(F.min(chrom).alias("first_chr"), F.max(chrom).alias("last_chr"))
            .filter("first_chr <> last_chr")
            .withColumn("side", F.lit(side))
        )

    return distinct, conflicts(*ref, "reference").unionByName(conflicts(*tgt, "target"))


def chunk_assign(rows: DataFrame, by: Sequence[str], order: Sequence[Column], size: int = 5000) -> DataFrame:
    """1-based position, chunk number and the first and last position of its chunk."""
    ranked = with_rank(rows, by, order, "position")
    chunk = F.ceil(F.col("position") / size)
    totals = rows.groupBy(*by).agg(F.count("*").alias("_total"))
    return (
        ranked.join(totals, list(by))
        .withColumn("chunk", chunk)
        .withColumn("chunk_start", (F.col("chunk") - 1) * size + 1)
        .withColumn("chunk_end", F.least(F.col("chunk") * size, F.col("_total")))
        .drop("_total")
    )


def presence_check(pairs: DataFrame, by: Sequence[str], genes: Sequence[str], ids: DataFrame, kind: str) -> DataFrame:
    """Genes of any pair that are not in ids (same column name as ids' only column)."""
    name = ids.columns[0]
    wanted = pairs.select(*by, F.explode(F.array(*genes)).alias(name))
    n = partitions_of(pairs, ids)
    # By group and gene first, so that a gene of all groups is no hot task.
    once = dealt(wanted, [*by, name], n).distinct()
    return dealt(once, [name], n).join(dealt(ids, [name], n).distinct(), name, "left_anti").withColumn("missing_from", F.lit(kind))


def completeness_check(
    expected: DataFrame, observed: DataFrame, by: Sequence[str], key: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Expected against observed keys.

    Returns (counts per group, keys that are missing or unexpected with a side). Both sides
    are read in one aggregate; a key with a null equals none of the other side.
    """
    keys = [*by, *key]
    part = F.when(F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False)), F.col("_expected"))
    sides = [df.select(*keys, F.lit(e).alias("_expected")) for df, e in ((expected, True), (observed, False))]
    rows = sides[0].unionByName(sides[1]).withColumn("_part", part)
    both = (
        dealt(rows, keys, partitions_of(*sides))
        .groupBy(*keys, "_part")
        .agg(F.max(F.when(F.col("_expected"), 1)).alias("_want"), F.nullif(F.count_if(~F.col("_expected")), F.lit(0)).alias("_have"))
    )
    state = F.when(F.col("_have").isNull(), "missing").when(F.col("_want").isNull(), "unexpected")
    odd = both.withColumn("issue", state).filter(F.col("issue").isNotNull()).select(*keys, "issue")
    counts = both.groupBy(*by).agg(
        F.count("_want").alias("expected"),
        F.coalesce(F.sum("_have"), F.lit(0)).alias("observed_rows"),
        F.sum(F.coalesce(F.col("_have") - 1, F.lit(0))).alias("duplicates"),
        F.count_if(F.col("_want").isNull()).alias("unexpected"),
        F.count_if(F.col("_have").isNull()).alias("missing"),
        F.try_divide(F.count_if(F.col("_want").isNotNull() & F.col("_have").isNotNull()), F.count("_want")).alias(
            "completion_fraction"
        ),
    )
    return counts, odd


def order_check(
    pairs: DataFrame,
    by: Sequence[str],
    genes1: DataFrame,
    genes2: DataFrame,
) -> DataFrame:
    """Gene order stated in the blocks against the gene tables, as counts.

    pairs has gene1, order1, gene2, order2; genes1 and genes2 have gene, order.
    """
    known1 = genes1.select(F.col("gene").alias("gene1"), F.col("order").alias("_o1"))
    known2 = genes2.select(F.col("gene").alias("gene2"), F.col("order").alias("_o2"))
    unknown = F.col("_o1").isNull() | F.col("_o2").isNull()
    off = (F.col("order1") != F.col("_o1")) | (F.col("order2") != F.col("_o2"))
    return (
        pairs.join(known1, "gene1", "left")
        .join(known2, "gene2", "left")
        .groupBy(*by)
        .agg(
            F.count("*").alias("pairs"),
            F.count_if(unknown).alias("unknown_gene_pairs"),
            F.count_if(~unknown & off).alias("order_mismatches"),
        )
    )


def collinearity_qc(
    blocks: DataFrame, pairs: DataFrame, by: Sequence[str], totals: DataFrame
) -> DataFrame:
    """One QC row per group.

    blocks: by, block_id, score, pvalue, n, orientation. pairs: by, block_id,
    gene1, gene2. totals: by, n1, n2. The median block size is the upper median.
    """
    keys = list(by)
    sizes = pairs.groupBy(*keys, "block_id").agg(F.count("*").alias("_size"))
    sized = blocks.join(sizes, [*keys, "block_id"], "left").withColumn("_size", F.coalesce("_size", F.lit(0)))
    per_block = sized.groupBy(*keys).agg(
        F.count("*").alias("block_count"),
        F.min("_size").alias("minimum_block_size"),
        F.max("_size").alias("maximum_block_size"),
        F.avg("_size").alias("mean_block_size"),
        F.avg("score").alias("mean_block_score"),
        F.avg("pvalue").alias("mean_block_pvalue"),
        F.count_if(F.col("orientation") == "plus").alias("plus_blocks"),
        F.count_if(F.col("orientation") == "minus").alias("minus_blocks"),
        F.count_if(~F.col("orientation").isin("plus", "minus")).alias("other_orientation_blocks"),
        F.count_if(F.col("_size") != F.col("n")).alias("block_size_mismatches"),
    )
    middle = exact_quantiles(sized, keys, "_size", {"median_block_size": 0.5}, "upper")
    distinct = pairs.groupBy(*keys, "gene1", "gene2").agg(F.count("*").alias("_n"))
    per_pair = distinct.groupBy(*keys).agg(
        F.sum("_n").alias("collinear_gene_pairs"),
        F.count("*").alias("unique_collinear_gene_pairs"),
        F.sum(F.col("_n") - 1).alias("duplicate_gene_pairs"),
        F.sum(F.when(F.col("gene1") == F.col("gene2"), F.col("_n")).otherwise(0)).alias("same_gene_pairs"),
    )
    # A group without blocks or without pairs keeps its row, with counts of zero.
    joined = totals.select(*keys, "n1", "n2").join(per_block, keys, "full").join(middle, keys, "left").join(per_pair, keys, "full")
    for gene, name in (("gene1", "species1_genes_in_blocks"), ("gene2", "species2_genes_in_blocks")):
        joined = joined.join(distinct_in(distinct, keys, gene, name), keys, "left")
    counts = [
        "block_count", "plus_blocks", "minus_blocks", "other_orientation_blocks", "block_size_mismatches", "collinear_gene_pairs",
        "unique_collinear_gene_pairs", "duplicate_gene_pairs", "same_gene_pairs", "species1_genes_in_blocks", "species2_genes_in_blocks",
    ]
    return (
        joined.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in counts})
        .withColumn("species1_block_gene_coverage", F.try_divide("species1_genes_in_blocks", "n1"))
        .withColumn("species2_block_gene_coverage", F.try_divide("species2_genes_in_blocks", "n2"))
    )


def repeated_pairs(pairs: DataFrame, by: Sequence[str], a: str, b: str) -> DataFrame:
    seen = pairs.groupBy(*by, a, b).agg(F.count("*").alias("_n"))
    total, unique = F.sum("_n"), F.count("*")
    return seen.groupBy(*by).agg(
        total.alias("total_pairs"),
        unique.alias("unique_pairs"),
        (total - unique).alias("repeated_pairs"),
        ((total - unique) / total).alias("repeated_fraction"),
    )


def parameter_sensitivity(
    summary: DataFrame,
    by: Sequence[str],
    set_col: str,
    measures: Sequence[str],
    strict: str = "strict",
    sensitive: str = "sensitive",
) -> DataFrame:
    """Strict and sensitive values side by side, their ratio and % change, and a flag."""
    wide = summary.groupBy(*by).agg(
        *[
            F.max(F.when(F.col(set_col) == value, F.col(m))).alias(f"{label}_{m}")
            for m in measures
            for label, value in (("strict", strict), ("sensitive", sensitive))
        ]
    )
    changes = []
    for m in measures:
        s, t = F.col(f"strict_{m}"), F.col(f"sensitive_{m}")
        wide = wide.withColumn(f"{m}_ratio", F.try_divide(t, s)).withColumn(
            f"{m}_percent_change", F.try_divide(t - s, s) * 100
        )
        changes.append(F.abs(f"{m}_percent_change"))
    most = F.greatest(*changes) if len(changes) > 1 else changes[0]
    flag = (
        F.when(most >= 50, "HIGH_SENSITIVITY").when(most >= 20, "MODERATE_SENSITIVITY").when(most.isNotNull(), "STABLE")
    )
    return wide.withColumn("review_flag", flag)


def merge_summary(rows: DataFrame, by: Sequence[str], pair: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Rows, unique pairs and finite values per group."""
    finite = {c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in values}
    seen = rows.groupBy(*by, *pair).agg(
        F.count("*").alias("_n"), *[F.count_if(test).alias(f"_f_{c}") for c, test in finite.items()]
    )
    return seen.groupBy(*by).agg(
        F.sum("_n").alias("rows"),
        F.count("*").alias("unique_pairs"),
        *[F.sum(f"_f_{c}").alias(f"finite_{c}") for c in values],
    )


def block_summary(
    pairs: DataFrame, ks: DataFrame | None, block: Sequence[str], value: str = "ks", with_list: bool = False
) -> DataFrame:
    """Pairs joined with Ks to one row per block.

    pairs: block keys, pair_index, gene1, gene2, chr1, chr2, start1, start2. The
    median is exact by rank, not by a per-block buffer. with_list adds the ordered
    `_`-joined Ks cell, which by nature holds the whole block.
    """
    keys = list(block)
    valued = pairs if ks is None else pairs.join(ks, ["gene1", "gene2"], "left")
    blocks = valued.groupBy(*keys).agg(
        F.count("*").alias("length"),
        F.avg(value).alias("ks_average"),
        F.min("chr1").alias("chr1"),
        F.min("chr2").alias("chr2"),
        F.min("start1").alias("start1"),
        F.max("start1").alias("end1"),
        F.min("start2").alias("start2"),
        F.max("start2").alias("end2"),
    )
    out = blocks.join(exact_quantiles(valued, keys, value, {"ks_median": 0.5}), keys, "left")
    if not with_list:
        return out
    cells = valued.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pair_index", value))).alias("_l"))
    text = F.concat_ws("_", F.transform("_l", lambda e: e[value].cast("string")))
    return out.join(cells.select(*keys, text.alias("ks")), keys, "left")


def concat_sequences(parts: Sequence[DataFrame], seq_id: str = "seq_id") -> tuple[DataFrame, DataFrame]:
    """All sequence sets in one, and the ids that occur more than once."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole, whole.groupBy(seq_id).agg(F.count("*").alias("occurrences")).filter("occurrences > 1")


def latest_runs(tables: Sequence[DataFrame], a: str, b: str, order: str = "run_order") -> DataFrame:
    """Runs of several steps; per unordered pair the row of the latest step wins.

    Within a step the row with the largest `order` wins.
    """
    staged = None
    for step, part in enumerate(tables):
        part = part.withColumn("step", F.lit(step))
        staged = part if staged is None else staged.unionByName(part)
    keyed = staged.withColumn("_p", F.least(a, b)).withColumn("_q", F.greatest(a, b))
    return first_per_group(keyed, ["_p", "_q"], [("step", "desc"), (order, "desc")]).drop("_p", "_q")


def undirected_lookup(wanted: DataFrame, runs: DataFrame, a: str, b: str, run_a: str, run_b: str) -> DataFrame:
    """Each wanted (a, b) with its run, stored either way round.

    orientation is FORWARD, REVERSE_AVAILABLE or NONE; status AVAILABLE or MISSING.
    """
    forward = runs.select(F.col(run_a).alias(a), F.col(run_b).alias(b), F.struct(*runs.columns).alias("_fwd"))
    backward = runs.select(F.col(run_b).alias(a), F.col(run_a).alias(b), F.struct(*runs.columns).alias("_rev"))
    joined = wanted.join(forward, [a, b], "left").join(backward, [a, b], "left")
    run = F.coalesce("_fwd", "_rev")
    orientation = (
        F.when(F.col("_fwd").isNotNull(), "FORWARD").when(F.col("_rev").isNotNull(), "REVERSE_AVAILABLE").otherwise("NONE")
    )
    extra = [c for c in runs.columns if c not in (run_a, run_b)]
    return joined.select(
        *wanted.columns,
        F.coalesce(run[run_a], F.col(a)).alias("stored_query"),
        F.coalesce(run[run_b], F.col(b)).alias("stored_subject"),
        *[run[c].alias(c) for c in extra],
        orientation.alias("orientation"),
        F.when(run.isNull(), "MISSING").otherwise("AVAILABLE").alias("status"),
    )


def join_manifests(first: DataFrame, others: Sequence[DataFrame], on: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Manifests side by side, and the keys of the first that lack a partner."""
    joined, absent = first, None
    for i, other in enumerate(others):
        gap = first.select(*on).join(other, list(on), "left_anti").withColumn("manifest", F.lit(i))
        absent = gap if absent is None else absent.unionByName(gap)
        joined = joined.join(other, list(on))
    return joined, absent
