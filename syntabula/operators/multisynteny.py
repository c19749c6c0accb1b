"""Partner depth, chromosome support and two-partner classes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .scale import dealt, expect_known

BY = ("comparison",)


def partner_depth(
    pairs: DataFrame, by: Sequence[str] = BY, chromosome_list: bool = True, gene_list: bool = False, partitions: int | None = None
) -> DataFrame:
    """Distinct partner genes and chromosomes per reference gene, with their classes.

    pairs: by, ref_chr, ref_gene, tgt_chr, tgt_gene. Partners are made distinct
    before they are counted. The chromosome list is short by nature; gene_list adds
    the partner genes, which puts all of a gene's partners into one cell. Partners without
    a chromosome count as genes; a list of none is null. partitions deals the pairs by
    gene once, in so many partitions, for all that follows.
    """
    keys = [*by, "ref_chr", "ref_gene"]
    # Structs are equal where their fields are, nulls included: a join on keys would lose those.
    pairs = pairs.select(F.struct(*keys).alias("_key"), "tgt_chr", "tgt_gene")
    if partitions:
        pairs = dealt(pairs, ["_key"], partitions)

    def per_gene(col: str, count: str, listed: str | None) -> DataFrame:
        aggregates = [F.count(col).alias(count)]
        if listed:
            text = F.array_sort(F.collect_list(F.col(col).cast("string")))
            aggregates.append(F.when(F.count(col) > 0, F.array_join(text, ",")).alias(listed))
        return pairs.select("_key", col).distinct().groupBy("_key").agg(*aggregates)

    genes, chroms = F.col("partner_gene_count"), F.col("partner_chromosome_count")
    return (
        per_gene("tgt_gene", "partner_gene_count", "target_genes" if gene_list else None)
        .join(per_gene("tgt_chr", "partner_chromosome_count", "target_chromosomes" if chromosome_list else None), "_key")
        .select("_key.*", "*")
        .drop("_key")
        .withColumn("partner_depth_class", F.when(genes > 2, ">2").otherwise(genes.cast("string")))
        .withColumn(
            "chromosome_depth_class", F.when(chroms > 2, ">2_chr").otherwise(F.concat(chroms.cast("string"), F.lit("_chr")))
        )
        .withColumn("two_on_distinct_chr", (genes >= 2) & (chroms >= 2))
    )


def depth_summary(depth: DataFrame, totals: DataFrame, by: Sequence[str] = BY, negative_zero: str = "floor") -> DataFrame:
    """One row per comparison. totals: by, ordered_genes.

    More represented than ordered genes means 0 undetected genes with
    negative_zero="floor" and an error with "error".
    """
    flat = depth.groupBy(*by).agg(
        F.count_distinct("ref_gene").alias("genes_with_any_partner"),
        F.count_if(F.col("partner_gene_count") == 1).alias("genes_with_1_partner"),
        F.count_if(F.col("partner_gene_count") == 2).alias("genes_with_2_partners"),
        F.count_if(F.col("partner_gene_count") > 2).alias("genes_with_gt2_partners"),
        F.count_if("two_on_distinct_chr").alias("genes_ge2_on_distinct_chr"),
        F.count_if(F.col("partner_chromosome_count") == 2).alias("genes_exactly_2_chr"),
        F.count_if(F.col("partner_chromosome_count") >= 2).alias("genes_ge2_chr"),
    )
    any_gene, ordered = F.col("genes_with_any_partner"), F.col("ordered_genes")
    missing = ordered - any_gene
    if negative_zero == "floor":
        zero = F.greatest(missing, F.lit(0))
    else:
        zero = F.when(missing < 0, F.raise_error(F.lit("more syntenic than ordered genes"))).otherwise(missing)

    def share(part: str, whole: Column) -> Column:
        return F.coalesce(F.try_divide(F.col(part), whole), F.lit(0.0))

    # A comparison without any partner keeps its row.
    every = totals.select(*by, "ordered_genes").join(flat, list(by), "full")
    counted = {c: F.coalesce(c, F.lit(0).cast("long")) for c in flat.columns if c not in by}
    return every.withColumns(counted).withColumns(
        {
            "genes_with_0_partners": zero,
            "fraction_any_partner": share("genes_with_any_partner", ordered),
            "fraction_1_partner": share("genes_with_1_partner", any_gene),
            "fraction_2_partners": share("genes_with_2_partners", any_gene),
            "fraction_gt2_partners": share("genes_with_gt2_partners", any_gene),
            "fraction_ge2_distinct_chr": share("genes_ge2_on_distinct_chr", any_gene),
        }
    )


def chromosome_support(pairs: DataFrame, by: Sequence[str] = BY, ordered: DataFrame | None = None) -> DataFrame:
    """Distinct genes either side and pairs per chromosome pair.

    ordered (by, ref_chr, ordered_genes) adds the fraction of the reference
    chromosome's genes.
    """
    keys = [*by, "ref_chr", "tgt_chr"]
    # Two plain two-step counts instead of one aggregate with two distinct columns,
    # which would multiply every row.
    ref = pairs.groupBy(*keys, "ref_gene").agg(F.count("*").alias("_n")).groupBy(*keys).agg(
        F.count("*").alias("ref_genes"), F.sum("_n").alias("gene_pairs")
    )
    tgt = pairs.select(*keys, "tgt_gene").distinct().groupBy(*keys).agg(F.count("*").alias("tgt_genes"))
    out = ref.join(tgt, keys)
    if ordered is None:
        return out
    return out.join(ordered, [*by, "ref_chr"], "left").withColumn(
        "ref_fraction", F.coalesce(F.try_divide("ref_genes", "ordered_genes"), F.lit(0.0))
    )


def ranked_partners(support: DataFrame, pairs: DataFrame, tgt_order: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Target chromosomes per reference chromosome, most reference genes first.

    support_fraction is the share of the reference chromosome's syntenic genes.
    The window runs over chromosome pairs.
    """
    keys = [*by, "ref_chr"]
    totals = pairs.groupBy(*keys).agg(F.count_distinct("ref_gene").alias("ref_chr_genes"))
    best = W.partitionBy(*keys).orderBy(F.desc("ref_genes"), F.desc("gene_pairs"), "_tgt_rank")
    return (
        expect_known(
            support, tgt_order.select(*by, "tgt_chr", F.col("rank").alias("_tgt_rank")), [*by, "tgt_chr"], "target chromosome without rank"
        )
        .withColumn("target_rank", F.row_number().over(best))
        .join(totals, keys)
        .withColumn("support_fraction", F.col("ref_genes") / F.col("ref_chr_genes"))
        .drop("_tgt_rank")
    )


def top2_partners(ranked: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Best and second target chromosome per reference chromosome."""

    def pick(rank: int, col: str) -> Column:
        return F.max(F.when(F.col("target_rank") == rank, F.col(col)))

    return ranked.filter("target_rank <= 2").groupBy(*by, "ref_chr").agg(
        F.max("ref_chr_genes").alias("ref_chr_genes"),
        pick(1, "tgt_chr").alias("top1_chr"),
        pick(1, "ref_genes").alias("top1_genes"),
        pick(2, "tgt_chr").alias("top2_chr"),
        F.coalesce(pick(2, "ref_genes"), F.lit(0)).alias("top2_genes"),
    )


def gene_support_class(pairs: DataFrame, top2: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Per reference gene: which of its chromosome's two best partners it is found on."""
    keys = [*by, "ref_chr"]
    genes = (
        pairs.select(*keys, "ref_gene", "tgt_chr")
        .distinct()
        .join(top2.select(*keys, "top1_chr", "top2_chr"), keys)
        .groupBy(*keys, "ref_gene")
        .agg(
            F.count("*").alias("target_chromosomes"),
            F.bool_or(F.col("tgt_chr") == F.col("top1_chr")).alias("on_top1"),
            F.coalesce(F.bool_or(F.col("tgt_chr") == F.col("top2_chr")), F.lit(False)).alias("on_top2"),
        )
    )
    label = (
        F.when(F.col("on_top1") & F.col("on_top2"), "both_top1_top2")
        .when(F.col("on_top1"), "top1_only")
        .when(F.col("on_top2"), "top2_only")
        .otherwise("other_target_chr")
    )
    return genes.withColumn("support_class", label)


def two_partner_class(
    top2: DataFrame, gene_support: DataFrame, by: Sequence[str] = BY, rule: str = "secondary"
) -> DataFrame:
    """Second-partner ratio, union and dual fractions, and the pattern class.

    rule="secondary" grades the second partner at 0.25 (single_dominant_partner,
    strong_1to2_candidate, moderate_secondary_partner, weak_secondary_partner);
    rule="balanced" at 0.50 (single_target, strong_1to2_candidate,
    moderate_balanced_two_partner, weak_second_partner).
    """
    keys = [*by, "ref_chr"]
    sets = gene_support.groupBy(*keys).agg(
        F.count_if(F.col("on_top1") | F.col("on_top2")).alias("union_genes"),
        F.count_if(F.col("on_top1") & F.col("on_top2")).alias("dual_genes"),
        F.count_if(F.col("target_chromosomes") == 2).alias("genes_exactly_2_chr"),
        F.count_if(F.col("target_chromosomes") >= 2).alias("genes_ge2_chr"),
    )
    rows = top2.join(sets, keys).withColumns(
        {
            "top1_fraction": F.col("top1_genes") / F.col("ref_chr_genes"),
            "top2_fraction": F.col("top2_genes") / F.col("ref_chr_genes"),
            "second_to_first_ratio": F.coalesce(F.try_divide("top2_genes", "top1_genes"), F.lit(0.0)),
            "union_fraction": F.col("union_genes") / F.col("ref_chr_genes"),
            "dual_fraction": F.col("dual_genes") / F.col("ref_chr_genes"),
        }
    )
    return rows.withColumn("pattern_class", pattern_class(rule))


def pattern_class(rule: str) -> Column:
    single = F.col("top2_chr").isNull()
    ratio = F.col("second_to_first_ratio")
    strong = (ratio >= 0.50) & (F.col("union_fraction") >= 0.70)
    names = RULES[rule]
    return (
        F.when(single, names["single"])
        .when(strong, names["strong"])
        .when(ratio >= names["moderate_at"], names["moderate"])
        .otherwise(names["weak"])
    )


# Class names and the ratio from which a partner counts as moderate.
RULES = {
    "secondary": {
        "single": "single_dominant_partner",
        "strong": "strong_1to2_candidate",
        "moderate": "moderate_secondary_partner",
        "moderate_at": 0.25,
        "weak": "weak_secondary_partner",
    },
    "balanced": {
        "single": "single_target",
        "strong": "strong_1to2_candidate",
        "moderate": "moderate_balanced_two_partner",
        "moderate_at": 0.50,
        "weak": "weak_second_partner",
    },
}


def multisynteny_summary(classes: DataFrame, pairs: DataFrame, by: Sequence[str] = BY, rule: str = "secondary") -> DataFrame:
    """One row per comparison: class counts, genes on two chromosomes, medians over chromosomes."""
    names = RULES[rule]
    genes = (
        pairs.select(*by, "ref_gene", "tgt_chr")
        .distinct()
        .groupBy(*by, "ref_gene")
        .agg(F.count("*").alias("_chroms"))
        .groupBy(*by)
        .agg(
            F.count("*").alias("ref_genes"),
            F.count_if(F.col("_chroms") == 2).alias("genes_exactly_2_chr"),
            F.count_if(F.col("_chroms") >= 2).alias("genes_ge2_chr"),
            (F.count_if(F.col("_chroms") >= 2) / F.count("*")).alias("fraction_ge2_chr"),
        )
    )

    def of(kind: str) -> Column:
        return F.count_if(F.col("pattern_class") == names[kind])

    per_chromosome = classes.groupBy(*by).agg(
        F.count("*").alias("ref_chromosomes"),
        of("strong").alias("strong_chromosomes"),
        of("moderate").alias("moderate_chromosomes"),
        of("weak").alias("weak_chromosomes"),
        of("single").alias("single_chromosomes"),
        (of("strong") / F.count("*")).alias("strong_fraction"),
        F.median("second_to_first_ratio").alias("median_second_to_first_ratio"),
        F.median("union_fraction").alias("median_union_fraction"),
        F.median("dual_fraction").alias("median_dual_fraction"),
    )
    return per_chromosome.join(genes, list(by))
