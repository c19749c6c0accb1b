"""Chromosome-level synteny: anchor matrices, strong partners, components, layouts.

Tables called matrix or support have one row per chromosome pair of a comparison.
Windows here run over such tables only; gene-level tables are aggregated first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.ids import natural_key, ploidy_number
from ..session import cut_lineage
from .scale import expect_known, with_rank

BY = ("comparison",)


def map_pairs(
    pairs: DataFrame,
    loci_ref: DataFrame,
    loci_tgt: DataFrame,
    by: Sequence[str] = BY,
    stored_reversed: Column | None = None,
    unplaced: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Anchor pairs (gene1, gene2) placed on both genomes.

    loci tables: gene, chrom, midpoint, one row per gene. stored_reversed marks
    pairs whose first gene belongs to the target. Returns (mapped pairs, counts per
    group with the mapped fraction); callers gate the fraction at 0.80. A gene whose
    chromosome is null is not mapped, unless unplaced genes are to be kept.
    """
    turned = F.lit(False) if stored_reversed is None else stored_reversed
    oriented = pairs.select(
        *by,
        F.when(turned, F.col("gene2")).otherwise(F.col("gene1")).alias("ref_gene"),
        F.when(turned, F.col("gene1")).otherwise(F.col("gene2")).alias("tgt_gene"),
    )

    def side(loci: DataFrame, name: str) -> DataFrame:
        return loci.select(
            F.col("gene").alias(f"{name}_gene"),
            F.col("chrom").alias(f"{name}_chr"),
            F.col("midpoint").alias(f"{name}_mid"),
            F.lit(True).alias(f"_{name}"),
        )

    placed = oriented.join(side(loci_ref, "ref"), "ref_gene", "left").join(side(loci_tgt, "tgt"), "tgt_gene", "left")
    ref_known, tgt_known = (F.col(c).isNotNull() for c in (("_ref", "_tgt") if unplaced else ("ref_chr", "tgt_chr")))
    found = ref_known & tgt_known
    counts = placed.groupBy(*by).agg(
        F.count("*").alias("raw_anchor_count"),
        F.count_if(found).alias("mapped_anchor_count"),
        F.count_if(~ref_known).alias("unmapped_reference"),
        F.count_if(~tgt_known).alias("unmapped_target"),
        (F.count_if(found) / F.count("*")).alias("mapping_fraction"),
    )
    mapped = placed.filter(found).select(*by, "ref_gene", "ref_chr", "ref_mid", "tgt_gene", "tgt_chr", "tgt_mid")
    return mapped, counts


def anchor_matrix(mapped: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    return mapped.groupBy(*by, "ref_chr", "tgt_chr").agg(F.count("*").alias("n"))


def dense_matrix(
    support: DataFrame, ref_order: DataFrame, tgt_order: DataFrame, value: str, by: Sequence[str] = BY
) -> DataFrame:
    """Every cell of the ref x target axes with its ranks, zero where nothing is supported.

    Support for a chromosome that is on neither axis is an error.

    The result has one row per cell by definition; the target axis of a comparison
    (a chromosome list) travels as one array.
    """
    axis = tgt_order.groupBy(*by).agg(F.collect_list(F.struct("tgt_chr", F.col("rank").alias("tgt_rank"))).alias("_axis"))
    cells = (
        ref_order.select(*by, "ref_chr", F.col("rank").alias("ref_rank"))
        .join(axis, list(by))
        .select(*by, "ref_chr", "ref_rank", F.inline("_axis"))
    )
    joined = cells.join(support.select(*by, "ref_chr", "tgt_chr", value), [*by, "ref_chr", "tgt_chr"], "full")
    off = F.raise_error(F.concat(F.lit("support off the axes: "), F.concat_ws(" ", "ref_chr", "tgt_chr")))
    placed = F.when(F.col("ref_rank").isNotNull(), F.coalesce(value, F.lit(0))).otherwise(off.cast(support.schema[value].dataType))
    return joined.withColumn(value, placed)


def wide_matrix(dense: DataFrame, targets: Sequence, value: str, by: Sequence[str] = BY) -> DataFrame:
    """One column per target chromosome; targets fixes the column order."""
    return dense.groupBy(*by, "ref_chr", "ref_rank").pivot("tgt_chr", list(targets)).agg(F.first(value))


def strong_partners(matrix: DataFrame, by: Sequence[str] = BY, min_n: int = 20, rel: float = 0.25) -> DataFrame:
    """Matrix with ref_strong and tgt_strong: n >= min_n and n >= rel x the focal maximum."""

    def strong(focal: str) -> Column:
        return (F.col("n") >= min_n) & (F.col("n") >= rel * F.max("n").over(W.partitionBy(*by, focal)))

    return matrix.withColumn("ref_strong", strong("ref_chr")).withColumn("tgt_strong", strong("tgt_chr"))


def rearrangement_pairs(strong: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Strong chromosome pairs of a chromosome that has more than one strong partner."""

    def several(focal: str, flag: str) -> Column:
        return F.col(flag) & (F.count_if(F.col(flag)).over(W.partitionBy(*by, focal)) > 1)

    marked = strong.withColumn("_r", several("ref_chr", "ref_strong")).withColumn("_t", several("tgt_chr", "tgt_strong"))
    return marked.filter("_r or _t").select(*by, "ref_chr", "tgt_chr", "n")


def rearrangement_candidates(strong: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """One row per focal chromosome, either side, with several strong partners."""

    def side(focal: str, partner: str, flag: str, name: str) -> DataFrame:
        listed = strong.filter(flag).groupBy(*by, F.col(focal).cast("string").alias("focal_chr"))
        return (
            listed.agg(
                F.count("*").alias("strong_partner_count"),
                F.array_join(F.array_sort(F.collect_list(F.col(partner).cast("string"))), ",").alias("strong_partner_chromosomes"),
            )
            .filter("strong_partner_count > 1")
            .withColumn("focal_side", F.lit(name))
        )

    both = side("ref_chr", "tgt_chr", "ref_strong", "reference").unionByName(
        side("tgt_chr", "ref_chr", "tgt_strong", "target")
    )
    return both.withColumn("interpretation", F.lit("POTENTIAL_SPLIT_FUSION_TRANSLOCATION_OR_DUPLICATION"))


def connected_labels(edges: DataFrame, by: Sequence[str]) -> DataFrame:
    """Smallest node name of each node's component. edges: by, a, b (undirected).

    Each round takes the smallest label among neighbours and then the label of that
    label, so path lengths halve; labels are checkpointed per round.
    """
    keys = list(by)
    both = edges.select(*keys, "a", "b").unionByName(
        edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))
    )
    links = cut_lineage(both.distinct())
    labels = cut_lineage(links.groupBy(*keys, F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = (
            links.join(labels.withColumnRenamed("node", "b"), [*keys, "b"])
            .groupBy(*keys, F.col("a").alias("node"))
            .agg(F.min("label").alias("_near"))
        )
        closer = labels.join(near, [*keys, "node"]).select(
            *keys, "node", F.least("label", "_near").alias("_label"), F.col("label").alias("_old")
        )
        jump = closer.select(*keys, F.col("node").alias("_label"), F.col("_label").alias("_far"))
        moved = cut_lineage(
            closer.join(jump, [*keys, "_label"]).select(*keys, "node", F.least("_label", "_far").alias("label"), "_old")
        )
        changed = moved.filter("label <> _old").limit(1).count()
        labels = moved.drop("_old")
        if changed == 0:
            return labels


def component_ratio(strong: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Components of the reference-to-target strong graph, ranked by anchor support.

    Support sums all anchors between the component's chromosomes, strong or not.
    The rank-1 component of a comparison gives its ratio.
    """
    keys = list(by)
    ref_node = F.concat(F.lit("R:"), F.col("ref_chr").cast("string"))
    tgt_node = F.concat(F.lit("T:"), F.col("tgt_chr").cast("string"))
    labels = connected_labels(strong.filter("ref_strong").select(*keys, ref_node.alias("a"), tgt_node.alias("b")), keys)
    name = F.substring("node", 3, 1_000_000)

    def listed(prefix: str) -> Column:
        inside = F.startswith(F.col("node"), F.lit(prefix))
        entries = F.array_sort(F.collect_list(F.when(inside, F.struct(natural_key(name).alias("k"), name.alias("v")))))
        return F.array_join(F.transform(entries, lambda e: e["v"]), ",")

    members = labels.groupBy(*keys, "label").agg(
        F.count_if(F.startswith(F.col("node"), F.lit("R:"))).alias("ref_count"),
        F.count_if(F.startswith(F.col("node"), F.lit("T:"))).alias("tgt_count"),
        listed("R:").alias("ref_chromosomes"),
        listed("T:").alias("tgt_chromosomes"),
    )
    ref_side = labels.select(*keys, F.col("node").alias("_r"), "label")
    tgt_side = labels.select(*keys, F.col("node").alias("_t"), "label")
    support = (
        strong.select(*keys, ref_node.alias("_r"), tgt_node.alias("_t"), "n")
        .join(ref_side, [*keys, "_r"])
        .join(tgt_side, [*keys, "_t", "label"])
        .groupBy(*keys, "label")
        .agg(F.sum("n").alias("support"))
    )
    best = W.partitionBy(*keys).orderBy(
        F.desc("support"), F.desc("ref_count"), F.desc("tgt_count"), natural_key(F.col("ref_chromosomes"))
    )
    return (
        members.join(support, [*keys, "label"])
        .withColumn("component_rank", F.row_number().over(best))
        .withColumn("ratio", F.concat_ws(":", "ref_count", "tgt_count"))
        .drop("label")
    )


def modal_ratio(components: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """The ratio with the largest support summed over components; smaller counts break ties."""
    summed = components.groupBy(*by, "ratio", "ref_count", "tgt_count").agg(F.sum("support").alias("support"))
    rank = F.struct(F.col("support"), -F.col("ref_count"), -F.col("tgt_count"))
    return summed.groupBy(*by).agg(F.max_by("ratio", rank).alias("modal_ratio"), F.max("support").alias("support"))


def synteny_ratio(strong: DataFrame, ploidy: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Median number of strong partners each way and the smaller:larger-ploidy ratio.

    ploidy: by, ref_ploidy, tgt_ploidy such as 2x. Chromosomes with anchors but no
    strong partner count as depth 0. Equal ploidies give no ratio.
    """

    def depth(focal: str, flag: str, name: str) -> DataFrame:
        per = strong.groupBy(*by, focal).agg(F.count_if(flag).alias("_d"))
        return per.groupBy(*by).agg(F.median("_d").alias(name), (F.count("*") % 2 == 1).alias(f"_odd_{name}"))

    def text(name: str) -> Column:
        whole = F.col(name).cast("int").cast("string")
        return F.when(F.col(f"_odd_{name}"), whole).otherwise(F.col(name).cast("string"))

    ref, tgt = ploidy_number(F.col("ref_ploidy")), ploidy_number(F.col("tgt_ploidy"))
    r, t = text("ref_median_depth"), text("tgt_median_depth")
    return (
        depth("ref_chr", "ref_strong", "ref_median_depth")
        .join(depth("tgt_chr", "tgt_strong", "tgt_median_depth"), list(by))
        .join(ploidy, list(by))
        .withColumn(
            "interpreted_ratio", F.when(ref < tgt, F.concat_ws(":", r, t)).when(tgt < ref, F.concat_ws(":", t, r))
        )
        .drop("_odd_ref_median_depth", "_odd_tgt_median_depth")
    )


def order_targets(matrix: DataFrame, ref_order: DataFrame, targets: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Target chromosomes in the order that follows the reference.

    ref_order: by, ref_chr, rank. targets: by, tgt_chr, number (999 if it has none).
    Sorted by rank of the strongest reference, anchor-weighted mean rank, strongest
    count, natural name. Without anchors the strongest reference is the first one
    and the position is the axis length plus the number. Anchors on reference
    chromosomes outside the axis have no place on it and do not count.
    """
    keys = list(by)
    axis = ref_order.groupBy(*keys).agg(F.count("*").alias("_axis"), F.min_by("ref_chr", "rank").alias("_first"))
    ranked = matrix.join(ref_order.select(*keys, "ref_chr", "rank"), [*keys, "ref_chr"]).filter("n > 0")
    stats = ranked.groupBy(*keys, "tgt_chr").agg(
        F.max_by(F.struct("ref_chr", "rank", "n"), F.struct("n", -F.col("rank"))).alias("_s"),
        F.sum("n").alias("total_anchors"),
        (F.sum(F.col("rank") * F.col("n")) / F.sum("n")).alias("_mean"),
    )
    rows = (
        targets.join(axis, keys)
        .join(stats, [*keys, "tgt_chr"], "left")
        .select(
            *keys,
            "tgt_chr",
            F.coalesce(F.col("_s.ref_chr"), F.col("_first")).alias("strongest_ref_chr"),
            F.coalesce(F.col("_s.n"), F.lit(0)).alias("strongest_anchors"),
            F.coalesce("total_anchors", F.lit(0)).alias("total_anchors"),
            F.coalesce("_mean", (F.col("_axis") + F.col("number")).cast("double")).alias("weighted_position"),
            F.coalesce(F.col("_s.rank"), F.lit(1)).alias("strongest_rank"),
        )
    )
    order = W.partitionBy(*keys).orderBy(
        "strongest_rank", "weighted_position", F.desc("strongest_anchors"), natural_key(F.col("tgt_chr").cast("string"))
    )
    return rows.withColumn("plot_rank", F.row_number().over(order))


def orientation(
    mapped: DataFrame, ref_order: DataFrame, ref_lengths: DataFrame, tgt_lengths: DataFrame, by: Sequence[str] = BY
) -> DataFrame:
    """Sign per target chromosome from the correlation of reference and target positions.

    Fewer than five anchors count as `+` with correlation 0.
    """
    keys = list(by)
    ref = ref_order.join(ref_lengths.select(*keys, "ref_chr", F.col("length_bp").alias("_rl")), [*keys, "ref_chr"])
    tgt = tgt_lengths.select(*keys, "tgt_chr", F.col("length_bp").alias("_tl"))
    known = expect_known(mapped, ref.select(*keys, "ref_chr", "rank", "_rl"), [*keys, "ref_chr"], "reference chromosome without rank or length")
    placed = expect_known(known, tgt, [*keys, "tgt_chr"], "target chromosome without length")
    x = F.col("rank") + F.col("ref_mid") / F.greatest(F.lit(1), F.col("_rl"))
    y = F.col("tgt_mid") / F.greatest(F.lit(1), F.col("_tl"))
    # Pearson r from its parts: the built-in corr fails on a constant side. There r is none;
    # the deviation of equal values need not come out as zero.
    varied = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    r_parts = F.when(varied, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))
    measured = placed.groupBy(*keys, "tgt_chr").agg(F.count("*").alias("n"), r_parts.alias("_r"))
    n = F.coalesce("n", F.lit(0))
    r = F.when(n < 5, 0.0).otherwise(F.coalesce("_r", F.lit(0.0)))
    return (
        tgt.select(*keys, "tgt_chr")
        .join(measured, [*keys, "tgt_chr"], "left")
        .select(*keys, "tgt_chr", n.alias("anchors_used"), r.alias("correlation"))
        .withColumn("orientation", F.when(F.col("correlation") < 0, "-").otherwise("+"))
    )


def running_layout(chroms: DataFrame, by: Sequence[str], gap: float, chrom: str = "chrom") -> DataFrame:
    """start, end, midpoint on [0, 1]: width by length, `gap` between neighbours.

    chroms: by, chrom, rank, length_bp.
    """
    usable = 1.0 - gap * F.greatest(F.lit(0), F.count("*").over(W.partitionBy(*by)) - 1)
    return _layout(chroms, by, chrom, usable, gap, "midpoint")


def radial_layout(chroms: DataFrame, by: Sequence[str], gap_degrees: float, chrom: str = "chrom") -> DataFrame:
    """The same on a full circle in radians, with a gap after every chromosome."""
    gap = F.radians(F.lit(gap_degrees))
    usable = 2 * F.pi() - gap * F.count("*").over(W.partitionBy(*by))
    return _layout(chroms, by, chrom, usable, gap, "center")


def _layout(chroms: DataFrame, by: Sequence[str], chrom: str, usable: Column, gap, middle: str) -> DataFrame:
    whole, before = W.partitionBy(*by), W.partitionBy(*by).orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
    room = F.when(usable <= 0, F.raise_error(F.lit("gap too large: no width remains"))).otherwise(usable)
    total = F.sum("length_bp").over(whole)
    place = F.row_number().over(W.partitionBy(*by).orderBy("rank")) - 1
    start = room * F.coalesce(F.sum("length_bp").over(before), F.lit(0)) / total + gap * place
    return (
        chroms.withColumn("start", start)
        .withColumn("width", room * F.col("length_bp") / total)
        .withColumn("end", F.col("start") + F.col("width"))
        .withColumn(middle, F.col("start") + F.col("width") / 2)
        .select(*by, chrom, "rank", "length_bp", "start", "end", middle, "width")
    )


def window_angles(windows: DataFrame, layout: DataFrame, by: Sequence[str], chrom: str = "chrom") -> DataFrame:
    """theta (middle) and width of every window on a radial layout."""
    arcs = layout.select(*by, chrom, "length_bp", F.col("start").alias("_a"), F.col("width").alias("_w"))
    first = F.col("_a") + F.col("_w") * F.col("window_start") / F.col("length_bp")
    last = F.col("_a") + F.col("_w") * F.col("window_end") / F.col("length_bp")
    return windows.join(arcs, [*by, chrom]).select(
        *windows.columns, ((first + last) / 2).alias("theta"), (last - first).alias("theta_width")
    )


def adjacent_pairs(order: DataFrame, by: Sequence[str], species: str, rank: str = "rank") -> DataFrame:
    """Neighbours in a ranked species list."""
    line = W.partitionBy(*by).orderBy(rank)
    return (
        order.withColumn("lower", F.lead(species).over(line))
        .withColumn("edge_rank", F.row_number().over(line))
        .filter(F.col("lower").isNotNull())
        .select(*by, F.col(species).alias("upper"), "lower", "edge_rank")
    )


def every_nth_sample(rows: DataFrame, by: Sequence[str], order: Sequence[Column], max_n: int) -> DataFrame:
    """Rows int(k*n/max_n), k = 0, 1, ...; all rows when a group has no more than max_n."""
    totals = rows.groupBy(*by).agg(F.count("*").alias("_n"))
    i, n = F.col("_i") - 1, F.col("_n")
    next_k = F.floor((i * max_n + n - 1) / n)
    return (
        with_rank(rows, by, order, "_i")
        .join(totals, list(by))
        .filter((n <= max_n) | (next_k * n < (i + 1) * max_n))
        .drop("_i", "_n")
    )


def link_x(mid: Column, length: Column, start: Column, end: Column, sign: Column | None = None) -> Column:
    """Track position of a midpoint, clamped to its chromosome and flipped for `-`."""
    fraction = F.least(F.lit(1.0), F.greatest(F.lit(0.0), mid / F.greatest(F.lit(1), length)))
    if sign is not None:
        fraction = F.when(sign == "-", 1.0 - fraction).otherwise(fraction)
    return start + fraction * (end - start)


def link_positions(
    mapped: DataFrame, ref_layout: DataFrame, tgt_layout: DataFrame, signs: DataFrame, by: Sequence[str] = BY
) -> DataFrame:
    """x_ref and x_tgt of every mapped pair. Layouts: by, chrom, length_bp, start, end."""
    keys = list(by)

    def side(layout: DataFrame, prefix: str) -> DataFrame:
        return layout.select(
            *keys,
            F.col("chrom").alias(f"{prefix}_chr"),
            *[F.col(c).alias(f"_{prefix}_{c}") for c in ("length_bp", "start", "end")],
        )

    joined = expect_known(mapped, side(ref_layout, "ref"), [*keys, "ref_chr"], "reference chromosome without place")
    targets = side(tgt_layout, "tgt").join(signs.select(*keys, "tgt_chr", "orientation"), [*keys, "tgt_chr"])
    joined = expect_known(joined, targets, [*keys, "tgt_chr"], "target chromosome without place or sign")
    x = {
        p: link_x(F.col(f"{p}_mid"), F.col(f"_{p}_length_bp"), F.col(f"_{p}_start"), F.col(f"_{p}_end"), s)
        for p, s in (("ref", None), ("tgt", F.col("orientation")))
    }
    return joined.select(*mapped.columns, x["ref"].alias("x_ref"), x["tgt"].alias("x_tgt"))
