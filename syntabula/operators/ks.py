"""Ks distributions: block curation, audits, densities, peaks and their support."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..functions import draws as D, peaks as P
from ..session import cut_lineage
from .scale import exact_quantiles, spread

# Block limits.
MAX_PVALUE, MIN_LENGTH, MIN_KS, MAX_KS, MAX_TANDEM = 0.2, 10, 0.0, 3.0, 0.5
# The five bandwidth factors.
FACTORS = (0.6, 0.8, 1.0, 1.2, 1.5)


@dataclass(frozen=True)
class KdeSpec:
    """Range and grid of the log-space density and the peak rules on it."""

    low: float = 0.1
    high: float = 3.0
    points: int = 1601
    min_values: int = 20
    prominence: float = 0.05
    log_distance: float = 0.12
    edge: float = 1.01
    grid: np.ndarray = field(init=False, repr=False, compare=False)

    def __post_init__(self):
        object.__setattr__(self, "grid", np.linspace(math.log(self.low), math.log(self.high), self.points))

    @property
    def distance(self) -> int:
        return max(1, int(self.log_distance / float(self.grid[1] - self.grid[0])))


SPEC = KdeSpec()


def filter_blocks(
    blocks: DataFrame,
    max_pvalue: float = MAX_PVALUE,
    min_length: int = MIN_LENGTH,
    min_ks: float = MIN_KS,
    max_ks: float = MAX_KS,
    max_tandem: float = MAX_TANDEM,
) -> DataFrame:
    """Adds reject_reason (first broken rule, NULL when kept) and low_tandem."""
    reason = (
        F.when(F.col("pvalue") > max_pvalue, "pvalue")
        .when(F.col("length") < min_length, "length")
        .when(F.col("ks_median") <= min_ks, "nonpositive_ks")
        .when(F.col("ks_median") > max_ks, "high_ks")
    )
    return blocks.withColumn("reject_reason", reason).withColumn(
        "low_tandem", F.col("reject_reason").isNull() & (F.col("tandem_ratio") <= max_tandem)
    )


def filter_funnel(judged: DataFrame, by: Sequence[str]) -> DataFrame:
    """Blocks per reject reason, kept blocks, kept fraction and the low-tandem subset."""
    reason = F.col("reject_reason")
    kept = F.count_if(reason.isNull())
    return judged.groupBy(*by).agg(
        F.count("*").alias("raw_blocks"),
        *[F.count_if(reason == r).alias(f"failed_{r}") for r in ("pvalue", "length", "nonpositive_ks", "high_ks")],
        kept.alias("primary_blocks"),
        (kept / F.count("*")).alias("primary_fraction"),
        F.count_if("low_tandem").alias("low_tandem_blocks"),
        F.count_if(reason.isNull() & ~F.col("low_tandem")).alias("high_tandem_blocks"),
    )


def pair_values(blocks: DataFrame, keep: Sequence[str], values: Column, max_ks: float = MAX_KS) -> DataFrame:
    """Block value lists to one row per value in (0, max_ks], numbered within its block."""
    listed = blocks.select(*keep, F.posexplode(values).alias("_i", "pair_ks"))
    return listed.filter((F.col("pair_ks") > 0) & (F.col("pair_ks") <= max_ks)).select(
        *keep, (F.col("_i") + 1).alias("pair_index"), "pair_ks"
    )


def list_length_mismatches(blocks: DataFrame, by: Sequence[str], values: Column) -> DataFrame:
    return blocks.groupBy(*by).agg(F.count_if(F.size(values) != F.col("length")).alias("ks_list_length_mismatches"))


def range_split(values: DataFrame, by: Sequence[str], value: str, low: float = 0.1, high: float = 3.0) -> DataFrame:
    """Counts and shares of positive values below, inside and above [low, high]."""
    v = F.col(value)
    inside = (v >= low) & (v <= high)
    total = F.count("*")
    return (
        values.filter((v > 0) & (v < float("inf")) & ~F.isnan(v))
        .groupBy(*by)
        .agg(
            total.alias("all_positive"),
            F.count_if(v < low).alias("below"),
            F.count_if(inside).alias("inside"),
            F.count_if(v > high).alias("above"),
            (F.count_if(v < low) / total).alias("fraction_below"),
            (F.count_if(inside) / total).alias("fraction_inside"),
            (F.count_if(v > high) / total).alias("fraction_above"),
            F.min(v).alias("minimum"),
            F.min(F.when(inside, v)).alias("inside_minimum"),
            F.max(F.when(inside, v)).alias("inside_maximum"),
        )
    )


def bin_number(value: Column, width: float, bins: int) -> Column:
    """Bin whose edges k*width hold the value; the last bin includes its upper edge."""
    guess = F.floor(value / width)
    exact = guess - (value < guess * width).cast("int") + (value >= (guess + 1) * width).cast("int")
    return F.least(exact, F.lit(bins - 1))


def histogram(
    values: DataFrame, by: Sequence[str], value: str, width: float = 0.05, low: float = 0.0, high: float = 3.0
) -> DataFrame:
    """Every bin of every group, empty ones with n = 0."""
    bins = round((high - low) / width)
    counts = (
        values.filter(F.col(value).between(low, high))
        .groupBy(*by, bin_number(F.col(value) - low, width, bins).alias("bin"))
        .agg(F.count("*").alias("n"))
    )
    axis = F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))
    every = values.select(*by).distinct().withColumn("bin", F.explode(axis))
    return every.join(counts, [*by, "bin"], "left").select(
        *by,
        "bin",
        (F.lit(low) + (F.col("bin") + 0.5) * width).alias("center"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def smooth_bins(hist: DataFrame, by: Sequence[str], kernel: Sequence[float] = (1, 2, 3, 2, 1)) -> DataFrame:
    """Centred weighted mean over neighbouring bins, zero outside. A group is one bin axis."""
    line = W.partitionBy(*by).orderBy("bin")
    half = len(kernel) // 2
    weighted = sum(
        F.coalesce(F.lag("n", half - i).over(line), F.lit(0)) * F.lit(float(w) / sum(kernel)) for i, w in enumerate(kernel)
    )
    return hist.withColumn("smooth", weighted)


def _curve_peaks(curve: DataFrame, by: Sequence[str], x: str, y: str, distance: int, carry: Sequence[str] = ()) -> DataFrame:
    """Peaks that keep their distance: by, location, height, prominence, place, top (the curve's maximum), carry.

    Array expressions over a curve's runs of equal heights: a run above both neighbours is a
    peak at its middle; peaks are taken from high to low (of equal ones the later first) unless one
    within distance was taken; the prominence goes down to the higher of the lowest points
    before the next higher run, or the end, on either side. A curve is a fixed axis (bins
    or grid points), so one group is one short array. carry: columns that are constant in a group.
    """
    points = F.array_sort(F.collect_list(F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))))
    lines = curve.groupBy(*by).agg(points.alias("_c"), *[F.first(c).alias(c) for c in carry])
    heights = lines.withColumn("_y", F.transform("_c", lambda p: p["y"]))
    last = F.size("_y") - 1
    starts = F.filter(F.sequence(F.lit(0), last), lambda i: (i == 0) | (F.get("_y", i) != F.get("_y", i - 1)))
    runs = heights.withColumn("_start", starts).withColumn("_level", F.transform("_start", lambda i: F.get("_y", i)))
    level = lambda k: F.get("_level", k)
    inner = F.when(F.size("_level") > 2, F.sequence(F.lit(1), F.size("_level") - 2)).otherwise(F.array().cast("array<int>"))
    tops = F.filter(inner, lambda k: (level(k) > level(k - 1)) & (level(k) > level(k + 1)))
    middle = lambda k: F.floor((F.get("_start", k) + F.get("_start", k + 1) - 1) / 2).cast("int")
    ranked = F.array_sort(F.transform(tops, lambda k: F.struct((-level(k)).alias("low"), (-middle(k)).alias("back"), k.alias("k"))))
    kept = F.aggregate(
        ranked,
        F.array().cast("array<struct<low:double,back:int,k:int>>"),
        lambda taken, c: F.when(F.exists(taken, lambda t: F.abs(t["back"] - c["back"]) < distance), taken).otherwise(F.concat(taken, F.array(c))),
    )
    each = runs.withColumn("_p", F.explode(kept)).withColumns({"height": -F.col("_p.low"), "place": -F.col("_p.back"), "_k": F.col("_p.k")})
    # The sides from the peak outwards, itself first, up to the first higher run.
    sides = {"_left": F.reverse(F.slice("_level", F.lit(1), F.col("_k") + 1)), "_right": F.slice("_level", F.col("_k") + 1, F.size("_level"))}

    def lowest(side: str) -> Column:
        higher = F.array_position(F.transform(side, lambda h: h > F.col("height")), True)
        return F.array_min(F.when(higher > 0, F.slice(side, F.lit(1), (higher - 1).cast("int"))).otherwise(F.col(side)))

    return each.withColumns(sides).select(
        *by,
        F.get("_c", F.col("place"))["x"].alias("location"),
        "height",
        (F.col("height") - F.greatest(lowest("_left"), lowest("_right"))).alias("prominence"),
        "place",
        F.array_max("_y").alias("top"),
        *carry,
    )


def _by_prominence(peaks: DataFrame, by: Sequence[str], *columns: str) -> DataFrame:
    """Ranks within each curve, of which there are few; equal ones from left to right."""
    order = W.partitionBy(*by).orderBy(F.desc("prominence"), "place")
    return peaks.withColumn("peak_rank", F.row_number().over(order)).select(*by, "peak_rank", *columns)


def local_peaks(
    curve: DataFrame, by: Sequence[str], x: str, y: str, distance: int, share: float = 0.05, floor: float = 0.0
) -> DataFrame:
    """Peaks of each curve ranked by prominence (_curve_peaks).

    The prominence threshold is share x maximum, at least floor.
    """
    found = _curve_peaks(curve, by, x, y, distance)
    enough = found.where(F.col("prominence") >= F.greatest(F.lit(float(floor)), F.col("top") * share))
    return _by_prominence(enough, by, "location", "height", "prominence")


def moments(values: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """n, extremes, mean, sample sd, unbiased skewness and unbiased excess kurtosis."""
    v = F.col(value)
    raw = values.groupBy(*by).agg(
        F.count(v).alias("n"),
        F.min(v).alias("minimum"),
        F.max(v).alias("maximum"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("sd"),
        F.skewness(v).alias("_g1"),
        F.kurtosis(v).alias("_g2"),
    )
    n = F.col("n").cast("double")
    skew = F.when(n > 2, F.col("_g1") * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("_g2") + 6))
    return raw.withColumn("skewness", skew).withColumn("excess_kurtosis", kurt).drop("_g1", "_g2")


def distribution_audit(values: DataFrame, by: Sequence[str], value: str, high: float = MAX_KS) -> DataFrame:
    """Moments, quartiles, boundary shares, histogram mode, peak count and flags per group."""
    keys = list(by)
    positive = values.filter((F.col(value) > 0) & (F.col(value) <= high)).select(*keys, value)
    v = F.col(value)
    edges = positive.groupBy(*keys).agg(
        F.count_if(v <= 0.1).alias("near_zero"), F.count_if(v >= 2.9).alias("high_boundary")
    )
    quartiles = exact_quantiles(positive, keys, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    hist = smooth_bins(histogram(positive, keys, value, high=high), keys)
    mode = hist.groupBy(*keys).agg(F.max_by("center", F.struct("n", -F.col("bin"))).alias("histogram_mode"))
    peaks = local_peaks(hist, keys, "center", "smooth", 3, floor=2.0)
    n_peaks = peaks.groupBy(*keys).agg(F.count("*").alias("candidate_peaks"))
    n = F.col("n")
    flag = (
        F.when(F.col("candidate_peaks") == 0, "NO_CLEAR_INTERNAL_PEAK")
        .when(F.col("candidate_peaks") == 1, "ONE_CANDIDATE_PEAK")
        .otherwise("MULTIMODAL_CANDIDATE")
    )
    boundary = (
        F.when(F.col("near_zero") / n >= 0.20, "STRONG_LOW_KS_BOUNDARY")
        .when(F.col("high_boundary") / n >= 0.10, "STRONG_HIGH_KS_BOUNDARY")
        .otherwise("NO_STRONG_BOUNDARY")
    )
    single = (
        (F.col("candidate_peaks") == 1)
        & (F.abs("skewness") <= 1)
        & (F.col("boundary_flag") == "NO_STRONG_BOUNDARY")
    )
    return (
        moments(positive, keys, value)
        .join(edges, keys)
        .join(quartiles, keys)
        .join(mode, keys)
        .join(n_peaks, keys, "left")
        .withColumn("candidate_peaks", F.coalesce("candidate_peaks", F.lit(0)))
        .withColumn("near_zero_fraction", F.col("near_zero") / n)
        .withColumn("high_boundary_fraction", F.col("high_boundary") / n)
        .withColumn("distribution_flag", flag)
        .withColumn("boundary_flag", boundary)
        .withColumn("single_gaussian_supported", F.when(single, "POSSIBLY").otherwise("NO"))
    )


def blockinfo_qc(blocks: DataFrame, by: Sequence[str], kind: Column, expected: DataFrame) -> DataFrame:
    """Ks cells per class and rows against the expected block count.

    kind is the class column of classify_number; expected: by, expected_blocks.
    """
    counted = blocks.groupBy(*by).agg(
        F.count("*").alias("blockinfo_rows"),
        *[F.count_if(kind == k).alias(f"ks_{k}") for k in ("finite", "missing", "nonnumeric", "nan", "infinite")],
    )
    ok = (F.col("blockinfo_rows") == F.col("expected_blocks")) & (F.col("ks_finite") == F.col("blockinfo_rows"))
    return counted.join(expected, list(by), "left").withColumn(
        "status", F.when(F.coalesce(ok, F.lit(False)), "PASS").otherwise("FAIL")
    )


# Density in log space


def _weighted(values: DataFrame, by: Sequence[str], value: str, spec: KdeSpec) -> DataFrame:
    """Distinct values in range with their counts: equal values share one kernel."""
    return (
        values.filter(F.col(value).between(spec.low, spec.high))
        .groupBy(*by, F.col(value).cast("double").alias("_v"))
        .agg(F.count("*").alias("_w"))
    )


def _log_stats(weighted: DataFrame, by: Sequence[str], spec: KdeSpec) -> DataFrame:
    """n, sd of ln, observed range; too few values or no spread is an error."""
    x, w = F.ln("_v"), F.col("_w")
    sums = weighted.groupBy(*by).agg(
        F.sum(w).alias("_n"),
        F.sum(w * x).alias("_s1"),
        F.sum(w * x * x).alias("_s2"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
        F.count("*").alias("_distinct"),
    )
    n = F.col("_n")
    variance = F.try_divide(F.col("_s2") - F.col("_s1") * F.col("_s1") / n, n - 1)
    few = F.raise_error(F.lit(f"fewer than {spec.min_values} values in the analysis range, or no spread"))
    sound = (n >= spec.min_values) & (F.col("_distinct") > 1)
    return sums.select(
        *by, F.when(sound, n).otherwise(few).alias("_n"), F.sqrt(F.greatest(variance, F.lit(0.0))).alias("_sd"), "_min", "_max"
    )


def _sum_arrays(parts: DataFrame, keys: Sequence[str], array: str) -> DataFrame:
    """Element-wise sums as rows (keys, i, total); the index is part of the shuffle key."""
    rows = parts.select(*keys, F.posexplode(array).alias("i", "_x"))
    return rows.groupBy(*keys, "i").agg(F.sum("_x").alias("total"))


def log_kde(
    values: DataFrame, by: Sequence[str], value: str, factors: Sequence[float] = FACTORS, spec: KdeSpec = SPEC
) -> DataFrame:
    """Gaussian density of ln(value) on the log grid, divided by x.

    Bandwidth is n^(-1/5) x sd x factor. Every task sums the kernels of its own
    values into one vector per group; the vectors are then added up by grid index.
    Columns: by, factor, i, x, density, observed_min, observed_max.
    """
    return _kde(_weighted(values, by, value, spec), by, factors, spec)


def _kde(weighted: DataFrame, by: Sequence[str], factors: Sequence[float], spec: KdeSpec) -> DataFrame:
    keys = list(by)
    stats = _log_stats(weighted, keys, spec)
    rows = weighted.join(stats, keys)
    schema = T.StructType(
        [rows.schema[c] for c in keys]
        + [T.StructField("factor", T.DoubleType()), T.StructField("part", T.ArrayType(T.DoubleType()))]
    )
    grid, chosen, flush_at = spec.grid, [float(f) for f in factors], 512

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}

        def flush() -> pd.DataFrame:
            out = [(*k, f, held[k][j].tolist()) for k in held for j, f in enumerate(chosen)]
            held.clear()
            return pd.DataFrame(out, columns=[*keys, "factor", "part"])

        for pdf in batches:
            for key, group in pdf.groupby(keys, sort=False):
                n, sd = float(group["_n"].iloc[0]), float(group["_sd"].iloc[0])
                x, w = np.log(group["_v"].to_numpy()), group["_w"].to_numpy(dtype=float)
                sums = held.setdefault(key, np.zeros((len(chosen), len(grid))))
                for j, f in enumerate(chosen):
                    width = n ** (-0.2) * f * sd
                    sums[j] += P.kernel_sum(grid, x, w, width) / (n * width * math.sqrt(2 * math.pi))
            if len(held) > flush_at:
                yield flush()
        if held:
            yield flush()

    parts = spread(rows.select(*keys, "_v", "_w", "_n", "_sd"), *keys, "_v").mapInPandas(partial, schema)
    step = (math.log(spec.high) - math.log(spec.low)) / (spec.points - 1)
    x = F.exp(F.lit(math.log(spec.low)) + F.col("i") * step)
    seen = stats.select(*keys, F.col("_min").alias("observed_min"), F.col("_max").alias("observed_max"))
    return (
        _sum_arrays(parts, [*keys, "factor"], "part")
        .withColumn("x", x)
        .withColumn("density", F.col("total") / F.col("x"))
        .join(seen, keys)
        .select(*keys, "factor", "i", "x", "density", "observed_min", "observed_max")
    )


def accept_peaks(density: np.ndarray, low: float, high: float, spec: KdeSpec) -> list[tuple[float, float, float]]:
    """(location, height, prominence) inside the observed range and off the grid ends, by prominence."""
    top = float(density.max()) if len(density) else 0.0
    if top <= 0:
        return []
    at, prom = P.find_peaks(density, spec.distance, top * spec.prominence)
    x = np.exp(spec.grid[at])
    ok = (x >= low) & (x <= high) & (x > spec.low * spec.edge) & (x < spec.high / spec.edge)
    order = np.argsort(-prom[ok], kind="stable")
    return [(float(x[ok][k]), float(density[at[ok][k]]), float(prom[ok][k])) for k in order]


def kde_peaks(curve: DataFrame, by: Sequence[str], spec: KdeSpec = SPEC) -> DataFrame:
    """Accepted peaks of each density curve (one grid of points per group), by prominence.

    A peak lies inside the observed range and off the ends of the grid.
    """
    found = _curve_peaks(curve, by, "x", "density", spec.distance, ("observed_min", "observed_max"))
    at = F.col("location")
    accepted = (
        (F.col("top") > 0)
        & (F.col("prominence") >= F.col("top") * spec.prominence)
        & at.between(F.col("observed_min"), F.col("observed_max"))
        & (at > spec.low * spec.edge)
        & (at < spec.high / spec.edge)
    )
    return _by_prominence(found.where(accepted).withColumn("log_location", F.ln(at)), by, "location", "log_location", "height", "prominence")


def _middle(values: Column) -> Column:
    """Median of an array in order."""
    n = F.size(values)
    return (F.get(values, F.floor((n - 1) / 2).cast("int")) + F.get(values, F.floor(n / 2).cast("int"))) / 2


def cluster_by_median(values: Column, tolerance: float) -> Column:
    """Sorted values join the last cluster while within tolerance of its median: an array of arrays.

    The median moves as values join, so this is a fold over the values in order.
    """

    def join(clusters: Column, value: Column) -> Column:
        last = F.element_at(clusters, -1)
        near = (F.size(clusters) > 0) & (F.abs(value - _middle(F.try_element_at(clusters, F.lit(-1)))) <= tolerance)
        grown = F.concat(F.slice(clusters, F.lit(1), F.size(clusters) - 1), F.array(F.concat(last, F.array(value))))
        return F.when(near, grown).otherwise(F.concat(clusters, F.array(F.array(value))))

    return F.aggregate(F.array_sort(values), F.array().cast("array<array<double>>"), join)


def bandwidth_consensus(
    peaks: DataFrame, by: Sequence[str], tolerance: float = 0.12, min_factors: int = 3
) -> DataFrame:
    """Peaks found, within tolerance in ln, under at least min_factors bandwidth factors.

    A group holds the few peaks of its curves.
    """
    members = F.collect_list(F.struct("log_location", "factor"))
    clusters = cluster_by_median(F.transform("_all", lambda p: p["log_location"]), tolerance)
    each = peaks.groupBy(*by).agg(members.alias("_all")).select(*by, "_all", F.posexplode(clusters).alias("_i", "_cluster"))
    near = F.filter("_all", lambda p: F.abs(p["log_location"] - F.col("log_location")) <= tolerance)
    support = F.size(F.array_distinct(F.transform(near, lambda p: p["factor"])))
    agreed = each.withColumn("log_location", _middle(F.col("_cluster"))).withColumn("bandwidth_support", support).where(F.col("bandwidth_support") >= min_factors)
    rank = F.row_number().over(W.partitionBy(*by).orderBy("_i"))
    return agreed.select(*by, rank.alias("peak_rank"), F.exp("log_location").alias("location"), "log_location", "bandwidth_support")


# Bootstrap

#: Values nearer than this share their draws.
VALUE_UNIT = 1e-9


def resampled_bins(weighted: DataFrame, by: Sequence[str], replicates: int, seed: int, spec: KdeSpec = SPEC) -> DataFrame:
    """(by, replicate, bin, n): how often the values of each grid point are drawn in each replicate.

    Every occurrence of a value is drawn a Poisson number of times of mean 1. The number is a
    function of seed, group, value, replicate and occurrence alone, so draws need no state,
    no order and no group in one place: rows are spread over tasks as they come, and
    tasks add up their own draws per grid point first. A value that occurs more than
    SINGLY times is drawn from the normal distribution of that mean and variance.
    """
    step = float(spec.grid[1] - spec.grid[0])
    point = F.floor((F.ln("_v") - F.lit(math.log(spec.low))) / step + 0.5).cast("int")
    words = D.key_words(F.lit(seed), *[F.col(c) for c in by], F.floor(F.col("_v") / VALUE_UNIT).cast("long"))
    keyed = weighted.select(*by, "_w", point.alias("bin"), words[0].alias("_a"), words[1].alias("_z"))
    times = F.when(F.col("_w") <= D.SINGLY, F.sequence(F.lit(1).cast("long"), F.col("_w"))).otherwise(F.array(F.lit(0).cast("long")))
    # Few values may carry all the work, so the replicates are dealt out too.
    chunks = F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // REPLICATES_PER_TASK)))
    dealt = spread(keyed.withColumn("_chunk", chunks), *by, "bin", "_a", "_chunk")
    first = F.col("_chunk") * REPLICATES_PER_TASK
    replicate = F.explode(F.sequence(first, F.least(first + REPLICATES_PER_TASK, F.lit(replicates)) - 1))
    each = dealt.withColumn("replicate", replicate).withColumn("_j", F.explode(times))
    key = (F.col("_a"), F.col("_z"))
    counter = F.col("replicate").cast("long") * 64
    each = D.with_uniform(each, "_u", key, counter + F.col("_j"))
    numbers = F.sequence(F.lit(1).cast("long"), F.lit(D.UNIFORMS).cast("long"))
    total = F.aggregate(numbers, F.lit(0).cast("long"), lambda t, j: t + D.uniform(key, counter + j))
    normal = total / F.lit(float(D.WORD)) - D.UNIFORMS / 2
    many = F.greatest(F.lit(0).cast("long"), F.floor(F.col("_w") + F.sqrt("_w") * normal + 0.5))
    drawn = each.withColumn("_n", F.when(F.col("_j") > 0, D.poisson_one(F.col("_u"))).otherwise(many))
    # Filtered after the sum: a filter before it would be pushed below the mixing steps and
    # multiply them.
    return drawn.groupBy(*by, "replicate", "bin").agg(F.sum("_n").alias("n")).where("n > 0")


#: Replicates that one row of a value stands for while rows are dealt out.
REPLICATES_PER_TASK = 50


def bootstrap_support(
    values: DataFrame,
    references: DataFrame,
    by: Sequence[str],
    value: str,
    replicates: int = 500,
    seed: int = 20260805,
    tolerance: float = 0.12,
    min_support: float = 0.60,
    factor: float = 1.0,
    spec: KdeSpec = SPEC,
) -> DataFrame:
    """How often each reference peak returns in resamples of the values.

    references: by, peak_rank, location, log_location, bandwidth_support. A resample is a
    table of draws per grid point (resampled_bins): its density is that of the draws,
    with values at their nearest grid point, and its bandwidth comes from their exact integer
    sums. A task holds one replicate's grid, whatever the number of values.
    """
    weighted = cut_lineage(_weighted(values, by, value, spec))
    return _bootstrap(weighted, cut_lineage(references), by, replicates, seed, tolerance, min_support, factor, spec)


def _bootstrap(weighted, references, by, replicates, seed, tolerance, min_support, factor, spec) -> DataFrame:
    keys = list(by)
    stats = _log_stats(weighted, keys, spec)
    bins = resampled_bins(weighted, keys, replicates, seed, spec)
    curves = bins.groupBy(*keys, "replicate").agg(F.collect_list(F.struct("bin", "n")).alias("_bins"))
    found = curves.mapInPandas(_sample_peaks(keys, factor, spec), T.StructType([*[weighted.schema[c] for c in keys], *_FOUND]))
    # Peaks per curve are few; references per group too.
    near = (
        references.select(*keys, "peak_rank", F.col("log_location").alias("_ref"))
        .join(found, keys)
        .withColumn("_gap", F.abs(F.col("log_location") - F.col("_ref")))
        .filter(F.col("_gap") <= tolerance)
        .groupBy(*keys, "peak_rank", "replicate")
        .agg(F.min_by("location", F.struct("_gap", "location")).alias("_at"))
    )
    at = F.col("_at")
    recovered = near.groupBy(*keys, "peak_rank").agg(
        F.count("*").alias("recoveries"),
        F.median(at).alias("bootstrap_median"),
        F.percentile(at, 0.025).alias("bootstrap_lower"),
        F.percentile(at, 0.975).alias("bootstrap_upper"),
    )
    seen = stats.select(*keys, F.col("_min").alias("observed_min"), F.col("_max").alias("observed_max"))
    support = F.coalesce(F.col("recoveries"), F.lit(0)) / replicates
    middle = F.col("bootstrap_median")
    valid = (support >= min_support) & (middle >= F.col("observed_min")) & (middle <= F.col("observed_max"))
    return (
        references.join(recovered, [*keys, "peak_rank"], "left")
        .join(seen, keys)
        .withColumn("recoveries", F.coalesce("recoveries", F.lit(0)))
        .withColumn("support", support)
        .withColumn("valid", F.coalesce(valid, F.lit(False)))
    )


_FOUND = [T.StructField("replicate", T.IntegerType()), T.StructField("location", T.DoubleType()), T.StructField("log_location", T.DoubleType())]


def _sample_peaks(keys: list[str], factor: float, spec: KdeSpec):
    """Peaks of resamples; the densities of a grid's points add up shifted copies of one kernel."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        offsets = np.arange(1 - spec.points, spec.points)
        x = np.exp(spec.grid)
        for pdf in batches:
            rows = []
            for *key, replicate, bins in pdf[[*keys, "replicate", "_bins"]].itertuples(index=False):
                at = np.array([b["bin"] for b in bins])
                n = np.array([b["n"] for b in bins], float)
                total, mean = n.sum(), n @ at / n.sum()
                deviation = math.sqrt(n @ (at - mean) ** 2 / (total - 1)) if total > 1 else 0.0
                if deviation == 0:
                    continue
                kernel = np.exp(-0.5 * (offsets / (total**-0.2 * factor * deviation)) ** 2)
                # Row s holds the kernel from its place s on: that of grid point points - 1 - s.
                shifted = np.lib.stride_tricks.sliding_window_view(kernel, spec.points)
                density = n @ shifted[spec.points - 1 - at]
                for location, _, _ in accept_peaks(density / x, x[at.min()], x[at.max()], spec):
                    rows.append((*key, replicate, location, math.log(location)))
            yield pd.DataFrame(rows, columns=[*keys, *[f.name for f in _FOUND]])

    return run


def nearest_within(
    ref: DataFrame, cand: DataFrame, by: Sequence[str], ref_x: str, cand_x: str, tolerance: float, name: str = "nearest"
) -> DataFrame:
    """Closest candidate value within tolerance of every ref row, else NULL.

    Points are bucketed by tolerance. In a bucket the neighbours come from one sorted
    pass over both tables; beyond it only the last value of the bucket before and
    the first of the bucket after can be in reach. Rows are never paired up.
    """
    keys = list(by)

    def bucket(x: Column) -> Column:
        return F.floor(x / tolerance)

    points = cand.select(*keys, F.col(cand_x).cast("double").alias("_x")).distinct().withColumn("_b", bucket(F.col("_x")))
    ends = points.groupBy(*keys, "_b").agg(F.min("_x").alias("_first"), F.max("_x").alias("_last"))
    before = ends.select(*keys, (F.col("_b") + 1).alias("_b"), F.col("_last").alias("_before"))
    after = ends.select(*keys, (F.col("_b") - 1).alias("_b"), F.col("_first").alias("_after"))
    rows = ref.select(*keys, F.struct(*ref.columns).alias("_row"), F.col(ref_x).cast("double").alias("_x")).withColumn(
        "_b", bucket(F.col("_x"))
    )
    # One pass up and one down, each with a growing frame: linear in the bucket. Equal
    # values are one row there, and the full rows stay out of it.
    wanted = rows.select(*keys, "_x", "_b").distinct().withColumns({"_c": F.lit(None).cast("double"), "_ask": F.lit(True)})
    both = wanted.unionByName(points.withColumns({"_c": F.col("_x"), "_ask": F.lit(False)}))
    cell = W.partitionBy(*keys, "_b")
    upto = cell.orderBy("_x").rangeBetween(W.unboundedPreceding, 0)
    downto = cell.orderBy(F.desc("_x")).rangeBetween(W.unboundedPreceding, 0)
    local = both.withColumn("_below", F.max("_c").over(upto)).withColumn("_above", F.min("_c").over(downto)).filter("_ask")
    options = F.filter(
        F.array("_below", "_above", "_before", "_after"),
        lambda c: c.isNotNull() & (F.abs(c - F.col("_x")) <= tolerance),
    )
    ranked = F.array_sort(F.transform(options, lambda c: F.struct(F.abs(c - F.col("_x")).alias("gap"), c.alias("at"))))
    found = (
        local.join(before, [*keys, "_b"], "left")
        .join(after, [*keys, "_b"], "left")
        .select(*keys, "_x", F.get(ranked, F.lit(0))["at"].alias(name))
    )
    same = F.lit(True)
    for c in (*keys, "_x"):
        same = same & rows[c].eqNullSafe(found[c])
    return rows.join(found, same, "left").select(rows["_row"].alias("_row"), found[name]).select("_row.*", name)


def cross_dataset_class(
    primary: DataFrame, low_tandem: DataFrame, by: Sequence[str], location: str = "location", tolerance: float = 0.12
) -> DataFrame:
    """ROBUST when a primary peak has a low-tandem peak within tolerance in ln, else PRIMARY_ONLY."""
    logged = primary.withColumn("_log", F.ln(location))
    matched = nearest_within(
        logged, low_tandem.select(*by, F.ln(location).alias("_other")), by, "_log", "_other", tolerance, "_near"
    )
    return (
        matched.withColumn("low_tandem_peak", F.exp("_near"))
        .withColumn("validation_class", F.when(F.col("_near").isNull(), "PRIMARY_ONLY").otherwise("ROBUST"))
        .drop("_log", "_near")
    )


def validated_peaks(
    judged: DataFrame, by: Sequence[str], value: str = "ks_median", replicates: int = 500, spec: KdeSpec = SPEC
) -> DataFrame:
    """Curated blocks to validated peaks: densities, consensus, bootstrap, cross-set class.

    judged comes from filter_blocks. The primary and low-tandem sets run as two
    groups of one lineage.
    """
    keys = [*by, "dataset"]
    primary, low = F.lit("primary"), F.lit("low_tandem")
    member_of = F.when(F.col("low_tandem"), F.array(primary, low)).otherwise(F.array(primary))
    sets = judged.filter("reject_reason IS NULL").withColumn("dataset", F.explode(member_of))
    # Compact, and read by every step below.
    weighted = cut_lineage(_weighted(sets, keys, value, spec))
    peaks = kde_peaks(_kde(weighted, keys, FACTORS, spec), [*keys, "factor"], spec)
    references = cut_lineage(bandwidth_consensus(peaks, keys))
    supported = cut_lineage(_bootstrap(weighted, references, keys, replicates, 20260805, 0.12, 0.60, 1.0, spec))
    valid = supported.filter("valid").withColumn("location", F.col("bootstrap_median"))

    def of(name: str) -> DataFrame:
        return valid.filter(F.col("dataset") == name).drop("dataset")

    return cross_dataset_class(of("primary"), of("low_tandem"), by)
