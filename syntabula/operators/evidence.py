"""Evidence tables: functional support, peak standardisation, one row per comparison."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .quality import GateError

# Accepted column names per role, in order of preference.
ALIASES = {
    "comparison": ("comparison", "comparison_id", "comparison_name", "dataset", "contrast", "analysis"),
    "peak_ks": (
        "peak_ks", "component_peak_ks", "validated_peak_ks", "corrected_peak_ks", "final_peak_ks", "peak_position",
        "peak_position_ks", "peak_center", "peak_centre", "peak_location", "mode_ks", "kde_peak", "kde_peak_ks",
        "peak", "ks_peak", "ks_mode", "mode",
    ),
    "validation_class": (
        "validation_class", "peak_validation_class", "validation_status", "robustness_class", "support_class",
        "class", "status",
    ),
    "component_id": ("component_id", "peak_id", "component", "peak_number", "component_number"),
    "ci_lower": ("ci_lower", "bootstrap_ci_lower", "peak_ci_lower", "lower_ci", "window_lower", "lower"),
    "ci_upper": ("ci_upper", "bootstrap_ci_upper", "peak_ci_upper", "upper_ci", "window_upper", "upper"),
}
# Points per word in a column name, points for values in range, score to accept.
WORD_POINTS = {"peak": 100, "ks": 60, "cent(re|er)": 50, "mode": 35, "position": 30, "location": 20}
RANGE_POINTS, ACCEPT_SCORE = 25, 60


def plain_name(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", name.strip().lower()).strip("_")


def resolve_aliases(df: DataFrame, aliases: dict[str, Sequence[str]], scored: str | None = None) -> dict[str, str | None]:
    """Column of df per role. The `scored` role falls back to the best-scoring numeric column.

    Works on column names; only the value ranges of candidate columns are aggregated.
    """
    known: dict[str, str] = {}
    for column in df.columns:
        if known.setdefault(plain_name(column), column) != column:
            raise GateError(f"column names {known[plain_name(column)]!r} and {column!r} become the same")
    found = {role: next((known[a] for a in names if a in known), None) for role, names in aliases.items()}
    if found.get("comparison", "") is None:
        like = [c for plain, c in known.items() if "comparison" in plain or "contrast" in plain]
        found["comparison"] = like[0] if len(like) == 1 else None
    if scored and found[scored] is None:
        found[scored] = _best_scored(df, known, found.get("comparison"))
    return found


def _best_scored(df: DataFrame, known: dict[str, str], skip: str | None) -> str | None:
    candidates = {plain: c for plain, c in known.items() if c != skip}
    checks = []
    for i, c in enumerate(candidates.values()):
        v = F.col(f"`{c}`").cast("string").try_cast("double")
        real = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
        checks += [F.count_if(real).alias(f"n{i}"), F.count_if(real & v.between(0, 3)).alias(f"in{i}")]
    seen = df.agg(*checks).first()
    ranked = []
    for i, (plain, c) in enumerate(candidates.items()):
        if seen[f"n{i}"]:
            score = sum(points for word, points in WORD_POINTS.items() if re.search(word, plain))
            score += RANGE_POINTS if seen[f"n{i}"] == seen[f"in{i}"] else 0
            ranked.append((score, seen[f"n{i}"], c))
    best = max(ranked, default=(0, 0, None))
    return best[2] if best[0] >= ACCEPT_SCORE else None


def standardise_peaks(peaks: DataFrame, order: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Peak table under any known headers to standard rows, with the rows that break a rule.

    Returns (rows: comparison, component_id, peak_ks, validation_class, ci_lower,
    ci_upper, source_peak_column; issues). A peak lies in (0, 3] and is unique per
    comparison.
    """
    found = resolve_aliases(peaks, ALIASES, scored="peak_ks")
    for role in ("comparison", "peak_ks"):
        if found[role] is None:
            raise GateError(f"no column for {role} among {peaks.columns}")

    def text(role: str, default: str = "") -> Column:
        if found[role] is None:
            return F.lit(default)
        cell = F.trim(F.coalesce(F.col(f"`{found[role]}`").cast("string"), F.lit("")))
        return F.when(cell == "", default).otherwise(cell)

    rows = peaks.select(
        text("comparison").alias("comparison"),
        text("component_id").alias("component_id"),
        F.col(f"`{found['peak_ks']}`").cast("string").try_cast("double").alias("peak_ks"),
        text("validation_class", "VALIDATED").alias("validation_class"),
        text("ci_lower").alias("ci_lower"),
        text("ci_upper").alias("ci_upper"),
        F.lit(found["peak_ks"]).alias("source_peak_column"),
    )
    peak = F.col("peak_ks")
    issue = (
        F.when(F.col("comparison") == "", "EMPTY_COMPARISON")
        .when(peak.isNull() | F.isnan(peak), "NOT_A_NUMBER")
        .when((peak <= 0) | (peak > 3), "OUTSIDE_RANGE")
    )
    wrong = rows.withColumn("issue", issue).filter(F.col("issue").isNotNull()).select("comparison", "peak_ks", "issue")
    twice = (
        rows.groupBy("comparison", "peak_ks")
        .agg(F.count("*").alias("_n"))
        .filter("_n > 1")
        .select("comparison", "peak_ks", F.lit("DUPLICATE_PEAK").alias("issue"))
    )
    return rows, wrong.unionByName(twice)


def peak_summary(rows: DataFrame) -> DataFrame:
    """Per comparison: peak count and the peaks and classes in ascending order (few per comparison)."""
    entries = F.array_sort(F.collect_list(F.struct("peak_ks", "validation_class")))
    return (
        rows.groupBy("comparison")
        .agg(entries.alias("_e"))
        .select(
            "comparison",
            F.size("_e").alias("validated_peak_count"),
            F.array_join(F.transform("_e", lambda e: e["peak_ks"].cast("string")), ",").alias("validated_peaks"),
            F.array_join(F.transform("_e", lambda e: e["validation_class"]), ",").alias("validation_classes"),
        )
    )


def _both_sources(strict: DataFrame, domain: DataFrame, key: str) -> DataFrame:
    a = strict.select(key).distinct().withColumn("_a", F.lit(True))
    b = domain.select(key).distinct().withColumn("_b", F.lit(True))
    return a.join(b, key, "full_outer").select(
        key, F.coalesce("_a", F.lit(False)).alias("_a"), F.coalesce("_b", F.lit(False)).alias("_b")
    )


def evidence_overlap(strict: DataFrame, domain: DataFrame, total: DataFrame, key: str = "protein_id") -> DataFrame:
    """Counts and percentages per evidence category.

    total is a one-row table with column `total`; more supported than total is an
    error.
    """
    a, b = F.col("_a"), F.col("_b")
    counts = _both_sources(strict, domain, key).agg(
        F.count_if(a).alias("strict"),
        F.count_if(b).alias("domain"),
        F.count_if(a & b).alias("both"),
        F.count_if(a & ~b).alias("strict_only"),
        F.count_if(b & ~a).alias("domain_only"),
        F.count("*").alias("union"),
    )
    whole = total.select(F.col("total").cast("long").alias("all_proteins"))
    # One row each.
    wide = counts.withColumn("_k", F.lit(1)).join(F.broadcast(whole.withColumn("_k", F.lit(1))), "_k").drop("_k")
    missing = F.col("all_proteins") - F.col("union")
    checked = wide.withColumn(
        "unsupported", F.when(missing < 0, F.raise_error(F.lit("more supported proteins than the total"))).otherwise(missing)
    ).withColumn("_t", F.col("all_proteins"))
    names = ["all_proteins", "strict", "domain", "both", "strict_only", "domain_only", "union", "unsupported"]
    return (
        checked.unpivot(["_t"], names, "category", "n")
        .withColumn("pct", F.col("n") * 100 / F.col("_t"))
        .drop("_t")
    )


def evidence_table(strict: DataFrame, domain: DataFrame, key: str = "protein_id") -> DataFrame:
    """Every supported protein with YES or NO per source."""

    def yes(flag: str) -> Column:
        return F.when(F.col(flag), "YES").otherwise("NO")

    return _both_sources(strict, domain, key).select(
        key, yes("_a").alias("strict"), yes("_b").alias("domain"), F.lit("YES").alias("supported")
    )


def compact_row(df: DataFrame, skip: Sequence[str]) -> Column:
    """All non-blank cells of a row as `name=value;name=value`."""
    cells = [
        F.when(F.trim(F.col(c).cast("string")) != "", F.concat(F.lit(f"{c}="), F.col(c).cast("string")))
        for c in df.columns
        if c not in skip
    ]
    return F.concat_ws(";", *cells)


def integrate_evidence(
    peaks: DataFrame,
    macro: DataFrame,
    depth: DataFrame,
    multi: DataFrame,
    interpretations: DataFrame | None = None,
    on: str = "comparison",
    peak: str = "peak_ks",
    macro_fields: Sequence[str] = (),
    multi_fields: dict[str, str] | None = None,
) -> DataFrame:
    """One row per comparison of macro.

    Peaks in ascending order become ks_component_1 and _2 (and their number); the
    depth row is kept whole as one compact text; multi_fields maps fields of multi
    to their output names.
    """
    sorted_peaks = peaks.groupBy(on).agg(F.array_sort(F.collect_list(peak)).alias("_p"))
    compact = depth.select(on, compact_row(depth, [on, "comparison_id"]).alias("gene_level_summary"))
    chosen = multi.select(on, *[F.col(c).alias(name) for c, name in (multi_fields or {}).items()])
    out = (
        macro.select(on, *macro_fields)
        .join(sorted_peaks, on, "left")
        .join(compact, on, "left")
        .join(chosen, on, "left")
        .withColumn("ks_component_1", F.get("_p", F.lit(0)))
        .withColumn("ks_component_2", F.get("_p", F.lit(1)))
        .withColumn("ks_component_count", F.coalesce(F.size("_p"), F.lit(0)))
        .drop("_p")
    )
    return out if interpretations is None else out.join(interpretations, on, "left")


def repair_fields(integrated: DataFrame, source: DataFrame, fields: dict[str, str], on: str = "comparison") -> DataFrame:
    """Overwrite fields (name in integrated -> name in source) from source; absent rows become NULL."""
    fresh = source.select(on, *[F.col(c).alias(f"_new_{name}") for name, c in fields.items()])
    joined = integrated.join(fresh, on, "left")
    return joined.select(
        *[F.col(f"_new_{c}").alias(c) if c in fields else F.col(c) for c in integrated.columns],
        *[F.col(f"_new_{c}").alias(c) for c in fields if c not in integrated.columns],
    )


def final_annotation_table(features: DataFrame, busco_protein: DataFrame, busco_genome: DataFrame, on: str = "species") -> DataFrame:
    """Annotation counts with protein and genome completeness and a status per missing part.

    The completeness tables have complete, single, duplicated, fragmented, missing, n.
    """
    parts = ["complete", "single", "duplicated", "fragmented", "missing", "n"]

    def named(df: DataFrame, prefix: str) -> DataFrame:
        return df.select(on, *[F.col(p).alias(f"{prefix}_{p}") for p in parts])

    lacking = F.concat_ws(
        ";",
        F.when(F.col("protein_complete").isNull(), "FAIL_PARSE_PROTEIN_BUSCO"),
        F.when(F.col("genome_complete").isNull(), "FAIL_PARSE_GENOME_BUSCO"),
    )
    return (
        features.join(named(busco_protein, "protein"), on, "left")
        .join(named(busco_genome, "genome"), on, "left")
        .withColumn("status", F.when(lacking == "", "PASS").otherwise(lacking))
    )
