"""Gates, totals and source checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


class GateError(ValueError):
    """Rows broke a rule that has to hold."""


def failing(df: DataFrame, condition: Column) -> DataFrame:
    """The rows that fail the condition (NULL fails)."""
    return df.filter(~F.coalesce(condition, F.lit(False)))


def expect(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """df itself, after raising if any row fails the condition (NULL fails).

    Only a count and five example rows come to the driver.
    """
    bad = failing(df, condition)
    count = bad.count()
    if count:
        raise GateError(f"{message}: {count} rows, e.g. {[r.asDict() for r in bad.take(5)]}")
    return df


def expect_none(df: DataFrame, message: str) -> None:
    """Raise when df, a table of issues, is not empty."""
    expect(df, F.lit(False), message)


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise GateError(f"missing columns: {missing}")
    return df


def overall_metrics(summary: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """One aggregate per metric over a summary, as (metric, value) rows."""
    row = summary.agg(*[expr.cast("double").alias(name) for name, expr in metrics.items()])
    return row.unpivot([], list(metrics), "metric", "value")


def source_dimension_check(sources: dict[str, DataFrame], expected: Sequence[str], on: str = "comparison") -> DataFrame:
    """Per source: rows, which expected comparisons it has, PASS or FAIL.

    Comparisons are compared as the set of expected ones that occur.
    """
    wanted = F.array_sort(F.array(*[F.lit(e) for e in expected]))
    out = None
    for name, df in sources.items():
        # Only expected names are collected, so the set is no longer than `expected`.
        seen = F.array_sort(F.collect_set(F.when(F.col(on).isin(list(expected)), F.col(on))))
        row = df.agg(F.count("*").alias("source_rows"), seen.alias("_seen")).select(
            F.lit(name).alias("analysis"),
            "source_rows",
            F.lit(len(expected)).alias("expected_comparisons"),
            F.size("_seen").alias("observed_comparisons"),
            F.array_join("_seen", ",").alias("comparison_set"),
            F.when(F.col("_seen") == wanted, "PASS").otherwise("FAIL").alias("status"),
        )
        out = row if out is None else out.unionByName(row)
    return out


def run_status(expected: DataFrame, complete: DataFrame, failed: DataFrame, on: str = "comparison") -> DataFrame:
    """Every expected run with PASS, FAIL or MISSING and a reason.

    complete: on, status, anchor_pairs, anchor_present. failed: on, reason. A passed
    run whose anchor file is absent fails.
    """
    joined = expected.join(complete.withColumnRenamed("status", "_run"), on, "left").join(
        failed.withColumnRenamed("reason", "_why"), on, "left"
    )
    passed = F.coalesce(F.col("_run") == "PASS", F.lit(False))
    present = F.coalesce("anchor_present", F.lit(False))
    broke = F.col("_why").isNotNull()
    return joined.select(
        *expected.columns,
        F.coalesce("anchor_pairs", F.lit(0)).alias("anchor_pairs"),
        F.when(passed & present, "PASS").when(passed | broke, "FAIL").otherwise("MISSING").alias("status"),
        F.when(passed & present, "")
        .when(passed, "RECORDED_ANCHOR_FILE_MISSING")
        .when(broke, F.coalesce(F.nullif("_why", F.lit("")), F.lit("UNKNOWN_FAILURE")))
        .otherwise("NO_RUN_COMPLETION_RECORD")
        .alias("reason"),
    )


def run_status_summary(runs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return runs.groupBy(*by).agg(
        F.count("*").alias("expected"),
        *[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("PASS", "FAIL", "MISSING")],
        F.sum("anchor_pairs").alias("anchor_pairs"),
    )
