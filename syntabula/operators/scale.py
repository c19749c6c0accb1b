"""Ranks and quantiles whose work stays bounded when one key holds most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..session import cut_lineage

# A plain window sorts one whole group in one task; beyond this many rows in the
# largest group the range-partitioned form is used.
WINDOW_GROUP_ROWS = 4_000_000
# Rows of a range partition.
SLICE_ROWS = 2_000_000
# Rows of a hash partition whose task sorts or aggregates them.
TASK_ROWS = 500_000


def group_sizes(df: DataFrame, by: Sequence[str]) -> tuple[int, int]:
    """Rows of the largest group and of all groups, read in one pass."""
    counts = df.groupBy(*by).count() if by else df.agg(F.count("*").alias("count"))
    found = counts.agg(F.max("count"), F.sum("count")).first()
    return found[0] or 0, found[1] or 0


def largest_group(df: DataFrame, by: Sequence[str]) -> int:
    return group_sizes(df, by)[0]


def with_rank(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    name: str,
    group_rows: int = WINDOW_GROUP_ROWS,
) -> DataFrame:
    """1-based row number per group under a total order.

    Columns that the order does not name follow it, so rows that still tie are equal and
    the numbers don't depend on the size of a group.

    The largest group is measured first. Small groups take the built-in window.
    Otherwise rows are range-partitioned on (by, order), so that a hot group is
    spread over many slices; each slice is numbered on its own and shifted by the
    number of that group's rows in earlier slices.
    """
    order = [*order, *[F.col(f.name) for f in df.schema if f.name not in by and f.dataType.typeName() not in ("map", "variant")]]
    largest, total = group_sizes(df, by)
    if by and largest <= group_rows:
        return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)).cast("long"))
    slices = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // SLICE_ROWS))
    keys = [F.col(c) for c in by]
    # The slice number has to stay the same in both branches below, also after a
    # lost executor: hence the written copy.
    sliced = cut_lineage(
        df.repartitionByRange(slices, *keys, *order).withColumn("_slice", F.spark_partition_id())
    )
    within = W.partitionBy("_slice", *by).orderBy(*order)
    earlier = W.partitionBy(*by).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    # At most one group continues into each slice: shifts has no more rows than slices.
    shifts = (
        sliced.groupBy("_slice", *by)
        .agg(F.count("*").alias("_n"))
        .withColumn("_shift", F.sum("_n").over(earlier))
        .filter("_shift > 0")
        .drop("_n")
    )
    numbered = sliced.withColumn("_local", F.row_number().over(within))
    same = numbered["_slice"] == shifts["_slice"]
    for c in by:
        same = same & numbered[c].eqNullSafe(shifts[c])
    return numbered.join(F.broadcast(shifts), same, "left").select(
        *[numbered[c] for c in df.columns],
        (numbered["_local"] + F.coalesce(shifts["_shift"], F.lit(0))).alias(name),
    )


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Hash-partition rows that are costly to process in Python.

    The planner merges small shuffle partitions by their bytes, which says nothing
    about the work per row; an explicit count is left alone.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cols)


def partitions_of(*frames: DataFrame) -> int:
    """Partitions that hold about TASK_ROWS rows of the frames each, at least one per core."""
    return partitions_for(frames[0].sparkSession, sum(df.count() for df in frames))


def partitions_for(spark: SparkSession, rows: int) -> int:
    return max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def dealt(df: DataFrame, cols: Sequence[str], partitions: int) -> DataFrame:
    """Hash-partition rows once for all that follows on cols, in as many partitions as rows need.

    The planner's partitions have a fixed count or grow to a size in compressed bytes, of
    which a few MB can be millions of rows. Aggregates fold equal rows as they come.
    """
    return df.repartition(partitions, *cols)


def first_per_group(df: DataFrame, by: Sequence[str], order: Sequence[tuple[str, str]]) -> DataFrame:
    """First row of each group; an aggregate, so hot groups combine map-side.

    order lists (column, "asc" | "desc"); descending columns must be numeric. A null
    comes after every value, whichever way the column is ordered.
    """
    parts = []
    for i, (c, way) in enumerate(order):
        parts += [F.col(c).isNull().alias(f"n{i}"), (F.col(c) if way == "asc" else -F.col(c)).alias(f"o{i}")]
    rank = F.struct(*parts)
    rest = [c for c in df.columns if c not in by]
    picked = df.groupBy(*by).agg(F.min_by(F.struct(*rest), rank).alias("_row"))
    return picked.select(*[F.col(c) if c in by else F.col("_row")[c].alias(c) for c in df.columns])


def distinct_in(rows: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """Distinct non-null values per group, as its own two-step aggregate.

    Two distinct counts in one aggregate would copy every row per count.
    """
    once = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.lit(1).alias("_one"))
    return once.groupBy(*by).agg(F.count("*").alias(name))


def expect_known(df: DataFrame, known: DataFrame, on: Sequence[str], what: str) -> DataFrame:
    """Inner join that fails on a row of df without a partner instead of dropping it."""
    joined = df.join(known.withColumn("_known", F.lit(True)), list(on), "left")
    key = on[-1]
    text = F.concat(F.lit(f"{what}: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    checked = F.when(F.col("_known"), F.col(key)).otherwise(F.raise_error(text).cast(df.schema[key].dataType))
    return joined.withColumn(key, checked).drop("_known")


def exact_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    probs: dict[str, float],
    method: str = "linear",
    accuracy: int = 10_000,
) -> DataFrame:
    """Exact quantiles per group without holding a group in one aggregation buffer.

    A bounded-error sketch gives a bracket around each wanted rank. Values outside
    the brackets only count, so they collapse to one row per gap; the running
    count then goes over the few values inside. method is "linear" (interpolated)
    or "upper" (element n*p, the upper median for p=0.5).
    """
    if not by:
        whole = df.withColumn("_all", F.lit(1))
        return exact_quantiles(whole, ["_all"], value, probs, method, accuracy).drop("_all")
    order = sorted(probs.items(), key=lambda item: item[1])
    margin = 4.0 / accuracy
    low = [max(0.0, p - margin) for _, p in order]
    high = [min(1.0, p + margin) for _, p in order]
    data = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    sketch = F.percentile_approx("_v", low + high, F.lit(accuracy))
    small = F.col("_total") <= 2 * accuracy
    width = len(order)
    brackets = (
        data.groupBy(*by)
        .agg(F.count("*").alias("_total"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), sketch.alias("_q"))
        .select(
            *by,
            "_total",
            F.when(small, F.array_repeat("_min", width)).otherwise(F.slice("_q", 1, width)).alias("_low"),
            F.when(small, F.array_repeat("_max", width)).otherwise(F.slice("_q", width + 1, width)).alias("_high"),
        )
    )
    joined = data.join(brackets, list(by))
    passed = sum(
        (F.col("_v") >= F.col("_low")[i]).cast("int") for i in range(width)
    )
    # Dealt out anew by value: else the count below would reuse the join's partitioning
    # by group, with all rows of a hot group in one task that no one may split.
    spread = joined.withColumn("_segment", passed).repartition(*by, "_segment", "_v")
    inside = (F.col("_segment") > 0) & (F.col("_v") <= F.get("_high", F.col("_segment") - 1))
    collapsed = (
        spread.withColumn("_outside", ~inside)
        .withColumn("_v", F.when(~F.col("_outside"), F.col("_v")))
        .groupBy(*by, "_segment", "_outside", "_v")
        .agg(F.count("*").alias("_n"), F.first("_total").alias("_total"))
    )
    running = (
        W.partitionBy(*by)
        .orderBy("_segment", "_outside", "_v")
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    counted = collapsed.withColumn("_upto", F.sum("_n").over(running))

    def at(rank: Column) -> Column:
        return F.min(F.when(F.col("_upto") > rank, F.col("_v")))

    picks = []
    for name, p in probs.items():
        if method == "upper":
            picks.append(at(F.floor(F.col("_total") * F.lit(p))).alias(name))
        else:
            place = (F.col("_total") - 1) * F.lit(p)
            picks += [at(F.floor(place)).alias(f"_lo_{name}"), at(F.ceil(place)).alias(f"_hi_{name}")]
    found = counted.groupBy(*by).agg(F.first("_total").alias("_total"), *picks)
    if method == "upper":
        return found.drop("_total")
    out = []
    for name, p in probs.items():
        place = (F.col("_total") - 1) * F.lit(p)
        step = place - F.floor(place)
        out.append((F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * step).alias(name))
    return found.select(*by, *out)
