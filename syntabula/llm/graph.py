"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import Scratch


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """(node, label) for every node of the links (a, b); label: the least node reachable.

    Alternating large and small stars: each round ties every node to the least of its
    neighbours, so that paths halve; the number of edges never grows. Minima are
    aggregates and combine map-side, so a node with very many links is no hot task.
    Each round is a written table. No links give an empty table.
    """
    ordered = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = scratch.table(ordered.distinct())
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a")
        new = scratch.table(
            small.where("b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(lower.select("a", F.col("m").alias("b")))
            .distinct()
        )
        now = _state(new)
        edges = new
        if now == state:
            break
        state = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)
