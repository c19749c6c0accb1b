"""The registered queries of the numbered operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import oracles
from .common import Scratch, documents, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return keep


@query("op3_secret_ownership", oracles.SECRETS)
def secret_ownership(spark, folder):
    from .secrets import scan

    with Scratch(spark) as scratch:
        return scan(scratch, documents(spark, folder), "doc_id", "text", owner="source", repository="doc_id")


@query("op5_simhash_components")
def simhash_components(spark, folder):
    from .simhash import near_duplicates

    with Scratch(spark) as scratch:
        found = near_duplicates(scratch, documents(spark, folder))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op6_risk_controlled_rules", oracles.RULES)
def risk_controlled_rules(spark, folder):
    from .rules import controlled

    with Scratch(spark) as scratch:
        return controlled(scratch, documents(spark, folder), table(spark, folder, "labels"))


@query("op10_edit_decontamination")
def edit_decontamination(spark, folder):
    from .decontamination import contaminated

    return contaminated(documents(spark, folder), table(spark, folder, "benchmark"))


@query("op4_histogram_packing")
def histogram_packing(spark, folder):
    from .packing import pack

    with Scratch(spark) as scratch:
        return pack(scratch, documents(spark, folder))


@query("op9_recompression_windows", oracles.WORDS)
def recompression_windows(spark, folder):
    from .words import repeated_windows

    with Scratch(spark) as scratch:
        return repeated_windows(scratch, documents(spark, folder)).drop("spans")


@query("op7_suffix_array_strings", oracles.STRINGS)
def suffix_array_strings(spark, folder):
    from .strings import repeated_strings

    with Scratch(spark) as scratch:
        found = repeated_strings(scratch, documents(spark, folder))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


@query("op1_fuzzy_lines")
def fuzzy_lines(spark, folder):
    from .lines import deduplicated

    with Scratch(spark) as scratch:
        return deduplicated(scratch, documents(spark, folder).select("doc_id", "text"))


@query("op8_string_kernel_toxicity")
def string_kernel_toxicity(spark, folder):
    from .toxicity import toxicity

    return toxicity(documents(spark, folder), table(spark, folder, "labels"))


@query("op2_ordinal_quality")
def ordinal_quality(spark, folder):
    from .quality import grade_of, graded, train

    docs, labels = documents(spark, folder), table(spark, folder, "labels")
    model = train(docs, labels.select("doc_id", grade_of(labels).alias("grade")), grades=3)
    return graded(docs, model)


@query("op12_rank_synchronous_counts")
def rank_synchronous_counts(spark, folder):
    from .token_counts import token_counts

    return token_counts(documents(spark, folder))


@query("op13_segment_hard_negatives", oracles.NEGATIVES)
def segment_hard_negatives(spark, folder):
    from .negatives import hard_negatives, shifted

    with Scratch(spark) as scratch:
        return hard_negatives(scratch, shifted(table(spark, folder, "embeddings")))


@query("op11_anchored_alignment")
def anchored_alignment(spark, folder):
    from .alignment import align

    with Scratch(spark) as scratch:
        return align(scratch, documents(spark, folder))
