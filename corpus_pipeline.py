"""The training-data pipeline: documents through quality, lines, near duplicates, benchmark items, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from syntabula.llm.common import Scratch, table
from syntabula.llm.decontamination import decontaminated
from syntabula.llm.lines import deduplicated
from syntabula.llm.packing import pack
from syntabula.llm.quality import grade_of, selected, train
from syntabula.llm.simhash import similar_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that reach the least grade; ratings come from the labels table."""
    labels = table(spark, sf_dir, "labels")
    model = train(docs, labels.select("doc_id", grade_of(labels).alias("grade")), grades=3)
    return selected(docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without near-duplicate lines; those of which no line with words is left go.

    n_chars is counted anew where the text changed. Documents without words stay.
    """
    with Scratch(spark) as scratch:
        found = deduplicated(scratch, docs)
    emptied = (F.col("n_removed") > 0) & ~F.coalesce(F.col("text"), F.lit("")).rlike(r"\S")
    changed = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.where(~emptied).withColumn("n_chars", changed).select(*docs.columns)


def near_duplicate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the least id, of several texts of that id the least hash.

    SimHash fingerprints of five-word shingles that anchors of the covering code bring together,
    and keys of least hashes beside them, give the candidates; links are sets of shingles of
    similarity 0.8 or more (similar_documents()). A document is an id with a text, so another text of a dropped document's id stays, and of equal rows of
    the kept document one does. Texts without words say nothing about likeness: they are no
    duplicates, nor are rows without an id.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    has_words = text.rlike(r"[^\x20\x09-\x0D]")
    own = F.struct("doc_id", "text_hash")
    with Scratch(spark) as scratch:
        found = scratch.table(similar_documents(scratch, docs.where(has_words & F.col("doc_id").isNotNull())))
        first = found.groupBy("group").agg(F.min(own).alias("first"))
        gone = found.join(first, "group").where(own != F.col("first")).select(own.alias("_gone")).distinct()
        gone = scratch.table(gone, keep=True)
        again = found.groupBy(own.alias("_again")).count().where("count > 1").select("_again")
        again = scratch.table(again, keep=True)
    marked = docs.withColumn("_own", F.struct("doc_id", F.xxhash64(text).alias("text_hash")))
    left = marked.join(gone, F.col("_own") == F.col("_gone"), "left_anti")
    if again.isEmpty():
        return left.drop("_own")
    # Equal rows, of which few documents have any: one stays.
    equal = left.join(again, F.col("_own") == F.col("_again"), "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(again, F.col("_own") == F.col("_again"), "left_anti").unionByName(equal).drop("_own")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, up to its error budget."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens and their places in sequences."""
    with Scratch(spark) as scratch:
        return pack(scratch, docs)


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicate_documents),
    ("benchmark_decontamination", benchmark),
    ("packing", packing),
]

#: No SQL: classifier, fingerprints and token ids have none; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each stage returns is written once and read again."""
    docs = table(spark, sf_dir, "documents")
    with Scratch(spark) as scratch:
        for name, stage in STAGES[:-1]:
            docs = scratch.table(stage(spark, docs, sf_dir))
        return STAGES[-1][1](spark, docs, sf_dir)
