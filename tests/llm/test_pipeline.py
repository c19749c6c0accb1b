"""The stages one after the other, on the smallest tables and on awkward rows."""

from pathlib import Path

import pytest

import corpus_pipeline as P
from llm_data import awkward, table
from syntabula.llm import decontamination
from syntabula.llm.packing import Encoder

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="test tables absent")


def test_run_packs_what_the_stages_keep(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(P.STAGES[:-1]):
        before = docs
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert docs.columns == columns and 0 < docs.count() <= before.count()
    bench = [decontamination.normal(r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    kept = docs.collect()
    assert not any(b in decontamination.normal(r["text"]) for r in kept for b in bench)
    assert all(r["n_chars"] == len(r["text"]) for r in kept)
    encoder = Encoder()
    want = sorted((r["doc_id"], len(encoder.ids(r["text"])) + 1) for r in kept)
    got = P.run(spark, FOLDER)
    assert sorted((r[0], r[1]) for r in got.groupBy("doc_id", "doc_tokens").count().collect()) == want


def test_clean_documents_stay(spark):
    """Documents with a good label, no copy and no benchmark item are not lost before packing."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = {r["doc_id"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").where("quality = 1").collect()}
    kept = {r["doc_id"] for r in P.quality(spark, docs, FOLDER).select("doc_id").collect()}
    assert len(labels & kept) >= 0.98 * len(labels)


@pytest.mark.parametrize("k", range(len(P.STAGES)))
def test_awkward_rows_and_empty_table(spark, k):
    _, stage = P.STAGES[k]
    docs = table(spark, awkward(6)).select("doc_id", "text", "lang", "source", "n_chars", "fp", "key", "value")
    found = stage(spark, docs, FOLDER)
    assert k == len(P.STAGES) - 1 or found.columns == docs.columns
    assert found.count() > 0
    assert stage(spark, docs.limit(0), FOLDER).count() == 0


def test_near_duplicates_go_by_row_not_by_id(spark):
    one = " ".join(f"a{i}" for i in range(60))
    other = " ".join(f"b{i}" for i in range(60))
    rows = [(1, one), (2, one + " end"), (2, other), (3, other), (4, "c d e"), (4, "c d e"), (None, one), (None, one), (5, None), (5, None), (6, " ")]
    docs = table(spark, rows)
    kept = sorted(((r["doc_id"], r["text"]) for r in P.near_duplicate_documents(spark, docs, FOLDER).collect()), key=str)
    assert kept == sorted([(1, one), (2, other), (4, "c d e"), (None, one), (None, one), (5, None), (5, None), (6, " ")], key=str)
