"""Documents packed into shards, and questions between shards by sorted keys.

A shard is one row: about SHARD_BYTES of text with the ids of its documents. Shards ask
each other about 64-bit keys: each sends its distinct keys in order, cut at the borders
of key ranges; one task per range merges the sorted parts and answers each with one bit
per key. A key that a third of all documents hold arrives once per shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Scratch

SHARD_BYTES, RANGE_KEYS = 2_000_000, 500_000
LAST = np.iinfo(np.int64).max


def pack(values: np.ndarray) -> bytes:
    """Whole numbers in non-descending order, compressed: differences, byte plane by byte plane."""
    steps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    return zstandard.compress(len(values).to_bytes(8, "little") + np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    raw = zstandard.decompress(data)
    n = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(raw, np.uint8, offset=8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_any(values: np.ndarray) -> bytes:
    """Whole numbers in any order, compressed byte plane by byte plane."""
    planes = np.ascontiguousarray(values.astype(np.int64).view(np.uint8).reshape(-1, 8).T)
    return zstandard.compress(len(values).to_bytes(8, "little") + planes.tobytes(), 1)


def unpack_any(data: bytes) -> np.ndarray:
    raw = zstandard.decompress(data)
    n = int.from_bytes(raw[:8], "little")
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, offset=8).reshape(8, n).T).view(np.int64).ravel()


@contextmanager
def small_batches(spark: SparkSession, rows: int = 8):
    """Few rows per batch while tables of shards are read; their rows are large."""
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = {n: spark.conf.get(n) for n in names}
    for n in names:
        spark.conf.set(n, str(rows))
    try:
        yield
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


class Shard:
    """Texts of one shard; ids as int64 with None kept apart."""

    def __init__(self, ids: list, texts: list[bytes]):
        self.ids, self.texts = ids, texts
        self.order = np.array([LAST if i is None else i for i in ids], np.int64)

    def row(self) -> tuple:
        return self.ids, [len(t) for t in self.texts], zstandard.compress(b"".join(self.texts), 3)

    @staticmethod
    def of(ids: list, sizes: list[int], data: bytes) -> Shard:
        whole = memoryview(zstandard.decompress(data)) if sizes and sum(sizes) else memoryview(b"")
        ends = np.cumsum(sizes).tolist()
        return Shard(ids, [bytes(whole[e - n : e]) for e, n in zip(ends, sizes)])


def _group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, texts, size = [], [], 0

    def out() -> pa.RecordBatch:
        a, b, c = Shard(ids, texts).row()
        return pa.RecordBatch.from_arrays(
            [pa.array([a], pa.list_(pa.int64())), pa.array([b], pa.list_(pa.int64())), pa.array([c], pa.binary())], names=["ids", "sizes", "data"]
        )

    for batch in batches:
        for key, text in zip(batch.column(0), batch.column(1)):
            data = (text.as_py() or "").encode()
            if texts and size + len(data) > SHARD_BYTES:
                yield out()
                ids, texts, size = [], [], 0
            ids.append(key.as_py())
            texts.append(data)
            size += len(data)
    if texts:
        yield out()


def build(scratch: Scratch, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(shard, ids, sizes, data): the written table of shards."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    grouped = rows.mapInArrow(_group, "ids array<long>, sizes array<long>, data binary")
    # The number is fixed by writing the table.
    return scratch.table(grouped.withColumn("shard", F.monotonically_increasing_id()))


def _keys(make: Callable, bits: int):
    """make(row) gives (keys in order, distinct; values or None) for a row of the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, values = make(row)
                cuts = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.empty(0, np.int64)
                edges = np.r_[0, cuts, len(keys)]
                full = np.flatnonzero(np.diff(edges))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(full, pa.int64()),
                        pa.array(np.full(len(full), row["shard"]), pa.int64()),
                        pa.array([pack(keys[edges[i] : edges[i + 1]]) for i in full], pa.binary()),
                        pa.array([None if values is None else pack_any(values[edges[i] : edges[i + 1]]) for i in full], pa.binary()),
                    ],
                    names=["range", "shard", "keys", "values"],
                )

    return run


def _merge(mode: str):
    """Answers for the shards of one range; binary search places each part in the merged keys."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        keys = [unpack(k) for k in part["keys"]]
        merged = np.unique(np.concatenate(keys))
        places = [np.searchsorted(merged, k) for k in keys]
        if mode == "elsewhere":
            seen = np.zeros(len(merged), np.int64)
            for p in places:
                seen[p] += 1
            bits = [seen[p] > 1 for p in places]
        else:
            values = [unpack_any(v) for v in part["values"]]
            least, most = np.full(len(merged), LAST), np.full(len(merged), np.iinfo(np.int64).min)
            for p, v in zip(places, values):
                np.minimum.at(least, p, v)
                np.maximum.at(most, p, v)
            bits = [least[p] < v for p, v in zip(places, values)] if mode == "smaller" else [(least < most)[p] for p in places]
        return pd.DataFrame(
            {"shard": part["shard"], "range": part["range"], "answer": [np.packbits(b).tobytes() for b in bits], "n": [len(b) for b in bits]}
        )

    return run


def ask(scratch: Scratch, table: DataFrame, make: Callable, mode: str, n_keys: int) -> DataFrame:
    """(shard, answers): for each shard one bit per key of make(row), in the order of its keys.

    mode "elsewhere": another shard has the key; "smaller": some shard has it with a
    smaller value; "differs": the key has two values or more (here a shard may send a
    key several times, with its least and greatest value). n_keys, an estimate of all
    keys, sets the number of ranges, so that a task merges about RANGE_KEYS.
    """
    bits = max(3, int(np.ceil(np.log2(max(1, n_keys / RANGE_KEYS)))))
    parts = table.mapInArrow(_keys(make, bits), "range long, shard long, keys binary, values binary")
    answers = parts.groupBy("range").applyInPandas(_merge(mode), "shard long, range long, answer binary, n long")
    return answers.groupBy("shard").agg(F.collect_list(F.struct("range", "n", "answer")).alias("answers"))


def bits_of(answers: list[dict] | None) -> np.ndarray:
    """The answers of a shard in the order of its keys."""
    parts = [np.unpackbits(np.frombuffer(a["answer"], np.uint8), count=a["n"]) for a in sorted(answers or [], key=lambda a: a["range"])]
    return np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
