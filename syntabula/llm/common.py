"""What the operators share: scratch tables, batches of texts, id columns."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import ensure_checkpoint_dir

#: Bytes of text that a task handles at a time; longer texts are handled alone.
CHUNK_BYTES = 2_000_000
#: Rows of a batch for Python while a scratch table is written.
BATCH_ROWS = 500
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


class Scratch:
    """Tables below the shared checkpoint folder, written once and read back.

    A written table cuts the lineage: an executor lost later costs a new read only.
    Tables that no later step reads are deleted when the block ends; keep() names
    those that the returned DataFrame still reads.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.kept = spark, [], set()
        ensure_checkpoint_dir(spark)
        base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
        self.folder = f"{base}/llm-{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for path in self.paths:
            if path not in self.kept:
                self._delete(path)

    def _delete(self, path: str) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)

    def table(self, df: DataFrame, keep: bool = False) -> DataFrame:
        path = f"{self.folder}/{len(self.paths)}"
        self.paths.append(path)
        # Rows hold whole texts; a batch for Python holds at most BATCH_ROWS of them.
        before = self.spark.conf.get(_BATCH)
        self.spark.conf.set(_BATCH, str(min(BATCH_ROWS, int(before))))
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(_BATCH, before)
        if keep:
            self.kept.add(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Delete the table behind df now; it must not be read again."""
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            self._delete(path)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def chunks(texts: Iterable) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, UTF-8 texts) of an Arrow column in pieces of about CHUNK_BYTES; null is empty."""
    held: list[bytes] = []
    first = size = 0
    for i, text in enumerate(texts):
        data = (text.as_py() or "").encode()
        if held and size + len(data) > CHUNK_BYTES:
            yield first, held
            held, first, size = [], i, 0
        held.append(data)
        size += len(data)
    if held:
        yield first, held


def mixed(values: np.ndarray) -> np.ndarray:
    """Bijective mix of 64-bit values."""
    v = values.astype(np.uint64, copy=True)
    v ^= v >> np.uint64(33)
    v *= np.uint64(0xFF51AFD7ED558CCD)
    v ^= v >> np.uint64(33)
    v *= np.uint64(0xC4CEB9FE1A85EC53)
    v ^= v >> np.uint64(33)
    return v


def text_of(name: str = "text"):
    """The text column, null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def partitions_for(df_rows: int, per_task: int, spark: SparkSession) -> int:
    """Shuffle partitions so that a task holds about per_task rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df_rows // per_task))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
