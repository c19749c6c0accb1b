"""Spark session and reliable-checkpoint settings."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "syntabula", cores: int | str = 8, memory: str = "12g") -> SparkSession:
    """Session for tests and benches; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", memory))
        .config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named in spark.checkpoint.dir.

    A local master without the setting gets a temporary folder; on a cluster a
    machine-local folder would not outlive an executor, so that is an error.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    context.setCheckpointDir(folder)


_WRITTEN: list[str] = []


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df once as a table below the shared checkpoint folder and read it back.

    Compared with checkpoint() the copy is columnar: later steps read only their
    columns, and its size is known to the planner. The job runs at once, while the plan
    that uses the table is built. release_tables() deletes what was written.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    path = f"{folder}/tables/{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release_tables(spark: SparkSession) -> int:
    """Delete every table of cut_lineage(); DataFrames that read one can't be used any more."""
    released = 0
    while _WRITTEN:
        place = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        released += place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return released
