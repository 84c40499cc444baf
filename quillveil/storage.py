"""Tables written between steps, in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which every executor can reach.

    Only where the session names none and all runs on this machine (tests) is a temporary folder made and set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-quillveil-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/quillveil-{uuid.uuid4().hex}"


#: Spark's own setting: a finished write's shuffle files go at once, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, path: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read again. The write's shuffle files are gone afterwards."""
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt by their keys to two tasks a core, 16 at least: a file of few bytes is read by one task, whatever its rows cost later."""
    return df.repartition(max(16, 2 * df.sparkSession.sparkContext.defaultParallelism), *keys)
