"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import storage

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders of the workspaces that are open, innermost last.
_WORKSPACES: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below the open workspace, or else below spark.checkpoint.dir (see `storage.shared_dir`)."""
    return f"{_WORKSPACES[-1]}/{uuid.uuid4().hex}" if _WORKSPACES else storage.shared_dir(spark)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared ones."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def workspace(spark: SparkSession) -> Iterator[str]:
    """A folder for all steps within, which is deleted at the end: what comes of them must be written elsewhere by then."""
    path = storage.shared_dir(spark)
    _WORKSPACES.append(path)
    try:
        yield path
    finally:
        _WORKSPACES.remove(path)
        removed(spark, path)


#: Spark's own setting: a finished write's shuffle files go at once, not when the driver happens to collect its garbage.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_TIDY, "false")
    spark.conf.set(_TIDY, "true")
    try:
        yield
    finally:
        spark.conf.set(_TIDY, before)


def stored(df: DataFrame, path: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read again. The write's shuffle files are gone afterwards."""
    with tidy(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def freed(spark: SparkSession, *paths: str) -> None:
    """Give back the space of stored tables that no frame in use reads any more: an empty table takes their place."""
    for path in paths:
        spark.range(0, numPartitions=1).write.mode("overwrite").parquet(path)


def parts_for(n: int, each: int) -> int:
    """Parts for n values of about `each`: in proportion to the input, 64 at least."""
    return max(64, -(-n // each))


def ascii_lower(text):
    """Lower-case A-Z alone; `lower` is the same and faster where a text is all ASCII."""
    text = F.coalesce(text, F.lit(""))
    return F.when(~text.rlike("[^\\x00-\\x7F]"), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def copies(df: DataFrame, n: str, block: int = 4096) -> DataFrame:
    """Each row `n` times (that column goes), by way of blocks, so that no row's copies are one large array."""
    left = F.col(n) - F.col("__block") * block
    rows = df.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / block))))
    return rows.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.least(left, F.lit(block)).cast("int")))).drop(n, "__block", "__copy")
