"""Word lists as stored tables: a folder of versions, of which readers take the last whole one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.wordlists import SCHEMA, unique


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Versions whose write was finished."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(top):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(top)]
    return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))


def load(spark: SparkSession, path: str) -> DataFrame:
    """The words of the last whole version; none where nothing has been saved."""
    found = _versions(spark, path)
    return spark.read.schema(SCHEMA).parquet(f"{path}/version={found[-1]}") if found else spark.createDataFrame([], SCHEMA)


def save(words: DataFrame, path: str) -> int:
    """Write the list, kept unique, as a new version, and return its number. A list may come from the version before; two writers at once get an error."""
    spark = words.sparkSession
    version = max(_versions(spark, path), default=0) + 1
    unique(words).write.parquet(f"{path}/version={version}")
    return version
