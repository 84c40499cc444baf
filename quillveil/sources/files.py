"""Files: which are taken, which reader they need, and what their names become."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Larger files are refused.
MOST_BYTES = 50 * 1024 * 1024
# Accepted kinds.
MIME = ("application/pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document")


def admission(name: Column, length: Column, mime: Column | None = None) -> Column:
    """Why a file is refused; null for those taken."""
    known = F.lower(name).rlike(r"\.(pdf|docx)$")
    if mime is not None:
        known = known | F.coalesce(mime.isin(*MIME), F.lit(False))
    return F.when(~known, "unsupported type").when(length > MOST_BYTES, "too large")


def route(name: Column) -> Column:
    return F.when(F.lower(name).endswith(".docx"), "docx").otherwise("pdf")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Accepted files below a path: name, length, format, content. Size and suffix are judged before contents are read."""
    files = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.where((F.col("length") <= MOST_BYTES) & F.lower("path").rlike(r"\.(pdf|docx)$")).select(F.col("path"), name.alias("filename"), "length", route(name).alias("format"), "content")
