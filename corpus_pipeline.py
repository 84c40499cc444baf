"""A training-data pipeline over `documents`: quality, near copies, benchmark leaks, personal data, token ids.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; its result is written as Parquet and read again as
the next one's docs. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillveil.llm import bpe, decontaminate, jaccard, pii, quality
from quillveil.llm.common import removed, shared_dir, table, tidy, workspace
from quillveil.llm.queries import RANKS, WANTED


def wanted_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the importance sample; the others (low quality, toxic) go, repeated rows together. Null and empty texts weigh nothing for or against."""
    sample = quality.resampled(docs, table(spark, sf_dir, "labels"), WANTED, shared_dir(spark))
    return sample.where("kept").select(docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates, see `jaccard.one_of_each`; documents without words all stay."""
    return jaccard.one_of_each(docs, shared_dir(spark))


def no_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with a benchmark item; null and empty texts stay, as do repeated rows."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), shared_dir(spark))


def no_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, repeated rows too, with personal data and the terms that would reveal it masked; null texts stay null."""
    return pii.sanitised(docs, shared_dir(spark), n_chars="n_chars")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, token_ids (unsigned 32-bit little-endian) and n_tokens of each row; null and empty texts have no tokens."""
    import public_tokenizers as P

    rows = bpe.encoded(docs.select("doc_id", "lang", "source", "text"), P.path(RANKS), P.PATTERN)
    return rows.select("doc_id", "lang", "source", "token_ids", bpe.n_tokens().alias("n_tokens"))


STAGES = [
    ("quality classifier", wanted_quality),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", no_benchmarks),
    ("PII", no_personal_data),
    ("byte-level BPE", token_ids),
]

#: SQL can't express the stages; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`STAGES` applied to `documents` in turn. An empty table gives no rows. What a stage wrote for itself goes when its result is written, and that result when the next one's is."""
    docs, scratch, before = table(spark, sf_dir, "documents"), shared_dir(spark), None
    for k, (_, stage) in enumerate(STAGES):
        out = f"{scratch}/stage-{k}"
        with workspace(spark), tidy(spark):
            stage(spark, docs, sf_dir).write.parquet(out)
        if before:
            removed(spark, before)
        docs, before = spark.read.parquet(out), out
    return docs
