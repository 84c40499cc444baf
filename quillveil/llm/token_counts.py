"""Exact length histogram: documents aggregated by encoded length, with suffix sums over the lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: Lengths in one block of the two-level suffix sums.
BLOCK = 1024


def length_histogram(df: DataFrame, length: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows (*by, length, n_docs): partial counts first, so that a hot length or group is one row a task.

    Null lengths are left out; an empty input gives no rows.
    """
    return df.where(F.col(length).isNotNull()).groupBy(*by, F.col(length).cast("long").alias("length")).agg(F.count("*").alias("n_docs"))


def context_limits(histogram: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row for each length that occurs, taken as a context limit.

    n_longer and tokens_longer count documents longer than the limit and all their tokens; tokens_total and docs_total
    are those of the group; tokens_kept is what is left when each document is cut at the limit, and tokens_cut what
    goes; quantile is the share of documents no longer than the limit. Between two rows all but tokens_kept and
    tokens_cut stay the same and those are linear in the limit (`at_limit`), so that the rows answer every limit.

    The suffix sums have two levels: within blocks of `BLOCK` lengths, and over the blocks' totals. The first
    is dealt by block; the second has one row a block and group.
    """
    key = [*by, "block"]
    rows = histogram.withColumn("block", F.floor(F.col("length") / BLOCK)).withColumn("tokens", F.col("length") * F.col("n_docs"))
    inner = Window.partitionBy(*key).orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(*key).agg(F.sum("n_docs").alias("b_docs"), F.sum("tokens").alias("b_tokens"))
    over = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    outer = over.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    total = over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        *[F.col(c).alias(f"k_{c}") for c in key],
        F.coalesce(F.sum("b_docs").over(outer), F.lit(0)).alias("above_docs"),
        F.coalesce(F.sum("b_tokens").over(outer), F.lit(0)).alias("above_tokens"),
        F.sum("b_docs").over(total).alias("docs_total"),
        F.sum("b_tokens").over(total).alias("tokens_total"),
    )
    rows = rows.withColumn("in_docs", F.coalesce(F.sum("n_docs").over(inner), F.lit(0))).withColumn("in_tokens", F.coalesce(F.sum("tokens").over(inner), F.lit(0)))
    on = [F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in key]
    joined = rows.join(blocks, on).withColumn("n_longer", F.col("in_docs") + F.col("above_docs")).withColumn("tokens_longer", F.col("in_tokens") + F.col("above_tokens"))
    kept = F.col("tokens_total") - F.col("tokens_longer") + F.col("n_longer") * F.col("length")
    return joined.select(
        *by, F.col("length").alias("context_limit"), "n_docs", "n_longer", "tokens_longer", "docs_total", "tokens_total",
        kept.alias("tokens_kept"), (F.col("tokens_total") - kept).alias("tokens_cut"), ((F.col("docs_total") - F.col("n_longer")) / F.col("docs_total")).alias("quantile"),
    )


def at_limit(limits: DataFrame, limit: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Tokens kept of each group when documents are cut at any `limit`, from the rows of `context_limits`."""
    under = F.col("context_limit") <= limit
    got = limits.groupBy(*by).agg(
        F.max("docs_total").alias("docs_total"), F.max("tokens_total").alias("tokens_total"),
        F.max_by(F.struct("n_longer", "tokens_longer"), F.when(under, F.col("context_limit"))).alias("at"),
    )
    n, tokens = F.coalesce("at.n_longer", "docs_total"), F.coalesce("at.tokens_longer", "tokens_total")
    return got.select(*by, F.lit(limit).cast("long").alias("context_limit"), n.alias("n_longer"), (F.col("tokens_total") - tokens + n * limit).alias("tokens_kept"), "tokens_total")


def length_quantile(limits: DataFrame, q: float, by: tuple[str, ...] = ()) -> DataFrame:
    """The least length that at least the share q of a group's documents don't exceed."""
    return limits.where(F.col("quantile") >= q).groupBy(*by).agg(F.min("context_limit").alias("length"))
