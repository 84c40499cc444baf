"""Connected components by joins: labels hook onto smaller neighbours' labels, and chains of labels are halved."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stored


def components(edges: DataFrame, scratch: str) -> DataFrame:
    """(node, component) for each node of `edges` (a, b; longs): the smallest node that it can reach.

    Loops, repeated edges and either direction are fine; rows with a null end are left out. Each round writes the labels
    to the shared folder; a component of diameter d needs about log d rounds. No node's edges meet in one task: minima are
    taken in part before each shuffle, and both sides of each join have exchanges of their own, which Spark can split.
    """
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    both = edges.union(edges.select(F.col("b"), F.col("a"))).distinct()
    both = stored(both, f"{scratch}/edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), f"{scratch}/labels-0")
    step = 0
    while True:
        step += 1
        of_b = labels.select(F.col("node").alias("b"), F.col("label").alias("label_b"))
        of_a = labels.select(F.col("node").alias("a"), F.col("label").alias("label_a"))
        met = both.join(of_b, "b").join(of_a, "a").where("label_b < label_a")
        lower = met.select(F.explode(F.array("a", "label_a")).alias("node"), F.col("label_b").alias("label"))
        lower = lower.groupBy("node").agg(F.min("label").alias("label"))
        lower = stored(lower, f"{scratch}/lower-{step}")
        if lower.isEmpty():
            return labels.select("node", F.col("label").alias("component"))
        hooked = labels.join(lower.withColumnRenamed("label", "low"), "node", "left").select("node", F.least("label", "low").alias("label"))
        hooked = stored(hooked, f"{scratch}/hooked-{step}")
        up = hooked.select(F.col("node").alias("label"), F.col("label").alias("up"))
        labels = stored(hooked.join(up, "label", "left").select("node", F.coalesce("up", "label").alias("label")), f"{scratch}/labels-{step}")
