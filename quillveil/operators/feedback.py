"""What reviewers' corrections say about detection: rates, calibrated confidences, and thresholds for a wanted precision.

Feedback is a table of entries: at (milliseconds), action (see `ACTIONS`), and of the detection entity_type, pattern_name, detection_method and
confidence; of a false negative, which nothing detected, the type alone counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# What a correction can say.
ACTIONS = ("false_positive", "false_negative", "boundary_correction", "reclassify", "confirm")
BINS = 50


def from_review(entities: DataFrame, at: Column) -> DataFrame:
    """Feedback from reviewed entities: confirmed ones are right, rejected ones false; others say nothing."""
    action = F.when(F.col("status") == "confirmed", "confirm").when(F.col("status") == "rejected", "false_positive")
    return entities.withColumn("action", action).withColumn("at", at).where("action IS NOT NULL")


def _rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)


def analytics(feedback: DataFrame, custom_patterns: int = 0) -> DataFrame:
    """One row: total_corrections, false_positive_rate (of detections), false_negative_rate (of what is there), accuracy_by_type (confirmed of detected),
    custom_patterns_created, and improvement_rate: by how many percent the share of confirmed detections in the later half of the time is above that in the earlier one.

    A rate of nothing is null, and so is the improvement on nothing or on zero. Unknown and null actions don't count. Half of the time: up to the middle between the first and the last entry.
    """
    rows = feedback.where(F.col("action").isin(*ACTIONS))
    span = rows.agg(F.min("at").alias("first"), F.max("at").alias("last"))
    rows = rows.join(F.broadcast(span), F.lit(True))  # one row
    is_a = lambda *kinds: F.col("action").isin(*kinds)
    early = F.col("at") <= (F.col("first") + F.col("last")) / 2
    detected, right = ~is_a("false_negative"), is_a("confirm")
    counts = rows.groupBy("entity_type").agg(
        F.count_if(~right).alias("corrections"), F.count_if(is_a("false_positive")).alias("fp"), F.count_if(is_a("false_negative")).alias("fn"), F.count_if(detected).alias("detected"), F.count_if(right).alias("right"),
        F.count_if(is_a("confirm", "boundary_correction", "reclassify")).alias("there"), F.count_if(detected & early).alias("d1"), F.count_if(right & early).alias("r1"), F.count_if(detected & ~early).alias("d2"), F.count_if(right & ~early).alias("r2"),
    )
    s = {c: F.coalesce(F.sum(c), F.lit(0)) for c in counts.columns[1:]}
    before, after = _rate(s["r1"], s["d1"]), _rate(s["r2"], s["d2"])
    by_type = F.map_from_entries(F.array_sort(F.collect_list(F.when((F.col("detected") > 0) & F.col("entity_type").isNotNull(), F.struct("entity_type", F.col("right") / F.col("detected"))))))
    return counts.agg(
        s["corrections"].alias("total_corrections"), _rate(s["fp"], s["detected"]).alias("false_positive_rate"), _rate(s["fn"], s["fn"] + s["there"]).alias("false_negative_rate"), by_type.alias("accuracy_by_type"),
        F.lit(custom_patterns).alias("custom_patterns_created"), F.when(before > 0, 100 * (after - before) / before).alias("improvement_rate"),
    )


def rates(feedback: DataFrame, by: Sequence[str] = ("entity_type", "pattern_name", "detection_method")) -> DataFrame:
    """(what, value, n, right, rate) of detections: overall (what is null), and by each of the columns."""
    rows = feedback.where(F.col("action").isin(*ACTIONS) & (F.col("action") != "false_negative"))
    what = F.explode(F.array(F.struct(F.lit(None).cast("string").alias("what"), F.lit(None).cast("string").alias("value")), *(F.struct(F.lit(c).alias("what"), F.col(c).cast("string").alias("value")) for c in by)))
    own = rows.select((F.col("action") == "confirm").alias("ok"), what.alias("w"))
    return own.groupBy("w.what", "w.value").agg(F.count("*").alias("n"), F.count_if("ok").alias("right")).withColumn("rate", F.col("right") / F.col("n"))


def _bin(confidence: Column, bins: int) -> Column:
    return F.least(F.greatest(F.floor(confidence * bins), F.lit(0)), F.lit(bins - 1)).cast("int")


def calibration(feedback: DataFrame, keys: Sequence[str] = ("entity_type",), bins: int = BINS) -> DataFrame:
    """(keys, from_bin, to_bin, n, right, calibrated): the share of right detections by confidence, made to rise with it.

    Counts go by `bins` bins of confidence; where a bin's share isn't above that of those before it they are pooled (isotonic regression by
    adjacent violators), within one row of at most `bins` counts a key. Detections without a confidence don't count.
    """
    rows = feedback.where(F.col("action").isin(*ACTIONS) & (F.col("action") != "false_negative") & F.col("confidence").isNotNull())
    counts = rows.groupBy(*keys, _bin(F.col("confidence"), bins).alias("bin")).agg(F.count("*").alias("n"), F.count_if(F.col("action") == "confirm").alias("right"))
    sorted_bins = F.array_sort(F.collect_list(F.struct(F.col("bin").alias("from_bin"), F.col("bin").alias("to_bin"), "n", "right")))
    block = "struct<from_bin:int,to_bin:int,n:bigint,right:bigint>"

    def pooled(done: Column, new: Column) -> Column:
        """The blocks so far, the last ones merged with the new one as long as their share isn't below its own."""
        start = F.struct(new.alias("last"), F.array().cast(f"array<{block}>").alias("kept"))

        def back(acc: Column, b: Column) -> Column:
            last = acc["last"]
            merged = F.struct(b["from_bin"].alias("from_bin"), last["to_bin"].alias("to_bin"), (b["n"] + last["n"]).alias("n"), (b["right"] + last["right"]).alias("right"))
            joins = b["right"] * last["n"] >= last["right"] * b["n"]
            return F.when(joins, F.struct(merged.alias("last"), acc["kept"].alias("kept"))).otherwise(F.struct(last.alias("last"), F.concat(F.array(b), acc["kept"]).alias("kept")))

        return F.aggregate(F.reverse(done), start, back, lambda acc: F.concat(acc["kept"], F.array(acc["last"])))

    fold = F.aggregate("bins", F.array().cast(f"array<{block}>"), pooled)
    out = counts.groupBy(*keys).agg(sorted_bins.alias("bins")).select(*keys, F.explode(fold).alias("b"))
    return out.select(*keys, "b.from_bin", "b.to_bin", "b.n", "b.right", (F.col("b.right") / F.col("b.n")).alias("calibrated"))


def thresholds(table: DataFrame, precision: float, keys: Sequence[str] = ("entity_type",), bins: int = BINS) -> DataFrame:
    """(keys, threshold): the least confidence from which on a calibrated detection is right as often as wanted; null: none is."""
    return table.groupBy(*keys).agg((F.min(F.when(F.col("calibrated") >= precision, F.col("from_bin"))) / bins).alias("threshold"))


def recalibrated(entities: DataFrame, table: DataFrame, keys: Sequence[str] = ("entity_type",), bins: int = BINS) -> DataFrame:
    """`entities` with calibrated confidences: those of the block that the confidence falls in, or of the last one below it, or else of the first; entities of keys without feedback keep theirs.

    The table has a row of at most `bins` blocks a key.
    """
    held = table.groupBy(*(F.col(k).alias(f"__{k}") for k in keys)).agg(F.array_sort(F.collect_list(F.struct("from_bin", "calibrated"))).alias("__blocks"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    below = F.filter("__blocks", lambda b: b["from_bin"] <= _bin(F.col("confidence"), bins))
    value = F.coalesce(F.get(below, F.size(below) - 1)["calibrated"], F.get("__blocks", F.lit(0))["calibrated"], F.col("confidence"))
    rows = entities.join(held, same, "left")
    return rows.withColumn("confidence", F.when(F.col("confidence").isNotNull(), value)).select(entities.columns)
