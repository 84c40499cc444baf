"""Filters, counts and bulk decisions on entities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..config import ENTITY_TYPES, HIGH, LOW, MEDIUM, TYPES, DetectionConfig


def band(confidence: Column) -> Column:
    """high, medium, low; null below."""
    return F.when(confidence >= HIGH, "high").when(confidence >= MEDIUM, "medium").when(confidence >= LOW, "low")


def config_filter(entities: DataFrame, config: DetectionConfig) -> DataFrame:
    return entities.where(F.col("entity_type").isin(*config.types) & (F.col("confidence") >= config.threshold))


def review_filter(entities: DataFrame, types: Sequence[str] = TYPES, hidden_bands: Sequence[str] = ()) -> DataFrame:
    """Shown types without hidden bands; what is in no band always stays."""
    shown = F.col("entity_type").isin(*types)
    return entities.where(shown & ~F.coalesce(band(F.col("confidence")).isin(*hidden_bands), F.lit(False)) if hidden_bands else shown)


def clamped(confidence: Column) -> Column:
    """Into [0, 1]; null stays null."""
    return F.when(confidence.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)))


def viewer_filter(entities: DataFrame) -> DataFrame:
    """What a viewer shows: all that isn't rejected."""
    return entities.where(F.col("status") != "rejected")


def with_status(entities: DataFrame, status: str) -> DataFrame:
    return entities.where(F.col("status") == status)


def counts_by_type(entities: DataFrame) -> DataFrame:
    """A row for each of the nine types, also those without entities."""
    dim = entities.sparkSession.createDataFrame([(t,) for t in TYPES], "entity_type string")
    return dim.join(entities.groupBy("entity_type").agg(F.count("*").alias("n")), "entity_type", "left").select("entity_type", F.coalesce("n", F.lit(0)).alias("n"))


def shown_counts(entities: DataFrame) -> DataFrame:
    """Counts by type without the types that have none."""
    return counts_by_type(entities).where("n > 0")


def counts_by_band(entities: DataFrame) -> DataFrame:
    b = band(F.col("confidence"))
    return entities.agg(*(F.count_if(b == k).alias(k) for k in ("high", "medium", "low")), F.count_if(F.col("status") == "confirmed").alias("confirmed"), F.coalesce(F.every(F.col("status") == "confirmed"), F.lit(True)).alias("all_confirmed"))


def statistics(entities: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Total, mean confidence, and maps of counts by type, band and method."""
    parts = []
    for name, col in (("by_type", F.col("entity_type")), ("by_band", F.coalesce(band(F.col("confidence")), F.lit("none"))), ("by_method", F.col("detection_method"))):
        parts.append(entities.groupBy(*keys, F.lit(name).alias("what"), col.alias("value")).agg(F.count("*").alias("n"), F.sum("confidence").alias("s")))
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    pick = lambda k: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("what") == k, F.struct("value", "n"))))).alias(k)
    own = F.col("what") == "by_type"
    return rows.groupBy(*keys).agg(F.sum(F.when(own, F.col("n"))).alias("total"), (F.sum(F.when(own, F.col("s"))) / F.sum(F.when(own, F.col("n")))).alias("mean_confidence"), pick("by_type"), pick("by_band"), pick("by_method"))


def rollup(entities: DataFrame) -> DataFrame:
    rows = entities.withColumn("band", F.coalesce(band(F.col("confidence")), F.lit("none")))
    return rows.rollup("entity_type", "band").agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"))


def set_status(entities: DataFrame, which: Column, status: str) -> DataFrame:
    return entities.withColumn("status", F.when(which, F.lit(status)).otherwise(F.col("status")))


def set_status_of(entities: DataFrame, ids: DataFrame, status: str, key: str = "id") -> DataFrame:
    """Rows whose id is in `ids` get the status."""
    own = ids.select(F.col(key).alias("__id")).distinct()
    joined = entities.join(own, F.col(key) == F.col("__id"), "left")
    return joined.withColumn("status", F.when(F.col("__id").isNotNull(), F.lit(status)).otherwise(F.col("status"))).drop("__id")


def confirm_confident(entities: DataFrame, least: float = HIGH) -> DataFrame:
    return set_status(entities, F.col("confidence") >= least, "confirmed")


def similar_counts(entities: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Of each text and type, exactly as written, how many aren't selected."""
    return entities.where(F.col("status") == "rejected").groupBy(*keys, "text", "entity_type").agg(F.count("*").alias("n"))


def ordered(entities: DataFrame, by: str = "page") -> DataFrame:
    """By page (rows of five units, then x), confidence, or type."""
    if by == "confidence":
        return entities.orderBy(F.desc("confidence"))
    if by == "type":
        return entities.orderBy("entity_type", F.desc("confidence"))
    return entities.orderBy("page_number", F.floor(F.col("bbox.y") / 5), "bbox.x")


def presentation(entities: DataFrame) -> DataFrame:
    """Name, colour and description of each row's type; unknown types have their own name and the grey of dates."""
    dim = F.broadcast(entities.sparkSession.createDataFrame([*ENTITY_TYPES], "entity_type string, display_name string, color string, description string"))
    joined = entities.join(dim, "entity_type", "left")
    return joined.withColumn("display_name", F.coalesce("display_name", "entity_type")).withColumn("color", F.coalesce("color", F.lit("#6B7280"))).withColumn("description", F.coalesce("description", F.lit("")))


def with_id(entities: DataFrame, *columns: str) -> DataFrame:
    """A stable id of each row, from the columns that name it."""
    return entities.withColumn("id", F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), 256))


def toggled(values: Column, value: str) -> Column:
    """A set with `value` taken out, or put in."""
    return F.when(F.array_contains(values, value), F.array_remove(values, value)).otherwise(F.array_append(values, F.lit(value)))
