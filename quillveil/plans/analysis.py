"""From documents to entities, and from entities to redacted documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..config import DetectionConfig
from ..functions.scripts import with_scripts
from ..functions.words import Word
from ..operators import dedupe, redact, review
from ..operators.detect import detect, entities_of, find_occurrences


def analysed(docs: DataFrame, config: DetectionConfig | None = None, words: Sequence[Word] = (), mode: str = "span", key: str = "doc_id", text: str = "text") -> DataFrame:
    """Entities of each document: detected, deduplicated, filtered by type and confidence.

    mode span keeps every place where spans don't overlap, which redaction needs; mode text keeps one row of each text of
    a document. Patterns are all run, since one dropped early could have won a tie.
    """
    config = config or DetectionConfig()
    found = detect(docs.select(key, text), text, config, words)
    if mode == "text":
        return review.config_filter(dedupe.by_text(found, (key,)), config)
    return dedupe.by_span(review.config_filter(found, config), (key,))


def redacted(docs: DataFrame, config: DetectionConfig | None = None, words: Sequence[Word] = (), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents with all that analysis finds, taken as confirmed, replaced by labels: redacted_text and redacted_count.

    All is found, chosen and replaced within the row: no shuffle, one scan, and the same on streams. `key` isn't needed; rows with
    equal or null keys are rows of their own.
    """
    config = config or DetectionConfig()
    rows = docs.withColumn("__scripts", F.array(*map(F.lit, config.force_scripts))) if config.force_scripts else with_scripts(docs, text, "__scripts")
    rows = rows.withColumn("__spans", dedupe.apart(entities_of(F.col(text), F.col("__scripts"), config, words)))
    return rows.withColumn("redacted_text", redact.redacted(F.col(text), F.col("__spans"))).withColumn("redacted_count", F.coalesce(F.size("__spans"), F.lit(0))).drop("__scripts", "__spans")


def all_sources(docs: DataFrame, model_entities: DataFrame | None = None, config: DetectionConfig | None = None, words: Sequence[Word] = (), key: str = "doc_id", text: str = "text") -> DataFrame:
    """What patterns and a model find, as the configuration asks for (`use_regex`, `use_ml`), filtered by type and confidence."""
    config = config or DetectionConfig()
    found = detect(docs.select(key, text), text, config, words)
    if config.use_ml and model_entities is not None:
        found = found.unionByName(model_entities, allowMissingColumns=True)
    return review.config_filter(found, config)


def with_selection(docs: DataFrame, entities: DataFrame, needle: str, kind: str = "CUSTOM", key: str = "doc_id", text: str = "text") -> DataFrame:
    """Entities and all places of a text selected by hand that aren't among them yet."""
    own = find_occurrences(docs.select(key, text), needle, kind, text)
    rows = entities.withColumn("__known", F.lit(True)).unionByName(own.withColumn("__known", F.lit(False)), allowMissingColumns=True)
    # By a window, not a join with the entities, so that they are worked out once.
    known = F.max("__known").over(Window.partitionBy(key, "text_index", F.lower("text")))
    return rows.withColumn("__met", known).where(F.col("__known") | ~F.col("__met")).drop("__known", "__met")
