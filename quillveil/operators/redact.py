"""Replacing what was confirmed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..sources import docx
from .sanitize import sanitized_archive

#: Units added around a rectangle.
MARGIN = 2.0


def redacted(text: Column, spans: Column) -> Column:
    """Each span (start, end, label) replaced by [label].

    Spans don't overlap (see `dedupe.by_span`); null spans leave the text as it is.
    """
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"))))

    def cut(own: Column) -> Column:
        before = lambda i: F.coalesce(F.get(own, i - 1)["end"], F.lit(0))
        pieces = F.transform(own, lambda s, i: F.concat(F.substr(text, before(i) + 1, s["start"] - before(i)), F.lit("["), s["label"], F.lit("]")))
        return F.concat(F.array_join(pieces, ""), F.substr(text, before(F.size(own)) + 1, F.length(text)))

    return F.when(spans.isNull(), text).otherwise(F.get(F.transform(F.array(ordered), cut), F.lit(0)))


def redact(docs: DataFrame, entities: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with redacted_text and redacted_count; entities of other documents are ignored."""
    spans = entities.groupBy(F.col(key).alias("__key")).agg(F.collect_list(F.struct(F.col("text_index").alias("start"), (F.col("text_index") + F.length("text")).alias("end"), F.col("entity_type").alias("label"))).alias("__spans"))
    joined = docs.join(spans, F.col(key).eqNullSafe(F.col("__key")), "left")
    return joined.withColumn("redacted_text", redacted(F.col(text), F.col("__spans"))).withColumn("redacted_count", F.coalesce(F.size("__spans"), F.lit(0))).drop("__key", "__spans")


def boxes(entities: DataFrame) -> DataFrame:
    """What to do on each page: delete a form's widget by name, or cover a rectangle with a margin."""
    b = F.col("bbox")
    rect = F.array(b["x"] - MARGIN, b["y"] - MARGIN, b["x"] + b["width"] + MARGIN, b["y"] + b["height"] + MARGIN)
    named = F.coalesce(F.col("form_field_name"), F.lit("")) != ""
    return entities.select("doc_id", "page_number", "form_field_name", F.when(named, "delete_widget").otherwise("redact").alias("action"), F.when(~named, rect).alias("rect"), "entity_type")


def highlighted(text: Column, spans: Column) -> Column:
    """For each span (text, label), longest text first, the first place in any case wrapped in a marked element."""
    longest = F.reverse(F.array_sort(F.transform(spans, lambda s: F.struct(F.length(s["text"]).alias("n"), s["text"].alias("text"), s["label"].alias("label")))))

    def wrap(acc: Column, s: Column) -> Column:
        at = F.instr(F.lower(acc), F.lower(s["text"]))
        hit = F.substr(acc, at, F.length(s["text"]))
        return F.when(at > 0, F.overlay(acc, F.concat(F.lit('<span class="entity-'), F.lower(s["label"]), F.lit('">'), hit, F.lit("</span>")), at, F.length(s["text"]))).otherwise(acc)

    return F.aggregate(longest, text, wrap)


def redact_archives(archives: DataFrame, entities: DataFrame, key: str = "doc_id", sanitize: bool = False) -> DataFrame:
    """Word archives (parts: entry name to bytes) with the confirmed entities' texts taken out, and success, error, redacted_count.

    Places are those of `docx.full_text`. The first run that an entity touches gets [TYPE], the others lose their share; all else,
    images among it, stays byte for byte. With `sanitize` the parts are sanitised too. Archives without confirmed entities have
    an error and keep their parts.
    """
    own = entities.where((F.col("status") == "confirmed") & (F.length("text") > 0))
    own = own.groupBy(F.col(key).alias("__key")).agg(F.collect_list(F.struct(F.col("text_index").alias("start"), (F.col("text_index") + F.length("text")).alias("end"), F.col("entity_type").alias("label"))).alias("__spans"))
    rows = archives.join(own, F.col(key).eqNullSafe(F.col("__key")), "left")
    done = F.transform_values("parts", lambda k, v: F.when(k == docx.DOCUMENT, F.encode(docx.with_spans_cut(F.decode(v, "UTF-8"), F.col("__spans")), "UTF-8")).otherwise(v))
    done = sanitized_archive(done) if sanitize else done
    none = F.col("__spans").isNull()
    rows = rows.withColumn("parts", F.when(none, F.col("parts")).otherwise(done)).withColumn("success", ~none)
    return rows.withColumn("error", F.when(none, F.lit("No entities confirmed for redaction"))).withColumn("redacted_count", F.coalesce(F.size("__spans"), F.lit(0))).drop("__key", "__spans")
