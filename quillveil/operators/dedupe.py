"""Removing entities that were found more than once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .layout import iou, same_box

#: Boxes that overlap by more, or lie within this many units of each other, are the same place.
OVERLAP, TOLERANCE = 0.8, 5.0


def by_text(entities: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Of each text (in any case) of a document the row with the highest confidence, by pattern and place at ties."""
    best = Window.partitionBy(*keys, F.lower("text")).orderBy(F.desc("confidence"), "pattern_ordinal", "text_index")
    return entities.withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n")


def by_span(entities: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Entities whose spans don't overlap: earlier in the order of confidence, length, pattern and place wins.

    Overlapping spans form an island; within one the winners are chosen from the best on. This is what redaction needs:
    each occurrence stays, and no two spans meet.
    """
    span = F.struct(
        F.negative("confidence").alias("rank"), F.negative(F.length("text")).alias("size"), F.col("pattern_ordinal").alias("ordinal"), F.col("text_index").alias("start"),
        (F.col("text_index") + F.length("text")).alias("end"),
    )
    order = Window.partitionBy(*keys).orderBy("text_index", F.col("text_index") + F.length("text"), "pattern_ordinal")
    before = F.max(F.col("text_index") + F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(before > F.col("text_index"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = entities.withColumn("__before", before).withColumn("__island", island).withColumn("__span", span)
    kept = rows.groupBy(*keys, "__island").agg(F.collect_set("__span").alias("s")).select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("__island").alias("__i"), F.aggregate(
        F.array_sort("s"), F.array().cast(entities.select(F.array(span)).schema[0].dataType),
        lambda acc, s: F.when(F.exists(acc, lambda t: (t["start"] < s["end"]) & (s["start"] < t["end"])), acc).otherwise(F.concat(acc, F.array(s)))).alias("kept"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    joined = rows.join(kept, same & (F.col("__island") == F.col("__i")))
    return joined.where(F.array_contains("kept", F.col("__span"))).select(entities.columns).dropDuplicates([*keys, "text_index", "pattern_ordinal"])


def apart(spans: Column) -> Column:
    """Of an array of spans (rank, size, ordinal, start, end, label) those that `by_span` keeps, within the row: islands first, then each island's best."""
    kind = "struct<start:int,end:int,rank:double,size:int,ordinal:int,label:string>"
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(*(s[k].alias(k) for k in ("start", "end", "rank", "size", "ordinal", "label")))))

    def island(acc: Column, s: Column) -> Column:
        last = F.get(acc["done"], F.size(acc["done"]) - 1)
        longer = F.concat(F.slice(acc["done"], 1, F.size(acc["done"]) - 1), F.array(F.concat(last, F.array(s))))
        done = F.when(s["start"] < acc["end"], longer).otherwise(F.concat(acc["done"], F.array(F.array(s))))
        return F.struct(F.greatest(acc["end"], s["end"]).alias("end"), done.alias("done"))

    def best(group: Column) -> Column:
        ranked = F.array_sort(F.transform(group, lambda s: F.struct(*(s[k].alias(k) for k in ("rank", "size", "ordinal", "start", "end", "label")))))
        none = F.array().cast("array<struct<rank:double,size:int,ordinal:int,start:int,end:int,label:string>>")
        return F.aggregate(ranked, none, lambda kept, s: F.when(F.exists(kept, lambda t: (t["start"] < s["end"]) & (s["start"] < t["end"])), kept).otherwise(F.concat(kept, F.array(s))))

    start = F.struct(F.lit(0).alias("end"), F.array().cast(f"array<array<{kind}>>").alias("done"))
    return F.flatten(F.transform(F.aggregate(by_start, start, island, lambda acc: acc["done"]), best))


def by_place(entities: DataFrame, keys: tuple[str, ...] = ("doc_id", "page_number"), scratch: str | None = None) -> DataFrame:
    """One entity a place of a page. Boxes that overlap by more than `OVERLAP` are one place (the most confident entity stays), and so are
    equal texts (in any case) whose boxes nearly coincide: found by one method the most confident stays, by two the place's first,
    as ml_ner with the mean confidence.

    Entities come by rows of `TOLERANCE` units, x, pattern and place in the text; each joins the first place that takes it, or begins
    its own. A page's entities are folded within one row, at the cost of its places times its entities; with a shared folder for
    steps (`scratch`) they are joined by grid cells instead, which suits pages of any size (see `spatial.places`). Column bbox (struct) has x, y, width, height.
    """
    if scratch:
        from .spatial import places

        return places(entities, scratch, keys, OVERLAP, TOLERANCE)
    own = F.struct(*entities.columns)
    rank = F.struct(F.floor(F.col("bbox.y") / TOLERANCE).alias("row"), F.col("bbox.x").alias("x"), F.col("pattern_ordinal").alias("o"), F.col("text_index").alias("t"), own.alias("e"))
    pages = entities.groupBy(*keys).agg(F.array_sort(F.collect_list(rank)).alias("__sorted"))
    kind = entities.select(F.array(F.struct(own.alias("first"), own.alias("best")))).schema[0].dataType

    def takes(place: Column, e: Column) -> Column:
        first = place["first"]
        equal = (F.lower(first["text"]) == F.lower(e["text"])) & same_box(first["bbox"], e["bbox"], TOLERANCE)
        return (iou(first["bbox"], e["bbox"]) > OVERLAP) | equal

    def merged(place: Column, e: Column) -> Column:
        first, best = place["first"], place["best"]
        mean = first.withField("confidence", (first["confidence"] + e["confidence"]) / 2).withField("detection_method", F.lit("ml_ner"))
        two_methods = (iou(first["bbox"], e["bbox"]) <= OVERLAP) & (first["detection_method"] != e["detection_method"])
        return F.struct(first.alias("first"), F.when(two_methods, mean).when(e["confidence"] > best["confidence"], e).otherwise(best).alias("best"))

    def step(places: Column, x: Column) -> Column:
        e = x["e"]
        at = F.array_position(F.transform(places, lambda p: takes(p, e)), F.lit(True))
        return F.when(at == 0, F.concat(places, F.array(F.struct(e.alias("first"), e.alias("best"))))).otherwise(F.transform(places, lambda p, i: F.when(i == at - 1, merged(p, e)).otherwise(p)))

    places = F.aggregate("__sorted", F.array().cast(kind), step, lambda done: F.transform(done, lambda p: p["best"]))
    return pages.select(F.inline(places)).select(entities.columns)


def spatial_anti_join(found: DataFrame, taken: DataFrame, keys: tuple[str, ...] = ("doc_id", "page_number"), tolerance: float = 2.0) -> DataFrame:
    """Rows of `found` that coincide with no row of `taken` on their page."""
    from .spatial import near_anti_join

    return near_anti_join(found, taken, keys, tolerance)
