"""Benchmark decontamination by winnowing, in DataFrame functions alone.

Of each window of `WINDOW` words the least hash of its `GRAM`-word grams is its fingerprint; equal windows have equal
fingerprints, so every span of `WINDOW` words that a document shares with an item is found by a join on fingerprints.
Hits are then extended: the whole windows behind equal fingerprints are compared word for word.
Items of fewer words are one window, whose fingerprint is the hash of all its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_lower, copies, freed, stored

WINDOW, GRAM = 10, 5
#: Fingerprints of all items, as long values, up to this many are broadcast (counted first); beyond, Spark shuffles.
BROADCAST_ROWS = 2_000_000
_BREAKS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words(text: Column) -> Column:
    """A-Z in lower case; runs of a-z, 0-9 and all that isn't ASCII. Null has none."""
    return F.array_remove(F.split(ascii_lower(text), _BREAKS), "")


def _each(first: int, last: Column, of) -> Column:
    """of(i) for i from `first` to `last`; an empty array where there is none."""
    return F.when(last >= first, F.transform(F.sequence(F.lit(first), last), of)).otherwise(F.array().cast("array<bigint>"))


def _gram(hashes: str, size: int):
    return lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(size)))


def with_fingerprints(df: DataFrame, lengths: list[int]) -> DataFrame:
    """Add words, n_words and for each length L fp_L: the fingerprint of the window at each word (column `text` is read)."""
    df = df.withColumn("words", words(F.col("text"))).withColumn("n_words", F.size("words").cast("long"))
    df = df.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    n = F.size("hashes")
    if WINDOW in lengths:
        df = df.withColumn("grams", _each(0, n - GRAM, _gram("hashes", GRAM)))
        df = df.withColumn(f"fp_{WINDOW}", _each(0, n - WINDOW, lambda i: F.least(*(F.get("grams", i + k) for k in range(WINDOW - GRAM + 1)))))
    for size in lengths:
        if size < WINDOW:
            df = df.withColumn(f"fp_{size}", _each(0, n - size, _gram("hashes", size)))
    return df.drop("hashes", "grams")


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct windows of all items: size, fp, window (its words, space between), items (sorted ids as strings)."""
    rows = items.select(F.col(item_id).cast("string").alias("item"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumn("words", words(F.col("text"))).withColumn("size", F.least(F.size("words"), F.lit(WINDOW))).where("size > 0")
    starts = rows.select("item", "size", "words", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("size") + 1)).alias("at"))
    parts = starts.select("item", "size", F.array_join(F.slice("words", F.col("at"), F.col("size")), " ").alias("text")).distinct()
    parts = with_fingerprints(parts, list(range(1, WINDOW + 1)))
    fp = F.coalesce(*(F.when(F.col("size") == k, F.get(f"fp_{k}", F.lit(0))) for k in range(1, WINDOW + 1)))
    return parts.select("size", fp.alias("fp"), F.col("text").alias("window"), "item").groupBy("size", "fp", "window").agg(F.collect_set("item").alias("items"))


def hits(docs: DataFrame, items: DataFrame, scratch: str, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """For each document (doc_id, text_hash): n_words, n_hit, items (ids as strings), spans of hit words.

    Repeated rows are worked on once and returned as often as they come. Null and wordless texts have no words and no
    hits; null ids are an id like others. Other columns are left out, whatever their names. Without items, all is clean.
    """
    windows = stored(item_windows(items, item_id, item_text), f"{scratch}/windows")
    lengths = [r[0] for r in windows.select("size").distinct().collect()]  # at most WINDOW values
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("text_hash", F.xxhash64("text"))
    marked = with_fingerprints(base, lengths)
    own = F.array_distinct(F.concat(*(F.col(f"fp_{k}") for k in lengths))) if lengths else F.array().cast("array<bigint>")
    # One row for each fingerprint, and one without for each document, so that no second pass has to count words.
    rows = marked.select("doc_id", "text_hash", "n_words", F.explode(F.concat(F.array(F.lit(None).cast("long")), own)).alias("fp"))
    known = windows.select(F.col("fp").alias("known")).distinct()
    if known.count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    rows = rows.join(known, F.col("fp") == F.col("known"), "left").where("fp IS NULL OR known IS NOT NULL")
    rows = rows.groupBy("doc_id", "text_hash").agg(F.max("n_words").alias("n_words"), F.collect_set("known").alias("fps"), F.count_if(F.col("fp").isNull()).alias("n_rows"))
    rows = stored(rows, f"{scratch}/flagged")

    flagged = rows.where(F.size("fps") > 0).select(F.col("doc_id").alias("f_id"), F.col("text_hash").alias("f_hash"), "fps")
    again = with_fingerprints(base.join(flagged, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("text_hash") == F.col("f_hash"))).drop("f_id", "f_hash"), lengths)
    found = None
    for size in lengths:
        at = F.filter(F.transform(f"fp_{size}", lambda fp, i: F.when(F.array_contains("fps", fp), i)), lambda i: i.isNotNull())
        part = again.select("doc_id", "text_hash", "words", F.explode(at).alias("at"))
        part = part.select("doc_id", "text_hash", "at", F.lit(size).alias("n"), F.array_join(F.slice("words", F.col("at") + 1, size), " ").alias("w"))
        found = part if found is None else found.unionByName(part)
    out = copies(rows.select("doc_id", "text_hash", "n_words", "n_rows"), "n_rows")
    if found is None:
        return out.select("*", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    found = found.join(windows.select("window", "size", "items"), (F.col("w") == F.col("window")) & (F.col("n") == F.col("size")))
    # Equal rows of the input give equal hits, which the sets take once.
    found = found.groupBy("doc_id", "text_hash").agg(
        F.array_sort(F.collect_set(F.struct(F.col("at").alias("start"), (F.col("at") + F.col("n")).alias("end")))).alias("found"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
    )
    none = F.array().cast("array<struct<start:int,end:int>>")
    merge = F.aggregate(
        "found", none,
        lambda a, x: F.when((F.size(a) > 0) & (F.get(a, F.size(a) - 1)["end"] >= x["start"]),
            F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(F.get(a, F.size(a) - 1)["start"].alias("start"), F.greatest(F.get(a, F.size(a) - 1)["end"], x["end"]).alias("end"))))
        ).otherwise(F.concat(a, F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"))))),
    )
    found = found.select(F.col("doc_id").alias("f_id"), F.col("text_hash").alias("f_hash"), "items", merge.alias("spans"))
    joined = out.join(found, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("text_hash") == F.col("f_hash")), "left")
    spans = F.coalesce("spans", none)
    n_hit = F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return joined.select("doc_id", "text_hash", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), spans.alias("spans"))


def digest(items: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(items), ","), 256)


def clean(docs: DataFrame, items: DataFrame, scratch: str, **columns) -> DataFrame:
    """The rows of `docs` that share no window with an item, all columns as they were."""
    doc_id, text = columns.get("doc_id", "doc_id"), columns.get("text", "text")
    bad = hits(docs, items, scratch, **columns).where("n_hit > 0").select(F.col("doc_id").alias("__bad_id"), F.col("text_hash").alias("__bad_hash"))
    bad = stored(bad.distinct(), f"{scratch}/contaminated")
    freed(docs.sparkSession, f"{scratch}/windows", f"{scratch}/flagged")
    same = docs[doc_id].eqNullSafe(bad["__bad_id"]) & (F.xxhash64(F.coalesce(docs[text].cast("string"), F.lit(""))) == bad["__bad_hash"])
    return docs.join(bad, same, "left_anti")
