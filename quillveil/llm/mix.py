"""Mixing sources to target weights, in DataFrame functions alone.

Each document gets a hash-random key. Within each source the keys are sorted by ranges (a range is a prefix of the
key, so that ranges fill evenly whatever the source's share), sums of words are taken by range, prefix sums of these over
a source's ranges say how many words precede each range, and running sums within a range do the rest. Each source is
cut at its budget to the word: whole epochs first, then the documents up to the cut, the last of them in part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import copies, freed, stored

#: Weights of the sources in their order, repeating.
WEIGHTS = (5, 2, 1)
#: A source's words are taken so many times at most.
EPOCHS = 3
#: Documents of a range, about: 16 to a power ranges a source, the same number for all.
RANGE = 256
#: Prefix sums over a source's ranges are taken in two steps, by this many hexadecimal digits more.
STEP = 3
#: Rows of one part of a table of sources, about.
PART = 1 << 20
_SOURCE = ["no_source", "source"]


def n_words(text: Column) -> Column:
    """Number of runs of other than space and \\x09-\\x0D; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0) -> DataFrame:
    """(no_source, source, doc_id, key, size, n_rows): documents by id, source and text, repeated rows counted.

    The key is the MD5 of seed, id and the text's MD5: the same in each run and at each layout of the table.
    """
    text_of = F.coalesce(F.col(text).cast("string"), F.lit(""))
    name = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.md5(text_of))
    rows = docs.select(
        F.col(source).isNull().alias("no_source"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"),
        F.col(doc_id).alias("doc_id"), F.md5(name).alias("key"), n_words(F.col(text)).alias("size"),
    )
    return rows.groupBy(*_SOURCE, "doc_id", "key", "size").agg(F.count("*").alias("n_rows"))


def running(df: DataFrame, order: list[Column], sums: dict[str, str], scratch: str) -> DataFrame:
    """`df` with the sums of columns over all rows before each, in that order; no row's place is shared.

    Ranges of the order are parts of a stored table; what precedes a part is summed over the parts (a row each), what precedes a row within its part.
    """
    parts = 1 + df.count() // PART
    cut = stored(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), scratch)
    totals = cut.groupBy("__part").agg(*(F.sum(c).alias(f"__{c}") for c in sums.values()))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("__part", *(F.coalesce(F.sum(f"__{c}").over(earlier), F.lit(0)).alias(f"__{c}") for c in sums.values()))
    within = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = cut.join(totals, "__part")
    return rows.withColumns({name: F.col(f"__{c}") + F.coalesce(F.sum(c).over(within), F.lit(0)) for name, c in sums.items()}).drop("__part", *(f"__{c}" for c in sums.values()))


def targets(sources: DataFrame, scratch: str, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(no_source, source, source_size, target) of sources with their sizes.

    Sources weigh `weights` in the order of their names (code points, null last), repeating, and share the sum of all sizes. A target stops at `epochs`
    times its source's size; what is over goes to the others by weight. With sources by size a weight, those that stop come first,
    and two running sums tell where they end: no rounds. Comparisons are exact.
    """
    numbered = running(sources.withColumn("one", F.lit(1).cast("long")), [F.col("no_source"), F.col("source")], {"at": "one"}, f"{scratch}/named").drop("one")
    weight = F.element_at(F.array(*(F.lit(w).cast("long") for w in weights)), (F.pmod("at", F.lit(len(weights))) + 1).cast("int"))
    numbered = numbered.withColumn("weight", weight).withColumn("most", F.col("source_size") * epochs).drop("at")
    first = [F.col("most").cast("double") / F.col("weight"), F.col("no_source"), F.col("source")]
    rows = stored(running(numbered, first, {"most_before": "most", "weight_before": "weight"}, f"{scratch}/filled"), f"{scratch}/sources")
    total, weight_all = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    wide = "decimal(38,0)"
    stops = F.col("most").cast(wide) * (F.lit(weight_all) - F.col("weight_before")) <= F.col("weight").cast(wide) * (F.lit(total) - F.col("most_before"))
    rows = rows.withColumn("stops", stops)
    used, weight_used = rows.where("stops").agg(F.coalesce(F.sum("most"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    shared = F.lit(float(total - used)) * F.col("weight") / F.lit(float(max(1, weight_all - weight_used)))
    return rows.select(*_SOURCE, "source_size", F.when(F.col("stops"), F.col("most").cast("double")).otherwise(shared).alias("target"))


def mixture(docs: DataFrame, scratch: str, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """For each row of `docs`: doc_id, source, key, size, source_size, target (its source's) and taken (words the mix takes, repeats counted).

    A source's taken words are its target, rounded; no document gives more than `epochs` times its size. Null texts and texts
    without words have size 0 and give nothing; a null source is a source, the last one; null ids are an id like others. Repeated rows (equal id,
    source and text) come back as often as they are given, and where the cut falls among them some give more than others. Other columns are
    left out, whatever their names. An empty table gives no rows.
    """
    rows = stored(sizes(docs, doc_id, text, source, seed), f"{scratch}/sizes")
    digits = max(0, math.ceil(math.log(max(1, rows.count()) / RANGE, 16)))
    rows = rows.withColumn("range", F.substring("key", 1, digits)).withColumn("words", F.col("size") * F.col("n_rows"))
    ranges = stored(rows.groupBy(*_SOURCE, "range").agg(F.sum("words").alias("words")), f"{scratch}/ranges")
    ranges = ranges.withColumn("wide", F.substring("range", 1, max(0, digits - STEP)))

    def before(*by: str) -> Column:
        return F.coalesce(F.sum("words").over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    wide = ranges.groupBy(*_SOURCE, "wide").agg(F.sum("words").alias("words")).withColumn("wide_before", before(*_SOURCE, "wide"))
    found = stored(targets(wide.groupBy(*_SOURCE).agg(F.sum("words").alias("source_size")), scratch, weights, epochs), f"{scratch}/targets")
    found = found.withColumn("budget", F.floor(F.col("target") + 0.5)).withColumn("epochs", F.expr("if(source_size > 0, budget div source_size, 0L)"))
    found = found.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size")).drop("budget")
    ranges = ranges.withColumn("narrow_before", before(*_SOURCE, "wide", "range")).join(wide.drop("words"), [*_SOURCE, "wide"]).join(found, _SOURCE)
    ranges = stored(ranges.select(*_SOURCE, "range", (F.col("wide_before") + F.col("narrow_before")).alias("range_before"), "source_size", "target", "epochs", "rest"), f"{scratch}/cuts")

    # Rows and ranges meet by source and range; the running sums need no other exchange.
    rows = rows.join(ranges.hint("merge"), [*_SOURCE, "range"])
    at = F.col("range_before") + before(*_SOURCE, "range", "key")
    last = F.least(F.greatest(F.col("rest") - at, F.lit(0)), F.col("words"))
    rows = rows.withColumn("last", last).withColumn("whole", F.expr("if(size > 0, last div size, 0L)"))
    # Of equal rows the first give a whole text to the last epoch, one a part of it, the others none.
    part = (F.col("last") > F.col("whole") * F.col("size")).cast("long")
    shares = F.array(
        F.struct(F.col("whole").alias("n"), F.col("size").alias("last")),
        F.struct(part.alias("n"), (F.col("last") - F.col("whole") * F.col("size")).alias("last")),
        F.struct((F.col("n_rows") - F.col("whole") - part).alias("n"), F.lit(0).cast("long").alias("last")),
    )
    rows = rows.withColumn("share", F.explode(F.filter(shares, lambda s: s["n"] > 0)))
    out = copies(rows.select("doc_id", F.when(~F.col("no_source"), F.col("source")).alias("source"), "key", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("share.last")).alias("taken"), F.col("share.n").alias("__n")), "__n")
    freed(docs.sparkSession, f"{scratch}/named", f"{scratch}/filled", f"{scratch}/sources", f"{scratch}/ranges")
    return out


def mixed(docs: DataFrame, scratch: str, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix itself: doc_id, source, text, epoch (from 0) and n_words, a row for each time that a text is used; the last may be a part (its first words).

    What `mixture` says of nulls and repeated rows holds; equal rows are used in turn. Texts travel once, to their numbers.
    """
    seed = options.get("seed", 0)
    plan = mixture(docs, scratch, doc_id, text, source, **options).where("taken > 0")
    plan = plan.select(F.col("key").alias("__key"), "size", "taken", F.col("source").alias("__source")).groupBy("__key", "__source", "size", "taken").agg(F.count("*").alias("__n"))
    text_of = F.coalesce(F.col(text).cast("string"), F.lit(""))
    name = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.md5(text_of))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), text_of.alias("text"), F.md5(name).alias("__id")).dropDuplicates(["__id", "source"])
    rows = rows.join(plan, (F.col("__id") == F.col("__key")) & F.col("source").eqNullSafe(F.col("__source")))
    rows = copies(rows, "__n").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("taken") - 1) / F.col("size")))))
    rows = rows.withColumn("n_words", F.least(F.col("size"), F.col("taken") - F.col("epoch") * F.col("size")))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    cut = F.when(F.col("n_words") < F.col("size"), F.array_join(F.slice(words, F.lit(1), F.col("n_words").cast("int")), " ")).otherwise(F.col("text"))
    return rows.select("doc_id", "source", cut.alias("text"), "epoch", "n_words")
