"""Personal data: base patterns with exact offsets, and terms that would still reveal what was masked.

All in DataFrame functions. The base kinds are found by regular expressions and checked; offsets are code points. The
information-theoretic part then asks, for each protected value e and each term t of the texts that hold it, how much of e's
information t reveals: share = PMI(t; e) / IC(e) = log(N n(t,e) / (n(t) n(e))) / log(N / n(e)), with document counts
over the whole corpus. In documents that hold e, terms with a share of `GENERALISE` or more are replaced by
a general label, those of `REMOVE` or more are deleted. A term counts only if at least `SUPPORT` different texts that
hold e have it, so that mere copies of one document say nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import located
from .common import copies, freed, stored

#: In the order in which spans are listed. Possessive forms and anchors keep matching linear on long runs.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap conditions without which a kind can't occur.
_GATES = {"email": lambda t: t.contains("@"), "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"), "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), "phone": lambda t: t.contains("+")}
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]", "removed": ""}

SUPPORT = 2
GENERALISE, REMOVE = 0.75, 0.95
_SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    return {
        "email": F.lit(True),
        "ip": F.forall(F.split(value, r"\."), lambda p: p.cast("double") <= 255),
        "card": n.between(16, 19) & F.call_function("luhn_check", _digits(value)),
        "phone": n.between(8, 15),
    }[kind]


def base_spans(text: Column) -> Column:
    """All valid base spans of a text: by kind as listed, then start."""
    none = F.array().cast(_SPAN)
    parts = []
    for kind in KINDS:
        good = F.filter(located(text, PATTERNS[kind]), _checker(kind))
        named = F.transform(good, _namer(kind))
        parts.append(F.when(_GATES[kind](text), named).otherwise(none))
    return F.concat(*parts)


def _checker(kind: str):
    return lambda s: _valid(kind, s["value"])


def _namer(kind: str):
    return lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"))


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("text_hash", F.xxhash64("text"))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}++"), F.lit(0)))


def disclosing_terms(base: DataFrame, corpus: DataFrame, scratch: str) -> DataFrame:
    """(doc_id, text_hash, term, action): for documents with protected values, the terms to `term` (generalise) or to have `removed`.

    `base` has doc_id, text_hash, spans and n_rows of each document, and text where there are spans; `corpus` all texts. Each row is
    a document of its own in all counts; only the support of a term counts different texts.
    """
    spark = base.sparkSession
    held = base.where(F.size("spans") > 0)
    mentions = held.select("doc_id", "text_hash", "n_rows", F.explode("spans").alias("m"))
    value = F.when(F.col("m.kind") == "email", F.lower("m.value")).when(F.col("m.kind") == "ip", F.col("m.value")).otherwise(_digits(F.col("m.value")))
    holders = stored(mentions.select(F.concat_ws(":", "m.kind", value).alias("value"), "doc_id", "text_hash", "n_rows").distinct(), f"{scratch}/mentions")
    total = base.agg(F.sum("n_rows")).first()[0] or 0
    in_text = holders.groupBy("value", "text_hash").agg(F.sum("n_rows").alias("n_docs"))
    per_value = in_text.groupBy("value").agg(F.sum("n_docs").alias("n_value"), F.count("*").alias("texts")).where(F.col("texts") >= SUPPORT).drop("texts")
    per_value = stored(per_value, f"{scratch}/values")
    values = in_text.join(per_value.select("value"), "value", "left_semi").groupBy("text_hash").agg(F.collect_list(F.struct("value", "n_docs")).alias("held"))
    values = values.withColumnRenamed("text_hash", "h_hash")
    texts = held.groupBy("text_hash").agg(F.first("text").alias("text")).join(values, F.col("text_hash") == F.col("h_hash"))
    pairs = texts.select("held", F.explode(_terms(F.col("text"))).alias("term")).select("term", F.explode("held").alias("h"))
    pairs = pairs.groupBy(F.col("h.value").alias("value"), "term").agg(F.count("*").alias("support"), F.sum("h.n_docs").alias("n_both")).where(F.col("support") >= SUPPORT)
    pairs = stored(pairs, f"{scratch}/pairs")
    # All words of the corpus, summed within each task before they are shuffled.
    words = corpus.select(F.explode(_terms(F.col("text"))).alias("own")).groupBy("own").agg(F.count("*").alias("n_term"))
    wanted = pairs.select("term").distinct()
    per_term = stored(words.join(wanted, F.col("own") == F.col("term"), "left_semi"), f"{scratch}/terms")
    scored = pairs.join(per_value, "value").join(per_term, F.col("term") == F.col("own"))
    share = F.log(F.lit(float(total)) * F.col("n_both") / (F.col("n_term") * F.col("n_value"))) / F.log(F.lit(float(total)) / F.col("n_value"))
    scored = scored.where(F.col("n_value") < total).withColumn("share", share).where(F.col("share") >= GENERALISE)
    scored = scored.select(F.col("value").alias("v"), "term", F.when(F.col("share") >= REMOVE, "removed").otherwise("term").alias("action"))
    shown = holders.join(scored, F.col("value") == F.col("v")).groupBy("doc_id", "text_hash", "term").agg(F.min("action").alias("action"))
    shown = stored(shown, f"{scratch}/shown")
    freed(spark, *(f"{scratch}/{name}" for name in ("mentions", "values", "pairs", "terms")))
    return shown


def _added(held: DataFrame, shown: DataFrame) -> DataFrame:
    """(doc_id, text_hash, added): the disclosing terms' spans that meet no base span, sorted by kind, then start.

    A row a word, joined with the document's terms; base spans come along, and running ends tell what they cover, so that no
    word is compared with all spans or terms.
    """
    keys = shown.select(F.col("doc_id").alias("t_id"), F.col("text_hash").alias("t_hash")).distinct()
    # Only texts that have such terms go on, dealt by document: those of one file of few bytes are many words.
    held = held.join(keys, F.col("doc_id").eqNullSafe(F.col("t_id")) & (F.col("text_hash") == F.col("t_hash")), "left_semi").repartition("doc_id", "text_hash")
    words = held.select("doc_id", "text_hash", F.explode(located(F.col("text"), r"\p{L}++")).alias("s"))
    same = F.col("doc_id").eqNullSafe(F.col("t_id")) & (F.col("text_hash") == F.col("t_hash")) & (F.lower("s.value") == F.col("term"))
    words = words.join(shown.select(F.col("doc_id").alias("t_id"), F.col("text_hash").alias("t_hash"), "term", "action"), same)
    words = words.select("doc_id", "text_hash", F.col("action").alias("kind"), "s.start", "s.end", "s.value", F.lit(False).alias("is_base"))
    base = held.select("doc_id", "text_hash", F.explode("spans").alias("s")).select("doc_id", "text_hash", "s.kind", "s.start", "s.end", "s.value", F.lit(True).alias("is_base"))
    order = Window.partitionBy("doc_id", "text_hash").orderBy("start", F.desc("is_base"))
    before = F.max(F.when(F.col("is_base"), F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    back = Window.partitionBy("doc_id", "text_hash").orderBy(F.desc("start"), "is_base")
    behind = F.min(F.when(F.col("is_base"), F.col("start"))).over(back.rowsBetween(Window.unboundedPreceding, -1))
    rows = words.unionByName(base).withColumn("before", before).withColumn("behind", behind)
    rows = rows.where(~F.col("is_base") & (F.coalesce("before", F.lit(0)) <= F.col("start")) & (F.coalesce("behind", F.col("end")) >= F.col("end")))
    return rows.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end", "value"))).alias("added"))


def spans(docs: DataFrame, scratch: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, base, added): base spans (kind, start, end, value) and those of disclosing terms, by kind, then start.

    Repeated rows are worked on once and returned as often as they come. Null and empty texts have no spans; null ids are
    an id like others. Columns of other names are left out. An empty table gives no rows. Texts travel only where they hold a value.
    """
    found, added = _found(docs, scratch, doc_id, text)
    out = found.select("doc_id", "text_hash", "spans", "n_rows").join(added.select(F.col("doc_id").alias("p_id"), F.col("text_hash").alias("p_hash"), "added"), F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("text_hash") == F.col("p_hash")), "left")
    out = out.select("doc_id", "text_hash", F.col("spans").alias("base"), F.coalesce("added", F.array().cast(_SPAN)).alias("added"), "n_rows")
    return copies(out, "n_rows")


def _found(docs: DataFrame, scratch: str, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    rows = _keyed(docs, doc_id, text)
    base = rows.withColumn("spans", base_spans(F.col("text"))).withColumn("text", F.when(F.size("spans") > 0, F.col("text")))
    base = base.groupBy("doc_id", "text_hash").agg(F.first("spans").alias("spans"), F.first("text").alias("text"), F.count("*").alias("n_rows"))
    base = stored(base, f"{scratch}/base")
    shown = disclosing_terms(base, rows, scratch)
    return base, stored(_added(base.where(F.size("spans") > 0), shown), f"{scratch}/added")


def listed(spans: Column | str) -> Column:
    """kind:start:end of each span, comma-joined, in the order given."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitised(docs: DataFrame, scratch: str, doc_id: str = "doc_id", text: str = "text", n_chars: str | None = None) -> DataFrame:
    """`docs` with spans replaced by their labels (`LABELS`); all other columns and rows stay as they are, repeated ones too.

    Of overlapping spans the first to start, by order of kinds, gives the label for their union. With `n_chars`, that column
    is set to the new text's length. Null texts stay null (their n_chars is null), empty ones empty; an empty table gives no rows.

    Only documents that hold a value are joined with their spans; the others pass by without a shuffle.
    """
    spark = docs.sparkSession
    found, added = _found(docs, scratch, doc_id, text)
    found = found.where(F.size("spans") > 0).select("doc_id", "text_hash", "spans")
    found = found.join(added.select(F.col("doc_id").alias("p_id"), F.col("text_hash").alias("p_hash"), "added"), F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("text_hash") == F.col("p_hash")), "left")
    every = F.concat("spans", F.coalesce("added", F.array().cast(_SPAN)))
    every = F.array_sort(F.transform(every, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    found = stored(found.select(F.col("doc_id").alias("__p_id"), F.col("text_hash").alias("__p_hash"), every.alias("__spans")), f"{scratch}/spans")
    freed(spark, *(f"{scratch}/{name}" for name in ("base", "shown", "added")))
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    holds = F.size(base_spans(body)) > 0
    same = F.col(doc_id).eqNullSafe(F.col("__p_id")) & (F.xxhash64(body) == F.col("__p_hash"))
    held = docs.where(holds).join(found, same, "left")

    def joined(done: Column, s: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))
        return F.when((F.size(done) > 0) & (s["start"] < last["end"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(s)))

    def piece(s: Column, i: Column) -> Column:
        label = F.lit("")
        for kind, value in LABELS.items():
            label = F.when(s["kind"] == kind, F.lit(value)).otherwise(label)
        at = F.coalesce(F.get("__spans", i - 1)["end"], F.lit(0))
        return F.concat(F.substr(F.col(text), at + 1, s["start"] - at), label)

    held = held.withColumn("__spans", F.aggregate("__spans", F.array().cast("array<struct<start:int,end:int,kind:string>>"), joined))
    rest = F.substr(F.col(text), F.coalesce(F.get("__spans", F.size("__spans") - 1)["end"], F.lit(0)) + 1, F.length(F.col(text)))
    held = held.withColumn(text, F.concat(F.array_join(F.transform("__spans", piece), ""), rest))

    def measured(df: DataFrame) -> DataFrame:
        df = df.withColumn(n_chars, F.length(text).cast(docs.schema[n_chars].dataType)) if n_chars else df
        return df.select(docs.columns)

    return measured(docs.where(~holds)).union(measured(held))
