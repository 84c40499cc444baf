"""Finding, checking and scoring sensitive values in texts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..config import DetectionConfig
from ..functions import text as X
from ..functions.patterns import CATALOGUE, Pattern
from ..functions.scripts import with_scripts
from ..functions.validators import VALIDATORS
from ..functions.words import Word, as_pattern
from ..functions.xml import bound

FOUND = "array<struct<ordinal:int,start:int,end:int,value:string>>"


def catalogue(config: DetectionConfig, words: Sequence[Word] = (), patterns: Sequence[Pattern] = CATALOGUE) -> list[tuple[int, Pattern]]:
    """Ordinals and patterns to run; words follow the built-in ones."""
    listed = [*patterns, *map(as_pattern, words)]
    return list(enumerate(listed)) if config.use_regex else []


def _valid(check: Column, value: Column, names: Sequence[str]) -> Column:
    """Whether a value passes the check of that name, one of `names`; without a name it does."""
    good = F.lit(True)
    for name in names:
        good = F.when(check == name, VALIDATORS[name](value)).otherwise(good)
    return good


def matches(text: Column, scripts: Column | None, chosen: Sequence[tuple[int, Pattern]]) -> Column:
    """All valid matches of a text, by pattern, then place; `scripts` None: no pattern is left out by script.

    A pattern's scan is skipped where its scripts weren't detected or a condition that each match meets fails. What follows the scans is one
    expression for all patterns, since each task reads and compiles what it runs.
    """
    if not chosen:
        return F.array().cast(FOUND)
    scans = []
    for ordinal, p in chosen:
        run = F.lit(True)
        if p.scripts and scripts is not None:
            run = run & F.arrays_overlap(scripts, F.array(*map(F.lit, p.scripts)))
        if p.needs:
            run = run & text.rlike(p.needs)
        values = F.when(run, F.regexp_extract_all(text, F.lit(p.regex), F.lit(0)))
        scans.append(F.struct(F.lit(ordinal).alias("ordinal"), F.lit(p.regex).alias("regex"), F.lit(p.validator or "").alias("check"), values.alias("values")))
    names = sorted({p.validator for _, p in chosen if p.validator})

    def found(s: Column) -> Column:
        good = F.filter(X.placed(text, s["regex"], s["values"]), lambda m: _valid(s["check"], m["value"], names))
        return F.transform(good, lambda m: F.struct(s["ordinal"].alias("ordinal"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value")))

    return F.flatten(F.transform(F.filter(F.array(*scans), lambda s: F.size(s["values"]) > 0), found))


def _by_ordinal(ordinal: Column, chosen: Sequence[tuple[int, Pattern]], get, none=None) -> Column:
    """A literal of each pattern, looked up by ordinal."""
    return F.get(F.array(*(F.lit(get(p)) for _, p in chosen)), ordinal - (chosen[0][0] if chosen else 0))


def confidence_of(text: Column, ordinal: Column, start: Column, end: Column, listed: Sequence[tuple[int, Pattern]]) -> Column:
    """A match's confidence, raised where a keyword of its pattern is near."""
    keywords = F.get(F.array(*(F.array(*map(F.lit, p.keywords)).cast("array<string>") for _, p in listed)), ordinal)
    boosted = X.has_keyword(X.near(text, start, end, _by_ordinal(ordinal, listed, lambda p: p.window)), keywords)
    base = _by_ordinal(ordinal, listed, lambda p: float(p.confidence))
    return F.least(F.lit(1.0), base * F.when(boosted, _by_ordinal(ordinal, listed, lambda p: float(p.boost))).otherwise(1.0))


def entities_of(text: Column, scripts: Column, config: DetectionConfig, words: Sequence[Word] = ()) -> Column:
    """(rank, size, ordinal, start, end, label) of a text's matches that the configuration lets through, within the row."""
    listed = catalogue(config, words)
    if not listed:
        return F.array().cast("array<struct<rank:double,size:int,ordinal:int,start:int,end:int,label:string>>")

    def scored(m: Column) -> Column:
        sure = confidence_of(text, m["ordinal"], m["start"], m["end"], listed)
        return F.struct(F.negative(sure).alias("rank"), (m["start"] - m["end"]).alias("size"), m["ordinal"].alias("ordinal"), m["start"].alias("start"), m["end"].alias("end"), _by_ordinal(m["ordinal"], listed, lambda p: p.type).alias("label"))

    return F.filter(F.transform(matches(text, scripts, listed), scored), lambda s: s["label"].isin(*config.types) & (s["rank"] <= -config.threshold))


def detect(df: DataFrame, text: str = "text", config: DetectionConfig | None = None, words: Sequence[Word] = (), patterns: Sequence[Pattern] = CATALOGUE, use_scripts: bool = True, along: Callable[[Column, Column], Column] | None = None, source: str | None = None) -> DataFrame:
    """One row for each match, with the columns of `df` but the text.

    Adds pattern_ordinal, pattern_name, entity_type, text (the match), text_index, utf16_index, confidence (raised where a
    keyword is near), detection_method, status and context_text. No shuffle: works on streams as on batches. Null texts
    have no matches. `along` (match, what the column `source` holds) is worked out within the text's row and comes with each match as a column of that name;
    `source` itself, which may be large, doesn't.
    """
    config = config or DetectionConfig()
    chosen = catalogue(config, words, patterns)
    body = F.col(text)
    keep = [c for c in df.columns if c not in (text, source)]
    rows = df
    if use_scripts:
        rows = df.withColumn("__scripts", F.array(*map(F.lit, config.force_scripts))) if config.force_scripts else with_scripts(df, text, "__scripts")
    listed = [(i, p) for i, p in chosen]
    rows = rows.withColumn("__found", matches(body, F.col("__scripts") if use_scripts else None, listed))
    if along:
        rows = rows.withColumn("__found", bound(F.col(source), lambda s: F.transform("__found", lambda m: F.struct(*(m[k].alias(k) for k in ("ordinal", "start", "end", "value")), along(m, s).alias("along")))))
    # The outer form and a filter behind it: for the plain one Spark would push a copy of all scans down as a filter.
    rows = rows.select(*keep, F.col(text).alias("__text"), F.explode_outer("__found").alias("m")).where(F.col("m").isNotNull())
    if not listed:
        listed = [(0, CATALOGUE[0])]
    o = F.col("m.ordinal")
    start, end = F.col("m.start"), F.col("m.end")
    confidence = confidence_of(F.col("__text"), o, start, end, listed)
    return rows.select(
        *keep, o.alias("pattern_ordinal"), _by_ordinal(o, listed, lambda p: p.name).alias("pattern_name"), _by_ordinal(o, listed, lambda p: p.type).alias("entity_type"),
        F.col("m.value").alias("text"), start.alias("text_index"), X.utf16_index(F.col("__text"), start).alias("utf16_index"), confidence.alias("confidence"),
        F.lit("regex").alias("detection_method"), F.lit("rejected").alias("status"), X.context(F.col("__text"), start, end).alias("context_text"),
        *([F.col("m.along").alias("along")] if along else []),
    )


def detect_type(df: DataFrame, kind: str, text: str = "text") -> DataFrame:
    """Matches of one entity type's patterns, whatever the script."""
    return detect(df, text, patterns=[p for p in CATALOGUE if p.type == kind], use_scripts=False)


def find_occurrences(df: DataFrame, needle: str, kind: str = "CUSTOM", text: str = "text") -> DataFrame:
    """All places of a literal as entities with confidence 1, found by hand and not selected."""
    if not needle:
        raise ValueError("nothing to look for")
    keep = [c for c in df.columns if c != text]
    rows = df.select(*keep, F.explode_outer(X.find_all(F.col(text), needle)).alias("m")).where(F.col("m").isNotNull())
    return rows.select(*keep, F.col("m.value").alias("text"), F.col("m.start").alias("text_index"), F.lit(kind).alias("entity_type"), F.lit(1.0).alias("confidence"), F.lit("manual").alias("detection_method"), F.lit("rejected").alias("status"))


def manual(df: DataFrame, kind: str) -> DataFrame:
    """Selections made by hand: certain and confirmed."""
    return df.select("*", F.lit(kind).alias("entity_type"), F.lit(1.0).alias("confidence"), F.lit("manual").alias("detection_method"), F.lit("confirmed").alias("status"))
