"""Detection for users of SQL: functions of the session, and patterns of their own with named checks.

`register(spark)` makes two functions: `find_entities(text)`, an array within the row, and `entities_in(text)`, a table to join
laterally: `SELECT d.doc_id, e.* FROM documents d, LATERAL entities_in(d.text) e`. Both are SQL through and through, so Spark plans them with the
rest of a query; they find what `operators.detect.detect(use_scripts=False)` finds.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import SparkSession

from .config import CONTEXT_SHOWN, TYPES
from .functions.patterns import CATALOGUE, Pattern

_ROW = "pattern_ordinal INT, pattern_name STRING, entity_type STRING, text STRING, text_index INT, confidence DOUBLE, context_text STRING"
_ENTITY = "STRUCT<" + _ROW.replace(" INT", ": INT").replace(" STRING", ": STRING").replace(" DOUBLE", ": DOUBLE") + ">"
_FOUND = "ARRAY<STRUCT<start: INT, end: INT, value: STRING>>"
_DIGITS = "regexp_replace({v}, '[^0-9]', '')"
_AREA = f"substring({_DIGITS}, if(length({_DIGITS}) = 11, 2, 1), 3)"
#: The checks of `functions.validators`, as conditions on a value {v}.
CHECKS = {
    "luhn": f"(length({_DIGITS}) BETWEEN 13 AND 19 AND luhn_check({_DIGITS}))",
    "ssn": f"(length({_DIGITS}) = 9 AND substring({_DIGITS}, 1, 3) NOT IN ('000', '666') AND substring({_DIGITS}, 4, 2) <> '00' AND substring({_DIGITS}, 6, 4) <> '0000')",
    "us_phone": f"(length({_DIGITS}) IN (10, 11) AND substring({_AREA}, 1, 1) NOT IN ('0', '1') AND NOT ({_AREA} = '555' AND substring({_DIGITS}, if(length({_DIGITS}) = 11, 5, 4), 1) = '1'))",
    "international_phone": f"(length({_DIGITS}) BETWEEN 8 AND 15)",
    "china_mobile": f"rlike({_DIGITS}, '^1(3[0-9]|4[5-9]|5[0-35-9]|6[2567]|7[0-8]|8[0-9]|9[0-35-9])[0-9]{{{{8}}}}$')",
    "chinese_id": "if(rlike(upper(trim({v})), '^[0-9]{{17}}[0-9X]$'), cast(substring({v}, 7, 4) AS INT) BETWEEN 1900 AND 2100 AND cast(substring({v}, 11, 2) AS INT) BETWEEN 1 AND 12 AND cast(substring({v}, 13, 2) AS INT) BETWEEN 1 AND 31"
    " AND substring(upper({v}), 18, 1) = substring('10X98765432', aggregate(sequence(1, 17), 0, (acc, i) -> acc + cast(substring({v}, i, 1) AS INT) * (cast(power(2, 18 - i) AS INT) % 11)) % 11 + 1, 1), false)",
}


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _scan(ordinal: int, p: Pattern) -> str:
    """A pattern, and what it finds in `text`."""
    keywords = f"array({', '.join(map(quoted, p.keywords))})" if p.keywords else "cast(array() AS ARRAY<STRING>)"
    gate = f"rlike(text, {quoted(p.needs)})" if p.needs else "true"
    return f"named_struct('ordinal', {ordinal}, 'name', {quoted(p.name)}, 'type', {quoted(p.type)}, 'regex', {quoted(p.regex)}, 'check', {quoted(p.validator or '')}, 'sure', {float(p.confidence)!r}D, 'boost', {float(p.boost)!r}D, 'size', {p.window}, 'keywords', {keywords}, 'values', if({gate}, regexp_extract_all(text, {quoted(p.regex)}, 0), NULL))"


def _entities(checks: Sequence[str]) -> str:
    """The entities of one scan `s` that found something, whatever its pattern: one expression, since each task reads and compiles what it runs."""
    step = "named_struct('at', acc.at + length(x.gap) + length(x.value), 'done', concat(acc.done, array(named_struct('start', acc.at + length(x.gap), 'end', acc.at + length(x.gap) + length(x.value), 'value', x.value))))"
    found = f"aggregate(zip_with(split(text, s.regex, -1), s.values, (g, v) -> named_struct('gap', g, 'value', v)), named_struct('at', 0, 'done', cast(array() AS {_FOUND})), (acc, x) -> if(x.value IS NULL, acc, {step}), acc -> acc.done)"
    if checks:
        found = f"filter({found}, m -> CASE s.check {' '.join(f'WHEN {quoted(c)} THEN ' + CHECKS[c].format(v='m.value') for c in checks)} ELSE true END)"
    near = lambda w: f"substring(text, greatest(m.start - {w}, 0) + 1, m.end + {w} - greatest(m.start - {w}, 0))"
    boost = f"if(exists(s.keywords, k -> contains(lower({near('s.size')}), k)), s.boost, 1.0D)"
    context = f"concat(if(m.start - {CONTEXT_SHOWN} > 0, '...', ''), {near(CONTEXT_SHOWN)}, if(m.end + {CONTEXT_SHOWN} < length(text), '...', ''))"
    row = f"named_struct('pattern_ordinal', s.ordinal, 'pattern_name', s.name, 'entity_type', s.type, 'text', m.value, 'text_index', m.start, 'confidence', least(1.0D, s.sure * {boost}), 'context_text', {context})"
    return f"transform({found}, m -> {row})"


def entities_sql(patterns: Sequence[Pattern] = CATALOGUE) -> str:
    """All entities of `text` by pattern, then place, as one expression; null where the text is."""
    scans = f"filter(array({', '.join(_scan(i, p) for i, p in enumerate(patterns))}), s -> size(s.values) > 0)"
    return f"if(text IS NULL, NULL, cast(flatten(transform({scans}, s -> {_entities(sorted({p.validator for p in patterns if p.validator}))})) AS ARRAY<{_ENTITY}>))"


def register(spark: SparkSession, patterns: Sequence[Pattern] = CATALOGUE, array: str = "find_entities", table: str = "entities_in") -> None:
    """Make both functions known to the session, for these patterns."""
    body = entities_sql(patterns)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {array}(text STRING) RETURNS ARRAY<{_ENTITY}> RETURN {body}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {table}(text STRING) RETURNS TABLE({_ROW}) RETURN SELECT inline({body})")


def _fault(spark: SparkSession, e: dict) -> str | None:
    jvm = spark.sparkContext._jvm
    if not isinstance(e, dict) or not e.get("pattern") or not isinstance(e["pattern"], str):
        return "no pattern"
    try:
        compiled = jvm.java.util.regex.Pattern.compile(e["pattern"])
    except Exception as x:
        return f"not a pattern: {str(getattr(x, 'java_exception', x)).splitlines()[0]}"
    if compiled.matcher("").find():
        return "it matches nothing at all"
    if e.get("entityType", "CUSTOM") not in TYPES:
        return f"no entity type {e['entityType']}"
    sure = e.get("confidence", 1.0)
    if isinstance(sure, bool) or not isinstance(sure, (int, float)) or not 0 <= sure <= 1:
        return "a confidence is from 0 to 1"
    if e.get("validator") is not None and e["validator"] not in CHECKS:
        return f"no check {e['validator']}"
    missed = [x for x in e.get("examples") or [] if not compiled.matcher(x).find()]
    return f"it misses its example {missed[0]!r}" if missed else None


def custom_patterns(spark: SparkSession, entries: str | Sequence[dict]) -> tuple[list[Pattern], list[str]]:
    """Users' patterns (JSON or what it stands for: pattern, and perhaps id, name, entityType, confidence, validator, contextKeywords, contextWindowSize, confidenceBoost, examples) and what is wrong with the others.

    A pattern must compile, match something, find its own examples and name a known type and check. Names and patterns that come again are refused.
    """
    try:
        listed = json.loads(entries) if isinstance(entries, str) else list(entries)
    except ValueError as e:
        return [], [f"not JSON: {e}"]
    good, errors, seen = [], [], set()
    for i, e in enumerate(listed if isinstance(listed, list) else [listed]):
        why = _fault(spark, e)
        name = (e.get("name") or e.get("id") or f"Custom {i + 1}") if isinstance(e, dict) else str(i + 1)
        if not why and {name, e["pattern"]} & seen:
            why = "it is there already"
        if why:
            errors.append(f"{name}: {why}")
            continue
        seen |= {name, e["pattern"]}
        more = {k: v for k, v in (("window", e.get("contextWindowSize")), ("boost", e.get("confidenceBoost"))) if v is not None}
        good.append(Pattern(name, e.get("entityType", "CUSTOM"), e["pattern"], float(e.get("confidence", 1.0)), e.get("validator"), (), tuple(k.lower() for k in e.get("contextKeywords") or ()), **more))
    return good, errors
