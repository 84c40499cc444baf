"""Words given by users, as patterns that allow for line breaks and for each script's marks."""

from __future__ import annotations

import re
import time
import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, functions as F

from .patterns import B, WS, Pattern


@dataclass(frozen=True)
class Word:
    word: str
    case_sensitive: bool = False
    whole_word: bool = True
    id: str = field(default_factory=lambda: uuid.uuid4().hex)
    created_at: int = field(default_factory=lambda: int(time.time() * 1000))

    def __post_init__(self):
        if not self.word.strip():
            raise ValueError("an empty word would match everywhere")


# The ranges that decide a word's script, the first to occur in this order, and marks allowed in gaps.
_SCRIPTS = (
    ("cjk", "一-鿿"), ("cjk", "぀-ヿ"), ("hangul", "가-힯ᄀ-ᇿ"), ("arabic", "؀-ۿݐ-ݿࢠ-ࣿﭐ-﷿ﹰ-﻿"),
    ("hebrew", "֐-׿"), ("devanagari", "ऀ-ॿ"), ("thai", "฀-๿"), ("thai", "຀-໿"), ("cyrillic", "Ѐ-ӿ"),
)
_MARKS = {"arabic": r"\x{64B}-\x{65F}\x{670}", "hebrew": r"\x{591}-\x{5C7}", "devanagari": r"\x{900}-\x{903}\x{93A}-\x{94F}\x{951}-\x{957}\x{962}-\x{963}", "thai": r"\x{E31}\x{E34}-\x{E3A}\x{E47}-\x{E4E}"}

_BEFORE, _AFTER = rf"(?:^|(?<=[{WS}\p{{P}}]))", rf"(?:\z|(?=[{WS}\p{{P}}]))"


def script(word: str) -> str:
    return next((name for name, chars in _SCRIPTS if re.search(f"[{chars}]", word)), "latin")


def regex(word: Word) -> str:
    """The characters in turn, between them gaps of blanks (and marks) with one line break at most."""
    kind = script(word.word)
    gap = f"[{_MARKS.get(kind, '')} \\t]*"
    body = f"{gap}\\n?{gap}".join(re.sub(r"([^\w\s])", r"\\\1", c) if ord(c) < 128 else c for c in word.word)
    if word.whole_word:
        before, after = _BEFORE, _AFTER
        if kind == "latin":
            ascii_word = re.compile("[A-Za-z0-9_]")
            before = B if ascii_word.match(word.word[0]) else before
            after = B if ascii_word.match(word.word[-1]) else after
        body = before + body + after
    return body if word.case_sensitive else f"(?iu){body}"


#: What stands in gaps: blanks, and the marks of all scripts.
BLANK = r" \t\n" + "".join(_MARKS.values())


def compacted(text: Column) -> Column:
    """A text without what may stand in gaps, case folded: if a word matches a text, its compact form is within that of the text."""
    bare = F.regexp_replace(text, f"[{BLANK}]+", "")
    # Upper case first: several small letters share one. Capital I with a dot folds to i alone, the final sigma to the other one, as in the patterns.
    return F.translate(F.lower(F.translate(F.upper(bare), "\u0130", "i")), "\u03c2", "\u03c3")


def script_column(word: str) -> Column:
    """What `script` says, for a column."""
    return F.coalesce(*(F.when(F.col(word).rlike(f"[{chars}]"), name) for name, chars in _SCRIPTS), F.lit("latin"))


def regex_column(word: str, case_sensitive: str, whole_word: str) -> Column:
    """What `regex` says, for columns of a table."""
    w = F.col(word)
    of_script = lambda values, default: F.coalesce(*(F.when(w.rlike(f"[{chars}]"), F.lit(values.get(name, default))) for name, chars in _SCRIPTS), F.lit(values.get("latin", default)))
    gap = F.concat(F.lit("["), of_script(_MARKS, ""), F.lit(" \\t]*"))
    escaped = lambda c: F.when(c.rlike(r"^[\x00-\x7F]$") & ~c.rlike(r"^[\w\s]$"), F.concat(F.lit("\\"), c)).otherwise(c)
    body = F.call_function("array_join", F.transform(F.regexp_extract_all(w, F.lit("(?s)."), F.lit(0)), escaped), F.concat(gap, F.lit("\\n?"), gap))
    latin = of_script({"latin": True}, False)
    before = F.when(latin & w.rlike("^[A-Za-z0-9_]"), B).otherwise(_BEFORE)
    after = F.when(latin & w.rlike(r"[A-Za-z0-9_]\z"), B).otherwise(_AFTER)
    body = F.when(F.col(whole_word), F.concat(before, body, after)).otherwise(body)
    return F.when(F.col(case_sensitive), body).otherwise(F.concat(F.lit("(?iu)"), body))


def as_pattern(word: Word) -> Pattern:
    return Pattern(f"Predefined: {word.word}", "CUSTOM", regex(word), 1.0)


def add(words: list[Word], new: Word) -> list[Word]:
    """A word with the same text, case and whole-word setting as one in the list is refused."""
    key = lambda w: (w.word, w.case_sensitive, w.whole_word)
    if key(new) in set(map(key, words)):
        raise ValueError("the word is in the list already")
    return [*words, new]


def update(words: list[Word], word_id: str, **changes) -> list[Word]:
    return [replace(w, **changes) if w.id == word_id else w for w in words]


def delete(words: list[Word], *word_ids: str) -> list[Word]:
    return [w for w in words if w.id not in word_ids]
