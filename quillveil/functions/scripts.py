"""Which writing systems a text uses, from counts of characters in its first part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Characters that are looked at.
SAMPLE = 10_000
# Character ranges of each script, in the order that breaks ties.
RANGES = {
    "latin": r"A-Za-z\x{C0}-\x{24F}",
    "cjk": r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}",
    "japanese": r"\x{3040}-\x{309F}\x{30A0}-\x{30FF}",
    "korean": r"\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}",
    "arabic": r"\x{600}-\x{6FF}\x{750}-\x{77F}\x{8A0}-\x{8FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}",
    "hebrew": r"\x{590}-\x{5FF}",
    "devanagari": r"\x{900}-\x{97F}",
    "thai": r"\x{E00}-\x{E7F}\x{E80}-\x{EFF}",
    "cyrillic": r"\x{400}-\x{4FF}",
}
IGNORED = r"0-9\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}\p{P}"
#: Those of them that are ASCII.
PLAIN = r"0-9\t\n\x0B\f\r !\x22#%&'()*,\-./:;?@\[\x5C\]_{}"
# The share, in per cent, that a script must exceed, in order of the result.
LIMITS = (("japanese", "japanese", 5), ("korean", "korean", 30), ("chinese", "cjk", 30), ("arabic", "arabic", 30), ("hebrew", "hebrew", 30), ("devanagari", "devanagari", 30), ("thai", "thai", 30), ("cyrillic", "cyrillic", 30), ("latin", "latin", 20))
LEAST, MIXED, FALLBACK = 10, 20, 10


def script_counts(text: Column) -> Column:
    """Struct of counts: each script, and other (neither a script's nor ignored)."""
    sample = F.substring(F.coalesce(text, F.lit("")), 1, SAMPLE)
    named = "".join(RANGES.values())
    # Ranges of scripts hold a few marks of punctuation: those count for their script, so only what is in neither is other.
    # Latin letters and plain marks go run by run, and the other scripts are looked for in what is left, which is little in most texts.
    bare = F.regexp_replace(sample, f"[{RANGES['latin']}]+", "")
    rest = F.regexp_replace(bare, f"[{PLAIN}]+", "")
    counts = {k: F.length(sample) - F.length(bare) if k == "latin" else F.regexp_count(rest, F.lit(f"[{r}]")) for k, r in RANGES.items()}
    counts["other"] = F.regexp_count(rest, F.lit(f"[^{named}{IGNORED}]"))
    return F.struct(*(c.cast("long").alias(k) for k, c in counts.items()))


def scripts_of(counts: Column) -> Column:
    """Detected scripts in their fixed order; ['unknown'] for short or unclear texts."""
    share = lambda k: counts[k] * 100.0 / counts["total"]
    found = [F.when(share(source) > limit, F.lit(name)) for name, source, limit in LIMITS]
    mixed = F.when((share("cjk") > MIXED) & (share("latin") > MIXED) & ~(share("japanese") > 5) & ~(share("cjk") > 30), F.lit("cjk"))
    listed = F.array_compact(F.array(*found, mixed))
    order = [*RANGES, "other"]
    top = F.array_max(F.array(*(F.struct(share(k).alias("share"), F.lit(-i).alias("rank"), F.lit(k).alias("name")) for i, k in enumerate(order))))
    single = F.when((top["share"] > FALLBACK) & (top["name"] != "other"), F.array(top["name"])).otherwise(F.array(F.lit("unknown")))
    return F.when(counts["total"] < LEAST, F.array(F.lit("unknown"))).otherwise(F.when(F.size(listed) > 0, listed).otherwise(single))


def with_scripts(df: DataFrame, text: str, scripts: str, counts: str | None = None) -> DataFrame:
    """Add the detected scripts, and with `counts` the counts; a text's characters are counted once, in a step of their own."""
    step = counts or "__script_counts"
    df = df.withColumn(step, script_counts(F.col(text)))
    total = sum((F.col(f"{step}.{k}") for k in RANGES), F.col(f"{step}.other"))
    df = df.withColumn(step, F.struct(f"{step}.*", total.alias("total"))).withColumn(scripts, scripts_of(F.col(step)))
    return df if counts else df.drop(step)


def script_statistics(counts: Column) -> Column:
    """Shares in per cent of each script (chinese: that of cjk)."""
    share = lambda k: F.when(counts["total"] > 0, counts[k] * 100.0 / counts["total"]).otherwise(0.0)
    return F.struct(*(share(k).alias(k) for k in (*RANGES, "other")), share("cjk").alias("chinese"))
