"""Offsets, contexts, chunks and other expressions on texts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..config import CONTEXT_SHOWN

MATCH = "array<struct<start:int,end:int,value:string>>"


#: Matches in one block: arrays grow by copying, so a long text's matches are placed block by block.
BLOCK = 512


def located(text: Column, pattern: str | Column) -> Column:
    """(start, end, value) of a pattern's leftmost non-overlapping matches, in code points; the pattern never matches nothing.

    A text without any match is scanned once and not split.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    values = F.array(F.regexp_extract_all(text, pattern, F.lit(0)))
    found = F.transform(values, lambda v: F.when(F.size(v) > 0, placed(text, pattern, v)))
    return F.coalesce(F.get(found, F.lit(0)), F.array().cast(MATCH))


def placed(text: Column, pattern: Column, values: Column) -> Column:
    """(start, end, value) of the matches `values` of a pattern, one at least.

    The same pattern splits off what lies between the matches, and running sums of lengths give exact places: over blocks
    of `BLOCK` matches first, then within each, so that the cost stays in proportion to the text.
    """
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), values.alias("value"))

    def moved(at: Column, x: Column) -> Column:
        return at + F.length(x["gap"]) + F.coalesce(F.length(x["value"]), F.lit(0))

    def cut(pairs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.size(pairs) - 1, F.lit(BLOCK)), lambda i: F.slice(pairs, i + 1, F.lit(BLOCK)))
        return F.transform(blocks, lambda b: F.struct(b.alias("block"), F.aggregate(b, F.lit(0), moved).alias("size")))

    def begun(acc: Column, b: Column) -> Column:
        return F.struct((acc["at"] + b["size"]).alias("at"), F.concat(acc["done"], F.array(F.struct(acc["at"].alias("at"), b["block"].alias("block")))).alias("done"))

    def within(b: Column) -> Column:
        start = F.struct(b["at"].alias("at"), F.array().cast(MATCH).alias("done"))

        def step(acc: Column, x: Column) -> Column:
            first = acc["at"] + F.length(x["gap"])
            end = first + F.length(x["value"])
            own = F.struct(first.alias("start"), end.alias("end"), x["value"].alias("value"))
            return F.when(x["value"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.concat(acc["done"], F.array(own)).alias("done")))

        return F.aggregate(b["block"], start, step, lambda acc: acc["done"])

    none = F.array().cast("array<struct<at:int,block:array<struct<gap:string,value:string>>>>")
    blocks = F.get(F.transform(F.array(pairs), cut), F.lit(0))  # binds the pairs: else each block would scan the text anew
    blocks = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), none.alias("done")), begun, lambda acc: acc["done"])
    return F.flatten(F.transform(blocks, within))


#: Sizes in one block of running sums, and how many times blocks are put into blocks: adding to a small array is cheap.
SUMS, LEVELS = 24, 3


def starts(sizes: Column, levels: int = LEVELS) -> Column:
    """Running sums of an array of sizes, each without its own: over blocks first (and blocks of these), then within each, so that the cost stays in proportion."""

    def fold(at: Column, own: Column) -> Column:
        zero = F.struct(at.alias("at"), F.array().cast("array<int>").alias("done"))
        return F.aggregate(own, zero, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["done"], F.array(acc["at"])).alias("done")), lambda acc: acc["done"])

    def cut(own: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(own) - 1, F.lit(SUMS)), lambda i: F.slice(own, i + 1, F.lit(SUMS)))

    def placed(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda acc, n: acc + n))
        return F.flatten(F.zip_with(blocks, starts(sums, levels - 1), lambda b, at: fold(at, b)))

    if levels == 1:
        return fold(F.lit(0), sizes)
    return F.get(F.transform(F.array(sizes), lambda own: F.when(F.size(own) > 0, F.get(F.transform(F.transform(F.array(own), cut), placed), F.lit(0))).otherwise(F.array().cast("array<int>"))), F.lit(0))


def find_all(text: Column, needle: str) -> Column:
    """Places of a literal, whatever its case."""
    quoted = "\\E\\\\E\\Q".join(needle.split("\\E"))
    return located(text, f"(?iu)\\Q{quoted}\\E")


def utf16_index(text: Column, at: Column) -> Column:
    """The place in UTF-16 units of a place in code points."""
    return (F.octet_length(F.encode(F.substr(text, F.lit(1), at), "UTF-16LE")) / 2).cast("int")


def near(text: Column, start: Column, end: Column, window: Column) -> Column:
    """The text from `window` characters before a match to as many behind it."""
    a = F.greatest(start - window, F.lit(0))
    return F.substr(text, a + 1, end + window - a)


def context(text: Column, start: Column, end: Column, window: int = CONTEXT_SHOWN) -> Column:
    """The surroundings of a match, with dots where the text goes on."""
    n = F.length(text)
    return F.concat(F.when(start - window > 0, "...").otherwise(""), near(text, start, end, F.lit(window)), F.when(end + window < n, "...").otherwise(""))


def has_keyword(surroundings: Column, keywords: Column) -> Column:
    """Whether any keyword occurs within, as part of a word or not, in any case."""
    low = F.lower(surroundings)
    return F.exists(keywords, lambda k: F.contains(low, k))


def chunks(text: Column, size: int = 2000, overlap: int = 200) -> Column:
    """(text, offset) of pieces of `size` characters that overlap; a last piece within the overlap isn't made."""
    n = F.length(text)
    starts = F.when(n <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n - overlap - 1, F.lit(size - overlap)))
    return F.transform(starts, lambda s: F.struct(F.substr(text, s + 1, F.when(n <= size, n).otherwise(F.lit(size))).alias("text"), s.alias("offset")))


def output_name(name: Column, suffix: str = "-REDACTED") -> Column:
    """`suffix` before the last dot, or at the end."""
    return F.when(name.contains("."), F.regexp_replace(name, r"\.([^.]*)$", f"{suffix}.$1")).otherwise(F.concat(name, F.lit(suffix)))


def extension(name: Column) -> Column:
    return F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1))).otherwise("")


def without_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def file_size(n: Column) -> Column:
    """Bytes to GB, base 1024, two places at most."""
    step = F.when(n < 1024, 0).when(n < 1024**2, 1).when(n < 1024**3, 2).otherwise(3)
    value = F.round(n / F.pow(F.lit(1024.0), step), 2)
    shown = F.regexp_replace(F.regexp_replace(F.format_string("%.2f", value), "0+$", ""), r"\.$", "")
    return F.when(n == 0, "0 Bytes").otherwise(F.concat_ws(" ", shown, F.element_at(F.array(*map(F.lit, ("Bytes", "KB", "MB", "GB"))), step + 1)))


def search_variants(needle: str) -> list[str]:
    """What else to look for where a text with line breaks isn't found: hyphens rejoined, or breaks taken out."""
    return [needle, *dict.fromkeys([needle.replace("-\n", "\n"), needle.replace("-\n", ""), needle.replace("\n", "")])] if "\n" in needle else [needle]


def iso_date(value: Column) -> Column:
    """ISO form of a document date: `D:YYYYMMDDHHmmSS` with an optional zone, or a W3C date; null where it is neither."""
    parts = [F.regexp_extract(value, r"^(?:D:)?(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{2})?(Z|[+-]\d{2}'?\d{0,2}'?)?$", i) for i in range(1, 8)]
    filled = [F.when(p == "", F.lit(d)).otherwise(p) for p, d in zip(parts[:6], ("", "01", "01", "00", "00", "00"), strict=True)]
    zone = F.when(parts[6].isin("", "Z"), "Z").otherwise(F.concat(F.substring(parts[6], 1, 3), F.lit(":"), F.rpad(F.regexp_replace(F.substr(parts[6], F.lit(4)), "'", ""), 2, "0")))
    built = F.concat(filled[0], F.lit("-"), filled[1], F.lit("-"), filled[2], F.lit("T"), filled[3], F.lit(":"), filled[4], F.lit(":"), filled[5], zone)
    given = F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}(:\d{2})?(\.\d+)?(Z|[+-]\d{2}:\d{2})?)?$"), value)
    out = F.when(parts[0] != "", built).otherwise(given)
    return F.when(F.try_to_timestamp(out).isNotNull(), out)
