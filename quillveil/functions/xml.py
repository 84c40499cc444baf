"""XML as a stream of events in columns, and the form of it that the expressions on Word parts read.

A token is a comment, a CDATA section, an instruction, a declaration or a tag; what stands between two is text. Quoted attribute values
may hold any character, `>` too.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The namespaces of word processing, and the prefix by which they go here.
_MAIN = r"http://schemas\.openxmlformats\.org/wordprocessingml/2006/main|http://purl\.oclc\.org/ooxml/wordprocessingml/main"
PREFIX = "w"

TOKEN = r"""(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<[!/A-Za-z_](?:[^<>"']++|"[^"]*+"|'[^']*+')*+>"""
_BINDING = rf"""xmlns(?::([\w.-]+))?\s*=\s*["'](?:{_MAIN})["']"""
#: A value that holds the end of a tag.
_OPEN_VALUE = r"""<[A-Za-z_][^<>"']*+(?:"[^"<>]*+"[^<>"']*+|'[^'<>]*+'[^<>"']*+)*+(?:"[^"<>]*>[^"<]*"|'[^'<>]*>[^'<]*')"""


def escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def bound(value: Column, to) -> Column:
    """to(value), with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), to), F.lit(0))


def tokens(part: Column) -> Column:
    """(text, token): the text before each token and the token itself, null behind the last."""
    return F.arrays_zip(F.split(part, TOKEN, -1).alias("text"), F.regexp_extract_all(part, F.lit(TOKEN), F.lit(0)).alias("token"))


def kind(token: Column) -> Column:
    return (
        F.when(token.isNull(), None).when(token.startswith("<!--"), "comment").when(token.startswith("<![CDATA["), "cdata").when(token.startswith("<?"), "instruction")
        .when(token.startswith("<!"), "declaration").when(token.startswith("</"), "close").when(token.endswith("/>"), "empty").otherwise("open")
    )


def name(token: Column) -> Column:
    """A tag's name with its prefix."""
    return F.regexp_extract(token, r"^</?([^\s/>]+)", 1)


def attributes(token: Column) -> Column:
    """A tag's attributes by name, their values as written."""
    found = F.regexp_extract_all(token, F.lit(r"""\s([^\s=<>"'/]+\s*=\s*(?:"[^"]*"|'[^']*'))"""), F.lit(1))
    pair = lambda a: F.struct(F.trim(F.substring_index(a, "=", 1)).alias("key"), F.regexp_extract(a, r"""(?s)=\s*["'](.*)["']$""", 1).alias("value"))
    return F.map_from_entries(F.aggregate(F.transform(found, pair), F.array().cast("array<struct<key:string,value:string>>"), lambda done, x: F.when(F.exists(done, lambda y: y["key"] == x["key"]), done).otherwise(F.concat(done, F.array(x)))))


def events(part: Column) -> Column:
    """(kind, name, attributes, depth, text) of a part's tokens and texts in order; depth counts the elements around.

    Comments are left out; CDATA sections are texts. Made for parts of bounded size: one array a part.
    """
    value = "struct<kind:string,name:string,attributes:map<string,string>,depth:int,text:string>"
    event = lambda k, n, a, d, t: F.struct(k.alias("kind"), n.alias("name"), a.alias("attributes"), d.alias("depth"), t.alias("text")).cast(value)
    none, bare = F.lit(None).cast("string"), F.lit(None).cast("map<string,string>")

    def step(acc: Column, p: Column) -> Column:
        k, depth = kind(p["token"]), acc["depth"]
        inner = F.regexp_extract(p["token"], r"(?s)^<!\[CDATA\[(.*)\]\]>$", 1)
        said = F.concat(F.when(p["text"] != "", F.array(event(F.lit("text"), none, bare, depth, p["text"]))).otherwise(F.array().cast(f"array<{value}>")), F.when((k == "cdata") & (inner != ""), F.array(event(F.lit("text"), none, bare, depth, escaped(inner)))).otherwise(F.array().cast(f"array<{value}>")))
        own = F.when(k.isin("open", "empty"), F.array(event(k, name(p["token"]), attributes(p["token"]), depth, none))).when(k == "close", F.array(event(k, name(p["token"]), bare, depth - 1, none))).otherwise(F.array().cast(f"array<{value}>"))
        moved = F.when(k == "open", 1).when(k == "close", -1).otherwise(0)
        return F.struct((depth + moved).alias("depth"), F.concat(acc["done"], said, own).alias("done"))

    start = F.struct(F.lit(0).alias("depth"), F.array().cast(f"array<{value}>").alias("done"))
    return F.aggregate(tokens(part), start, step, lambda acc: acc["done"])


def prefixes(part: Column) -> Column:
    """The prefixes that stand for word processing in a part; the empty one is the default namespace. Bindings count for the whole part."""
    return F.array_distinct(F.regexp_extract_all(part, F.lit(_BINDING), F.lit(1)))


def _cleaned(text: Column) -> Column:
    """Without comments, CDATA as text, and `>` only where tags end."""

    def shown(t: Column) -> Column:
        tag = F.concat(F.replace(F.substr(t, F.lit(1), F.length(t) - 1), F.lit(">"), F.lit("&gt;")), F.lit(">"))
        return F.when(t.isNull() | t.startswith("<!--"), "").when(t.startswith("<![CDATA["), escaped(F.substr(t, F.lit(10), F.length(t) - 12))).when(t.startswith("<?") | t.startswith("<!"), t).otherwise(tag)

    return F.array_join(F.transform(tokens(text), lambda p: F.concat(F.replace(p["text"], F.lit(">"), F.lit("&gt;")), shown(p["token"]))), "")


def _renamed(text: Column, ps: Column) -> Column:
    """Elements and attributes of the prefixes `ps` (the empty one: elements without any) under `PREFIX`; what had that name before goes by `w0`."""
    inside = r"""(?=[\w.-]+\s*=\s*["'][^<>]*+>)"""
    taken = ~F.array_contains(ps, PREFIX)
    for old, new in ((rf"(</?){PREFIX}:", f"$1{PREFIX}0:"), (rf"(\s){PREFIX}:{inside}", f"$1{PREFIX}0:"), (rf"""(\s)xmlns:{PREFIX}(\s*=)""", f"$1xmlns:{PREFIX}0$2")):
        text = F.regexp_replace(text, F.when(taken, old).otherwise("(?!)()()"), F.lit(new))
    # `others` names no prefix where there is none.
    others = F.concat_ws("|", F.lit("(?!)"), F.array_join(F.filter(ps, lambda p: (p != "") & (p != PREFIX)), "|"))
    text = F.regexp_replace(text, F.concat(F.lit("(</?)(?:"), others, F.lit("):")), F.lit(f"$1{PREFIX}:"))
    text = F.regexp_replace(text, F.concat(F.lit(r"(\s)(?:"), others, F.lit(f"):{inside}")), F.lit(f"$1{PREFIX}:"))
    text = F.regexp_replace(text, F.when(F.array_contains(ps, ""), r"(</?)(?=[A-Za-z_][\w.-]*+[\s/>])").otherwise("(?!)()"), F.lit(f"$1{PREFIX}:"))
    text = F.regexp_replace(text, rf"""xmlns(?::(?!{PREFIX}\b)[\w.-]+)?(\s*=\s*["'](?:{_MAIN})["'])""", f"xmlns:{PREFIX}$1")
    # Two names for one namespace are one now.
    return F.regexp_replace(text, rf"""(xmlns:{PREFIX}\s*=\s*["'](?:{_MAIN})["'])([^<>]*?)\s+xmlns:{PREFIX}\s*=\s*["'](?:{_MAIN})["']""", "$1$2")


def normalised(part: Column) -> Column:
    """A part without comments, with CDATA as text, no `>` in values, and word processing under the prefix `w`, whatever the part calls it.

    A part that is so already comes back as it is. If `w` means something else there, that goes by `w0`.
    """
    unclean = lambda text: text.contains("<!--") | text.contains("<![CDATA[") | text.rlike(_OPEN_VALUE)
    clean = bound(part, lambda text: F.when(unclean(text), _cleaned(text)).otherwise(text))
    return bound(clean, lambda text: bound(prefixes(text), lambda ps: F.when(F.exists(ps, lambda p: p != PREFIX), _renamed(text, ps)).otherwise(text)))
