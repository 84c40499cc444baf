"""Registered queries of pages, archives and reviews, and their equivalents in SQL.

Pages are the documents' lines laid out; boxes of entities on pages are derived from `lineitem`, one a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .config import ENTITY_TYPES, MEDIUM, TYPES
from .functions import text as X
from .functions.patterns import BY_NAME
from .operators import audit, dedupe, layout, redact, review, sanitize
from .operators.detect import find_occurrences
from .plans import analysis, pages
from .queries import DETECT_D, DETECT_R, R, _detect_sql, _matches_sql, _of_pattern, _pages, _table, documents, records
from .operators.detect import detect
from .sources import docx, pdf
from .storage import spread

PATTERNS = (BY_NAME["Email"], BY_NAME["IP Address (IPv4)"])
_KINDS = "[" + ", ".join(f"'{t}'" for t in TYPES) + "]"


# --- redaction of texts -----------------------------------------------------------------------------------------------


def _redacted_sql(detected: str, source: str, key: str) -> str:
    """Greedy choice by list_reduce: a span joins those kept if it meets none of them."""
    return f"""WITH e AS (SELECT {key}, {{'r': -confidence, 'z': -length(text), 'o': pattern_ordinal, 'a': text_index, 'b': text_index + length(text), 'l': entity_type}} AS s FROM ({detected}) WHERE confidence >= {MEDIUM}),
k AS (SELECT {key}, list_reduce(list_transform(list_sort(list(s)), lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda t: t.a < x[1].b AND x[1].a < t.b)) > 0 THEN acc ELSE list_concat(acc, x) END) AS kept FROM e GROUP BY {key}),
c AS (SELECT {key}, kept, list_sort(list_transform(kept, lambda t: {{'a': t.a, 'b': t.b, 'l': t.l}})) AS p FROM k)
SELECT d.{key}, CASE WHEN p IS NULL THEN d.text ELSE
  array_to_string(list_transform(range(1, len(p) + 1), lambda i: substr(d.text, CASE WHEN i = 1 THEN 1 ELSE p[i - 1].b + 1 END, p[i].a - CASE WHEN i = 1 THEN 0 ELSE p[i - 1].b END) || '[' || p[i].l || ']'), '') || substr(d.text, p[len(p)].b + 1) END AS redacted_text,
  coalesce(len(p), 0)::INT AS redacted_count FROM {source} d LEFT JOIN c ON c.{key} = d.{key}"""


# --- archives -----------------------------------------------------------------------------------------------------------


def _word_archives(spark, sf_dir) -> DataFrame:
    """A run a word, empty runs between, numeric references, and an image that is no text."""
    d = spread(documents(spark, sf_dir), "doc_id")
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    safe = F.transform(words, lambda w: F.replace(F.replace(F.replace(F.replace(w, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("'"), F.lit("&#39;")), F.lit("é"), F.lit("&#xE9;")))
    runs = F.array_join(F.transform(safe, lambda w: F.concat(F.lit('<w:r><w:t xml:space="preserve"/><w:t>'), w, F.lit("</w:t></w:r>"))), "")
    body = F.concat(F.lit("<w:document><w:body><w:p>"), runs, F.lit("</w:p></w:body></w:document>"))
    parts = F.create_map(
        F.lit("word/document.xml"), F.encode(body, "UTF-8"), F.lit("word/media/image1.png"), F.unhex(F.sha2(F.col("doc_id").cast("string"), 256)),
        F.lit("docProps/core.xml"), F.encode(F.lit("<cp><dc:creator>someone</dc:creator></cp>"), "UTF-8"), F.lit("word/comments.xml"), F.encode(F.lit("<w:comment >c</w:comment>"), "UTF-8"),
    )
    return d.select("doc_id", parts.alias("parts"))


def redacted_archives(spark, sf_dir):
    """Word archives written, read, redacted, sanitised, written and read once more."""
    archives = docx.entries(docx.written(_word_archives(spark, sf_dir))).drop("error")
    texts = archives.select("doc_id", docx.full_text(F.decode(F.element_at("parts", docx.DOCUMENT), "UTF-8")).alias("text"))
    found = review.set_status(find_occurrences(texts, "of the"), F.lit(True), "confirmed")
    done = redact.redact_archives(archives, found, sanitize=True)
    read = docx.entries(docx.written(done.select("doc_id", "success", "redacted_count", "parts")))
    text = docx.full_text(F.decode(F.element_at("parts", docx.DOCUMENT), "UTF-8"))
    image = F.hex(F.element_at("parts", F.lit("word/media/image1.png")))
    creator = F.element_at("parts", F.lit("docProps/core.xml")) == F.encode(F.lit(sanitize.EMPTY_CORE), "UTF-8")
    return read.select("doc_id", "success", F.col("redacted_count").cast("long"), F.sha2(text, 256).alias("sha256"), F.lower(image).alias("image"), (F.col("success") & creator).alias("anonymous"), F.size("parts").cast("long").alias("n_parts"))


ARCHIVES_SQL = r"""WITH t AS (SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''), ' ') AS t FROM documents),
n AS (SELECT *, len(regexp_extract_all(t, '(?i)of the'))::BIGINT AS n FROM t)
SELECT doc_id, n > 0 AS success, n AS redacted_count, sha256(trim(replace(regexp_replace(t, '(?i)of the', '[CUSTOM] ', 'g'), '[CUSTOM]  ', '[CUSTOM] '))) AS sha256,
  sha256(doc_id::VARCHAR) AS image, n > 0 AS anonymous, CASE WHEN n > 0 THEN 3 ELSE 4 END::BIGINT AS n_parts FROM n"""


def archive_contents(spark, sf_dir):
    """Previews, images by kind and metadata of archives with headings, bold and italic runs."""
    d = _table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    k = F.col("c_custkey")
    style = F.element_at(F.array(*map(F.lit, ("Heading1", "Heading2", "Heading3", "Title", "ListParagraph", "Normal"))), (k % 6 + 1).cast("int"))
    run = F.concat(F.lit("<w:r><w:rPr>"), F.when(k % 2 == 0, "<w:b/>").otherwise(""), F.when(k % 3 == 0, "<w:i/>").otherwise(""), F.lit("</w:rPr><w:t>"), F.col("c_name"), F.lit("</w:t></w:r>"))
    body = F.concat(F.lit('<w:p><w:pPr><w:pStyle w:val="'), style, F.lit('"/></w:pPr>'), run, F.lit("</w:p>"))
    core = F.concat(F.lit("<cp><dc:title> T"), k.cast("string"), F.lit(" </dc:title><dc:creator>"), F.col("c_name"), F.lit("</dc:creator><dc:subject></dc:subject><cp:keywords>a &amp; b</cp:keywords><dcterms:created>2020-01-02T03:04:05Z</dcterms:created></cp>"))
    suffix = F.element_at(F.array(*map(F.lit, ("png", "JPG", "bmp", "xyz"))), (k % 4 + 1).cast("int"))
    names = F.array(F.lit("word/document.xml"), F.lit("docProps/core.xml"), F.lit("docProps/app.xml"), F.concat(F.lit("word/media/image1."), suffix))
    parts = F.map_from_arrays(names, F.array(*(F.encode(c, "UTF-8") for c in (body, core, F.lit("<Application>W</Application><Company>ACME</Company>"), F.lit("image")))))
    rows = d.select("c_custkey", "c_mktsegment", parts.alias("parts"))
    images = docx.images(rows.select("c_custkey", "parts")).select(F.col("c_custkey").alias("i_key"), "mime", "image_name")
    t = docx.text_parts(F.col("parts"))
    meta = sanitize.shown_metadata(docx.metadata(F.col("t")))
    out = rows.select("c_custkey", t.alias("t")).select("c_custkey", docx.html_preview(F.element_at("t", docx.DOCUMENT)).alias("html"), F.array_join(F.array_sort(F.transform(F.map_entries(meta), lambda e: F.concat_ws("=", e["key"], e["value"]))), "|").alias("metadata"))
    return out.join(images, F.col("c_custkey") == F.col("i_key"), "left").drop("i_key")


CONTENTS_SQL = """SELECT c_custkey, '<' || tag || '>' || CASE WHEN c_custkey % 2 = 0 THEN '<strong>' ELSE '' END || CASE WHEN c_custkey % 3 = 0 THEN '<em>' ELSE '' END || c_name || CASE WHEN c_custkey % 3 = 0 THEN '</em>' ELSE '' END || CASE WHEN c_custkey % 2 = 0 THEN '</strong>' ELSE '' END || '</' || tag || '>' AS html,
  'author=' || c_name || '|company=ACME|created=2020-01-02T03:04:05Z|creator=W|keywords=a & b|title=T' || c_custkey AS metadata,
  ['image/png', 'image/jpeg', 'image/bmp', NULL][c_custkey % 4 + 1] AS mime, CASE WHEN c_custkey % 4 < 3 THEN 'image1.' || ['png', 'JPG', 'bmp', 'xyz'][c_custkey % 4 + 1] END AS image_name
FROM (SELECT *, ['h1', 'h2', 'h3', 'h1', 'li', 'p'][c_custkey % 6 + 1] AS tag FROM customer)"""


def hidden_more(spark, sf_dir):
    """Hidden content of archives with macros, embedded objects, headers and footers, by turns; and what sanitising leaves of it."""
    d = _table(spark, sf_dir, "orders").select("o_orderkey")
    k = F.col("o_orderkey")
    names = (("word/vbaProject.bin", 2), ("word/header1.xml", 3), ("word/footer1.xml", 5), ("word/embeddings/a.bin", 7), ("docProps/custom.xml", 4), ("word/settings.xml", 1))
    pick = F.array_compact(F.array(F.lit("word/document.xml"), *(F.when(k % n == 0, F.lit(name)) for name, n in names)))
    value = F.transform(pick, lambda name: F.when(name == "word/settings.xml", '<w:rsids><w:rsid w:val="1"/></w:rsids><w:zoom w:percent="100"/><w:proofState w:spelling="clean"/>').otherwise("<x/>"))
    rows = d.select("o_orderkey", F.map_from_arrays(pick, value).alias("t"))
    rows = rows.withColumn("kept", sanitize.sanitized_parts(F.col("t"))).withColumn("least", sanitize.sanitized_parts(F.col("t"), optional=True))
    kinds = lambda w: F.array_join(F.array_sort(F.transform(w, lambda x: x["type"])), ",")
    return rows.select("o_orderkey", kinds(audit.docx_warnings(F.col("t"))).alias("kinds"), F.array_join(F.array_sort(F.map_keys("kept")), ",").alias("kept"), F.array_join(F.array_sort(F.map_keys("least")), ",").alias("least"), F.element_at("kept", F.lit("word/settings.xml")).alias("settings"), audit.has_type(audit.docx_warnings(F.col("t")), "macros").alias("macros"))


HIDDEN_MORE_SQL = """SELECT o_orderkey, array_to_string(list_sort(list_filter([CASE WHEN k % 7 = 0 THEN 'embedded_objects' END, CASE WHEN k % 3 = 0 OR k % 5 = 0 THEN 'headers_footers' END, CASE WHEN k % 2 = 0 THEN 'macros' END], lambda x: x IS NOT NULL)), ',') AS kinds,
  array_to_string(list_sort(list_filter(['word/document.xml', 'word/settings.xml', CASE WHEN k % 3 = 0 THEN 'word/header1.xml' END, CASE WHEN k % 5 = 0 THEN 'word/footer1.xml' END, CASE WHEN k % 7 = 0 THEN 'word/embeddings/a.bin' END], lambda x: x IS NOT NULL)), ',') AS kept,
  'word/document.xml,word/settings.xml' AS least, '<w:zoom w:percent="100"/>' AS settings, k % 2 = 0 AS macros FROM (SELECT o_orderkey, o_orderkey AS k FROM orders)"""


# --- pages ----------------------------------------------------------------------------------------------------------------


def _form_pages(spark, sf_dir) -> DataFrame:
    """Laid-out documents with a form field each, whose value is an address."""
    k = F.col("doc_id").cast("string")
    bounds = F.struct(F.lit(1.0).alias("x"), F.lit(2.0).alias("y"), F.lit(30.0).alias("width"), F.lit(4.0).alias("height"))
    field = F.struct(F.concat(F.lit("f"), k).alias("name"), F.lit("").alias("label"), F.concat(F.lit("user"), k, F.lit("@example.com")).alias("value"), F.array(F.lit("yes"), F.lit("no")).alias("options"), bounds.alias("bounds"))
    return _pages(spark, sf_dir, dealt=True).withColumn("form_fields", F.array(field))


def _box(b) -> list:
    return [F.round(b[k], 6).alias(k) for k in ("x", "y", "width", "height")]


def page_detection(spark, sf_dir):
    """Values on pages with their boxes: of form fields, or shares of text items."""
    found = pages.detected(_form_pages(spark, sf_dir), patterns=PATTERNS, use_scripts=False)
    return found.select("doc_id", "pattern_name", "text", "text_index", "form_field_name", *_box(F.col("bbox")))


_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents"
_ITEMS = rf"""SELECT doc_id, t, i, unnest(ws) AS w, unnest(range(0, len(ws))) AS k, len(ws) AS n FROM (SELECT *, regexp_split_to_array(trim(t), '\s+') AS ws FROM ({_LINES}))"""
_PLACED = f"SELECT *, (coalesce(sum(length(w) + 1) OVER (PARTITION BY doc_id ORDER BY i, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS a FROM ({_ITEMS}) WHERE w <> ''"
_PAGE_TEXT = rf"""(SELECT doc_id, coalesce(p.t, '') || ' f' || doc_id || ' user' || doc_id || '@example.com yes no' AS text, length(coalesce(p.t, '')) AS base
  FROM documents LEFT JOIN (SELECT doc_id, string_agg(l, chr(10) ORDER BY i) AS t FROM (SELECT doc_id, i, string_agg(w, ' ' ORDER BY k) AS l FROM ({_ITEMS}) WHERE w <> '' GROUP BY doc_id, i) GROUP BY doc_id) p USING (doc_id))"""
PAGE_DETECTION_SQL = f"""WITH page AS {_PAGE_TEXT}, items AS ({_PLACED}),
m AS ({' UNION ALL '.join(f"SELECT doc_id, '{p.name}' AS pattern_name, text_index, v AS text FROM ({_matches_sql('page', 'doc_id', p)})" for p in PATTERNS)})
SELECT doc_id, pattern_name, m.text, CASE WHEN f THEN -1 ELSE text_index END::INT AS text_index, CASE WHEN f THEN 'f' || doc_id END AS form_field_name,
  round(CASE WHEN f THEN 1.0 ELSE 10 + k * (length(t) * 5.0 / n) + 5.0 * (text_index - a) - 0.5 END, 6)::DOUBLE AS x, round(CASE WHEN f THEN 2.0 ELSE 800.0 - 12.0 * i - 10.0 END, 6)::DOUBLE AS y,
  round(CASE WHEN f THEN 30.0 ELSE 5.0 * length(m.text) + 1.0 END, 6)::DOUBLE AS width, CASE WHEN f THEN 4.0 ELSE 10.0 END::DOUBLE AS height
FROM (SELECT m.*, m.text_index > page.base AND m.text_index + length(m.text) <= length(page.text) AS f FROM m JOIN page USING (doc_id)) m
LEFT JOIN items USING (doc_id) WHERE f AND items.a = 0 OR NOT f AND a <= text_index AND text_index < a + length(w)"""


def selected_texts(spark, sf_dir):
    """What stands under a box in the upper left of each page; a second box is too small to count."""
    items = layout.text_items(_pages(spark, sf_dir))
    box = lambda i, w, h: F.struct(F.lit(i).alias("box_id"), F.struct(F.lit(10.0).alias("x"), F.lit(760.0).alias("y"), F.lit(w).alias("width"), F.lit(h).alias("height")).alias("bbox"))
    boxes = documents(spark, sf_dir).select("doc_id", F.lit(1).alias("page_number"), F.explode(F.array(box(1, 60.0, 40.0), box(2, 4.0, 40.0))).alias("b")).select("doc_id", "page_number", "b.box_id", "b.bbox")
    return layout.selected_text(boxes, items).select("doc_id", "box_id", "text")


SELECTED_SQL = f"""SELECT doc_id, 1 AS box_id, string_agg(w, ' ' ORDER BY i, k) AS text FROM ({_ITEMS}) WHERE w <> '' AND 10 + k * (length(t) * 5.0 / n) <= 70
  AND 800.0 - 12.0 * i - 10.0 <= 800 AND 800.0 - 12.0 * i >= 760 AND 10 + k * (length(t) * 5.0 / n) + length(w)::DOUBLE / length(t) * (length(t) * 5.0) >= 10 GROUP BY doc_id"""


def _page_entities(spark, sf_dir) -> DataFrame:
    """An entity with a box for each line of an order: pages are orders."""
    lines = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*(F.min(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")))
    k, n = F.col("l_partkey"), F.col("l_linenumber")
    bbox = F.struct(((k % 3) * 15.0).alias("x"), ((F.col("l_suppkey") % 3) * 3.0).alias("y"), (F.lit(30.0) + F.col("l_suppkey") % 4).alias("width"), F.lit(10.0).alias("height"))
    return lines.select(
        F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page_number"), n.cast("int").alias("pattern_ordinal"), (n * 7).cast("int").alias("text_index"), F.element_at(F.array(*map(F.lit, ("AIR", "RAIL", "SHIP", "TRUCK"))), (k % 4 + 1).cast("int")).alias("text"),
        (F.lit(0.5) + (k % 50) / 100.0).alias("confidence"), F.when(F.col("l_returnflag") == "N", "regex").otherwise("model").alias("detection_method"), F.element_at(F.array(*map(F.lit, TYPES)), (k % 9 + 1).cast("int")).alias("entity_type"),
        F.when(F.col("l_linestatus") == "O", "confirmed").otherwise("rejected").alias("status"), bbox.alias("bbox"), F.when(k % 4 == 0, F.concat(F.lit("w"), (k % 3).cast("string"))).otherwise("").alias("form_field_name"),
    )


_E = f"""(SELECT l_orderkey AS doc_id, 1 AS page_number, l_linenumber::INT AS o, (l_linenumber * 7)::INT AS text_index, ['AIR', 'RAIL', 'SHIP', 'TRUCK'][l_partkey % 4 + 1] AS text, (0.5 + (l_partkey % 50) / 100.0)::DOUBLE AS confidence,
  CASE WHEN l_returnflag = 'N' THEN 'regex' ELSE 'model' END AS m, {_KINDS}[l_partkey % 9 + 1] AS entity_type, CASE WHEN l_linestatus = 'O' THEN 'confirmed' ELSE 'rejected' END AS status,
  ((l_partkey % 3) * 15.0)::DOUBLE AS x, ((l_suppkey % 3) * 3.0)::DOUBLE AS y, (30.0 + l_suppkey % 4)::DOUBLE AS w, 10.0::DOUBLE AS h, CASE WHEN l_partkey % 4 = 0 THEN 'w' || l_partkey % 3 ELSE '' END AS field
  FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus FROM lineitem GROUP BY ALL))"""


def place_dedupe(spark, sf_dir):
    kept = dedupe.by_place(_page_entities(spark, sf_dir))
    return kept.select("doc_id", "text", "pattern_ordinal", F.round("confidence", 6).alias("confidence"), "detection_method")


_META = "greatest(0, least(p.f.x + p.f.w, x[1].f.x + x[1].f.w) - greatest(p.f.x, x[1].f.x)) * greatest(0, least(p.f.y + p.f.h, x[1].f.y + x[1].f.h) - greatest(p.f.y, x[1].f.y))"
_OVER = f"({_META}) > 0.8 * (p.f.w * p.f.h + x[1].f.w * x[1].f.h - ({_META}))"
_EQUAL = "(lower(p.f.t) = lower(x[1].f.t) AND abs(p.f.x - x[1].f.x) < 5 AND abs(p.f.y - x[1].f.y) < 5 AND abs(p.f.w - x[1].f.w) < 5 AND abs(p.f.h - x[1].f.h) < 5)"
_AT = f"list_position(list_transform(acc, lambda p: {_OVER} OR {_EQUAL}), true)"
PLACE_SQL = f"""WITH e AS (SELECT doc_id, {{'row': floor(y / 5), 'x': x, 'o': o, 'i': text_index, 'e': {{'t': text, 'o': o, 'c': confidence, 'm': m, 'x': x, 'y': y, 'w': w, 'h': h}}}} AS s FROM {_E}),
k AS (SELECT doc_id, list_reduce(list_transform(list_sort(list(s)), lambda r: [{{'f': r.e, 'b': r.e}}]), lambda acc, x: CASE WHEN coalesce({_AT}, 0) = 0 THEN list_concat(acc, x)
  ELSE list_transform(acc, lambda p, i: CASE WHEN i <> {_AT} THEN p
    WHEN NOT ({_OVER}) AND p.f.m <> x[1].f.m THEN {{'f': p.f, 'b': {{'t': p.f.t, 'o': p.f.o, 'c': (p.f.c + x[1].f.c) / 2, 'm': 'ml_ner', 'x': p.f.x, 'y': p.f.y, 'w': p.f.w, 'h': p.f.h}}}}
    WHEN x[1].f.c > p.b.c THEN {{'f': p.f, 'b': x[1].f}} ELSE p END) END) AS places FROM e GROUP BY doc_id)
SELECT doc_id, p.b.t AS text, p.b.o AS pattern_ordinal, round(p.b.c, 6) AS confidence, p.b.m AS detection_method FROM (SELECT doc_id, unnest(places) AS p FROM k)"""


def spatial_except(spark, sf_dir):
    """Rejected entities that coincide with no confirmed one on their page."""
    e = _page_entities(spark, sf_dir)
    left = dedupe.spatial_anti_join(review.with_status(e, "rejected"), review.viewer_filter(e))
    return left.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("text_index").alias("places"))


EXCEPT_SQL = f"""WITH e AS {_E} SELECT doc_id, count(*) AS n, sum(text_index)::BIGINT AS places FROM e WHERE status = 'rejected' AND NOT EXISTS (SELECT 1 FROM e b WHERE b.status <> 'rejected' AND b.doc_id = e.doc_id
  AND abs(b.x - e.x) < 2 AND abs(b.y - e.y) < 2 AND abs(b.w - e.w) < 2 AND abs(b.h - e.h) < 2) GROUP BY doc_id"""


def page_redactions(spark, sf_dir):
    """What a PDF's writer is to do for each order: widgets to delete by name, rectangles to cover, and how many entities that is."""
    e = _page_entities(spark, sf_dir)
    widgets = e.where("form_field_name <> '' AND pattern_ordinal % 2 = 1").select("doc_id", "page_number", F.col("form_field_name").alias("name"), F.col("pattern_ordinal").alias("widget"))
    out = pages.redactions(e, widgets)
    shown = F.transform("actions", lambda a: F.concat_ws(" ", a["action"], a["form_field_name"], F.coalesce(a["widget"].cast("string"), F.lit("")), F.array_join(F.transform(a["rect"], lambda v: v.cast("int").cast("string")), " ")))
    return out.select("doc_id", "redacted_count", F.array_join(F.array_sort(shown), "|").alias("actions"))


REDACTIONS_SQL = f"""WITH e AS {_E}, f AS (SELECT doc_id, field AS name, min(o) AS widget FROM e WHERE field <> '' AND o % 2 = 1 GROUP BY ALL),
a AS (SELECT e.doc_id, CASE WHEN field = '' THEN 'redact   ' || (x - 2)::INT || ' ' || (y - 2)::INT || ' ' || (x + w + 2)::INT || ' ' || (y + h + 2)::INT WHEN widget IS NOT NULL THEN 'delete_widget ' || field || ' ' || widget END AS a
  FROM e LEFT JOIN f ON f.doc_id = e.doc_id AND f.name = e.field WHERE status = 'confirmed')
SELECT doc_id, count(*) AS redacted_count, coalesce(string_agg(a, '|' ORDER BY a), '') AS actions FROM a GROUP BY doc_id"""


def review_flow(spark, sf_dir):
    """Ids, names and colours; entities chosen by id get a status; types without any are left out; confidences stay in bounds."""
    e = review.with_id(_page_entities(spark, sf_dir), "doc_id", "page_number", "pattern_ordinal")
    chosen = e.where("confidence > 0.9").select("id")
    e = review.presentation(review.set_status_of(e, chosen, "confirmed"))
    e = e.withColumn("sure", F.round(review.clamped(F.col("confidence") * 1.5), 6))
    return e.select("doc_id", "id", "display_name", "color", "description", "status", "sure", F.when(F.col("confidence") >= 0.9, review.toggled(F.array(F.col("entity_type"), F.lit("X")), "X")).otherwise(review.toggled(F.array(F.col("entity_type")), "X")).alias("toggled")).withColumn("toggled", F.array_join("toggled", ","))


_TYPE_ROWS = ", ".join("('" + "', '".join(r) + "')" for r in ENTITY_TYPES)
REVIEW_FLOW_SQL = f"""SELECT doc_id, sha256(doc_id || '|1|' || o) AS id, t.n AS display_name, t.c AS color, t.d AS description, CASE WHEN confidence > 0.9 THEN 'confirmed' ELSE status END AS status,
  round(least(1.0, confidence * 1.5), 6)::DOUBLE AS sure, CASE WHEN confidence >= 0.9 THEN entity_type ELSE entity_type || ',X' END AS toggled FROM {_E} e JOIN (VALUES {_TYPE_ROWS}) t(k, n, c, d) ON t.k = e.entity_type"""


def shown_types(spark, sf_dir):
    return review.shown_counts(review.viewer_filter(_page_entities(spark, sf_dir).where("entity_type <> 'SSN'")))


SHOWN_SQL = f"SELECT entity_type, count(*) AS n FROM {_E} WHERE status <> 'rejected' AND entity_type <> 'SSN' GROUP BY 1"


def hit_places(spark, sf_dir):
    """Occurrences of a text on a page with the search hit that is theirs, or else the first."""
    e = _page_entities(spark, sf_dir)
    hits = e.where("pattern_ordinal % 3 <> 0").select("doc_id", "page_number", "text", F.col("pattern_ordinal").alias("hit"), "bbox")
    out = layout.kth_hit(e.select("doc_id", "page_number", "text", "text_index"), layout.first_hits(hits))
    return out.select("doc_id", "text", "text_index", F.col("bbox.x").alias("x"), F.col("bbox.y").alias("y"), F.col("bbox.width").alias("width"))


HITS_SQL = f"""WITH e AS {_E}, h AS (SELECT *, row_number() OVER (PARTITION BY doc_id, text ORDER BY o) AS n FROM e WHERE o % 3 <> 0), q AS (SELECT *, row_number() OVER (PARTITION BY doc_id, text ORDER BY text_index) AS n FROM e)
SELECT q.doc_id, q.text, q.text_index, coalesce(h.x, f.x) AS x, coalesce(h.y, f.y) AS y, coalesce(h.w, f.w) AS width FROM q LEFT JOIN h ON h.doc_id = q.doc_id AND h.text = q.text AND h.n = q.n LEFT JOIN h f ON f.doc_id = q.doc_id AND f.text = q.text AND f.n = 1"""


def merged_hits(spark, sf_dir):
    """Neighbouring hits of each order as one box."""
    hits = _page_entities(spark, sf_dir).select("doc_id", "page_number", F.col("pattern_ordinal").alias("hit"), "bbox")
    return layout.merged_hits(hits, 80.0).select("doc_id", "hit", *_box(F.col("bbox")), "n")


MERGED_SQL = f"""WITH e AS {_E}, c AS (SELECT *, CASE WHEN abs(y - lag(y) OVER q) < h + lag(h) OVER q AND abs(x - lag(x) OVER q) < 24 THEN 0 ELSE 1 END AS fresh FROM e WINDOW q AS (PARTITION BY doc_id ORDER BY o)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY o) AS g FROM c)
SELECT doc_id, min(o) AS hit, round(min(x), 6) AS x, round(min(y), 6) AS y, round(max(x + w) - min(x), 6) AS width, round(max(y + h) - min(y), 6) AS height, count(*) AS n FROM g GROUP BY doc_id, g"""


# --- PDF findings ------------------------------------------------------------------------------------------------------------


def pdf_findings(spark, sf_dir):
    """Annotations, widgets, layers, files and scripts of each customer's orders, taken as pages: totals, pages, warnings, metadata."""
    o = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("y"))
    rows = o.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").cast("int").alias("page_number"), (F.col("o_orderkey") % 3).cast("int").alias("annotations"), (F.col("o_orderkey") % 2).cast("int").alias("widgets"))
    s = pdf.page_statistics(rows)
    k = F.col("doc_id")
    files = F.transform(F.sequence(F.lit(0), (k % 8).cast("int")), lambda i: F.concat(F.lit("a"), i.cast("string")))
    w = audit.pdf_warnings((k % 2).cast("int"), F.when(k % 4 == 1, F.array(F.lit("L"))).otherwise(F.array().cast("array<string>")), F.col("annotation_pages"), F.col("annotations"), F.col("widget_pages"), F.col("widgets"), F.slice(files, 2, 8), k % 5 == 0)
    meta = pdf.metadata(F.create_map(F.lit("info:Title"), F.concat(F.lit(" T"), k.cast("string")), F.lit("info:Author"), F.lit(" "), F.lit("info:Producer"), F.lit("P")))
    gone = sanitize.removed_annotations(F.transform(F.sequence(F.lit(0), (k % 4).cast("int")), lambda i: F.struct(F.concat(F.lit("K"), (i % 2).cast("string")).alias("type"))))
    return s.select(
        "doc_id", F.col("annotations").cast("long"), F.array_join("annotation_pages", ",").alias("pages"), F.array_join(F.transform(w, lambda x: F.concat_ws(":", x["type"], F.coalesce(x["count"].cast("string"), F.lit("")))), ",").alias("warnings"),
        F.get(F.transform(F.filter(w, lambda x: x["type"] == "embedded_files"), lambda x: x["details"]), F.lit(0)).alias("files"), F.size(audit.of_severity(w, "high")).cast("long").alias("high"), audit.report(w)["has_hidden"].alias("hidden"),
        F.array_join(F.transform(F.map_entries(meta), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("metadata"), F.array_join(gone["types"], ",").alias("types"), gone["removed"].cast("long").alias("removed"),
    )


FINDINGS_SQL = """WITH s AS (SELECT o_custkey AS k, sum(o_orderkey % 3)::BIGINT AS a, coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) FILTER (o_orderkey % 3 > 0), '') AS p, sum(o_orderkey % 2)::BIGINT AS w FROM orders GROUP BY o_custkey),
f AS (SELECT *, k % 8 AS n, list_transform(range(1, k % 8 + 1), lambda i: 'a' || i) AS names FROM s)
SELECT k AS doc_id, a AS annotations, p AS pages, array_to_string(list_filter([CASE WHEN k % 2 = 1 THEN 'ocg_layers:1' END, CASE WHEN a > 0 THEN 'hidden_annotations:' || a END, CASE WHEN w > 0 THEN 'form_fields:' || w END, CASE WHEN n > 0 THEN 'embedded_files:' || n END, CASE WHEN k % 5 = 0 THEN 'javascript:' END], lambda x: x IS NOT NULL), ',') AS warnings,
  CASE WHEN n > 0 THEN 'Embedded files: ' || array_to_string(names[1:5], ', ') || CASE WHEN n > 5 THEN ' and ' || (n - 5) || ' more...' ELSE '' END END AS files,
  ((k % 2) + (n > 0)::INT + (k % 5 = 0)::INT)::BIGINT AS high, k % 2 = 1 OR a > 0 OR w > 0 OR n > 0 OR k % 5 = 0 AS hidden, 'title=T' || k || ',producer=P' AS metadata,
  CASE WHEN k % 4 = 0 THEN 'K0' ELSE 'K0,K1' END AS types, k % 4 + 1 AS removed FROM f"""


def iso_dates(spark, sf_dir):
    """Dates of orders as PDF properties write them, in several forms."""
    o = _table(spark, sf_dir, "orders")
    k, d = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    value = F.when(k % 4 == 0, F.concat(F.lit("D:"), F.date_format(d, "yyyyMMddHHmmss"), F.lit("+02'00'"))).when(k % 4 == 1, F.concat(F.lit("D:"), F.date_format(d, "yyyyMM"))).when(k % 4 == 2, F.date_format(d, "yyyy-MM-dd")).otherwise(F.lit("no date"))
    return o.select("o_orderkey", X.iso_date(value).alias("iso"))


DATES_SQL = """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate::TIMESTAMP, '%Y-%m-%dT%H:%M:%S') || '+02:00' WHEN 1 THEN strftime(o_orderdate, '%Y-%m') || '-01T00:00:00Z' WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') END AS iso FROM orders"""


# --- all sources -------------------------------------------------------------------------------------------------------------


def combined_entities(spark, sf_dir):
    """Patterns' entities, those of a model, and all places of a text selected by hand that aren't among them."""
    docs = records(spark, sf_dir)
    model = docs.where("rec_id % 3 = 0").select("rec_id", F.substring("text", 1, 6).alias("text"), F.lit(0).alias("text_index"), F.lit("ORG").alias("entity_type"), (F.lit(0.4) + (F.col("rec_id") % 5) / 10.0).alias("confidence"), F.lit("ml_ner").alias("detection_method"), F.lit("rejected").alias("status"))
    found = analysis.all_sources(docs, model, analysis.DetectionConfig(use_ml=True), key="rec_id")
    return analysis.with_selection(docs, found, "phone", key="rec_id").groupBy("rec_id", "detection_method").agg(F.count("*").alias("n"), F.sum("text_index").alias("places"))


COMBINED_SQL = f"""SELECT rec_id, detection_method, count(*) AS n, sum(text_index)::BIGINT AS places FROM (
  SELECT rec_id, 'regex' AS detection_method, text_index FROM ({DETECT_R}) WHERE confidence >= {MEDIUM}
  UNION ALL SELECT rec_id, 'ml_ner', 0 FROM {R} WHERE rec_id % 3 = 0 AND 0.4 + (rec_id % 5) / 10.0 >= {MEDIUM}
  UNION ALL SELECT rec_id, 'manual', (coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + 5 * (i - 1))::INT FROM (SELECT rec_id, g, unnest(range(1, len(g))) AS i FROM (SELECT rec_id, regexp_split_to_array(text, '(?i)phone') AS g FROM {R}))) GROUP BY ALL"""


def _of_records(name: str):
    def run(spark, sf_dir):
        found = detect(records(spark, sf_dir), patterns=[BY_NAME[name]], use_scripts=False)
        return found.select("rec_id", "text_index", F.col("text").alias("v"))

    return run, _matches_sql(R, "rec_id", BY_NAME[name])


_ALL = {
    "redacted_archives": (redacted_archives, ARCHIVES_SQL), "archive_contents": (archive_contents, CONTENTS_SQL), "hidden_more": (hidden_more, HIDDEN_MORE_SQL), "page_detection": (page_detection, PAGE_DETECTION_SQL),
    "selected_texts": (selected_texts, SELECTED_SQL), "place_dedupe": (place_dedupe, PLACE_SQL), "spatial_except": (spatial_except, EXCEPT_SQL), "page_redactions": (page_redactions, REDACTIONS_SQL),
    "review_flow": (review_flow, REVIEW_FLOW_SQL), "shown_types": (shown_types, SHOWN_SQL), "hit_places": (hit_places, HITS_SQL), "merged_hits": (merged_hits, MERGED_SQL), "pdf_findings": (pdf_findings, FINDINGS_SQL),
    "iso_dates": (iso_dates, DATES_SQL), "combined_entities": (combined_entities, COMBINED_SQL), "record_dates": _of_records("Date (YYYY-MM-DD)"), "record_urls": _of_records("URL (with protocol)"),
}
QUERIES = {name: run for name, (run, _) in _ALL.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in _ALL.items()} | {"redacted_documents": _redacted_sql(DETECT_D, "documents", "doc_id"), "redacted_records": _redacted_sql(DETECT_R, R, "rec_id")}
