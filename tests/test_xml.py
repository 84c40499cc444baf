import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from quillveil.functions import xml as X
from quillveil.operators import audit, redact, review, sanitize
from quillveil.operators.detect import find_occurrences
from quillveil.sources import docx, pdf

MAIN = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
BODY = '<{p}body><!-- <{p}t>no</{p}t> --><{p}p><{p}pPr><{p}pStyle {a}val="Heading1"/></{p}pPr><{p}r title="a>b"><{p}rPr><{p}b {a}val="1"/><{p}i {a}val="0"/></{p}rPr><{p}t>one &lt; <![CDATA[<two> & ]]></{p}t></{p}r>' \
    '<{p}ins {a}id="1"><{p}r><{p}t>new</{p}t></{p}r></{p}ins><{p}del {a}id="2"><{p}r><{p}delText>old</{p}delText></{p}r></{p}del></{p}p></{p}body>'  # fmt: skip
FORMS = {
    "w": f'<w:document xmlns:w="{MAIN}">' + BODY.format(p="w:", a="w:") + "</w:document>",
    "other": f"<x1:document xmlns:x1='{MAIN}' xmlns:w=\"urn:else\">" + BODY.format(p="x1:", a="x1:").replace("<x1:body>", '<x1:body><w:t w:k="v">else</w:t>') + "</x1:document>",
    "default": f'<document xmlns="{MAIN}" xmlns:w="{MAIN}">' + BODY.format(p="", a="w:") + "</document>",
    "strict": '<s:document xmlns:s="http://purl.oclc.org/ooxml/wordprocessingml/main">' + BODY.format(p="s:", a="s:") + "</s:document>",
}


@pytest.mark.parametrize("form", FORMS)
def test_all_forms_read_alike(spark, form):
    df = spark.createDataFrame([(1, FORMS[form])], "doc_id int, x string")
    x = F.col("x")
    r = df.select(docx.full_text(x).alias("text"), docx.html_preview(x).alias("html"), sanitize.document_xml(x).alias("clean"), X.normalised(x).alias("n"), X.normalised(X.normalised(x)).alias("again")).first()
    assert r.text == "one < <two> &  new"
    assert r.html == "<h1><strong>one &lt; &lt;two&gt; &amp; </strong>new</h1>"
    assert "old" not in r.clean and "new" in r.clean and "<w:ins" not in r.clean and "<!--" not in r.clean
    assert r.again == r.n
    own = f"{{{MAIN if form != 'strict' else 'http://purl.oclc.org/ooxml/wordprocessingml/main'}}}"
    before, after = ([(e.tag, dict(e.attrib), (e.text or "").strip()) for e in ET.fromstring(t).iter()] for t in (FORMS[form], r.n))
    strip = lambda e: [(t, sorted(a.items()), s) for t, a, s in e]
    assert strip(before) == strip(after) and any(t == f"{own}t" for t, *_ in before)
    assert spark.createDataFrame([(FORMS[form].replace("<!-- <", "<b/><").replace(" -->", ""),)], "x string").select(X.normalised(F.col("x"))).first()[0]
    w = df.select(audit.docx_warnings(docx.text_parts(F.create_map(F.lit("word/document.xml"), F.encode("x", "UTF-8")))).alias("w")).first().w
    assert {i["type"]: i["count"] for i in w} == {"track_changes": 2}


def test_a_plain_part_stays_as_it_is(spark):
    plain = ['<w:a b="c"/>', "", "text > only", f'<w:document xmlns:w="{MAIN}"><w:t>1 > 0 "x>y"</w:t></w:document>', None]
    df = spark.createDataFrame([(t,) for t in plain], "x string")
    assert [r[0] for r in df.select(X.normalised(F.col("x"))).collect()] == plain


def test_events_agree_with_a_parser(spark):
    text = '<?xml version="1.0"?><!DOCTYPE a><a b="1" c=\'>2\'><!-- <x/> -->t1<d/>t2<e f="g"><![CDATA[<h>]]></e></a>'
    got = [(e.kind, e.name, e.attributes, e.depth, e.text) for e in spark.createDataFrame([(text,)], "x string").select(X.events(F.col("x"))).first()[0]]
    assert got == [
        ("open", "a", {"b": "1", "c": ">2"}, 0, None), ("text", None, None, 1, "t1"), ("empty", "d", {}, 1, None), ("text", None, None, 1, "t2"),
        ("open", "e", {"f": "g"}, 1, None), ("text", None, None, 2, "&lt;h&gt;"), ("close", "e", None, 1, None), ("close", "a", None, 0, None),
    ]
    assert spark.createDataFrame([("",), (None,)], "x string").select(X.events(F.col("x"))).collect()[0][0] == []


def test_redaction_of_other_prefixes(spark):
    parts = spark.createDataFrame([(1, FORMS["other"])], "doc_id int, x string").select("doc_id", F.create_map(F.lit("word/document.xml"), F.encode("x", "UTF-8")).alias("parts"))
    text = parts.select("doc_id", docx.full_text(F.decode(F.element_at("parts", docx.DOCUMENT), "UTF-8")).alias("text"))
    found = review.set_status(find_occurrences(text, "<two>"), F.lit(True), "confirmed")
    out = redact.redact_archives(parts, found).select(docx.full_text(F.decode(F.element_at("parts", docx.DOCUMENT), "UTF-8"))).first()[0]
    assert out == "one < [CUSTOM] &  new"


def test_settings_previews_and_properties(spark):
    row = spark.createDataFrame([("<w:rsids><w:rsid/></w:rsids><w:compat><w:x/></w:compat><w:zoom/>",)], "x string").select(sanitize.settings_xml(F.col("x"))).first()[0]
    assert row == "<w:compat></w:compat><w:zoom/>"
    run = '<w:p><w:r><w:rPr>{}</w:rPr><w:t>x</w:t></w:r></w:p>'
    cases = [("<w:b/>", True), ('<w:b w:val="true"/>', True), ('<w:b w:val="0"/>', False), ('<w:b w:val="off" />', False), ("<w:bCs/>", False), ("", False)]
    got = spark.createDataFrame([(run.format(c),) for c, _ in cases], "x string").select(docx.html_preview(F.col("x"))).collect()
    assert [("<strong>" in r[0]) for r in got] == [b for _, b in cases]
    meta = spark.createDataFrame([({"info:CreationDate": "D:20240102", "info:ModDate": "yesterday", "info:Title": " T "},)], "m map<string,string>").select(pdf.metadata(F.col("m"))).first()[0]
    assert meta == {"creationDate": "2024-01-02T00:00:00Z", "modificationDate": "yesterday", "title": "T"}
