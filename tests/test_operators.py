import io
import zipfile

from pyspark.sql import functions as F

from quillveil.config import DetectionConfig
from quillveil.functions.words import Word
from quillveil.operators import audit, dedupe, layout, ner, redact, review, sanitize
from quillveil.operators.detect import detect, find_occurrences, manual
from quillveil.plans import analysis
from quillveil.sources import docx, files, pdf, settings
from quillveil.streaming import detection

E = "doc_id long, text string, text_index int, pattern_ordinal int, confidence double, detection_method string, page_number int, bbox struct<x:double,y:double,width:double,height:double>, entity_type string, status string"


def entity(doc=1, text="a", at=0, o=0, c=0.9, how="regex", page=1, box=(0.0, 0.0, 0.0, 0.0), kind="EMAIL", status="rejected"):
    return (doc, text, at, o, c, how, page, box, kind, status)


def test_spans_never_overlap(spark):
    rows = [entity(text="abcd", at=0, c=0.5), entity(text="cdef", at=2, c=0.9, o=1), entity(text="efgh", at=4, c=0.5, o=2), entity(text="zz", at=20), entity(text="zz", at=30), entity(doc=2, text="abcd")]
    got = {(r.doc_id, r.text_index, r.text) for r in dedupe.by_span(spark.createDataFrame(rows, E)).collect()}
    assert got == {(1, 2, "cdef"), (1, 20, "zz"), (1, 30, "zz"), (2, 0, "abcd")}
    text = {r.text.lower() for r in dedupe.by_text(spark.createDataFrame([*rows, entity(text="ZZ", at=40, c=0.95)], E)).collect()}
    assert text == {"abcd", "cdef", "efgh", "zz"}


def test_places(spark):
    box = (10.0, 10.0, 100.0, 10.0)
    rows = [entity(text="A", c=0.8, box=box), entity(text="B", at=1, c=0.9, box=(11.0, 10.0, 100.0, 10.0)), entity(text="C", at=2, c=0.7, box=(300.0, 10.0, 20.0, 10.0)), entity(text="c", at=3, c=0.9, how="ml_ner", box=(304.0, 12.0, 20.0, 10.0))]
    got = {(r.text, round(r.confidence, 3), r.detection_method) for r in dedupe.by_place(spark.createDataFrame(rows, E)).collect()}
    assert got == {("B", 0.9, "regex"), ("C", 0.8, "ml_ner")}
    a, b = spark.createDataFrame(rows[:2], E), spark.createDataFrame([entity(box=box)], E)
    assert dedupe.spatial_anti_join(a, b).count() == 0
    boxes = spark.createDataFrame([((0.0, 0.0, 2.0, 2.0), (1.0, 0.0, 2.0, 2.0))], f"a {layout.BBOX}, b {layout.BBOX}")
    assert abs(boxes.select(layout.iou(F.col("a"), F.col("b"))).first()[0] - 1 / 3) < 1e-12


def test_review(spark):
    df = spark.createDataFrame([entity(c=0.95), entity(c=0.75, kind="PHONE"), entity(c=0.4, kind="DATE")], E)
    assert review.config_filter(df, DetectionConfig(level="conservative")).count() == 1
    assert review.review_filter(df, hidden_bands=["high", "medium", "low"]).count() == 1
    n = {r.entity_type: r.n for r in review.counts_by_type(df).collect()}
    assert len(n) == 9 and n["PHONE"] == 1 and n["SSN"] == 0
    assert review.with_status(review.confirm_confident(df), "confirmed").count() == 1
    ids = review.with_id(df, "doc_id", "entity_type")
    assert review.with_status(review.set_status_of(ids, ids.where("entity_type = 'DATE'"), "confirmed"), "confirmed").count() == 1
    assert review.presentation(df).where("color = '#8B5CF6'").count() == 1
    assert [r.confidence for r in review.ordered(df, "confidence").collect()] == [0.95, 0.75, 0.4]
    s = review.statistics(df, ("doc_id",)).first()
    assert s.total == 3 and s.by_band == {"high": 1, "medium": 1, "none": 1}


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "mail a@b.com or 😀 c@d.org now"), (2, "nothing"), (3, None)], "doc_id long, text string")
    out = {r.doc_id: r for r in redact.redact(docs, detect(docs)).collect()}
    assert out[1].redacted_text == "mail [EMAIL] or 😀 [EMAIL] now" and out[1].redacted_count == 2 and out[2].redacted_text == "nothing" and out[3].redacted_text is None
    plan = {r.doc_id: r.redacted_text for r in analysis.redacted(spark.createDataFrame([(1, "credit card 4111 1111 1111 1111 and call 212-456-7890 please, Bob")], "doc_id long, text string"), words=[Word("bob")]).collect()}
    assert plan[1] == "credit card [CREDIT_CARD] and call [PHONE] please, [CUSTOM]"
    box = spark.createDataFrame([(1, 1, None, (10.0, 10.0, 5.0, 5.0), "EMAIL"), (1, 1, "f", (0.0, 0.0, 1.0, 1.0), "SSN")], "doc_id long, page_number int, form_field_name string, bbox struct<x:double,y:double,width:double,height:double>, entity_type string")
    assert {(r.action, tuple(r.rect or ())) for r in redact.boxes(box).collect()} == {("redact", (8.0, 8.0, 17.0, 17.0)), ("delete_widget", ())}
    mark = spark.createDataFrame([("Ab ab", [("ab", "EMAIL")])], "t string, s array<struct<text:string,label:string>>").select(redact.highlighted(F.col("t"), F.col("s"))).first()[0]
    assert mark == '<span class="entity-email">Ab</span> ab'


def test_occurrences_and_manual(spark):
    docs = spark.createDataFrame([(1, "Ab.c aB.C abxc")], "doc_id long, text string")
    assert [r.text_index for r in find_occurrences(docs, "ab.c").orderBy("text_index").collect()] == [0, 5]
    assert manual(docs, "PERSON").first().status == "confirmed"


def test_model_tokens(spark):
    docs = spark.createDataFrame([(1, "John Smith at Acme"), (2, "boom")], "doc_id long, text string")

    def model(texts):
        if "boom" in texts:
            raise RuntimeError("no")
        t = [("John", "B-PER", 0.9), ("Smith", "I-PER", 0.7), ("Ac", "B-ORG", 0.8), ("##me", "I-ORG", 0.1), ("x", "B-MISC", 0.5)]
        return [[{"word": w, "entity": e, "score": s, "start": i, "end": i + 1} for i, (w, e, s) in enumerate(t)] for _ in texts]

    rows = ner.with_tokens(docs, model)
    tokens = rows.select("doc_id", "chunk_offset", F.posexplode("tokens").alias("place", "t")).select("doc_id", "chunk_offset", "place", "t.*")
    got = {(r.text, r.entity_type, round(r.confidence, 3)) for r in ner.grouped(tokens, ("doc_id", "chunk_offset")).collect()}
    assert got == {("John Smith", "PERSON", 0.8), ("Acme", "ORG", 0.8)}


def test_layout(spark):
    line = lambda t, y: (t, 0.0, y, (0.0, y, 10.0 * len(t), 10.0), ("f", 10.0))
    page = [(1, 1, 100.0, 100.0, [("text", [line("ab cd", 0.0), line("ef", 12.0)])], [("n", "l", "v@x.com", "text", 2, ["o"], None, (0.0, 0.0, 10.0, 5.0))], {"info:Title": " T ", "info:Author": " "}, 2, 0)]
    pages = spark.createDataFrame(page, pdf.PAGE)
    items = layout.text_items(pages)
    assert layout.combined_text(items).first().text == "ab cd\nef"
    assert [(r.start, r.end) for r in layout.item_offsets(items).orderBy("start").collect()] == [(0, 2), (3, 5), (6, 8)]
    sel = spark.createDataFrame([(1, 1, 7, (0.0, 89.0, 100.0, 11.0)), (1, 1, 8, (0.0, 0.0, 2.0, 2.0))], "doc_id long, page_number int, box_id int, bbox struct<x:double,y:double,width:double,height:double>")
    assert [(r.box_id, r.text) for r in layout.selected_text(sel, items).collect()] == [(7, "ab cd")]
    f = pages.select(layout.form_text(F.col("form_fields"), F.lit("base")).alias("f"), pdf.form_fields(F.col("form_fields"), F.col("height")).alias("g"), pdf.metadata(F.col("metadata")).alias("m")).first()
    assert f.f.text == "base n l v@x.com o" and f.g[0].is_required and f.g[0].bounds.y == 95.0 and f.m == {"title": "T"}
    assert pages.select(layout.containing_field(layout.form_text(F.col("form_fields"), F.lit("base"))["ranges"], F.lit(9), F.lit(16))).first()[0] == "n"
    assert pdf.page_statistics(pages).first().annotation_pages == [1]


def test_archives(spark, tmp_path):
    def archive(parts):
        b = io.BytesIO()
        with zipfile.ZipFile(b, "w") as z:
            for k, v in parts.items():
                z.writestr(k, v)
        return b.getvalue()

    xml = '<w:document><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:b/><w:t>A &amp; B</w:t></w:r><w:ins w:id="1"><w:r><w:t></w:t></w:r></w:ins><w:del w:id="2"><w:r><w:t>gone</w:t></w:r></w:del><w:r><w:rPr><w:vanish/></w:rPr><w:t>C</w:t></w:r></w:p></w:document>'
    good = archive({"word/document.xml": xml, "word/media/i.PNG": b"\x89", "word/media/x.bin": b"1", "docProps/core.xml": "<dc:creator> Me </dc:creator>", "word/vbaProject.bin": b"1"})
    for name, raw in (("a.docx", good), ("b.docx", b"not a zip"), ("c.txt", b"x")):
        (tmp_path / name).write_bytes(raw)
    read = files.read(spark, str(tmp_path))
    rows = docx.entries(read.select("filename", "content")).cache()
    assert {r.filename: r.error is None for r in rows.collect()} == {"a.docx": True, "b.docx": False}
    ok = rows.where("error IS NULL")
    parts = docx.text_parts(F.col("parts"))
    r = ok.select(docx.full_text(F.try_element_at(parts, F.lit(docx.DOCUMENT))).alias("t"), docx.metadata(parts).alias("m"), docx.html_preview(F.try_element_at(parts, F.lit(docx.DOCUMENT))).alias("h"), audit.report(audit.docx_warnings(parts)).alias("w")).first()
    assert r.t == "A & B gone C" and r.m == {"author": "Me"} and r.h.startswith("<h1><strong>A &amp; B</strong>")
    assert [w.type for w in r.w.warnings] == ["hidden_text", "track_changes", "macros"] and r.w.has_hidden and "3 high severity" in r.w.summary
    assert [(i.image_name, i.mime) for i in docx.images(ok).collect()] == [("i.PNG", "image/png")]
    clean = ok.select("filename", F.transform_values(sanitize.sanitized_parts(parts), lambda _, v: F.encode(v, "UTF-8")).alias("parts"))
    again = docx.entries(docx.written(clean)).select(docx.text_parts(F.col("parts")).alias("p")).select(docx.full_text(F.element_at("p", docx.DOCUMENT)).alias("t"), F.map_keys("p").alias("k")).first()
    assert again.t == "A & B C" and "word/vbaProject.bin" not in again.k


def test_settings():
    words = [Word("x", id="1", created_at=5)]
    got = settings.load(settings.export(DetectionConfig(level="aggressive"), words))
    assert got["success"] and got["config"].threshold == 0.5 and got["words"] == words
    assert settings.load("{")["errors"] and settings.load("{}")["errors"] == ["no version"] and settings.load_config("x") == DetectionConfig() and settings.load_words("x") == []


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "mail a@b.com"), (2, "no")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    detection.started(detection.entities(source), str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    assert [r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["a@b.com"]


def test_word_xml_with_empty_nodes_and_references(spark):
    xml = '<w:p><w:r><w:t xml:space="preserve"/></w:r><w:r><w:t>a &amp;#39; &#39;&#x41;</w:t></w:r><w:r><w:t xml:space="preserve">john@x</w:t></w:r><w:r><w:t></w:t><w:t>.com &lt; b</w:t></w:r></w:p>'
    text = docx.full_text(F.col("xml"))
    rows = spark.createDataFrame([(xml,)], "xml string").withColumn("text", text).withColumn("at", F.instr("text", "john") - 1)
    spans = F.array(F.struct(F.col("at").alias("start"), (F.col("at") + 11).alias("end"), F.lit("EMAIL").alias("label")))
    r = rows.withColumn("cut", docx.with_spans_cut(F.col("xml"), spans)).first()
    assert r.text == "a &#39; 'A john@x .com < b"
    assert r.cut == xml.replace(">john@x<", ">[EMAIL]<").replace(">.com &lt; b<", "> &lt; b<")


def test_nested_changes_go_whole(spark):
    xml = '<w:del w:id="1">a<w:del w:id="2">b<w:del w:id="3">c</w:del>d</w:del>e</w:del>f<w:delText>g</w:delText><w:del w:id="4"/>h<w:ins w:id="5">i</w:ins>'
    df = spark.createDataFrame([(xml,)], "x string")
    assert df.select(sanitize.accepted_changes(F.col("x"))).first()[0] == "f<w:delText>g</w:delText>hi"


def test_redaction_within_the_row_is_that_of_the_joins(spark):
    docs = spark.createDataFrame([(1, "mail a@b.com, ssn 123-45-6789, card 4111 1111 1111 1111 or 2024-01-15"), (2, None), (3, ""), (None, "call (212) 456-7890 now")], "doc_id long, text string")
    by_rows = {(r.doc_id, r.redacted_text, r.redacted_count) for r in analysis.redacted(docs).collect()}
    found = review.confirm_confident(analysis.analysed(docs), 0.0)
    assert by_rows == {(r.doc_id, r.redacted_text, r.redacted_count) for r in redact.redact(docs, found).collect()} and sum(n for _, _, n in by_rows) >= 4


def test_long_texts_take_time_in_proportion(spark):
    from quillveil.functions import text as X

    df = spark.createDataFrame([("word " * 30_000,)], "t string")
    r = df.select(X.located(F.col("t"), "w[a-z]+").alias("m"), X.starts(F.transform(F.sequence(F.lit(1), F.lit(5000)), lambda i: i.cast("int"))).alias("s")).first()
    assert len(r.m) == 30_000 and r.m[-1].start == 5 * 29_999 and r.s[:4] == [0, 1, 3, 6] and len(r.s) == 5000
