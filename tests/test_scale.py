"""What keeps the cost in proportion: work dealt to all cores, and done once."""

import re
from dataclasses import replace

from pyspark.sql import functions as F

from quillveil.functions import scripts
from quillveil.functions.patterns import B, CATALOGUE, EDGE
from quillveil.functions.text import located
from quillveil.operators import audit, sanitize, wordlists
from quillveil.operators.detect import detect
from quillveil.plans import analysis
from quillveil.sources import docx
from quillveil.queries import records

from test_patterns import CASES

SF = "/root/testdata/sf0.001"


def _nodes(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_records_are_dealt_to_many_tasks(spark):
    assert records(spark, SF).rdd.getNumPartitions() >= 16


def test_what_follows_the_scans_is_planned_once(spark):
    assert _nodes(detect(records(spark, SF))).count("split(") == 1


def test_a_selection_does_not_detect_again(spark):
    docs = records(spark, SF)
    with_more = analysis.with_selection(docs, detect(docs), "phone", key="rec_id")
    assert _nodes(with_more).count("Generate explode") == 2
    rows = spark.createDataFrame([(1, "a Phone, a phone", 0), (1, "x", 0)], "k int, text string, n int")
    known = spark.createDataFrame([(1, "phone", 2), (1, "phone", 2), (1, "x", None)], "k int, text string, text_index int")
    got = analysis.with_selection(rows, known, "phone", key="k").groupBy("text_index").agg(F.count("*").alias("n")).collect()
    assert sorted((r.text_index or -1, r.n) for r in got) == [(-1, 1), (2, 2), (11, 1)]


def test_cheap_conditions_lose_no_match(spark):
    texts = [t for _, t, _ in CASES] + ["(212) 456-7890", "(212) 456.7890", "1-212-456-7890", "a+44 20 7123 4567", "5500 0000-0000 0004", "May 3,　2020", "January 1,  2019", "6212345678901232", "4222222222222", "2001:0db8:85a3:0000:0000:8a2e:0370:7334"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    gated, free = (detect(rows, patterns=ps, use_scripts=False).select("id", "pattern_name", "text_index", "text") for ps in (CATALOGUE, [replace(p, needs=None) for p in CATALOGUE]))
    assert sorted(gated.collect()) == sorted(free.collect()) and free.count() > 20


def test_the_catalogues_boundaries_are_looked_up_and_are_the_same(spark):
    assert not any("[A-Za-z0-9_]" in p.regex for p in CATALOGUE)
    texts = ["a1_b-c", "电1话a", "é1é", "_", "", " a ", "٣3", "a\u0301b", "K1ſ2", "1\n2", "x😀y", "İi"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    at = rows.select(*(F.regexp_replace("text", F.lit(b), F.lit("|")).alias(n) for b, n in ((B, "b"), (EDGE, "edge")))).collect()
    assert [r.b for r in at] == [r.edge for r in at] and sum(r.b.count("|") for r in at) > 20


def test_scripts_are_looked_for_in_what_plain_marks_leave(spark):
    """Each ASCII character by itself and all together: letters are Latin, ignored ones nothing, the others other."""
    chars = [chr(i) for i in range(128)]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate([*chars, "".join(chars)])], "id int, text string").withColumn("n", scripts.script_counts(F.col("text")))
    got = {r.id: r.n for r in rows.collect()}
    other = {c for c in chars if not c.isalpha() and c not in "0123456789\t\n\x0b\f\r !\"#%&'()*,-./:;?@[\\]_{}"}
    assert {c for i, c in enumerate(chars) if got[i].latin} == {c for c in chars if c.isalpha()}
    assert {c for i, c in enumerate(chars) if got[i].other} == other and (got[128].latin, got[128].other, got[128].cjk) == (52, len(other), 0)
    assert f"[{scripts.PLAIN}]+" in _nodes(rows)


def test_texts_without_matches_have_none(spark):
    rows = spark.createDataFrame([(1, "ab"), (2, None), (3, ""), (4, "a1b")], "id int, text string")
    got = {r.id: [tuple(m) for m in r.m] for r in rows.select("id", located(F.col("text"), "[0-9]").alias("m")).collect()}
    assert got == {1: [], 2: [], 3: [], 4: [(1, 2, "1")]}


def test_accepting_changes_scans_a_text_once_a_name(spark):
    rows = spark.createDataFrame([(1, "<w:ins a='1'><w:t>a</w:t></w:ins><w:del><w:t>b</w:t></w:del>")], "id int, t string")
    out = rows.select(sanitize.accepted_changes(F.regexp_replace("t", "zz", "")).alias("t"))
    assert _nodes(out).count(", zz, ") == 1 and out.first().t == "<w:t>a</w:t>"


def test_warnings_make_their_parts_once(spark):
    rows = spark.createDataFrame([(1, "<w:vanish/>")], "id int, t string")
    w = audit.docx_warnings(F.create_map(F.lit("word/document.xml"), F.regexp_replace("t", "zz", "")))
    out = rows.select(F.transform(w, lambda x: F.concat_ws(":", x["type"], x["count"])).alias("w"))
    assert _nodes(out).count(", zz, ") == 1 and out.first().w == ["hidden_text:1"]


def test_a_words_expression_looks_for_its_first_character_first(spark):
    words = spark.createDataFrame([("1", "Ünder"), ("2", "(x)"), ("3", "word")], "id string, word string")
    docs = spark.createDataFrame([(1, "a ÜN DER (x) swords w or\nd, WORD")], "doc_id int, text string")
    found = wordlists.candidates(docs, words)
    assert all("(?=\\Q" in w.regex for r in found.collect() for w in r.words)
    assert sorted((r.word_id, r.text) for r in wordlists.matches(docs, words).collect()) == [("1", "ÜN DER"), ("2", "(x)"), ("3", "WORD"), ("3", "w or\nd")]


def test_archives_go_to_python_by_few_rows(spark):
    """An Arrow batch holds 10,000 archives, however large; and the call stays outside the expressions that use it several times."""
    parts = F.create_map(F.lit(docx.DOCUMENT), F.encode(F.concat(F.lit("<w:t>"), F.col("id").cast("string"), F.lit("</w:t>")), "UTF-8"), F.lit("a.png"), F.unhex(F.lit("00ff")))
    read = docx.entries(docx.written(spark.range(250).select("id", parts.alias("parts"))))
    text = read.select("id", docx.full_text(F.decode(F.element_at("parts", docx.DOCUMENT), "UTF-8")).alias("text"), F.element_at("parts", "a.png").alias("image"), "error")
    plan = text._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "InPandas" not in plan and "ArrowEvalPython" not in plan
    assert sorted(text.collect()) == [(i, str(i), bytearray(b"\x00\xff"), None) for i in range(250)]
    bad = docx.entries(spark.createDataFrame([(1, b"no archive"), (2, None)], "id int, content binary")).collect()
    assert [(r.parts, r.error is None) for r in bad] == [({}, False)] * 2


def test_runs_of_all_sizes_take_one_scan(spark):
    texts = ["The straße\n is wide, İstanbul! a_b9 c", "x", "", "ſun Kelvin é1 ab", "ab", "  tail of text"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    df = rows.select("text", wordlists._runs(F.col("text"), [], [2, 5, 8]).alias("runs"))
    assert _nodes(df).count("regexp_extract_all(") == 1
    for r in df.collect():
        for n in (2, 5, 8):
            one = rows.where(F.col("text") == r.text).select(wordlists._runs(F.col("text"), [], [n]).alias("runs")).first().runs
            assert set(one) <= set(r.runs)
        shown = {r.text[i:].replace(" ", "").replace("\n", "")[:2].lower() for i in range(len(r.text)) if re.match(r"[A-Za-z0-9_]", r.text[i]) and (i == 0 or not re.match(r"[A-Za-z0-9_]", r.text[i - 1]))}
        assert {x[1:] for x in r.runs if len(x) == 3} >= {s for s in shown if len(s) == 2 and s.isascii()}
