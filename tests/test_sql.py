import json

from pyspark.sql import functions as F

from quillveil import queries, sql as S
from quillveil.functions.patterns import CATALOGUE
from quillveil.operators.detect import detect
from quillveil.sources import settings

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["pattern_ordinal", "pattern_name", "entity_type", "text", "text_index", "confidence", "context_text"]


def test_sql_finds_what_detection_finds(spark):
    S.register(spark)
    rows = queries.records(spark, SMALL).unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "1990 51900 111 11010519491231002x, 11010519491331002X")], "rec_id long, text string"))
    rows.createOrReplaceTempView("sql_records")
    want = sorted(map(tuple, detect(rows, use_scripts=False).select("rec_id", *COLUMNS).collect()))
    table = spark.sql(f"SELECT r.rec_id, {', '.join('e.' + c for c in COLUMNS)} FROM sql_records r, LATERAL entities_in(r.text) e")
    assert sorted(map(tuple, table.collect())) == want and len(want) > 100
    array = spark.sql("SELECT rec_id, inline(f) FROM (SELECT rec_id, find_entities(text) AS f FROM sql_records)")
    assert sorted(map(tuple, array.collect())) == want


def test_users_patterns(spark):
    entries = [
        {"id": "a", "name": "Case", "pattern": r"CASE-\d{4}", "entityType": "CUSTOM", "confidence": 0.5, "contextKeywords": ["File"], "contextWindowSize": 12, "confidenceBoost": 1.5, "examples": ["CASE-1234"]},
        {"id": "b", "pattern": r"\d{16}", "entityType": "CREDIT_CARD", "validator": "luhn"},
        {"id": "c", "pattern": "("}, {"id": "d", "pattern": "x*"}, {"id": "e", "pattern": "x", "entityType": "NONE"}, {"id": "f", "pattern": "x", "confidence": 2}, {"id": "g", "pattern": "x", "validator": "none"},
        {"id": "h", "pattern": "x", "examples": ["y"]}, {"id": "i", "pattern": r"CASE-\d{4}"}, {"id": "j"}, 7,
    ]
    given = settings.load(settings.export(custom=entries))["custom"]
    good, errors = S.custom_patterns(spark, given)
    assert [p.name for p in good] == ["Case", "b"] and [e.split(":")[0] for e in errors] == ["c", "d", "e", "f", "g", "h", "i", "j", "11"]
    assert S.custom_patterns(spark, "{")[0] == [] and S.custom_patterns(spark, json.dumps(entries[:1]))[1] == []
    patterns = [*CATALOGUE, *good]
    S.register(spark, patterns, "find_more", "more_in")
    df = spark.createDataFrame([(1, "file CASE-1234, CASE-12345 and a@b.cc"), (2, "4111111111111111 4111111111111112")], "doc_id int, text string")
    df.createOrReplaceTempView("sql_docs")
    got = sorted(map(tuple, spark.sql(f"SELECT d.doc_id, {', '.join('e.' + c for c in COLUMNS)} FROM sql_docs d, LATERAL more_in(d.text) e").collect()))
    assert got == sorted(map(tuple, detect(df, patterns=patterns, use_scripts=False).select("doc_id", *COLUMNS).collect()))
    own = [r for r in got if r[2] in ("Case", "b")]
    assert [(r[4], r[6]) for r in own] == [("CASE-1234", 0.75), ("CASE-1234", 0.5), ("4111111111111111", 1.0)]
    assert df.select(F.expr("find_more(text)")).count() == 2
