"""The registered queries of the library's own operators, and their equivalents in SQL.

Each reads the given tables whole. `records` is derived from `customer`: a text a row that holds, by turns, all kinds of
values that the catalogue knows, in several scripts, so that the work on them grows with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .config import HIGH, LOW, MEDIUM, THRESHOLDS, TYPES, DetectionConfig
from .functions import scripts as S, text as X
from .functions.patterns import BY_NAME, CATALOGUE, EDGE, Pattern
from .functions.words import Word
from .operators import audit, dedupe, layout, ner, redact, review, sanitize
from .operators.detect import detect, find_occurrences
from .plans import analysis
from .sources import docx, files
from .storage import spread

RECORDS = """
SELECT c_custkey AS rec_id, CASE c_custkey % 12
  WHEN 0 THEN concat('My SSN is ', lpad(concat('', 100 + c_custkey % 800), 3, '0'), '-', lpad(concat('', c_custkey % 90), 2, '0'), '-', lpad(concat('', c_custkey % 7000), 4, '0'), ' and my phone is (', 200 + c_custkey % 700, ') ', 200 + c_custkey % 500, '-', 1000 + c_custkey % 8000, ', thanks.')
  WHEN 1 THEN concat('Please charge credit card number 4111 1111 1111 ', 1000 + c_custkey % 8000, ' or 5500-0000-0000-', lpad(concat('', c_custkey % 9000), 4, '0'), ' for ', c_name)
  WHEN 2 THEN concat('Born on ', 1 + c_custkey % 12, '/', 1 + c_custkey % 28, '/19', 50 + c_custkey % 49, ', moved ', 2000 + c_custkey % 25, '-0', 1 + c_custkey % 9, '-1', c_custkey % 10, ', left January ', 1 + c_custkey % 28, ', 2019 for good')
  WHEN 3 THEN concat('姓名：张三，电话：13', c_custkey % 10, '-', 1000 + c_custkey % 9000, '-', 1000 + c_custkey % 8999, '，邮箱：user', c_custkey, '@example.com，座机：010-', 10000000 + c_custkey)
  WHEN 4 THEN concat('身份证号码是11010519491231002X和护照EA', 1000000 + c_custkey, '以及旧护照E', 10000000 + c_custkey, '，签发于', 2000 + c_custkey % 25, '年', 1 + c_custkey % 12, '月', 1 + c_custkey % 28, '日，请保管好这些证件')
  WHEN 5 THEN concat('The server at 10.', c_custkey % 300, '.', c_custkey % 256, '.7 and 2001:0db8:85a3:0000:0000:8a2e:0370:', 1000 + c_custkey % 8999, ' mirrors https://www', c_custkey, '.example.com/a/b?q=', c_custkey, ' twice')
  WHEN 6 THEN concat('US passport number C', 10000000 + c_custkey, ' was found near www.site', c_custkey, '.org/path, no more words')
  WHEN 7 THEN concat('これは日本語のテキストです。日付は', 2000 + c_custkey % 25, '年', 1 + c_custkey % 12, '月1日、連絡先は user', c_custkey, '@example.co.jp です')
  WHEN 8 THEN concat('Это текст на русском языке, карта 6212345678901', 100 + c_custkey % 900, ' и почта a', c_custkey, '@почта.рф или b@mail.ru')
  WHEN 9 THEN concat('Send coins to 1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa or call me by phone: 212.', 200 + c_custkey % 700, '.', 1000 + c_custkey % 8000, ' before 31/12/20', 10 + c_custkey % 15)
  WHEN 10 THEN concat('passport M', 10000000 + c_custkey, ' Amex 3782 822463 1000', c_custkey % 10, ' Discover 6011-0000-0000-', lpad(concat('', c_custkey % 9000), 4, '0'), ' number ', c_custkey)
  ELSE concat(c_custkey % 1000, '-45-6789') END AS text
FROM customer
"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "text")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = spread(_table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey")
    return spark.sql(RECORDS.replace("FROM customer", "FROM {customer}"), customer=customers)


# --- SQL, put together from the catalogue ---------------------------------------------------------------------------


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _re2(p: Pattern) -> str:
    """The pattern in the dialect of the other engine, whose word boundary is ASCII; what its look-ahead excludes is
    excluded by the validator."""
    return p.regex.replace(EDGE, r"\b").replace("(?!000|666)", "").replace("(?!00)", "").replace("(?!0000)", "").replace(r"\x0B", r"\v")


_D = "regexp_replace(v, '[^0-9]', '', 'g')"
_AREA = f"substr({_D}, CASE WHEN length({_D}) = 11 THEN 2 ELSE 1 END, 3)"
VALID_SQL = {
    None: "true",
    "luhn": f"(length({_D}) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length({_D}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr({_D}, length({_D}) + 1 - i, 1)::INT WHEN substr({_D}, length({_D}) + 1 - i, 1)::INT > 4 THEN substr({_D}, length({_D}) + 1 - i, 1)::INT * 2 - 9 ELSE substr({_D}, length({_D}) + 1 - i, 1)::INT * 2 END)) % 10 = 0)",
    "ssn": f"(length({_D}) = 9 AND substr({_D}, 1, 3) NOT IN ('000', '666') AND substr({_D}, 4, 2) <> '00' AND substr({_D}, 6, 4) <> '0000')",
    "us_phone": f"(length({_D}) IN (10, 11) AND substr({_AREA}, 1, 1) NOT IN ('0', '1') AND NOT ({_AREA} = '555' AND substr({_D}, CASE WHEN length({_D}) = 11 THEN 5 ELSE 4 END, 1) = '1'))",
    "international_phone": f"(length({_D}) BETWEEN 8 AND 15)",
    "china_mobile": f"regexp_full_match({_D}, '1(3[0-9]|4[5-9]|5[0-35-9]|6[2567]|7[0-8]|8[0-9]|9[0-35-9])[0-9]{{8}}')",
    "chinese_id": "(substr(v, 7, 4)::INT BETWEEN 1900 AND 2100 AND substr('10X98765432', (list_sum(list_transform(range(1, 18), lambda i: substr(v, i, 1)::INT * ((2 ** (18 - i))::BIGINT % 11))) % 11)::INT + 1, 1) = upper(substr(v, 18, 1)))",
}


def _matches_sql(source: str, key: str, p: Pattern) -> str:
    """(key, text_index, v): valid matches with their places."""
    re = _q(_re2(p))
    return f"""SELECT {key}, pos AS text_index, v FROM (
  SELECT {key}, (coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(a[1:i - 1], lambda x: length(x))), 0))::INT AS pos, a[i] AS v
  FROM (SELECT {key}, a, g, unnest(range(1, len(a) + 1)) AS i FROM (SELECT {key}, regexp_extract_all(text, {re}) AS a, regexp_split_to_array(text, {re}) AS g FROM {source}))) WHERE {VALID_SQL[p.validator]}"""


def _scripts_sql(source: str, key: str) -> str:
    """(key, counts of all scripts, other, total, scripts)."""
    cut = f"substr(coalesce(text, ''), 1, {S.SAMPLE})"
    counts = [f"len(regexp_extract_all({cut}, {_q('[' + r + ']')})) AS {k}" for k, r in S.RANGES.items()]
    counts.append(f"len(regexp_extract_all({cut}, {_q('[^' + ''.join(S.RANGES.values()) + S.IGNORED.replace(chr(92) + 'x0B', chr(92) + 'v') + ']')})) AS other")
    names = [*S.RANGES, "other"]
    listed = ", ".join(f"CASE WHEN {source_} * 100.0 / total > {limit} THEN '{name}' END" for name, source_, limit in S.LIMITS)
    mixed = "CASE WHEN cjk * 100.0 / total > 20 AND latin * 100.0 / total > 20 AND NOT japanese * 100.0 / total > 5 AND NOT cjk * 100.0 / total > 30 THEN 'cjk' END"
    tops = " ".join(f"WHEN {k} = top THEN '{k}'" for k in names)
    return f"""SELECT *, CASE WHEN total < 10 THEN ['unknown'] WHEN len(found) > 0 THEN found WHEN top * 100.0 / total > 10 AND CASE {tops} END <> 'other' THEN [CASE {tops} END] ELSE ['unknown'] END AS scripts FROM (
  SELECT *, list_filter([{listed}, {mixed}], lambda x: x IS NOT NULL) AS found, greatest({', '.join(names)}) AS top FROM (
    SELECT *, {' + '.join(names)} AS total FROM (SELECT {key}, {', '.join(counts)} FROM {source})))"""


def _detect_sql(source: str, key: str, patterns=CATALOGUE, use_scripts: bool = True) -> str:
    parts = []
    for i, p in enumerate(CATALOGUE):
        if p not in patterns:
            continue
        gate = f" WHERE {key} IN (SELECT {key} FROM scr WHERE len(list_intersect(scripts, {list(p.scripts)!r})) > 0)" if p.scripts and use_scripts else ""
        words = f"[{', '.join(map(_q, p.keywords))}]::VARCHAR[]"
        parts.append(f"SELECT {key}, {i} AS o, {_q(p.name)} AS pattern_name, '{p.type}' AS entity_type, {p.confidence}::DOUBLE AS conf, {p.boost}::DOUBLE AS boost, {p.window} AS w, {words} AS kw, text_index, v FROM ({_matches_sql(source, key, p)}){gate}")
    body = " UNION ALL ".join(parts)
    near = "lower(substr(t.text, greatest(text_index - w, 0) + 1, text_index + length(v) + w - greatest(text_index - w, 0)))"
    return f"""SELECT {key}, o AS pattern_ordinal, pattern_name, entity_type, v AS text, text_index,
  least(1.0, conf * CASE WHEN len(list_filter(kw, lambda k: contains({near}, k))) > 0 THEN boost ELSE 1.0 END)::DOUBLE AS confidence,
  CASE WHEN text_index - 50 > 0 THEN '...' ELSE '' END || substr(t.text, greatest(text_index - 50, 0) + 1, text_index + length(v) + 50 - greatest(text_index - 50, 0)) || CASE WHEN text_index + length(v) + 50 < length(t.text) THEN '...' ELSE '' END AS context_text
  FROM (WITH scr AS ({_scripts_sql(source, key)}) {body}) d JOIN (SELECT {key}, text FROM {source}) t USING ({key})"""


R = f"({RECORDS})"
#: Keys of `documents` are unique, so that joins by them are exact.
DETECT_R, DETECT_D = _detect_sql(R, "rec_id"), _detect_sql("documents", "doc_id")
_ENTITY = ("pattern_ordinal", "pattern_name", "entity_type", "text", "text_index", "confidence", "context_text")


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(records(spark, sf_dir))


def _of_pattern(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = detect(documents(spark, sf_dir), patterns=[BY_NAME[name]], use_scripts=False)
        return found.select("doc_id", "text_index", F.col("text").alias("v"))

    return run, _matches_sql("documents", "doc_id", BY_NAME[name])


def _word_list() -> list[Word]:
    return [Word("the", id="1", created_at=0), Word("ond", whole_word=False, id="2", created_at=0), Word("电话", id="3", whole_word=False, created_at=0)]


def word_matches(spark, sf_dir):
    """Users' words in all documents, whole or in part, across line breaks."""
    found = detect(documents(spark, sf_dir), words=_word_list(), config=DetectionConfig(force_scripts=("unknown",)), patterns=())
    return found.groupBy("pattern_name").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


WORDS_SQL = """
SELECT * FROM (SELECT 'Predefined: the' AS pattern_name, sum(len(a))::BIGINT AS n, count_if(len(a) > 0) AS n_docs FROM (SELECT regexp_extract_all(text, '(?i)\\bt[ \\t]*\\n?[ \\t]*h[ \\t]*\\n?[ \\t]*e\\b') AS a FROM documents)
UNION ALL SELECT 'Predefined: ond', sum(len(a))::BIGINT, count_if(len(a) > 0) FROM (SELECT regexp_extract_all(text, '(?i)o[ \\t]*\\n?[ \\t]*n[ \\t]*\\n?[ \\t]*d') AS a FROM documents)
UNION ALL SELECT 'Predefined: 电话', sum(len(a))::BIGINT, count_if(len(a) > 0) FROM (SELECT regexp_extract_all(text, '电[ \\t]*\\n?[ \\t]*话') AS a FROM documents)) WHERE n > 0
"""


def script_statistics(spark, sf_dir):
    rows = S.with_scripts(records(spark, sf_dir), "text", "scripts", "s")
    return rows.select("rec_id", *(F.col(f"s.{k}").alias(k) for k in (*S.RANGES, "other", "total")), F.array_join("scripts", ",").alias("scripts"))


def document_scripts(spark, sf_dir):
    rows = S.with_scripts(documents(spark, sf_dir), "text", "found").select(F.array_join("found", ",").alias("scripts"))
    return rows.groupBy("scripts").agg(F.count("*").alias("n"))


def text_dedupe(spark, sf_dir):
    return dedupe.by_text(_entities(spark, sf_dir), ("rec_id",)).select("rec_id", *_ENTITY)


TEXT_DEDUPE_SQL = f"SELECT rec_id, {', '.join(_ENTITY)} FROM ({DETECT_R}) QUALIFY row_number() OVER (PARTITION BY rec_id, lower(text) ORDER BY confidence DESC, pattern_ordinal, text_index) = 1"


def _filtered(level: str):
    def run(spark, sf_dir):
        return review.config_filter(dedupe.by_text(_entities(spark, sf_dir), ("rec_id",)), DetectionConfig(level=level)).select("rec_id", *_ENTITY)

    return run, f"SELECT * FROM ({TEXT_DEDUPE_SQL}) WHERE confidence >= {THRESHOLDS[level]}"


def review_filter(spark, sf_dir):
    return review.review_filter(_entities(spark, sf_dir), [t for t in TYPES if t != "DATE"], ["medium"]).select("rec_id", *_ENTITY)


REVIEW_SQL = f"SELECT rec_id, {', '.join(_ENTITY)} FROM ({DETECT_R}) WHERE entity_type <> 'DATE' AND NOT (confidence >= {MEDIUM} AND confidence < {HIGH})"


def type_counts(spark, sf_dir):
    return review.counts_by_type(_entities(spark, sf_dir))


TYPES_SQL = f"SELECT t AS entity_type, count(e.rec_id) AS n FROM (SELECT unnest({list(TYPES)!r}) AS t) LEFT JOIN ({DETECT_R}) e ON e.entity_type = t GROUP BY t"


def band_counts(spark, sf_dir):
    return review.counts_by_band(review.confirm_confident(_entities(spark, sf_dir)))


BANDS_SQL = f"SELECT count_if(confidence >= {HIGH}) AS high, count_if(confidence >= {MEDIUM} AND confidence < {HIGH}) AS medium, count_if(confidence >= {LOW} AND confidence < {MEDIUM}) AS low, count_if(confidence >= {HIGH}) AS confirmed, bool_and(confidence >= {HIGH}) AS all_confirmed FROM ({DETECT_R})"


def entity_statistics(spark, sf_dir):
    s = review.statistics(_entities(spark, sf_dir))
    return s.select("total", F.round("mean_confidence", 9).alias("mean_confidence"), F.size("by_type").alias("n_types"), F.size("by_band").alias("n_bands"), F.try_element_at("by_type", F.lit("PHONE")).alias("phones"))


STATISTICS_SQL = f"SELECT count(*) AS total, round(avg(confidence), 9) AS mean_confidence, count(DISTINCT entity_type)::INT AS n_types, count(DISTINCT CASE WHEN confidence >= {HIGH} THEN 3 WHEN confidence >= {MEDIUM} THEN 2 WHEN confidence >= {LOW} THEN 1 ELSE 0 END)::INT AS n_bands, count_if(entity_type = 'PHONE') AS phones FROM ({DETECT_R})"


def entity_rollup(spark, sf_dir):
    return review.rollup(_entities(spark, sf_dir)).select("entity_type", "band", "n", F.round("mean_confidence", 9).alias("mean_confidence"))


ROLLUP_SQL = f"SELECT entity_type, band, count(*) AS n, round(avg(confidence), 9) AS mean_confidence FROM (SELECT *, CASE WHEN confidence >= {HIGH} THEN 'high' WHEN confidence >= {MEDIUM} THEN 'medium' WHEN confidence >= {LOW} THEN 'low' ELSE 'none' END AS band FROM ({DETECT_R})) GROUP BY ROLLUP (entity_type, band)"


def similar_counts(spark, sf_dir):
    return review.similar_counts(_entities(spark, sf_dir), ())


SIMILAR_SQL = f"SELECT text, entity_type, count(*) AS n FROM ({DETECT_R}) GROUP BY text, entity_type"


def redacted_emails(spark, sf_dir):
    found = detect(documents(spark, sf_dir), patterns=[BY_NAME["Email"]])
    return redact.redact(documents(spark, sf_dir), found).select("doc_id", F.sha2("redacted_text", 256).alias("sha256"), F.col("redacted_count").cast("long").alias("n"))


_EMAIL = _q(_re2(BY_NAME["Email"]))
EMAILS_SQL = f"SELECT doc_id, sha256(regexp_replace(text, {_EMAIL}, '[EMAIL]', 'g')) AS sha256, len(regexp_extract_all(text, {_EMAIL}))::BIGINT AS n FROM documents"


def redacted_documents(spark, sf_dir):
    """The flagship: detect, filter, resolve overlaps, redact."""
    return analysis.redacted(documents(spark, sf_dir)).select("doc_id", "redacted_text", "redacted_count")


def redacted_records(spark, sf_dir):
    return analysis.redacted(records(spark, sf_dir), key="rec_id").select("rec_id", "redacted_text", "redacted_count")


def text_chunks(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", F.explode(X.chunks(F.col("text"))).alias("c"))
    return rows.select("doc_id", F.col("c.offset").alias("offset"), F.sha2("c.text", 256).alias("sha256"))


CHUNKS_SQL = """SELECT doc_id, o::INT AS offset, sha256(CASE WHEN length(text) <= 2000 THEN text ELSE substr(text, o + 1, 2000) END) AS sha256
FROM (SELECT doc_id, text, unnest(CASE WHEN length(text) <= 2000 THEN [0] ELSE range(0, length(text) - 200, 1800) END) AS o FROM documents)"""


def occurrences(spark, sf_dir):
    return find_occurrences(documents(spark, sf_dir), "Of The").groupBy("doc_id").agg(F.count("*").alias("n"), F.min("text_index").alias("first"))


OCCURRENCES_SQL = "SELECT doc_id, len(regexp_extract_all(text, '(?i)of the'))::BIGINT AS n, length(regexp_split_to_array(text, '(?i)of the')[1])::INT AS first FROM documents WHERE regexp_matches(text, '(?i)of the')"


def file_listing(spark, sf_dir):
    """Names made of ids and sources, sizes of texts: which would be taken, by which reader, and named how."""
    d = _table(spark, sf_dir, "documents")
    name = F.concat("source", F.lit("."), F.col("doc_id").cast("string"), F.element_at(F.array(*map(F.lit, (".pdf", ".DOCX", ".txt", ""))), (F.col("doc_id") % 4 + 1).cast("int")))
    size = F.col("n_chars") * F.when(F.col("doc_id") % 7 == 0, 40_000).otherwise(1)
    rows = d.select("doc_id", name.alias("name"), size.alias("size"))
    return rows.select("doc_id", "name", files.admission(F.col("name"), F.col("size")).alias("refused"), files.route(F.col("name")).alias("format"), X.output_name(F.col("name")).alias("output"), X.extension(F.col("name")).alias("extension"), X.file_size(F.col("size")).alias("shown"))


FILES_SQL = """SELECT doc_id, name, CASE WHEN NOT regexp_matches(lower(name), '\\.(pdf|docx)$') THEN 'unsupported type' WHEN size > 52428800 THEN 'too large' END AS refused,
  CASE WHEN lower(name) LIKE '%.docx' THEN 'docx' ELSE 'pdf' END AS format, regexp_replace(name, '\\.([^.]*)$', '-REDACTED.\\1') AS output, lower(regexp_extract(name, '([^.]*)$', 1)) AS extension,
  CASE WHEN size = 0 THEN '0 Bytes' ELSE regexp_replace(regexp_replace(printf('%.2f', round(size / (1024.0 ** p)::DOUBLE, 2)), '0+$', ''), '\\.$', '') || ' ' || ['Bytes', 'KB', 'MB', 'GB'][p + 1] END AS shown
FROM (SELECT *, CASE WHEN size < 1024 THEN 0 WHEN size < 1048576 THEN 1 WHEN size < 1073741824 THEN 2 ELSE 3 END AS p FROM (
  SELECT doc_id, source || '.' || doc_id || ['.pdf', '.DOCX', '.txt', ''][doc_id % 4 + 1] AS name, n_chars * CASE WHEN doc_id % 7 = 0 THEN 40000 ELSE 1 END AS size FROM documents))"""


def _archives(spark, sf_dir):
    """Word archives made of the documents: a run a line, with marks that the audit counts."""
    d = spread(documents(spark, sf_dir), "doc_id")
    safe = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    runs = F.transform(F.split(safe, "\n"), lambda t: F.concat(F.lit('<w:r><w:t xml:space="preserve">'), t, F.lit("</w:t></w:r>")))
    k = F.col("doc_id")
    extra = F.concat(
        F.repeat(F.lit("<w:rPr><w:vanish/></w:rPr>"), (k % 3).cast("int")), F.repeat(F.lit('<w:ins w:id="1"><w:r><w:t></w:t></w:r></w:ins>'), (k % 4).cast("int")),
        F.repeat(F.lit('<w:del w:id="2"><w:r><w:delText>x</w:delText></w:r></w:del>'), (k % 2).cast("int")), F.repeat(F.lit('<w:bookmarkStart w:id="3"/>'), (k % 5).cast("int")),
    )
    body = F.concat(F.lit("<w:document><w:body><w:p>"), F.array_join(runs, ""), extra, F.lit("</w:p></w:body></w:document>"))
    parts = F.map_filter(F.create_map(
        F.lit("word/document.xml"), body, F.lit("word/comments.xml"), F.repeat(F.lit("<w:comment >c</w:comment>"), (k % 2).cast("int")),
        F.lit("docProps/core.xml"), F.concat(F.lit("<cp><dc:title>T"), k.cast("string"), F.lit("</dc:title></cp>")), F.lit("docProps/app.xml"), F.lit("<Company>ACME</Company><TotalTime>9</TotalTime>"),
        F.lit("customXml/item1.xml"), F.when(k % 6 == 0, F.lit("<a/>"))), lambda _, v: v.isNotNull() & (v != ""))
    return d.select("doc_id", F.transform_values(parts, lambda _, v: F.encode(v, "UTF-8")).alias("parts"))


def docx_text(spark, sf_dir):
    """Archives written, read again, and their texts and metadata taken out."""
    read = docx.entries(docx.written(_archives(spark, sf_dir)))
    t = docx.text_parts(F.col("parts"))
    rows = read.select("doc_id", "error", t.alias("t"))
    return rows.select("doc_id", F.sha2(docx.full_text(F.try_element_at("t", F.lit(docx.DOCUMENT))), 256).alias("sha256"), F.element_at(docx.metadata(F.col("t")), "title").alias("title"), F.col("error").isNull().alias("ok"))


DOCX_SQL = "SELECT doc_id, sha256(array_to_string(list_filter(string_split(text, chr(10)), lambda x: x <> ''), ' ')) AS sha256, 'T' || doc_id AS title, true AS ok FROM documents"


def hidden_content(spark, sf_dir):
    w = audit.docx_warnings(docx.text_parts(F.col("parts")))
    rows = _archives(spark, sf_dir).select("doc_id", w.alias("w"))
    return rows.select("doc_id", F.array_join(F.transform("w", lambda x: F.concat_ws(":", x["type"], F.coalesce(x["count"].cast("string"), F.lit("")))), ",").alias("warnings"), audit.summary(F.col("w")).alias("summary"), F.get(F.transform(F.filter("w", lambda x: x["type"] == "track_changes"), lambda x: x["details"]), F.lit(0)).alias("changes"))


HIDDEN_SQL = """SELECT doc_id, array_to_string(list_filter([CASE WHEN v > 0 THEN 'hidden_text:' || v END, CASE WHEN c > 0 THEN 'comments:' || c END, CASE WHEN i + d > 0 THEN 'track_changes:' || (i + d) END, CASE WHEN x > 0 THEN 'custom_xml:1' END, CASE WHEN b > 0 THEN 'bookmarks:' || b END], lambda y: y IS NOT NULL), ',') AS warnings,
  CASE WHEN h + m + l = 0 THEN 'No hidden content detected' ELSE 'Found ' || (h + m + l) || ' potential hidden content issue(s): ' || array_to_string(list_filter([CASE WHEN h > 0 THEN h || ' high severity' END, CASE WHEN m > 0 THEN m || ' medium severity' END, CASE WHEN l > 0 THEN l || ' low severity' END], lambda y: y IS NOT NULL), ', ') || '. Enable "Sanitize Document" to remove hidden content.' END AS summary,
  CASE WHEN i + d > 0 THEN array_to_string(list_filter([CASE WHEN i > 0 THEN i || ' insertion(s)' END, CASE WHEN d > 0 THEN d || ' deletion(s)' END], lambda y: y IS NOT NULL), ', ') END AS changes
FROM (SELECT *, (v > 0)::INT + (i + d > 0)::INT AS h, (c > 0)::INT + (x > 0)::INT AS m, (b > 0)::INT AS l FROM (
  SELECT doc_id, doc_id % 3 AS v, doc_id % 2 AS c, doc_id % 4 AS i, doc_id % 2 AS d, (doc_id % 6 = 0)::INT AS x, doc_id % 5 AS b FROM documents))"""


def sanitized_archives(spark, sf_dir):
    parts = sanitize.sanitized_parts(docx.text_parts(F.col("parts")))
    rows = _archives(spark, sf_dir).select("doc_id", parts.alias("p"))
    return rows.select("doc_id", F.array_join(F.array_sort(F.map_keys("p")), ",").alias("kept"), F.element_at("p", "docProps/app.xml").alias("app"), F.size(audit.docx_warnings(F.col("p"))).alias("n_warnings"), F.sha2(docx.full_text(F.element_at("p", "word/document.xml")), 256).alias("sha256"))


SANITIZED_SQL = """SELECT doc_id, 'docProps/app.xml,docProps/core.xml,word/document.xml' AS kept, '<Company></Company><TotalTime>0</TotalTime>' AS app, (doc_id % 3 > 0)::INT AS n_warnings,
  sha256(array_to_string(list_filter(string_split(text, chr(10)), lambda x: x <> ''), ' ')) AS sha256 FROM documents"""


def _pages(spark, sf_dir, dealt=False):
    """Documents as laid-out pages: a line a line of text, 12 units high; `dealt` out to all cores where costly work within the row follows."""
    d = documents(spark, sf_dir)
    d = (spread(d, "doc_id") if dealt else d).withColumn("lines", F.split("text", "\n"))
    line = lambda t, i: F.struct(t.alias("text"), F.lit(10.0).alias("x"), (i * 12.0).alias("y"), F.struct(F.lit(10.0).alias("x"), (i * 12.0).alias("y"), (F.length(t) * 5.0).alias("w"), F.lit(10.0).alias("h")).alias("bbox"))
    return d.select("doc_id", F.lit(1).alias("page_number"), F.lit(800.0).alias("height"), F.array(F.struct(F.transform("lines", line).alias("lines"))).alias("blocks"))


def page_items(spark, sf_dir):
    items = layout.text_items(_pages(spark, sf_dir))
    return items.groupBy("doc_id").agg(F.count("*").alias("n"), F.round(F.sum("width"), 3).alias("width"), F.min("y").alias("bottom"))


ITEMS_SQL = r"""SELECT doc_id, count(*) AS n, round(sum(length(w) / length(t) * (length(t) * 5.0)), 3)::DOUBLE AS width, min(800.0 - 12.0 * i - 10.0)::DOUBLE AS bottom FROM (
  SELECT doc_id, t, i, unnest(regexp_split_to_array(trim(t), '\s+')) AS w FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents)) WHERE w <> '' GROUP BY doc_id"""


def page_texts(spark, sf_dir):
    return layout.combined_text(layout.text_items(_pages(spark, sf_dir)), ("doc_id", "page_number")).select("doc_id", F.sha2("text", 256).alias("sha256"))


PAGES_SQL = r"""SELECT doc_id, sha256(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda t: array_to_string(list_filter(regexp_split_to_array(trim(t), '\s+'), lambda w: w <> ''), ' ')), lambda t: t <> ''), chr(10))) AS sha256 FROM documents WHERE regexp_matches(text, '\S')"""


def node_overlaps(spark, sf_dir):
    """E-mail matches and the lines of their documents that they touch."""
    spans = detect(documents(spark, sf_dir), patterns=[BY_NAME["Email"], BY_NAME["IP Address (IPv4)"]]).select("doc_id", F.col("text_index").alias("start"), (F.col("text_index") + F.length("text")).alias("end"))
    lines = documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("node", "str"))
    from pyspark.sql import Window

    at = F.coalesce(F.sum(F.length("str") + 1).over(Window.partitionBy("doc_id").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    nodes = lines.withColumn("start", at).withColumn("end", at + F.length("str"))
    return layout.overlapping(spans, nodes).select("doc_id", F.col("node").cast("long").alias("node"), F.col("from").cast("long").alias("from"), F.col("to").cast("long").alias("to"))


OVERLAPS_SQL = f"""WITH s AS (SELECT doc_id, text_index AS a, text_index + length(text) AS b FROM ({_detect_sql('documents', 'doc_id', (BY_NAME['Email'], BY_NAME['IP Address (IPv4)']))})),
n AS (SELECT *, coalesce(sum(length(str) + 1) OVER (PARTITION BY doc_id ORDER BY node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS x FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS str, unnest(range(0, len(string_split(text, chr(10))))) AS node FROM documents))
SELECT doc_id, node::BIGINT AS node, greatest(a - x, 0)::BIGINT AS "from", (least(b, x + length(str)) - x)::BIGINT AS "to" FROM s JOIN n USING (doc_id) WHERE x < b AND x + length(str) > a"""


def entity_groups(spark, sf_dir):
    """Words of the benchmark as a model's tokens, tagged by their length, joined into entities."""
    words = _table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", r"\s+")).alias("place", "word")).where("word <> ''")
    n = F.length("word")
    tag = F.when(n > 9, "B-PER").when(n > 7, "I-PER").when(n > 5, "B-ORG").when(n > 4, "I-ORG").otherwise("I-LOC")
    tokens = words.select("item_id", "place", F.when(n == 3, F.concat(F.lit("##"), F.col("word"))).otherwise(F.col("word")).alias("word"), tag.alias("entity"), (n / 100.0).alias("score"), F.col("place").alias("start"), (F.col("place") + 1).alias("end"))
    return ner.grouped(tokens, ("item_id",)).select("item_id", "text", "entity_type", F.round("confidence", 9).alias("confidence"), F.col("start").cast("long").alias("start"))


GROUPS_SQL = r"""WITH t AS (SELECT item_id, p, w, CASE WHEN length(w) > 9 THEN 'B-PER' WHEN length(w) > 7 THEN 'I-PER' WHEN length(w) > 5 THEN 'B-ORG' WHEN length(w) > 4 THEN 'I-ORG' ELSE 'I-LOC' END AS tag, length(w) / 100.0 AS s
  FROM (SELECT item_id, unnest(regexp_split_to_array(text, '\s+')) AS w, unnest(range(0, len(regexp_split_to_array(text, '\s+')))) AS p FROM benchmark) WHERE w <> ''),
a AS (SELECT *, sum(CASE WHEN length(w) = 3 AND row_number_ > 1 THEN 0 ELSE 1 END) OVER (PARTITION BY item_id ORDER BY p) AS g FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY p) AS row_number_ FROM t)),
b AS (SELECT item_id, g, string_agg(w, '' ORDER BY p) AS word, min_by(tag, p) AS tag, min_by(s, p) AS s, min(p) AS st FROM a GROUP BY item_id, g),
c AS (SELECT *, coalesce((lag(substr(tag, 3)) OVER (PARTITION BY item_id ORDER BY g) <> substr(tag, 3)) OR tag LIKE 'B-%', true)::INT AS fresh FROM b),
d AS (SELECT *, sum(fresh) OVER (PARTITION BY item_id ORDER BY g) AS grp FROM c)
SELECT item_id, trim(string_agg(word, ' ' ORDER BY g)) AS text, CASE substr(min_by(tag, g), 3) WHEN 'PER' THEN 'PERSON' WHEN 'ORG' THEN 'ORG' ELSE 'LOC' END AS entity_type, round(avg(s), 9)::DOUBLE AS confidence, min(st)::BIGINT AS start FROM d GROUP BY item_id, grp HAVING length(trim(string_agg(word, ' ' ORDER BY g))) >= 2"""


def streamed_counts(spark, sf_dir):
    """The documents as a stream of files, detected and written once; counts of what was written."""
    from .storage import shared_dir
    from .streaming import detection

    path = shared_dir(spark)
    source = detection.source(spark, f"{sf_dir}/documents.parquet", _table(spark, sf_dir, "documents").schema)
    detection.started(detection.entities(source.select("doc_id", "text")).select("doc_id", "entity_type", "confidence"), f"{path}/out", f"{path}/log").awaitTermination()
    return spark.read.schema("doc_id long, entity_type string, confidence double").parquet(f"{path}/out").groupBy("entity_type").agg(F.count("*").alias("n"))


STREAMED_SQL = f"SELECT entity_type, count(*) AS n FROM ({DETECT_D}) WHERE confidence >= {MEDIUM} GROUP BY entity_type"

_ALL = {
    "email_matches": _of_pattern("Email"), "us_phone_matches": _of_pattern("Phone (US)"), "ipv4_matches": _of_pattern("IP Address (IPv4)"), "card_matches": _of_pattern("Credit Card (Generic)"),
    "iso_date_matches": _of_pattern("Date (YYYY-MM-DD)"), "url_matches": _of_pattern("URL (with protocol)"),
    "document_detection": (lambda s, d: detect(documents(s, d)).select("doc_id", *_ENTITY), f"SELECT doc_id, {', '.join(_ENTITY)} FROM ({DETECT_D})"),
    "record_detection": (lambda s, d: _entities(s, d).select("rec_id", *_ENTITY), f"SELECT rec_id, {', '.join(_ENTITY)} FROM ({DETECT_R})"),
    "word_matches": (word_matches, WORDS_SQL),
    "script_statistics": (script_statistics, f"SELECT rec_id, {', '.join([*S.RANGES, 'other', 'total'])}, array_to_string(scripts, ',') AS scripts FROM ({_scripts_sql(R, 'rec_id')})"),
    "document_scripts": (document_scripts, f"SELECT array_to_string(scripts, ',') AS scripts, count(*) AS n FROM ({_scripts_sql('documents', 'doc_id')}) GROUP BY 1"),
    "text_dedupe": (text_dedupe, TEXT_DEDUPE_SQL),
    "config_filter_conservative": _filtered("conservative"), "config_filter_balanced": _filtered("balanced"), "config_filter_aggressive": _filtered("aggressive"),
    "review_filter": (review_filter, REVIEW_SQL), "type_counts": (type_counts, TYPES_SQL), "band_counts": (band_counts, BANDS_SQL), "entity_statistics": (entity_statistics, STATISTICS_SQL),
    "entity_rollup": (entity_rollup, ROLLUP_SQL), "similar_counts": (similar_counts, SIMILAR_SQL), "redacted_emails": (redacted_emails, EMAILS_SQL),
    "redacted_documents": (redacted_documents, None), "redacted_records": (redacted_records, None), "text_chunks": (text_chunks, CHUNKS_SQL), "occurrences": (occurrences, OCCURRENCES_SQL),
    "file_listing": (file_listing, FILES_SQL), "docx_text": (docx_text, DOCX_SQL), "hidden_content": (hidden_content, HIDDEN_SQL), "sanitized_archives": (sanitized_archives, SANITIZED_SQL),
    "page_items": (page_items, ITEMS_SQL), "page_texts": (page_texts, PAGES_SQL), "node_overlaps": (node_overlaps, OVERLAPS_SQL), "entity_groups": (entity_groups, GROUPS_SQL), "streamed_counts": (streamed_counts, STREAMED_SQL),
}
QUERIES = {name: run for name, (run, _) in _ALL.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in _ALL.items() if sql}
