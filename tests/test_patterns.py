import pytest
from pyspark.sql import functions as F

from quillveil.functions import scripts, text as X, words
from quillveil.functions.patterns import BY_NAME, CATALOGUE, for_scripts
from quillveil.functions.words import Word
from quillveil.operators.detect import detect

# Fixed values: (pattern, text, whether it is found).
CASES = [
    ("SSN (US)", "123-45-6789", True), ("SSN (US)", "900-12-3456", True), ("SSN (US)", "666-12-3456", False), ("SSN (US)", "1234567890", False), ("SSN (US)", "123-00-3456", False),
    ("Email", "name+tag@domain.co.uk", True), ("Email", "user@.com", False), ("Email", "user name@example.com", True),
    ("Phone (US)", "(212) 456-7890", True), ("Phone (US)", "(555) 123-4567", False), ("Phone (US)", "123-4567", False),
    ("Phone (International)", "+44 20 71234567", False), ("Phone (China Mobile)", "158 0013 8000", True), ("Phone (China Mobile)", "128-0013-8000", False), ("Phone (China Mobile)", "电话13800138000", True),
    ("Phone (China Landline)", "0755-1234567", True), ("Credit Card (Visa)", "4111 1111 1111 1111", True), ("Credit Card (Visa)", "4532-1234-5678-9012", False),
    ("Credit Card (Mastercard)", "2221 0000 0000 0009", True), ("Credit Card (Amex)", "3782 822463 10005", True), ("Credit Card (UnionPay)", "6212345678901232", True), ("Credit Card (Discover)", "6011-0000-0000-0004", True),
    ("Credit Card (Generic)", "4111-1111-1111-1111", True), ("Date (MM/DD/YYYY)", "13/01/2024", False), ("Date (DD/MM/YYYY)", "13/01/2024", True), ("Date (YYYY-MM-DD)", "2024-01-15", True), ("Date (Chinese)", "2024年1月15日", True),
    ("Date (Month DD, YYYY)", "January 32, 2024", True), ("Date (Month DD, YYYY)", "Jan 15, 2024", False), ("Chinese National ID", "31010519900307234X", False), ("Chinese National ID", "11010519491231002X", True),
    ("Chinese Passport (Current)", "EP1234567", False), ("Chinese Passport (Current)", "EA1234567", True), ("Chinese Passport (Legacy)", "E12345678", True), ("US Passport", "C12345678", True),
    ("IP Address (IPv4)", "192.168.1.1.1", True), ("IP Address (IPv6)", "2001:db8:85a3::8a2e:370:7334", False), ("IP Address (IPv6)", "2001:0db8:85a3:0000:0000:8a2e:0370:7334", True),
    ("URL (with protocol)", "https://example.com?query=test", True), ("URL (without protocol)", "document.pdf", False), ("URL (without protocol)", "www.example.com", True), ("Crypto (Bitcoin)", "bc1qar0srrr7xfkvy5l643lydnw9re59gtzzwf5mdq", True),
]


def test_patterns(spark):
    rows = spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(CASES)], "id int, text string")
    found = {(r.id, r.pattern_name) for r in detect(rows, use_scripts=False).collect()}
    assert [(n, t) for i, (n, t, yes) in enumerate(CASES) if ((i, n) in found) != yes] == []


def test_offsets_contexts_and_scores(spark):
    text = "😀 My SSN is 123-45-6789, not 000-45-6789, or 123-45-6789 again"
    rows = detect(spark.createDataFrame([(1, text)], "id int, text string")).orderBy("text_index").collect()
    assert [(r.text_index, r.utf16_index, text[r.text_index : r.text_index + len(r.text)]) for r in rows] == [(12, 13, "123-45-6789"), (45, 46, "123-45-6789")]
    assert [r.confidence for r in rows] == [0.85 * 1.15, 0.85] and rows[0].context_text.startswith("😀 My")
    assert detect(spark.createDataFrame([(1, None), (2, "")], "id int, text string")).count() == 0


# Fixed values: (word, case-sensitive, whole, text, whether it is found).
WORDS = [
    ("password", False, True, "pass \n word", True), ("password", False, True, "p a s s w o r d", True), ("password", False, True, "mypassword", False), ("Password", True, True, "PASSWORD", False),
    ("pass", False, False, "compass", True), ("密码", False, True, "这是密码测试", False), ("密码", False, True, "「密码」", True), ("密码", False, False, "这是密码测试", True), ("パスワード", False, True, "これはパスワードです", False),
    ("비밀번호", False, True, "비밀번호는", False), ("كلمة", False, True, "كَلِمَة", True), ("סיסמה", False, True, "סִיסְמָה", True), ("पासवर्ड", False, True, "पासवर्ड।", True), ("รหัสผ่าน", False, True, "นี่คือ รหัสผ่าน ของฉัน", True),
    ("пароль", False, True, "ПаРоЛь", True), ("пароль", False, True, "мойпароль", False), ("test@123", False, False, "test\n@\n123", True), ("12345", False, True, "123456", False), ("a.b", False, False, "axb", False),
]


def test_words(spark):
    for word, case, whole, text, yes in WORDS:
        df = spark.createDataFrame([(text,)], "text string")
        assert df.select(F.col("text").rlike(words.regex(Word(word, case, whole)))).first()[0] == yes, (word, text)


def test_word_lists():
    a = words.add([], Word("x"))
    with pytest.raises(ValueError):
        words.add(a, Word("x"))
    with pytest.raises(ValueError):
        Word(" ")
    assert words.delete(words.update(a, a[0].id, word="y"), a[0].id) == []


# Texts and the scripts they use.
SCRIPTS = [
    ("This is a sample English text with some words and numbers 12345.", ["latin"]), ("姓名：张三，电话：138-0013-8000，邮箱：test@example.com", ["chinese", "latin"]), ("これは日本語のテキストです。とても長い。", ["japanese"]),
    ("이것은 한국어 문서입니다. 중요한 정보가 있습니다.", ["korean"]), ("Это текст на русском языке.", ["cyrillic"]), ("123-45-6789", ["unknown"]), ("This is a mixed document with some 日本語テキスト included.", ["japanese", "latin"]),
]


def test_scripts(spark):
    df = scripts.with_scripts(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SCRIPTS)], "i int, text string"), "text", "s", "c")
    assert {r.i: sorted(r.s) for r in df.collect()} == {i: sorted(s) for i, (_, s) in enumerate(SCRIPTS)}
    shares = df.where("i = 0").select(scripts.script_statistics(F.col("c"))).first()[0]
    assert shares.latin == 100.0


def test_patterns_of_scripts():
    names = {p.name for p in for_scripts(["japanese"])}
    assert {"Date (Chinese)", "Email"} <= names and not names & {"Phone (China Mobile)", "US Passport"}
    assert BY_NAME["Credit Card (Visa)"].best == 0.6 and len(CATALOGUE) == 26


def test_text_helpers(spark):
    df = spark.createDataFrame([("a.b.pdf", 0), ("x", 1536)], "n string, s long")
    rows = df.select(X.output_name(F.col("n")), X.extension(F.col("n")), X.without_extension(F.col("n")), X.file_size(F.col("s"))).collect()
    assert [tuple(r) for r in rows] == [("a.b-REDACTED.pdf", "pdf", "a.b", "0 Bytes"), ("x-REDACTED", "", "x", "1.5 KB")]
    dates = spark.createDataFrame([("D:20240102030405+02'00'",), ("2024-01-02T03:04:05Z",), ("D:2024",), ("no",), ("D:20249999",)], "d string").select(X.iso_date(F.col("d"))).collect()
    assert [r[0] for r in dates] == ["2024-01-02T03:04:05+02:00", "2024-01-02T03:04:05Z", "2024-01-01T00:00:00Z", None, None]
    for n in (0, 1, 1999, 2000, 2001, 3801, 5000):
        t = "".join(chr(97 + i % 26) for i in range(n))
        got = spark.createDataFrame([(t,)], "t string").select(X.chunks(F.col("t"))).first()[0]
        assert all(t[c.offset : c.offset + 2000] == c.text for c in got) and (got[-1].offset + len(got[-1].text) >= n)
    assert X.search_variants("ab") == ["ab"] and X.search_variants("a-\nb") == ["a-\nb", "a\nb", "ab", "a-b"]
