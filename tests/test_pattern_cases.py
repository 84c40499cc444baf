from quillveil.operators.detect import detect

# Fixed values: (pattern, texts in which it is found, texts in which it isn't).
CASES = [
    ("SSN (US)", ["123-45-6789", "123 45 6789", "123456789", "SSN: 987-65-4321", "900-12-3456"], ["000-12-3456", "666-12-3456", "123-00-3456", "123-45-0000", "12-345-6789", "1234567890"]),
    ("Email", ["user@example.com", "john.doe@company.org", "name+tag@domain.co.uk", "user123@test-domain.com", "Contact: admin@example.com", "my.email_2024@company-site.io", "user name@example.com"], ["@example.com", "user@", "user@.com", "not-an-email"]),
    ("Phone (US)", ["(212) 456-7890", "212-456-7890", "212.456.7890", "2124567890", "+1-212-456-7890", "+1 (212) 456-7890"], ["123-4567", "55-123-4567", "(555) 123-4567"]),
    ("Phone (International)", [], ["+44 20 71234567", "+33 142868200", "+86 13800138000", "+81-3-12345678", "+49 3012345678", "+123456789012345", "+1-2"]),
    ("Phone (China Mobile)", ["138-0013-8000", "13800138000", "158 0013 8000", "186-1234-5678", "199-8888-8888"], ["128-0013-8000", "238-0013-8000", "1380013800"]),
    ("Phone (China Landline)", ["010-12345678", "021-12345678", "0755-1234567", "0571-12345678", "0851 12345678"], ["10-12345678", "0755-123456"]),
    ("Credit Card (Visa)", ["4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1111", "4012888888881881"], ["4532-1234-5678-9012", "5532-1234-5678-9010", "4532-1234-567"]),
    ("Credit Card (Mastercard)", ["5500 0000 0000 0004", "5500-0000-0000-0004", "2221 0000 0000 0009"], ["5500-0000-0000-0005", "4500-0000-0000-0004"]),
    ("Credit Card (Amex)", ["3782 822463 10005", "3782-822463-10005", "371449635398431"], ["3782-822463-10006", "3882-822463-10005", "3782-822463-100"]),
    ("Credit Card (UnionPay)", ["6212345678901232"], ["6234567890123458", "6212345678901266", "6312345678901234", "621234567890123"]),
    ("Date (MM/DD/YYYY)", ["01/15/2024", "12/31/2023", "1/1/2024", "06/30/1999"], ["13/01/2024", "01/32/2024", "1/1/1899", "2024/01/15"]),
    ("Date (YYYY-MM-DD)", ["2024-01-15", "2023-12-31", "1999-06-30"], ["2024-13-01", "2024-01-32", "01-15-2024"]),
    ("Date (Chinese)", ["2024年1月15日", "2024年01月15日", "2023年12月31日", "1999年6月30日"], ["2024年13月15日", "2024年1月32日", "1899年1月15日"]),
    ("Date (Month DD, YYYY)", ["January 15, 2024", "December 31, 2023", "March 1, 1999", "January 32, 2024"], ["Jan 15, 2024"]),
    ("Chinese National ID", [], ["110101199001010010", "31010519900307234X", "440305199003071234", "11010119900307234", "1101011990030723456", "11010119900307234A"]),
    ("Chinese Passport (Current)", ["EA1234567", "EB9876543", "EG1234567"], ["E1234567", "EA12345678", "E12345678", "EP1234567"]),
    ("US Passport", ["C12345678", "A98765432", "Z11111111"], ["AB1234567", "123456789", "AB123456", "12345678"]),
    ("IP Address (IPv4)", ["192.168.1.1", "8.8.8.8", "10.0.0.1", "255.255.255.255", "192.168.1.1.1"], ["256.1.1.1", "192.168.1"]),
    ("IP Address (IPv6)", ["2001:0db8:85a3:0000:0000:8a2e:0370:7334"], ["2001:db8:85a3::8a2e:370:7334", "::1", "fe80::1", "::gggg", "192.168.1.1"]),
    ("URL (with protocol)", ["https://example.com", "http://www.example.org", "https://subdomain.example.com/path/to/page", "https://example.com?query=test", "https://example.com#section"], ["ftp://example.com", "example.com", "http://"]),
    ("URL (without protocol)", ["www.example.com", "www.subdomain.example.com/path", "www.example.org/page?query=test"], ["example.com", "http://example.com", "document.pdf"]),
    ("Crypto (Bitcoin)", ["1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa", "3J98t1WpEZ73CNmYviecrnyiWrnqRhWNLy", "bc1qar0srrr7xfkvy5l643lydnw9re59gtzzwf5mdq", "1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfN"], ["0A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa", "1ABC"]),
]


def test_all_patterns_on_their_cases(spark):
    cases = [(name, t, yes) for name, found, missed in CASES for t, yes in [*((t, True) for t in found), *((t, False) for t in missed)]]
    assert len(cases) > 145
    rows = spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(cases)], "id int, text string")
    got = {(r.id, r.pattern_name) for r in detect(rows, use_scripts=False).collect()}
    assert [(name, t) for i, (name, t, yes) in enumerate(cases) if ((i, name) in got) != yes] == []


def test_the_match_within_a_longer_text(spark):
    rows = spark.createDataFrame([(1, "user name@example.com"), (2, "192.168.1.1.1")], "id int, text string")
    got = {(r.id, r.text) for r in detect(rows, use_scripts=False).collect()}
    assert {(1, "name@example.com"), (2, "192.168.1.1")} <= got
