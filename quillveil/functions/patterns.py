"""The catalogue of patterns, in Java's regular expression syntax."""

from __future__ import annotations

from dataclasses import dataclass

from ..config import BOOST, CONTEXT_WINDOW

#: An ASCII word boundary: Java's own \b also sees letters of other scripts, and would miss numbers next to them.
B = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
#: The same for the catalogue, in Java's own class, which is ASCII, too, and looked up in a table; under (?u), which users' words need, both differ.
EDGE = r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))"
#: White space as scripts in browsers have it, for use within a class.
WS = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


@dataclass(frozen=True)
class Pattern:
    name: str
    type: str
    regex: str
    confidence: float
    validator: str | None = None
    scripts: tuple[str, ...] = ()
    keywords: tuple[str, ...] = ()
    window: int = CONTEXT_WINDOW
    boost: float = BOOST
    #: A cheap condition on the text without which there is no match: the pattern without its boundaries, with any character where a class is wide.
    needs: str | None = None

    @property
    def best(self) -> float:
        """The highest confidence that a match can have."""
        return min(1.0, self.confidence * (self.boost if self.keywords else 1.0))


def _java(body: str) -> str:
    return body.replace("{B}", EDGE).replace("{S}", WS)


def _p(name, kind, confidence, body, validator=None, scripts=(), keywords=(), window=CONTEXT_WINDOW, boost=BOOST, needs="[0-9]"):
    return Pattern(name, kind, _java(body), confidence, validator, tuple(scripts), tuple(keywords), window, boost, needs)


# Names, types, confidences, patterns, scripts, keywords, windows and boosts, in order of detection.
_CALL = ("phone", "tel", "telephone", "mobile", "cell", "contact", "call")
_PASS = ("护照", "护照号", "passport", "passport number", "passport no")
_HAN = ("chinese", "cjk")
_PATH = r"[-a-zA-Z0-9@:%._+~#=]{1,256}\.[a-zA-Z]{2,6}{B}[-a-zA-Z0-9()@:%_+.~#?&/=]*"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
CATALOGUE: tuple[Pattern, ...] = (
    _p("SSN (US)", "SSN", 0.85, r"{B}(?!000|666)\d{3}[-{S}]?(?!00)\d{2}[-{S}]?(?!0000)\d{4}{B}", "ssn", ("latin",), ("ssn", "social security", "social security number", "ss#", "ss #"), 30, 1.15, needs=r"\d{3}\D?\d{2}\D?\d{4}"),
    _p("Email", "EMAIL", 0.95, r"{B}[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}{B}", needs="@"),
    _p("Phone (US)", "PHONE", 0.9, r"{B}(?:\+?1[-.{S}]?)?\(?\d{3}\)?[-.{S}]?\d{3}[-.{S}]?\d{4}{B}", "us_phone", ("latin",), _CALL, 40, 1.1, needs=r"\d{3}\D{0,2}\d{3}\D?\d{4}"),
    _p("Phone (International)", "PHONE", 0.85, r"{B}\+\d{1,3}[-.{S}]?\d{1,4}[-.{S}]?\d{1,4}[-.{S}]?\d{1,9}{B}", "international_phone", (), _CALL, 40, 1.1, needs=r"\+\d(?:\D?\d){3}"),
    _p("Phone (China Mobile)", "PHONE", 0.9, r"{B}1[3-9]\d[-{S}]?\d{4}[-{S}]?\d{4}{B}", "china_mobile", _HAN, ("电话", "手机", "联系", "phone", "mobile", "tel", "contact"), 20, 1.15, needs=r"1[3-9]\d\D?\d{4}\D?\d{4}"),
    _p("Phone (China Landline)", "PHONE", 0.65, r"{B}0\d{2,3}[-{S}]?\d{7,8}{B}", None, _HAN, ("电话", "座机", "固话", "phone", "tel", "landline"), 20, 1.2, needs=r"0\d{2,3}\D?\d{7}"),
    _p("Credit Card (Generic)", "CREDIT_CARD", 0.4, r"{B}(?:\d[-{S}]?){12,18}\d{B}", "luhn", (), ("card", "credit", "debit", "visa", "mastercard", "amex", "payment", "cc", "card number", "信用卡", "银行卡"), 50, 2.0, needs=r"(?:\d\D?){12}\d"),
    _p("Credit Card (Visa)", "CREDIT_CARD", 0.6, r"{B}4\d{3}[-{S}]?\d{4}[-{S}]?\d{4}[-{S}]?(?:\d{4}|\d{1}){B}", "luhn", needs=r"4\d{3}\D?\d{4}\D?\d{4}\D?\d"),
    _p("Credit Card (Mastercard)", "CREDIT_CARD", 0.6, r"{B}(?:5[1-5]\d{2}|222[1-9]|22[3-9]\d|2[3-6]\d{2}|27[01]\d|2720)[-{S}]?\d{4}[-{S}]?\d{4}[-{S}]?\d{4}{B}", "luhn", needs=r"[25]\d{3}\D?\d{4}\D?\d{4}\D?\d{4}"),
    _p("Credit Card (Amex)", "CREDIT_CARD", 0.6, r"{B}3[47]\d{2}[-{S}]?\d{6}[-{S}]?\d{5}{B}", "luhn", needs=r"3[47]\d{2}\D?\d{6}\D?\d{5}"),
    _p("Credit Card (Discover)", "CREDIT_CARD", 0.6, r"{B}6(?:011|5\d{2})[-{S}]?\d{4}[-{S}]?\d{4}[-{S}]?\d{4}{B}", "luhn", needs=r"6\d{3}\D?\d{4}\D?\d{4}\D?\d{4}"),
    _p("Credit Card (UnionPay)", "CREDIT_CARD", 0.6, r"{B}62\d{14,17}{B}", "luhn", needs=r"62\d{14}"),
    _p("Date (MM/DD/YYYY)", "DATE", 0.85, r"{B}(?:0?[1-9]|1[0-2])/(?:0?[1-9]|[12][0-9]|3[01])/(?:19|20)\d{2}{B}", needs=r"\d/\d{1,2}/\d{4}"),
    _p("Date (YYYY-MM-DD)", "DATE", 0.85, r"{B}(?:19|20)\d{2}-(?:0?[1-9]|1[0-2])-(?:0?[1-9]|[12][0-9]|3[01]){B}", needs=r"\d{4}-\d{1,2}-\d"),
    _p("Date (Month DD, YYYY)", "DATE", 0.8, r"(?i){B}(?:January|February|March|April|May|June|July|August|September|October|November|December)[{S}]+\d{1,2},[{S}]+\d{4}{B}", needs=r"\d,\D"),
    _p("Date (Chinese)", "DATE", 0.9, r"(?:19|20)\d{2}年(?:0?[1-9]|1[0-2])月(?:0?[1-9]|[12]\d|3[01])日", None, ("chinese", "japanese", "cjk"), needs=r"\d年\d"),
    _p("Date (DD/MM/YYYY)", "DATE", 0.75, r"{B}(?:0?[1-9]|[12][0-9]|3[01])/(?:0?[1-9]|1[0-2])/(?:19|20)\d{2}{B}", needs=r"\d/\d{1,2}/\d{4}"),
    _p("Chinese National ID", "CUSTOM", 0.7, r"{B}[1-9]\d{5}(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dXx]{B}", "chinese_id", _HAN, ("身份证", "身份证号", "id", "id card", "identity", "national id", "证件"), 25, 1.2, needs=r"\d{17}"),
    _p("Chinese Passport (Current)", "CUSTOM", 0.95, r"{B}E[A-HJ-NR-Z]\d{7}{B}", None, _HAN, _PASS, 25, 1.05, needs=r"E[A-Z]\d{7}"),
    _p("Chinese Passport (Legacy)", "CUSTOM", 0.9, r"{B}E\d{8}{B}", None, _HAN, _PASS, 25, 1.1, needs=r"E\d{8}"),
    _p("US Passport", "CUSTOM", 0.4, r"{B}[A-Z]\d{8}{B}", None, ("latin",), ("passport", "passport number", "passport no", "passport #", "us passport"), 30, 2.0, needs=r"[A-Z]\d{8}"),
    _p("IP Address (IPv4)", "CUSTOM", 0.95, r"{B}(?:" + _OCTET + r"\.){3}" + _OCTET + r"{B}", needs=r"\d\.\d{1,3}\.\d"),
    _p("IP Address (IPv6)", "CUSTOM", 0.9, r"{B}(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}{B}", needs=r"[0-9a-fA-F]:[0-9a-fA-F]{1,4}:"),
    _p("URL (with protocol)", "CUSTOM", 0.95, r"{B}https?://" + _PATH, needs="://"),
    _p("URL (without protocol)", "CUSTOM", 0.7, r"{B}www\." + _PATH, needs=r"www\."),
    _p("Crypto (Bitcoin)", "CUSTOM", 0.85, r"{B}(?:[13][a-km-zA-HJ-NP-Z1-9]{25,34}|bc1[a-z0-9]{39,59}){B}", needs=r"[13][A-Za-z1-9]{25}|bc1[a-z0-9]{39}"),
)
BY_NAME = {p.name: p for p in CATALOGUE}


def of_type(kind: str) -> tuple[Pattern, ...]:
    return tuple(p for p in CATALOGUE if p.type == kind)


def for_scripts(scripts: list[str], patterns: tuple[Pattern, ...] = CATALOGUE) -> tuple[Pattern, ...]:
    """Patterns without scripts, and those that share one with `scripts`."""
    return tuple(p for p in patterns if not p.scripts or set(p.scripts) & set(scripts))
