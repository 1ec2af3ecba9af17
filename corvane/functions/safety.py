"""Input checks and personal data, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns of each check, in the order in which they are tried.
SQL_PATTERNS = (
    r"(?i)\b(SELECT|INSERT|UPDATE|DELETE|DROP|CREATE|ALTER|EXEC|UNION)\b",
    r"(--|#|/\*|\*/)",
    r"(?i)(\bOR\b|\bAND\b).*(=|<|>)",
    r"(?i)'\s*(OR|AND)\s*'",
    r"(?i)(\bWAITFOR\s+DELAY\b|\bSLEEP\s*\()",
    r"(?i);\s*(DROP|DELETE|INSERT|UPDATE)",
)
XSS_PATTERNS = (
    r"(?i)<script[^>]*>", r"(?i)javascript:", r"(?i)on\w+\s*=", r"(?i)<iframe[^>]*>",
    r"(?i)<object[^>]*>", r"(?i)<embed[^>]*>", r"(?i)eval\s*\(", r"(?i)expression\s*\(",
)
INJECTION_PATTERNS = (
    r"(?i)(忽略|忘记|disregard|ignore)\s*(之前|以上|prior|above)",
    r"(?i)(你(现在)?是|你现在是|你现在扮演)",
    r"(?i)(system|developer|admin)\s*[:：]",
    r"(?i)#\s*system\s*#",
    r"(?i)(指令|instruction)s?\s*[:：]",
    r"(?i)按顺序执行.*?:",
    r"(?i)(DAN|do\s*anything|anything\s*now)",
    r"(?i)你现在可以.*?了",
    r"(?i)(告诉我|show|tell).*(系统|内部|prompt|指令|instruction)",
    r"(?i)(你(的)?(系统)?提示词|prompt)",
)
PATH_PATTERNS = (r"\.\./", r"\.\.\\", r"(/|\\)\.\\", r"(?i)%2e%2e")
ZERO_WIDTH = r"[​-‏ - ]"
PII_PATTERNS = {
    "phone_cn": r"1[3-9][0-9]{9}",
    "phone_en": r"\+?[0-9\s\-\(\)]{10,}",
    "id_card_cn": r"\b[0-9]{17}[0-9Xx]\b",
    "email": r"\b[A-Za-z0-9_.-]+@[A-Za-z0-9_.-]+\.[A-Za-z0-9_]+\b",
    "bank_card": r"\b[0-9]{16,19}\b",
    "ip_address": r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b",
    "mac_address": r"(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}",
}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _any(text: Column, patterns) -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | text.rlike(p)
    return found


def injection_score(text: Column | str) -> Column:
    """1 less 0.25 for each injection pattern found; not below 0."""
    c = F.coalesce(_col(text), F.lit(""))
    hits = F.lit(0)
    for p in INJECTION_PATTERNS:
        hits = hits + c.rlike(p).cast("int")
    return F.greatest(F.lit(0.0), 1 - 0.25 * hits)


def threat(text: Column | str) -> Column:
    """Kind of the first check that fails (sql_injection, xss, path_traversal, hidden_characters, prompt_injection), or none."""
    c = F.coalesce(_col(text), F.lit(""))
    return (
        F.when(_any(c, SQL_PATTERNS), "sql_injection")
        .when(_any(c, XSS_PATTERNS), "xss")
        .when(_any(c, PATH_PATTERNS), "path_traversal")
        .when(c.rlike(ZERO_WIDTH), "hidden_characters")
        .when(injection_score(c) < 0.3, "prompt_injection")
        .when(injection_score(c) < 0.8, "suspicious_prompt")
        .otherwise("none")
    )


def check(text: Column | str) -> Column:
    """Struct (safe, threat, score)."""
    kind = threat(text)
    return F.struct(kind.isin("none", "suspicious_prompt").alias("safe"), kind.alias("threat"), injection_score(text).alias("score"))


def sanitised(text: Column | str, escape: bool = False) -> Column:
    """Without zero-width characters, white space collapsed, optionally with HTML characters escaped."""
    c = F.regexp_replace(F.coalesce(_col(text), F.lit("")), ZERO_WIDTH, "")
    if escape:
        for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
            c = F.replace(c, F.lit(plain), F.lit(entity))
    return F.trim(F.regexp_replace(c, r"[ \t\r\n]+", " "))


def pii(text: Column | str) -> Column:
    """Array of (type, value) of all matches of all types; matches of different types may overlap."""
    c = F.coalesce(_col(text), F.lit(""))

    def found(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value")))

    return F.concat(*(found(kind, pattern) for kind, pattern in PII_PATTERNS.items()))


def masked_value(value: Column | str, kind: str) -> Column:
    """One matched value in the mask of its type."""
    c = _col(value)
    first, last = (lambda n: F.substring(c, 1, n)), F.right(c, F.lit(4))
    if kind == "phone_cn":
        return F.concat(first(3), F.lit("****"), last)
    if kind == "phone_en":
        return F.concat(F.regexp_replace(first(6), "[0-9]", "*"), last)
    if kind == "id_card_cn":
        return F.concat(first(6), F.lit("**********"), last)
    if kind == "email":
        at = F.instr(c, "@")
        return F.when(at > 0, F.concat(F.substring(c, F.lit(1), F.least(at - 1, F.lit(2))), F.lit("***@"), F.substring(c, at + 1, F.length(c)))).otherwise("***")
    if kind == "bank_card":
        return F.concat(first(4), F.lit("****"), last)
    return F.lit("***")


def masked(text: Column | str, kinds=tuple(PII_PATTERNS)) -> Column:
    """The text with all matches masked, type after type in the order of ``kinds``.

    Texts are cut at the matches and put together again with each match masked, so
    that masks which depend on the match need no Python.
    """
    c = F.coalesce(_col(text), F.lit(""))
    for kind in kinds:
        c = _masked_kind(c, kind)
    return c


def _masked_kind(text: Column, kind: str) -> Column:
    values = F.regexp_extract_all(text, F.lit(PII_PATTERNS[kind]), F.lit(0))
    gaps = F.split(text, PII_PATTERNS[kind], -1)

    def join(gap, k):
        value = F.get(values, k)
        return F.concat(gap, F.when(value.isNull(), "").otherwise(masked_value(value, kind)))

    return F.array_join(F.transform(gaps, join), "")


def json_texts(value: Column | str) -> Column:
    """Array of the texts under the usual keys of a JSON message, at the top and one level below."""
    keys = ("message", "query", "question", "content", "text", "input", "prompt", "body")
    c = _col(value)
    found = F.array(*(F.get_json_object(c, f"$.{k}") for k in keys), *(F.get_json_object(c, f"$.*.{k}") for k in keys))
    return F.filter(found, lambda x: x.isNotNull())
