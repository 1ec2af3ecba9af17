"""Text functions as Columns.

Patterns are ASCII-only where SQL oracles have to agree; ``unicode=True`` variants
use Unicode letters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"一-鿿"
#: What ends a sentence: CJK and ASCII marks.
SENTENCE_END = r"(?<=[。！？!?；;．.])\s*"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: Column | str, unicode: bool = False) -> Column:
    """Lower-case alphanumeric runs, then single CJK characters, then pairs of neighbouring CJK characters."""
    lowered = F.lower(_col(text))
    words = F.regexp_extract_all(lowered, F.lit(r"[\p{L}\p{N}&&[^一-鿿]]+" if unicode else r"[a-z0-9]+"), F.lit(0))
    single = F.regexp_extract_all(lowered, F.lit(f"[{CJK}]"), F.lit(0))
    # overlapping pairs: the same search from the first and from the second character of each run
    runs = F.regexp_extract_all(lowered, F.lit(f"[{CJK}]{{2,}}"), F.lit(0))
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda k: F.substring(r, k, F.lit(2)))))
    return F.concat(words, single, pairs)


def terms(text: Column | str) -> Column:
    """Distinct [a-z0-9_]+ runs and pairs of all CJK characters joined together."""
    lowered = F.lower(_col(text))
    cjk = F.array_join(F.regexp_extract_all(lowered, F.lit(f"[{CJK}]"), F.lit(0)), "")
    pairs = F.when(F.length(cjk) >= 2, F.transform(F.sequence(F.lit(1), F.greatest(F.length(cjk) - 1, F.lit(1))), lambda k: F.substring(cjk, k, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.regexp_extract_all(lowered, F.lit("[a-z0-9_]+"), F.lit(0)), pairs))


def term_relevance(query: Column | str, statement: Column | str) -> Column:
    """Share of the query's terms that the statement has, at most 0.99; 0 without terms, and for a null statement."""
    q = terms(query)
    share = F.coalesce(F.size(F.array_intersect(q, terms(statement))) / F.size(q), F.lit(0.0))  # least() passes over nulls
    return F.when(F.size(q) > 0, F.least(F.lit(0.99), share)).otherwise(0.0)


def token_estimate(text: Column | str) -> Column:
    """Tokens of a text by rule: a CJK character is 1/1.5 token, any other 1/4."""
    c = _col(text)
    cjk = F.regexp_count(c, F.lit(f"[{CJK}]"))
    return F.floor(cjk / 1.5 + (F.length(c) - cjk) / 4).cast("long")


def chars_for_tokens(n: Column, cjk_share: float = 0.7) -> Column:
    """Characters that give about ``n`` tokens in a text with this share of CJK characters."""
    return F.floor(n / (F.lit(cjk_share) / 1.5 + F.lit(1 - cjk_share) / 4)).cast("long")


def sentences(text: Column | str) -> Column:
    """Trimmed, non-empty sentences."""
    parts = F.transform(F.split(_col(text), SENTENCE_END), lambda s: F.trim(s))
    return F.filter(parts, lambda s: F.length(s) > 0)


def is_noise(chunk: Column | str) -> Column:
    """Blank, under 15 characters, mostly punctuation, or mostly bullets."""
    c = F.trim(_col(chunk))
    valid = F.regexp_count(c, F.lit(f"[A-Za-z0-9{CJK}]"))
    marks = F.length(c) - valid
    bullets = c.rlike(r"[-*•·.]{10,}") & (valid < 5)
    return F.coalesce((F.length(c) < 15) | ((marks > 0.6 * F.length(c)) & (valid < 10)) | bullets, F.lit(True))


def is_meaningful_query(query: Column | str) -> Column:
    """Has a letter, digit or CJK character, and is not a long run of one or two characters."""
    compact = F.regexp_replace(_col(query), r"\s+", "")
    distinct = F.size(F.array_distinct(F.split(compact, "")))
    return F.coalesce(compact.rlike(f"[A-Za-z0-9{CJK}]") & ~((F.length(compact) >= 32) & (distinct <= 2)), F.lit(False))


#: What a chunker's sentences end with, and characters that stand for these within list items meanwhile.
_MARKS, _HELD = ".!?;；．,，", "".join(chr(0xE000 + k) for k in range(8))
_LIST_LINE = r"^[ \t]*(?:(?:\d+[.、]|[-*+])[ \t]+|[①-⑳]|[一二三四五六七八九十百零\d]+[、，])[ \t]*\S"
_BREAKS = r"(?<=[.!?;；．])|(?<=[,，])(?=[A-Za-z一-鿿(]|\d+\.)"


def chunk_sentences(text: Column | str) -> Column:
    """Sentences as the chunker has them: after . ! ? ; and after a comma that a letter follows at once; lines of lists stay whole.

    Marks in list lines are held back as private characters while the text is split.
    """
    lines = F.transform(F.split(F.coalesce(_col(text), F.lit("")), "\n"), lambda x: F.when(x.rlike(_LIST_LINE), F.translate(x, _MARKS, _HELD)).otherwise(x))
    parts = F.transform(F.split(F.array_join(lines, "\n"), _BREAKS), lambda s: F.regexp_replace(F.translate(s, _HELD, _MARKS), r"^\s+|\s+$", ""))
    return F.filter(parts, lambda s: s != "")


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity of two arrays of numbers; 0 if one of them is zero, null if lengths differ."""
    x, y = (F.transform(_col(v), lambda e: e.cast("double")) for v in (a, b))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, e: s + e)
    dot, xx, yy = total(F.zip_with(x, y, lambda p, q: p * q)), total(F.transform(x, lambda e: e * e)), total(F.transform(y, lambda e: e * e))
    value = F.when((xx == 0) | (yy == 0), 0.0).otherwise(dot / F.sqrt(xx * yy))
    return F.when(F.size(x) == F.size(y), value)


def version_key(version: Column | str) -> Column:
    """Three numbers of a version such as v2.1.3; parts that are no number count 0."""
    parts = F.split(F.regexp_replace(F.lower(F.trim(_col(version))), "^v", ""), r"[._-]")
    numbers = F.transform(parts, lambda p: F.coalesce(F.when(p.rlike(r"^\d+$"), p.cast("int")), F.lit(0)))
    return F.slice(F.concat(numbers, F.array_repeat(F.lit(0), 3)), 1, 3)


def is_newer(a: Column | str, b: Column | str) -> Column:
    return version_key(a) > version_key(b)


def title_from_filename(path: Column | str) -> Column:
    """Base name without extension and leading numbers."""
    base = F.regexp_extract(_col(path), r"([^/\\]+)$", 1)
    return F.regexp_replace(F.regexp_replace(base, r"\.[A-Za-z0-9]+$", ""), r"^[0-9]+[._ -]*", "")


def display_name(path: Column | str) -> Column:
    """Base name without a known document extension."""
    base = F.regexp_extract(_col(path), r"([^/\\]+)$", 1)
    return F.regexp_replace(base, r"(?i)\.(pdf|docx?|txt|md|markdown|html?|csv|json|xlsx?)$", "")


def heading_level(line: Column | str) -> Column:
    """1 to 6 for a Markdown heading line, else null."""
    c = _col(line)
    return F.when(c.rlike(r"^#{1,6}\s+\S"), F.length(F.regexp_extract(c, "^(#{1,6})", 1)))


def html_to_text(html: Column | str) -> Column:
    """Text of an HTML page: scripts, styles, comments and tags go, common entities are decoded, white space collapses."""
    c = F.coalesce(_col(html), F.lit(""))
    c = F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", " ")
    c = F.regexp_replace(c, r"<[^>]*>", " ")
    for entity, plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(plain))
    return F.trim(F.regexp_replace(c, r"[ \t\r\n]+", " "))


def normalised_tags(tags: Column | str) -> Column:
    """Array of trimmed, non-empty, distinct tags of a list separated by commas or semicolons."""
    parts = F.transform(F.split(F.coalesce(_col(tags), F.lit("")), "[,，;；]"), lambda s: F.trim(s))
    return F.array_distinct(F.filter(parts, lambda t: F.length(t) > 0))


def slug(text: Column | str) -> Column:
    """Lower-case letters, digits and single hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(_col(text))), r"[^a-z0-9]+", "-"), "^-+|-+$", "")


def safe_filename(name: Column | str) -> Column:
    """Base name with anything but letters, digits, dot, hyphen and underscore replaced."""
    base = F.regexp_extract(_col(name), r"([^/\\]*)$", 1)
    return F.regexp_replace(base, r"[^A-Za-z0-9._-]", "_")


def session_title(message: Column | str, limit: int = 20) -> Column:
    """First characters of a message, with an ellipsis if cut."""
    c = F.trim(_col(message))
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("..."))).otherwise(c)


def snippet(text: Column | str, limit: int = 220) -> Column:
    """White space collapsed, cut to ``limit`` characters."""
    return F.substring(F.trim(F.regexp_replace(F.coalesce(_col(text), F.lit("")), r"[ \t\r\n]+", " ")), 1, limit)


def doc_type_of(path: Column | str) -> Column:
    """Kind of a document by words in its path; the first that fits."""
    p = F.lower(_col(path))
    rules = (("paper", r"paper|arxiv|论文"), ("experiment", r"experiment|实验"), ("meeting", r"meeting|minutes|组会|纪要"), ("policy", r"policy|rules|制度|规范"), ("guide", r"guide|manual|readme|指南"))
    found = F.lit("other")
    for kind, pattern in reversed(rules):
        found = F.when(p.rlike(pattern), kind).otherwise(found)
    return found


def chunk_identity(source: Column, version: Column, chunk_id: Column, chunk_hash: Column, text: Column) -> Column:
    """Digest under which two rows are the same chunk; the text counts only where both chunk ids are missing."""
    empty = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    body = F.when((empty(chunk_id) == "") & (empty(chunk_hash) == ""), F.sha2(empty(text), 256)).otherwise("")
    return F.sha2(F.concat_ws("\x1f", empty(source), empty(version), empty(chunk_id), empty(chunk_hash), body), 256)


def worker_chunk_id(file_hash: Column, index: Column, text: Column) -> Column:
    """File digest, position and text digest, joined by hyphens."""
    tail = F.substring(F.md5(F.concat(text, file_hash, index.cast("string"))), 1, 12)
    return F.concat_ws("-", F.substring(file_hash, 1, 20), index.cast("string"), tail)


def key_facts(text: Column | str) -> Column:
    """Array of numbers with units and of dates."""
    c = _col(text)
    numbers = F.regexp_extract_all(c, F.lit(r"[0-9]+(?:\.[0-9]+)?\s*(?:%|percent|百分比|人数|天|年|元|万元|人次)"), F.lit(0))
    dates = F.regexp_extract_all(c, F.lit(r"[0-9]{4}[-/年][0-9]{1,2}[-/月][0-9]{1,2}|[0-9]{1,2}[-/月][0-9]{1,2}"), F.lit(0))
    pairs = F.regexp_extract_all(c, F.lit(r"[一-龥]{2,6}\s*[:：]\s*[^\n，,。；;]{2,20}"), F.lit(0))
    return F.concat(F.transform(numbers, lambda x: F.concat(F.lit("number: "), x)), F.transform(dates, lambda x: F.concat(F.lit("date: "), x)), pairs)


def research_identifiers(text: Column | str, limit: int = 100) -> Column:
    """Distinct DOI and arXiv identifiers, as links."""
    c = _col(text)
    doi = F.transform(F.regexp_extract_all(c, F.lit(r"10\.[0-9]{4,9}/[-._;()/:A-Za-z0-9]+"), F.lit(0)), lambda x: F.concat(F.lit("https://doi.org/"), F.regexp_replace(x, r"[.,;)]+$", "")))
    arxiv = F.transform(F.regexp_extract_all(c, F.lit(r"(?i)arxiv:\s*([0-9]{4}\.[0-9]{4,5})"), F.lit(1)), lambda x: F.concat(F.lit("https://arxiv.org/abs/"), x))
    return F.slice(F.array_distinct(F.concat(doi, arxiv)), 1, limit)


def citation_audit(answer: Column | str, n_sources: Column) -> Column:
    """Struct of used, invalid and unused source numbers of an answer with marks such as [1] or [S1]."""
    used = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(_col(answer), F.lit(r"\[S?([0-9]{1,6})\]"), F.lit(1)), lambda x: x.cast("long"))))
    every = F.when(n_sources > 0, F.sequence(F.lit(1).cast("long"), F.greatest(n_sources.cast("long"), F.lit(1).cast("long")))).otherwise(F.array().cast("array<bigint>"))
    return F.struct(F.array_intersect(used, every).alias("used"), F.array_except(used, every).alias("invalid"), F.array_except(every, used).alias("unused"))


def action_items(content: Column | str) -> Column:
    """Array of (title, owner, due) of checkbox and TODO lines of meeting notes."""
    lines = F.filter(F.transform(F.split(_col(content), r"\r?\n"), lambda s: F.trim(s)), lambda x: (F.length(x) > 0) & ~x.startswith("#"))
    box = r"^[-*]\s*\[\s*[xX]?\s*\]\s*"
    wanted = F.filter(lines, lambda x: x.rlike(box) | x.rlike(r"(?i)\bTODO\b|待办|行动项|后续动作"))

    def item(line):
        parts = F.filter(F.transform(F.split(F.regexp_replace(F.regexp_replace(line, box, ""), r"^[-*]\s*", ""), "[|｜]"), lambda s: F.trim(s)), lambda p: F.length(p) > 0)
        title = F.regexp_replace(F.coalesce(F.get(parts, F.lit(0)), F.lit("")), r"(?i)^(TODO|待办|行动项|后续动作)\s*[:：]?\s*", "")
        field = lambda pattern: F.coalesce(F.array_max(F.transform(parts, lambda p: F.nullif(F.regexp_extract(p, pattern, 1), F.lit("")))), F.lit(""))
        owner, due = field(r"(?i)(?:负责人|owner|assignee)\s*[:：]\s*(.+)"), field(r"(?i)(?:截止(?:日期)?|due)\s*[:：]\s*([0-9]{4}-[0-9]{2}-[0-9]{2})")
        return F.struct(title.alias("title"), owner.alias("owner"), due.alias("due"))

    return F.filter(F.transform(wanted, item), lambda i: F.length(i["title"]) > 0)


def gain_of(label: Column | str) -> Column:
    """Gain of a relevance label."""
    c = F.lower(_col(label))
    return F.when(c.isin("highly_relevant", "high"), 3.0).when(c.isin("relevant", "medium"), 2.0).when(c.isin("partially_relevant", "low"), 1.0).otherwise(0.0)


def judge_score(reply: Column | str) -> Column:
    """The number after ``SCORE:`` in a judge's reply, held to 1 to 5; 3 without one."""
    raw = F.nullif(F.regexp_extract(_col(reply), r"(?i)SCORE\s*[:：]\s*([0-9]+(?:\.[0-9]+)?)", 1), F.lit(""))
    return F.coalesce(F.least(F.lit(5.0), F.greatest(F.lit(1.0), raw.cast("double"))), F.lit(3.0))


def normalised_score(raw: Column | str) -> Column:
    """A score of 1 to 5 on a scale of 0 to 1."""
    return (F.least(F.lit(5.0), F.greatest(F.lit(1.0), _col(raw))) - 1) / 4


def restriction_values(value: Column | str) -> Column:
    """Array of names in a JSON list or a list separated by commas or semicolons; null and empty give none."""
    c = F.trim(F.coalesce(_col(value), F.lit("")))
    listed = F.when(c.startswith("["), F.from_json(c, "array<string>")).otherwise(F.split(c, "[,，;；]"))
    return F.filter(F.transform(F.coalesce(listed, F.array().cast("array<string>")), lambda s: F.trim(s)), lambda v: F.length(v) > 0)


def json_or(value: Column | str, schema: str, default: Column) -> Column:
    """A JSON text as ``schema``, or the default if it is none."""
    return F.coalesce(F.from_json(_col(value), schema), default)
