"""Licence scans: exact phrases, and notices with a few edits.

A text is reduced to its words, joined by single spaces. Notices are searched in
that form with up to ``errors`` edits of characters. What tells one licence from
another (its name and version) has to stand there letter for letter, as whole
words; edits may fall on the rest of a notice only. By the pigeonhole principle, of
errors + 1 pieces of a notice one stands unchanged in every such copy: the pieces
are searched exactly, and only around them does the regex library's bounded-error
matching run.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache
from itertools import accumulate

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The phrases and labels of the contract.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Short notices in the reduced form, their labels, and the edits allowed outside the braces. Words in braces are exact.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit", 8),
    ("terms of the {gnu general} public license as published by the free software foundation", "gpl", 6),
    ("terms of the {gnu lesser general} public license as published by the free software foundation", "lgpl", 6),
    ("terms of the {gnu affero general} public license as published by the free software foundation", "agpl", 6),
    ("subject to the terms of the {mozilla} public license v {2 0}", "mpl-2", 4),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd", 6),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc", 8),
    ("this is free and unencumbered software released into the {public domain}", "unlicense", 5),
    ("dedicated to the public domain under {cc0 1 0}", "cc0", 4),
    ("{apache license version 1 1}", "apache-1.1", 0),
)
#: Beginnings of notices that name a licence, and the edits allowed in each.
BEGINNINGS = (("licensed under the", 3), ("licensed under", 2), ("released under the", 3), ("released under", 2), ("distributed under the", 3), ("available under the", 3))
#: Licences as notices name them, and their labels. Fixed values.
NAMES = (
    ("{mit} license", "mit"), ("{apache} license version {2 0}", "apache-2"), ("{apache} license {2 0}", "apache-2"), ("{apache} license version {1 1}", "apache-1.1"), ("{bsd} license", "bsd"),
    ("{bsd 2} clause license", "bsd-2-clause"), ("{bsd 3} clause license", "bsd-3-clause"), ("{isc} license", "isc"), ("{zlib} license", "zlib"), ("{boost} software license version {1 0}", "bsl-1"),
    ("{mozilla} public license version {2 0}", "mpl-2"), ("{mozilla} public license {2 0}", "mpl-2"), ("{mozilla} public license version {1 1}", "mpl-1.1"), ("{eclipse} public license version {2 0}", "epl-2"), ("{eclipse} public license version {1 0}", "epl-1"),
    ("{mpl 2 0}", "mpl-2"), ("{epl 2 0}", "epl-2"), ("{gpl}", "gpl"), ("{gnu gpl}", "gpl"), ("{lgpl}", "lgpl"), ("{gnu lgpl}", "lgpl"), ("{agpl}", "agpl"), ("{gnu agpl}", "agpl"),
)
#: Licences of the GNU project: short and long name, and versions with the label's.
GNU = (("gpl", "gnu general", ("1", "2", "3")), ("lgpl", "gnu lesser general", ("2", "2.1", "3")), ("lgpl", "gnu library general", ("2",)), ("agpl", "gnu affero general", ("3",)))
#: Creative commons licences: what may follow attribution, and the label.
COMMONS = (("", "cc-by"), (" sharealike", "cc-by-sa"), (" noncommercial", "cc-by-nc"), (" noderivatives", "cc-by-nd"), (" noncommercial sharealike", "cc-by-nc-sa"), (" noncommercial noderivatives", "cc-by-nc-nd"))
#: What follows the version of one.
TERRITORIES = (" international", " unported", " generic", "")


def _named() -> tuple[tuple[str, str, int], ...]:
    """Notices of every beginning and name."""
    names = list(NAMES)
    for short, long, versions in GNU:
        for v in versions:
            label, digits = f"{short}-{v}", v.replace(".", " ")
            forms = {digits, f"{digits} 0"} if "." not in v else {digits}
            for d in sorted(forms):
                names += [(f"{{{x}v{d}}}", label) for x in (short, f"gnu {short}")] + [(f"{{{x} v{d}}}", label) for x in (short, f"gnu {short}")] + [(f"{{{x} version {d}}}", label) for x in (short, f"gnu {short}")]
                names += [(f"{{{long}}} public license version {{{d}}}", label), (f"{{{long}}} public license {{v{d}}}", label)]
    found = [(f"{beginning} {name}", label, errors) for name, label in names for beginning, errors in BEGINNINGS]
    for more, label in COMMONS:
        found += [(f"licensed under {article} {{creative commons attribution{more}}} {{version}}{where} license", label, 4) for article in ("a", "the") for where in TERRITORIES]
        found.append((f"licensed under {{{label.replace('-', ' ')}}} {{version}}", label, 2))
    return tuple(found)


def _identifiers() -> tuple[tuple[str, str], ...]:
    """SPDX identifiers in the reduced form, with the labels used here."""
    found = [
        ("mit", "mit"), ("mit 0", "mit-0"), ("apache 2 0", "apache-2"), ("apache 1 1", "apache-1.1"), ("0bsd", "0bsd"), ("bsd 2 clause", "bsd-2-clause"), ("bsd 3 clause", "bsd-3-clause"), ("isc", "isc"), ("zlib", "zlib"),
        ("mpl 2 0", "mpl-2"), ("mpl 1 1", "mpl-1.1"), ("epl 2 0", "epl-2"), ("epl 1 0", "epl-1"), ("bsl 1 0", "bsl-1"), ("unlicense", "unlicense"), ("cc0 1 0", "cc0"), ("wtfpl", "wtfpl"), ("artistic 2 0", "artistic-2"),
    ]
    for short, _, versions in GNU:
        for v in versions:
            name = f"{short} {v.replace('.', ' ')}" + ("" if "." in v else " 0")
            found += [(name + tail, f"{short}-{v}") for tail in ("", " only", " or later")]
    found += [(f"{label.replace('-', ' ')} {v}", label) for _, label in COMMONS for v in ("1 0", "2 0", "2 5", "3 0", "4 0")]
    return tuple(dict.fromkeys(found))


SPDX = _identifiers()
#: Every notice that scan() looks for unless told otherwise.
ALL_NOTICES = (*NOTICES, *_named(), *((f"spdx license identifier {{{name}}}", label, 2) for name, label in SPDX))

#: Versions that creative commons licences have had.
VERSION = r"(?:[123] 0|2 5|4 0)"
_TABLE = bytes(c if c >= 128 or chr(c) in "0123456789abcdefghijklmnopqrstuvwxyz" else ord(chr(c).lower()) if chr(c) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else 32 for c in range(256))


def reduced(text: str | None) -> list[bytes]:
    """Words in UTF-8: runs of 0-9, a-z (A-Z lower-cased) and characters beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


@dataclass
class Notice:
    """A notice (exact words in braces), its label, the edits allowed, its pieces with their offsets."""

    template: str
    label: str
    errors: int
    text: str = field(init=False)
    exact: list[str] = field(init=False)
    pieces: list[tuple[str, int]] = field(init=False)
    anchor: str | None = field(init=False)

    def __post_init__(self):
        sample = self.template.replace("{version}", "{4 0}")
        self.text = sample.replace("{", "").replace("}", "")
        self.exact = [x for x in regex.findall(r"\{(.*?)\}", self.template) if x != "version"]
        n, parts = len(self.text), self.errors + 1
        cuts = [n * k // parts for k in range(parts + 1)]
        self.pieces = [(self.text[a:b], a) for a, b in zip(cuts, cuts[1:], strict=False)]
        if "{version}" in self.template:  # no piece may hold a version's digits
            at = sample.index("{4 0}") - sample[: sample.index("{4 0}")].count("{") - sample[: sample.index("{4 0}")].count("}")
            self.pieces = [(piece, a) for piece, a in self.pieces if a + len(piece) <= at or a >= at + 3] + [(self.exact[0], self.text.index(self.exact[0]))]
        # a text without this word, which has to stand there as it is, has no match
        self.anchor = max((w for x in self.exact for w in x.split()), key=len, default=None)

    @cached_property
    def pattern(self) -> regex.Pattern:
        body = "".join(self._part(x) for x in regex.split(r"(\{.*?\})", self.template) if x)
        # a version is no other one's beginning: 2 is not 2 1
        ends = "(?! [0-9])" if self.template.endswith("}") and self.text[-1].isdigit() else ""
        return regex.compile(rf"(?<![^ ]){body}(?![^ ]){ends}", regex.BESTMATCH)

    def _part(self, part: str) -> str:
        if part == "{version}":
            return VERSION
        if part[0] == "{":
            return rf"(?<![^ ]){part[1:-1]}(?![^ ])"
        if len(part) == 1:
            return part
        # in a short stretch one letter may be put in at most: "unlicensed" is no edit of "licensed"
        inserted = 1 if len(part) <= 24 else self.errors
        return rf"(?:{regex.escape(part, literal_spaces=True)}){{i<={inserted},d<={self.errors},s<={self.errors},e<={self.errors}}}"

    def search(self, joined: str) -> list[tuple[int, int, int]]:
        """(start, end, edits) of the matches around exact pieces, without overlaps."""
        if not all(x in joined for x in self.exact):
            return []
        windows = set()
        for piece, offset in self.pieces:
            at = joined.find(piece)
            while at >= 0:
                # more characters on both sides, for the word borders and a number that goes on
                windows.add((max(0, at - offset - self.errors - 1), at - offset + len(self.text) + self.errors + 3))
                at = joined.find(piece, at + 1)
        found, reach = [], 0
        for begin, end in sorted(windows):
            m = self.pattern.search(joined, max(begin, reach), min(end, len(joined))) if end > reach else None
            if m and m.end() > m.start() and sum(m.fuzzy_counts) <= self.errors:
                found.append((m.start(), m.end(), sum(m.fuzzy_counts)))
                reach = m.end()
        return found


@lru_cache(maxsize=2)
def _compiled(notices: tuple[tuple[str, str, int], ...]) -> list[Notice]:
    """Notices, once in a worker; a pattern is compiled when a text has the words for it."""
    return [Notice(*n) for n in notices]


def _starts(words: list[bytes], length) -> list[int]:
    """Where each word starts in the words joined by spaces."""
    return list(accumulate((length(w) + 1 for w in words[:-1]), initial=0)) if words else []


def phrase_places(words: list[bytes], phrases=PHRASES) -> list[tuple[int, str]]:
    """(first word, label) wherever a phrase's words stand one after the other."""
    line = b" " + b" ".join(words) + b" "
    found, starts = [], None
    for phrase, label in phrases:
        wanted = b" " + phrase.encode() + b" "
        at = line.find(wanted)
        while at >= 0:
            starts = starts if starts is not None else _starts(words, len)
            found.append((bisect_right(starts, at) - 1, label))
            at = line.find(wanted, at + 1)
    return found


def best_matches(notices: list[Notice], joined: str) -> list[tuple[int, int, int, Notice]]:
    """(edits, start, end, notice) of matches that no better one overlaps: fewer edits, then longer, then the earlier notice."""
    words = set(joined.split(" "))
    every = [(edits, start - end, k, start, end) for k, notice in enumerate(notices) if notice.anchor is None or notice.anchor in words for start, end, edits in notice.search(joined)]
    starts: list[int] = []
    kept: list[tuple[int, int, int, Notice]] = []
    for edits, _, k, start, end in sorted(every):
        at = bisect_right(starts, start)
        if (not at or kept[at - 1][2] <= start) and (at == len(kept) or end <= kept[at][1]):
            starts.insert(at, start)
            kept.insert(at, (edits, start, end, notices[k]))
    return kept


_MORE = regex.compile(r" (?:or|and|with) (" + "|".join(sorted((name for name, _ in SPDX), key=len, reverse=True)) + r")(?![^ ])(?! [0-9])")


def further_identifiers(joined: str, end: int) -> list[tuple[int, int, str]]:
    """(start, end, label) of the identifiers that an SPDX expression joins to one that ends at ``end``."""
    found, labels = [], dict(SPDX)
    while m := _MORE.match(joined, end):
        found.append((m.start(1), m.end(1), labels[m[1]]))
        end = m.end()
    return found


_RESULT = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label: string, first_word: long, last_word: long, edits: int>>"
)


def judged(text: str | None, notices: list[Notice], phrases=PHRASES) -> tuple:
    """The fields of scan()'s struct for one text."""
    words = reduced(text)
    base = phrase_places(words, phrases)
    letters = [w.decode("utf-8", "replace") for w in words]
    joined = " ".join(letters)
    found = best_matches(notices, joined)
    starts = _starts(letters, len) if found else []
    marks = [(start, end, notice.label, edits) for edits, start, end, notice in found]
    for _, _, end, notice in found:
        if notice.template.startswith("spdx "):
            marks += [(*mark, 0) for mark in further_identifiers(joined, end) if mark not in {m[:3] for m in marks}]
    spans = [{"label": label, "first_word": bisect_right(starts, start) - 1, "last_word": bisect_right(starts, end - 1) - 1, "edits": edits} for start, end, label, edits in sorted(marks)]
    best = max([1.0 if base else 0.0, *(1 - edits / len(notice.text) for edits, _, _, notice in found)])
    places = [k for k, _ in base]
    own = {label for _, label in base}
    both = own | {s["label"] for s in spans}
    return len(words), len(base), min(places, default=None), max(places, default=None), ",".join(sorted(own)), ",".join(sorted(both)), best, spans


def scan(docs: DataFrame, text_col: str = "text", out: str = "licenses", phrases=PHRASES, notices=ALL_NOTICES) -> DataFrame:
    """``docs`` with a struct: counts and places of phrases, labels, a score, and the spans (in words) of notices.

    score is the share of unedited characters in the best match, 1 for a phrase, 0
    without any. A column named ``out`` is replaced.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        compiled = _compiled(tuple(notices))
        names = [x.split()[0] for x in _RESULT.split(", ")[:8]]
        for texts in batches:
            rows = pd.DataFrame([judged(t, compiled, phrases) for t in texts], columns=names)
            yield rows.astype({"first_word": "Int64", "last_word": "Int64"})

    return docs.withColumn(out, F.pandas_udf(run, _RESULT)(text_col))


def op9_licenses(docs: DataFrame) -> DataFrame:
    """Columns doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row.

    Null and empty texts have no words, no labels (empty strings) and score 0; texts
    of any length are scanned whole. Of overlapping matches that with the fewest edits
    counts, then the longest, then the earlier in the list (ties). Repeated rows come
    out as often as they went in; an empty table gives no rows; columns of other
    names are ignored.
    """
    rows = scan(docs.select("doc_id", "text"))
    return rows.select("doc_id", *(F.col(f"licenses.{c}").alias(c) for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")))


#: The columns that rest on exact phrases, as SQL; the method's own labels are beyond it.
BASE_SQL = r"""
with cut as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), places as (
  select doc_id, label, unnest(list_filter(range(1, len(w) + 1), lambda k: array_to_string(w[k:k + n - 1], ' ') = phrase)) - 1 as place
  from cut, (values ('under the mit license', 'mit', 4), ('apache license version 2', 'apache-2', 4), ('cc by nc', 'cc-by-nc', 3)) p(phrase, label, n)
), found as (
  select doc_id, count(*) as n_base, min(place) as first_word, max(place) as last_word, string_agg(distinct label, ',' order by label) as base_labels from places group by doc_id
)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels
from cut left join found using (doc_id)"""
