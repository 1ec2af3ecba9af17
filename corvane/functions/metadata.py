"""Metadata of documents and results as Columns: what is shown of them, and in which form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import display_name, snippet

#: Metadata that may be passed on with a result.
SAFE_FIELDS = (
    "doc_id", "version", "effective_date", "expiry_date", "source", "title", "doc_type", "category", "project_name", "visibility",
    "confidentiality", "page_number", "section_title", "section_path", "chunk_index", "created_at",
)


def _filled(c: Column | str) -> Column:
    return F.nullif(F.trim((F.col(c) if isinstance(c, str) else c).cast("string")), F.lit(""))


def scalar(values: Column) -> Column:
    """An array as a text of its filled elements, joined by commas; null as an empty text."""
    return F.coalesce(F.array_join(F.filter(values, lambda v: F.length(v) > 0), ","), F.lit(""))


def safe_metadata(df: DataFrame) -> Column:
    """Struct of those of SAFE_FIELDS that ``df`` has, blank ones as null."""
    return F.struct(*(_filled(c).alias(c) for c in SAFE_FIELDS if c in df.columns))


def time_info(effective: Column | str, updated: Column | str, created: Column | str, version: Column | str) -> Column:
    """The first that is filled, as "name=value"; empty if none is."""
    named = (("effective_date", effective), ("updated_at", updated), ("created_at", created), ("version", version))
    return F.coalesce(*(F.when(_filled(c).isNotNull(), F.concat(F.lit(f"{n}="), _filled(c))) for n, c in named), F.lit(""))


def shown_title(title: Column | str, file_name: Column | str, source: Column | str) -> Column:
    """Title, else file name, else base name of the source, else "untitled"."""
    return F.coalesce(_filled(title), _filled(display_name(file_name)), _filled(display_name(source)), F.lit("untitled"))


def source_card(title: Column | str, file_name: Column | str, source: Column | str, text: Column | str, score: Column | str) -> Column:
    """Struct (title, source, snippet, score) of a result."""
    rounded = F.round(F.col(score) if isinstance(score, str) else score, 4)
    return F.struct(shown_title(title, file_name, source).alias("title"), _filled(source).alias("source"), snippet(text).alias("snippet"), rounded.alias("score"))


def user_session(user: Column | str, session: Column | str) -> Column:
    """Id of a user's session; underscores of the user's id are doubled, so that no two users share one."""
    return F.concat_ws("_", F.replace(_filled(user), F.lit("_"), F.lit("__")), _filled(session))


def number_list(value: Column | str, most: int = 1000) -> Column:
    """Array of the numbers of a JSON list or a list separated by commas, semicolons or spaces; null if one is none or there are too many."""
    c = F.trim(F.regexp_replace(F.col(value) if isinstance(value, str) else value, r"^\[|\]$", ""))
    parts = F.filter(F.split(c, r"[,;\s]+"), lambda p: F.length(p) > 0)
    numbers = F.transform(parts, lambda p: p.try_cast("double"))
    bad = F.exists(numbers, lambda n: n.isNull() | F.isnan(n) | (F.abs(n) == float("inf")))
    return F.when(~bad & (F.size(numbers) <= most), numbers)
