"""The catalogue of documents and what is kept beside it: searches, pages, registration, feedback, CSV texts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import numbered

CATALOGUE_FIELDS = ("title", "source", "author", "project_name", "research_direction", "summary")


def keyword_filter(columns: list[str], keyword: str) -> Column:
    """Rows of which one of the columns holds the keyword, whatever its case; an empty keyword fits all."""
    wanted = keyword.strip().lower()
    if not wanted:
        return F.lit(True)
    return reduce(or_, (F.coalesce(F.contains(F.lower(c), F.lit(wanted)), F.lit(False)) for c in columns))


def free_text_filter(columns: list[str], text: str) -> Column:
    """As keyword_filter(), in all columns joined by spaces, so a search may run from one into the next."""
    joined = F.lower(F.concat_ws(" ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)))
    return F.contains(joined, F.lit(text.strip().lower()))


def optional(column: str, value) -> Column:
    """Equality, or no condition where the value is null or empty."""
    return F.lit(True) if value is None or value == "" else F.coalesce(F.col(column) == value, F.lit(False))


def newest_first(rows: DataFrame, time: str = "created_at", title: str = "title") -> DataFrame:
    """By time, then title, both descending; a missing time comes last."""
    return rows.orderBy(F.coalesce(F.col(time).cast("string"), F.lit("")).desc(), F.col(title).desc())


def scrolled(rows: DataFrame, key: str, size: int = 256) -> DataFrame:
    """``rows`` with the number of their page, from 0, in order of a unique key; pages of a table of any size."""
    return numbered(rows, [], [key], "_place").withColumn("page", F.floor((F.col("_place") - 1) / size)).drop("_place")


def registered(current: DataFrame, arriving: DataFrame, key: str = "doc_id") -> DataFrame:
    """New documents are added as published; those that are there stay as they are."""
    fresh = arriving.join(current.select(key), key, "left_anti").dropDuplicates([key]).withColumn("status", F.lit("published"))
    return current.unionByName(fresh, allowMissingColumns=True)


def archived(documents: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Soft deletion: the rows stay, with the status archived."""
    marked = documents.join(ids.select(key).distinct().withColumn("_gone", F.lit(True)), key, "left")
    return marked.withColumn("status", F.when(F.col("_gone"), "archived").otherwise(F.col("status"))).drop("_gone")


def feedback_issues(feedback: DataFrame, resolutions: DataFrame, reader: str | None, status: str = "open", limit: int = 20) -> DataFrame:
    """Newest negative feedback with its status by the last resolution; a ``reader`` who reviews (None) sees everyone's.

    feedback: (feedback_id, username, feedback_type, at); resolutions: (feedback_id, status, at).
    """
    last = resolutions.groupBy("feedback_id").agg(F.max_by("status", "at").alias("status"))
    rows = feedback.where(F.col("feedback_type") != "like").join(last, "feedback_id", "left").withColumn("status", F.coalesce("status", F.lit("open")))
    mine = rows if reader is None else rows.where(F.col("username") == reader)
    return mine.where(F.col("status") == status).orderBy(F.col("at").desc(), "feedback_id").limit(min(max(limit, 1), 100))


def sessions_of(sessions: DataFrame, user: str, limit: int = 50) -> DataFrame:
    """A user's sessions, whose ids begin with the user's and an underscore, newest first."""
    own = sessions.where(F.col("session_id").startswith(user.replace("_", "__") + "_"))
    return own.orderBy(F.col("updated_at").desc(), "session_id").limit(limit)


def live_entries(log: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """A cache from its log (key, value, at): the newest value of each key unless it has expired."""
    newest = log.groupBy("key").agg(F.max_by("value", "at").alias("value"), F.max("at").alias("at"))
    return newest.where(F.unix_timestamp(now) - F.unix_timestamp("at") < ttl_seconds)


def csv_checked(text: Column | str, max_rows: int = 1000, max_columns: int = 50) -> Column:
    """Struct (problem, header, n_rows) of CSV texts; problem is null for a table with unique, filled names and equal widths."""
    import csv
    import io

    def checked(value: str | None) -> tuple:
        try:
            rows = list(csv.reader(io.StringIO(value or ""), strict=True))
        except csv.Error:
            return "format", None, None
        if not 2 <= len(rows) <= max_rows + 1:
            return "rows", None, None
        header = [name.strip() for name in rows[0]]
        if not all(header) or len(header) > max_columns or len(set(header)) != len(header):
            return "header", None, None
        if any(len(row) != len(header) for row in rows[1:]):
            return "width", None, None
        return None, header, len(rows) - 1

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([checked(t) for t in batch], columns=["problem", "header", "n_rows"]).astype({"n_rows": "Int64"})

    return F.pandas_udf(run, "problem string, header array<string>, n_rows long")(text)
