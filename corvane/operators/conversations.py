"""Messages of sessions: history, anchors, search, context budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def last_messages(messages: DataFrame, n: int, session: str = "conv_id", order: str = "turn") -> DataFrame:
    """The last ``n`` messages of each session, with position 1 for the last."""
    place = F.row_number().over(W.partitionBy(session).orderBy(F.col(order).desc()))
    return messages.withColumn("position", place.cast("long")).where(F.col("position") <= n)


def with_anchor(messages: DataFrame, session: str = "conv_id", order: str = "turn", limit: int = 120) -> DataFrame:
    """Each message with the text of the last user message before it, cut to ``limit`` characters."""
    before = W.partitionBy(session).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    anchor = F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(before)
    return messages.withColumn("anchor", F.substring(anchor, 1, limit))


def standalone_queries(messages: DataFrame, trigger: str, limit: int = 240, **options) -> DataFrame:
    """User messages with a standalone form: where the trigger pattern fits, the anchor in front."""
    rows = with_anchor(messages, **options).where("role = 'user'")
    fired = F.col("text").rlike(trigger) & F.col("anchor").isNotNull()
    return rows.withColumn("triggered", F.coalesce(fired, F.lit(False))).withColumn("standalone", F.substring(F.when(fired, F.concat_ws(" ", "anchor", "text")).otherwise(F.col("text")), 1, limit))


def search(messages: DataFrame, keyword: str, recent: int = 10, hits: int = 3, session: str = "conv_id", order: str = "turn") -> DataFrame:
    """Of the last ``recent`` messages of each session the last ``hits`` that contain a keyword."""
    found = last_messages(messages, recent, session, order).drop("position").where(F.contains(F.lower("text"), F.lit(keyword.lower())))
    return last_messages(found, hits, session, order)


def session_overview(messages: DataFrame, session: str = "conv_id") -> DataFrame:
    """Numbers of messages by role and the title of each session: its first user message."""
    first = F.min_by("text", F.when(F.col("role") == "user", F.col("turn")))
    return messages.groupBy(session).agg(F.count("*").alias("messages"), F.count_if(F.col("role") == "user").alias("user_messages"), first.alias("first_message"))


def within_budget(items: DataFrame, budget: int, group: str, order: str, text: str = "text", least: int = 50) -> DataFrame:
    """Items in order as long as their characters, and 2 for each, fit; the first that does not is cut if over ``least`` remain."""
    upto = W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    used = F.sum(F.length(text) + 2).over(upto)
    left = budget - (used - F.length(text) - 2)
    rows = items.withColumn("left", left)
    whole, cut = F.length(text) + 2 <= F.col("left"), F.col("left") > least
    return rows.where(whole | cut).withColumn("kept", F.when(whole, F.col(text)).otherwise(F.substring(F.col(text), F.lit(1), F.col("left").cast("int")))).drop("left")


def to_summarise(messages: DataFrame, threshold: int, keep: int, session: str = "conv_id", order: str = "turn") -> DataFrame:
    """Messages that a summary should replace: in sessions longer than ``threshold``, all but the last ``keep``."""
    n = F.count("*").over(W.partitionBy(session))
    place = F.row_number().over(W.partitionBy(session).orderBy(F.col(order).desc()))
    return messages.withColumn("_n", n).withColumn("_p", place).where((F.col("_n") > threshold) & (F.col("_p") > keep)).drop("_n", "_p")
