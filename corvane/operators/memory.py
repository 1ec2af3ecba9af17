"""Memories of users: their history, what they were at a time, changes by their owners, search, and the recall gate.

A history is rows (memory_id, user_id, at, seq, event, content) with event add, update or
delete; ``seq`` orders what happened at one moment. The owner is the user of the first row.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import term_relevance
from .answers import valid_memory
from .ordered import last_known, with_next
from .retrieval import top_k


def history(events: DataFrame) -> DataFrame:
    """``events`` with ``valid_to``: the time of the next one of the same memory; null in the last."""
    return with_next(events, ["memory_id"], ["at", "seq"], ["at"], prefix="_next_").withColumnRenamed("_next_at", "valid_to")


def owners(events: DataFrame) -> DataFrame:
    """(memory_id, owner)."""
    return events.groupBy("memory_id").agg(F.min_by("user_id", F.struct("at", "seq")).alias("owner"))


def as_of(events: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests`` (request_id, memory_id, user_id, at) with ``content`` as it was at that time, and ``state``.

    States: denied (the user does not own the memory, or there is none), absent (not yet
    there, or deleted), present. Ownership is checked first, so that nothing of others is ever
    compared. Both sides are put in one order and the last known value is carried on:
    no pairs arise, and a memory of any number of rows needs no task of its own. A change at the very time of a request counts.
    """
    owned = requests.join(owners(events), "memory_id", "left").withColumn("_mine", F.coalesce(F.col("user_id") == F.col("owner"), F.lit(False))).drop("owner")
    change = F.struct((F.col("event") == "delete").alias("gone"), "content")
    left = events.select("memory_id", "at", F.lit(0).alias("kind"), F.col("seq").cast("string").alias("order"), F.col("seq").alias("_seq"), change.alias("change"), F.lit(None).cast(requests.schema["request_id"].dataType).alias("request_id"))
    right = owned.where("_mine").select("memory_id", "at", F.lit(1).alias("kind"), F.col("request_id").cast("string").alias("order"), F.lit(None).cast(events.schema["seq"].dataType).alias("_seq"), F.lit(None).cast(left.schema["change"].dataType).alias("change"), "request_id")
    filled = last_known(left.unionByName(right), ["memory_id"], ["at", "kind", "_seq", "order"], "change").where("kind = 1").select("request_id", F.col("last_change").alias("last"))
    found = owned.join(filled, "request_id", "left")
    present = F.col("last").isNotNull() & ~F.col("last.gone")
    state = F.when(~F.col("_mine"), "denied").when(present, "present").otherwise("absent")
    return found.withColumn("state", state).withColumn("content", F.when(F.col("_mine") & present, F.col("last.content"))).drop("last", "_mine")


def current(events: DataFrame) -> DataFrame:
    """(memory_id, owner, content, updated_at) of memories that are there."""
    last = F.max_by(F.struct("event", "content", "at"), F.struct("at", "seq")).alias("last")
    owner = F.min_by("user_id", F.struct("at", "seq")).alias("owner")
    return events.groupBy("memory_id").agg(owner, last).where("last.event != 'delete'").select("memory_id", "owner", "last.content", F.col("last.at").alias("updated_at"))


def changes(events: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (memory_id, user_id, at, seq, event, content) with ``accepted``: an update or delete needs a memory that is there and one's own, an add a new id."""
    there = current(events).select("memory_id", "owner")
    old = events.select("memory_id").distinct().withColumn("_old", F.lit(True))
    joined = asked.join(there, "memory_id", "left").join(old, "memory_id", "left")
    accepted = F.when(F.col("event") == "add", F.col("_old").isNull()).otherwise(F.col("user_id") == F.col("owner"))
    return joined.withColumn("accepted", F.coalesce(accepted, F.lit(False))).drop("owner", "_old")


def search(events: DataFrame, queries: DataFrame, k: int = 5, score=term_relevance) -> DataFrame:
    """The best ``k`` of a user's own memories for each query (query_id, user_id, query), by a score of query and content above 0."""
    own = current(events).select(F.col("memory_id").alias("doc_id"), F.col("owner").alias("user_id"), "content")
    pairs = queries.join(own, "user_id").select("query_id", "doc_id", score("query", "content").alias("score")).where("score > 0")
    return top_k(pairs, k)


def recall_gate(memories: DataFrame, claims: DataFrame, user_known: Column) -> DataFrame:
    """``memories`` with ``verdict``: plain, verified, invalid_metadata or acl_filtered; only plain and verified ones may be recalled.

    A memory that says it is research (by memory_type or scope) has to show both marks, a project
    (which may be empty), run, claim and sources, a passed review, the user's confirmation and that it was verified; and
    what it cites has to be the claim that was confirmed: ``claims`` (run_id, claim_id, project_id, source_ids, readable) holds
    those that may be read. Any other memory is plain. Columns: memory_type, scope, project_id, run_id, claim_id, source_ids,
    review_decision, user_confirmed, verified.
    """
    c = F.col
    research = F.coalesce((c("memory_type") == "confirmed_research_fact") | (c("scope") == "research"), F.lit(False)) | F.coalesce(c("scope") == "research", F.lit(False))
    filled = lambda name: F.length(F.trim(c(name).cast("string"))) > 0
    needed = (
        c("memory_type") == "confirmed_research_fact", c("scope") == "research", c("project_id").isNotNull(), filled("run_id"), filled("claim_id"), F.size("source_ids") > 0,
        c("review_decision") == "PASS", c("user_confirmed"), c("verified"), user_known,
    )
    complete = reduce(and_, (F.coalesce(x.cast("boolean"), F.lit(False)) for x in needed))
    cited = claims.select("run_id", "claim_id", c("project_id").alias("_project"), c("source_ids").alias("_sources"), c("readable").alias("_readable"))
    # a table of claims may look small where its rows are made of few others, and then fills a task if it is broadcast
    joined = memories.join(cited.hint("merge"), ["run_id", "claim_id"], "left")
    valid = valid_memory(c("_project"), c("project_id"), c("_sources"), c("source_ids"), F.coalesce(c("_readable"), F.lit(False)))
    verdict = F.when(~research, "plain").when(~complete, "invalid_metadata").when(valid, "verified").otherwise("acl_filtered")
    return joined.withColumn("verdict", verdict).drop("_project", "_sources", "_readable")


def recall_counts(gated: DataFrame) -> DataFrame:
    """One row of counters over a gate's verdicts."""
    n = lambda *which: F.count_if(F.col("verdict").isin(*which))
    return gated.agg(F.count("*").alias("candidates"), n("plain", "verified").alias("allowed"), n("acl_filtered").alias("acl_filtered"), n("invalid_metadata").alias("invalid_metadata"), n("verified").alias("research_verified"))
