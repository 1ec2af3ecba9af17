"""Corrective retrieval: grades, decisions, and a bounded loop over unresolved queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import term_relevance
from ..storage import stored

#: Share of high grades, mean score of a HIGH and of a MEDIUM decision, and share of low grades for NO_RESULTS.
MIN_HIGH_RATIO, HIGH_MEAN, MEDIUM_MEAN, NO_RESULTS_LOW_RATIO = 0.2, 0.25, 0.15, 0.8


def graded(results: DataFrame, query: str = "query", text: str = "text", high: float = 0.5, medium: float = 0.25, score=term_relevance) -> DataFrame:
    """Results with a relevance score and a grade: high, medium or low."""
    rows = results.withColumn("relevance", score(query, text))
    grade = F.when(F.col("relevance") >= high, "high").when(F.col("relevance") >= medium, "medium").otherwise("low")
    return rows.withColumn("grade", grade)


def decisions(grades: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """One row for each query: numbers of grades, mean score, and the decision high, medium, low or no_results.

    ``queries`` adds those without any result.
    """
    counts = grades.groupBy("query_id").agg(F.count("*").alias("n_docs"), *(F.count_if(F.col("grade") == g).alias(f"n_{g}") for g in ("high", "medium", "low")), F.avg("relevance").alias("mean_score"))
    if queries is not None:
        counts = queries.select("query_id").distinct().join(counts, "query_id", "left").fillna(0)
    n = F.col("n_docs")
    decision = (
        F.when(n == 0, "no_results")
        .when((F.col("n_high") == 0) & (F.col("n_medium") == 0) & (F.col("n_low") / n >= NO_RESULTS_LOW_RATIO), "no_results")
        .when((F.col("n_high") / n >= MIN_HIGH_RATIO) & (F.col("mean_score") >= HIGH_MEAN), "high")
        .when((F.col("n_high") + F.col("n_medium") > 0) & (F.col("mean_score") >= MEDIUM_MEAN), "medium")
        .otherwise("low")
    )
    return counts.withColumn("decision", decision)


def usable(grades: DataFrame, decided: DataFrame) -> DataFrame:
    """High documents of a high decision, high and medium ones of a medium decision."""
    wanted = F.when(F.col("decision") == "high", F.col("grade") == "high").when(F.col("decision") == "medium", F.col("grade") != "low").otherwise(False)
    return grades.join(decided.select("query_id", "decision"), "query_id").where(wanted)


def corrective_retrieval(queries: DataFrame, retrieve: Callable[[DataFrame], DataFrame], rewrite: Callable[[DataFrame], DataFrame], rounds: int = 3) -> DataFrame:
    """Retrieve, grade, and try rewritten queries again where the decision is low; at most ``rounds`` rounds.

    ``retrieve`` gives (query_id, query, doc_id, text, ...) for (query_id, query); ``rewrite``
    gives new texts for queries without an answer. Only these go into the next round; each
    round's grades, decisions and open queries are stored, which computes them once and cuts the lineage.
    """
    found: DataFrame | None = None
    pending = queries.select("query_id", "query")
    for number in range(1, rounds + 1):
        grades = stored(graded(retrieve(pending)), "correction-grades")
        decided = stored(decisions(grades, pending), "correction-decisions")
        good = usable(grades, decided).withColumn("round", F.lit(number))
        found = good if found is None else found.unionByName(good)
        unresolved = decided.where(F.col("decision").isin("low", "no_results")).select("query_id")
        if number == rounds:
            break
        pending = rewrite(pending.join(unresolved, "query_id", "left_semi"))
        pending = stored(pending, "pending-queries")
        if pending.isEmpty():
            break
    return found
