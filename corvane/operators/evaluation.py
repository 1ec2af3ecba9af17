"""Evaluation of answers and pipelines: judge scores, claim axes, attribution of misses, reviews of pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import judge_score, normalised_score

AXES = ("faithfulness", "answer_relevancy", "context_recall", "context_precision")


def judged(replies: DataFrame) -> DataFrame:
    """Scores of a judge's replies (one text column for each of AXES).

    The first two go to a scale of 0 to 1, the last two stay on 1 to 5; a case with a
    missing reply has 0.5 everywhere.
    """
    missing = F.greatest(*(F.col(a).isNull() for a in AXES))
    scores = {a: normalised_score(judge_score(a)) if k < 2 else judge_score(a) for k, a in enumerate(AXES)}
    return replies.withColumns({a: F.when(missing, F.lit(0.5)).otherwise(s) for a, s in scores.items()})


def eligible_recall(expected: DataFrame, results: DataFrame, corpus: DataFrame, allowed: DataFrame) -> DataFrame:
    """Recall over all expected documents, and over those that are in the corpus and may be read.

    expected and results: (query_id, doc_id); corpus and allowed: (doc_id).
    """
    rows = expected.select("query_id", "doc_id").distinct()
    flag = lambda df, keys, name: df.select(*keys).distinct().withColumn(name, F.lit(True))
    rows = rows.join(flag(results, ["query_id", "doc_id"], "hit"), ["query_id", "doc_id"], "left").join(flag(corpus, ["doc_id"], "there"), "doc_id", "left").join(flag(allowed, ["doc_id"], "open"), "doc_id", "left")
    eligible = F.coalesce(F.col("there") & F.col("open"), F.lit(False))
    hit = F.col("hit").isNotNull()
    return rows.groupBy("query_id").agg(
        F.count("*").alias("n_expected"), F.count_if(eligible).alias("n_eligible"), (F.count_if(hit) / F.count("*")).alias("recall"),
        (F.count_if(hit & eligible) / F.nullif(F.count_if(eligible), F.lit(0).cast("long"))).alias("eligible_recall"),
    )


def miss_reason(in_corpus: Column, readable: Column, planned: Column, candidate_rank: Column, k: int, lexical_rank: Column, vector_rank: Column) -> Column:
    """Why an expected document is missing: missing_document, acl, planning, rerank, lexical, semantic or unknown; the first that fits."""
    return (
        F.when(~in_corpus, "missing_document").when(~readable, "acl").when(~planned, "planning").when(candidate_rank > k, "rerank")
        .when(candidate_rank.isNotNull(), "unknown").when(lexical_rank.isNull() & vector_rank.isNotNull(), "lexical").otherwise("semantic")
    )


def unique_claims(claims: DataFrame, most: int = 24) -> DataFrame:
    """First of claims equal but for case and white space, numbered C1, C2, ... in each case's order."""
    key = F.lower(F.trim(F.regexp_replace("text", r"\s+", " ")))
    first = claims.withColumn("key", key).where("key != ''").groupBy("case_id", "key").agg(F.min(F.struct("position", "text")).alias("f"))
    rows = first.withColumn("n", F.row_number().over(W.partitionBy("case_id").orderBy("f.position"))).where(F.col("n") <= most)
    return rows.select("case_id", F.concat(F.lit("C"), F.col("n").cast("string")).alias("claim_id"), "f.text")


def claim_scores(verdicts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and faithfulness of each case from verdicts (case_id, axis, verdict).

    Axes: response (claims that the gold answer supports), gold (gold claims that the
    response has), context (response claims that the contexts support).
    """
    rate = lambda axis: F.avg(F.when(F.col("axis") == axis, (F.col("verdict") == "supported").cast("double")))
    rows = verdicts.groupBy("case_id").agg(rate("response").alias("precision"), rate("gold").alias("recall"), rate("context").alias("faithfulness"))
    p, r = F.coalesce("precision", F.lit(0.0)), F.coalesce("recall", F.lit(0.0))
    return rows.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))


def complete_verdicts(expected: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Verdicts for all expected (case_id, axis, claim_id); what the judge left out is not_enough_information."""
    known = F.when(F.col("verdict").isin("supported", "contradicted", "not_enough_information"), F.col("verdict"))
    return expected.join(verdicts, ["case_id", "axis", "claim_id"], "left").withColumn("verdict", F.coalesce(known, F.lit("not_enough_information")))


def judge_batches(items: DataFrame, size: int = 8) -> DataFrame:
    """Items of each case and axis in batches of ``size``, numbered from 0."""
    n = F.row_number().over(W.partitionBy("case_id", "axis").orderBy("claim_id")) - 1
    return items.withColumn("batch", F.floor(n / size))


def by_category(rows: DataFrame, categories: str, *values: str) -> DataFrame:
    """Means for each of a row's categories (an array) and overall; context metrics may be averaged above 0 with positive_mean()."""
    every = F.explode(F.array_union(F.array(F.lit("overall")), F.coalesce(F.col(categories), F.array().cast("array<string>"))))
    return rows.withColumn("category", every).groupBy("category").agg(F.count("*").alias("n"), *(F.avg(v).alias(v) for v in values))


def positive_mean(value: Column | str) -> Column:
    """Mean of the values above 0."""
    c = F.col(value) if isinstance(value, str) else value
    return F.avg(F.when(c > 0, c))


def review_wins(scores: DataFrame, mapping: DataFrame) -> DataFrame:
    """Blind reviews (case_id, label, score) under their mapping (case_id, label, system): mean and wins of each system; ties win for none."""
    named = scores.join(mapping, ["case_id", "label"])
    best = F.max("score").over(W.partitionBy("case_id"))
    rows = named.withColumn("top", (F.col("score") == best).cast("int"))
    tied = F.sum("top").over(W.partitionBy("case_id"))
    rows = rows.withColumn("win", F.when((F.col("top") == 1) & (tied == 1), 1).otherwise(0))
    return rows.groupBy("system").agg(F.count("*").alias("reviews"), F.avg("score").alias("mean"), F.sum("win").alias("wins"))


def regressions(runs: DataFrame, baseline: str) -> DataFrame:
    """For each other variant: share of the baseline's hits that it lost, and of misses that it turned into hits.

    ``runs``: (query_id, variant, hit).
    """
    base = runs.where(F.col("variant") == baseline).select("query_id", F.col("hit").alias("base"))
    both = runs.where(F.col("variant") != baseline).join(base, "query_id")
    rate = lambda c, of: F.avg(F.when(of, c.cast("double")))
    return both.groupBy("variant").agg(rate(~F.col("hit"), F.col("base")).alias("lost"), rate(F.col("hit"), ~F.col("base")).alias("gained"))


def hit_rate(log: DataFrame, hit: str = "hit", by: str = "kind") -> DataFrame:
    """Hit rate of a cache's log for each kind."""
    return log.groupBy(by).agg(F.count("*").alias("requests"), F.avg(F.col(hit).cast("double")).alias("hit_rate"))


def leaks(results: DataFrame, denied: DataFrame) -> DataFrame:
    """Numbers of results for each query that its reader may not see; (query_id, doc_id) of both."""
    return results.join(denied.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("leaks"))
