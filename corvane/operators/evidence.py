"""Evidence, claims and conflicts."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import term_relevance
from .ordered import with_next

# Quantities are an attribute, a number and one of these units; words that contradict each other.
UNITS = "天|人|年|月|%|percent|元|万元|次|件|个"
CONTRADICTIONS = (("可以", "不能"), ("必须", "禁止"), ("需要", "无需"), ("有权", "无权"), ("同意", "拒绝"), ("批准", "驳回"), ("有效", "无效"), ("适用", "不适用"))


def quantities(docs: DataFrame, text: str = "text", units: str = UNITS) -> DataFrame:
    """Rows (doc_id, attribute, value, unit) of all "attribute number unit" in a text."""
    pattern = rf"([一-龥a-zA-Z]{{2,8}})\s*([0-9]+(?:\.[0-9]+)?)\s*({units})"
    whole = F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)))
    rows = docs.select("doc_id", whole.alias("m"))
    return rows.select("doc_id", *(F.regexp_extract("m", pattern, k).alias(n) for k, n in ((1, "attribute"), (2, "value"), (3, "unit"))))


def numeric_conflicts(found: DataFrame) -> DataFrame:
    """Attributes and units with more than one value: (attribute, unit, n_values, n_docs)."""
    values = found.groupBy("attribute", "unit", "value").agg(F.count("*").alias("n"))
    per = values.groupBy("attribute", "unit").agg(F.count("*").alias("n_values"))
    docs = found.groupBy("attribute", "unit").agg(F.countDistinct("doc_id").alias("n_docs"))
    return per.where("n_values > 1").join(docs, ["attribute", "unit"])


def contradicting_neighbours(ranked: DataFrame, pairs=CONTRADICTIONS, limit: int | None = 500) -> DataFrame:
    """Documents next to each other in a query's ranking of which one affirms what the other denies.

    ``ranked``: (query_id, rank, doc_id, title, text); ranks of a query differ. Only the
    first ``limit`` characters count, all without one, and documents with the same or no
    title do not contradict each other. Of the texts only the words found go on to the
    comparison, and a ranking may be of any length.
    """
    words = sorted({w for pair in pairs for w in pair})
    head = F.substring("text", 1, limit) if limit else F.col("text")
    rows = ranked.select("query_id", "rank", "doc_id", "title", F.array(*(F.contains(head, F.lit(w)) for w in words)).alias("held"))
    rows = with_next(rows, ["query_id"], ["rank"], ["doc_id", "title", "held"])
    has = lambda side, w: F.coalesce(F.get(side, F.lit(words.index(w))), F.lit(False))
    clash = reduce(or_, ((has("held", a) & has("next_held", b)) | (has("held", b) & has("next_held", a)) for a, b in pairs))
    named = (F.col("title") != "") & (F.col("next_title") != "") & (F.col("title") != F.col("next_title"))
    return rows.where(clash & named).select("query_id", "doc_id", "next_doc_id")


def numbered_evidence(found: DataFrame, limit: int = 12) -> DataFrame:
    """Best score of each (query_id, source, excerpt), numbered S1, S2, ... in order of score."""
    best = found.withColumn("key", F.md5(F.concat_ws("\x1f", "source", F.substring("excerpt", 1, 300)))).groupBy("query_id", "key").agg(F.max(F.struct("score", "source", "excerpt")).alias("b"))
    order = W.partitionBy("query_id").orderBy(F.round("b.score", 9).desc(), "key")
    rows = best.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit)
    return rows.select("query_id", F.concat(F.lit("S"), F.col("n").cast("string")).alias("source_id"), "b.source", "b.excerpt", "b.score")


def claim_issues(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Each claim with its issue: missing_citation, invalid_source, or null.

    ``claims``: (run_id, claim_id, source_ids); ``evidence``: (run_id, source_id).
    """
    cited = claims.select("run_id", "claim_id", F.explode_outer("source_ids").alias("source_id"))
    known = evidence.select("run_id", "source_id").distinct().withColumn("known", F.lit(True))
    state = cited.join(known, ["run_id", "source_id"], "left").groupBy("run_id", "claim_id").agg(F.count("source_id").alias("n_cited"), F.count_if(F.col("source_id").isNotNull() & F.col("known").isNull()).alias("n_unknown"))
    issue = F.when(F.col("n_cited") == 0, "missing_citation").when(F.col("n_unknown") > 0, "invalid_source")
    return state.select("run_id", "claim_id", "n_cited", "n_unknown", issue.alias("issue"))


def valid_claims(claims: DataFrame, evidence: DataFrame, rejected: DataFrame | None = None) -> DataFrame:
    """Claims without an issue whose text no reviewer rejected."""
    good = claim_issues(claims, evidence).where("issue is null").select("run_id", "claim_id")
    kept = claims.join(good, ["run_id", "claim_id"], "left_semi")
    return kept if rejected is None else kept.join(rejected.select("run_id", F.col("claim").alias("text")), ["run_id", "text"], "left_anti")


def coverage(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """For each run the share of its evidence that a claim cites."""
    cited = claims.select("run_id", F.explode("source_ids").alias("source_id")).distinct().withColumn("cited", F.lit(1))
    return evidence.join(cited, ["run_id", "source_id"], "left").groupBy("run_id").agg(F.count("*").alias("n_evidence"), F.coalesce(F.sum("cited"), F.lit(0)).alias("n_cited")).withColumn("coverage", F.col("n_cited") / F.col("n_evidence"))


def support(claims: DataFrame, evidence: DataFrame, least: float = 0.12) -> DataFrame:
    """Whether any cited excerpt shares at least this much of a claim's terms."""
    cited = claims.select("run_id", "claim_id", F.col("text").alias("claim"), F.explode("source_ids").alias("source_id"))
    return cited.join(evidence, ["run_id", "source_id"]).groupBy("run_id", "claim_id").agg(F.max(term_relevance("claim", "excerpt")).alias("support")).withColumn("supported", F.col("support") >= least)


def failure_attribution(acl_blocked: Column, n_results: Column, n_evidence: Column, n_claims: Column, n_rejected: Column, n_answered: Column) -> Column:
    """The first stage that failed: acl, knowledge_gap, retrieval, analysis, review, generation or none."""
    return (
        F.when(acl_blocked, "acl").when(n_results == 0, "knowledge_gap").when(n_evidence == 0, "retrieval").when(n_claims == 0, "analysis")
        .when(n_rejected >= n_claims, "review").when(n_answered < n_claims - n_rejected, "generation").otherwise("none")
    )


def review_route(decision: Column, revisions: Column) -> Column:
    """A pass or one revision leads on to generation."""
    return F.when((decision == "PASS") | (revisions >= 1), "generate").otherwise("revise")


def rendered_claims(claims: DataFrame) -> DataFrame:
    """One text for each run: its claims with citations."""
    line = F.concat(F.lit("- "), F.col("text"), F.transform(F.array(F.array_join("source_ids", "][")), lambda s: F.when(s != "", F.concat(F.lit(" ["), s, F.lit("]"))).otherwise(""))[0])
    rows = claims.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("claim_id", line.alias("line")))).alias("l"))
    return rows.select("run_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("answer"))


def reusable_runs(runs: DataFrame, hidden: DataFrame) -> DataFrame:
    """The newest completed and passed run of each question with at least two subquestions and nothing hidden."""
    usable = runs.where((F.col("status") == "completed") & (F.col("decision") == "PASS") & (F.col("n_subquestions") >= 2)).join(hidden.select("run_id"), "run_id", "left_anti")
    order = W.partitionBy("question").orderBy(F.col("created_at").desc(), "run_id")
    return usable.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def redacted_runs(runs: DataFrame, evidence: DataFrame, visible: DataFrame) -> DataFrame:
    """Runs with the number of evidence rows that the reader may not see; with any, the answer is withheld."""
    hidden = evidence.join(visible.select("doc_id"), "doc_id", "left_anti").groupBy("run_id").agg(F.count("*").alias("n_hidden"))
    both = runs.join(hidden, "run_id", "left").withColumn("n_hidden", F.coalesce("n_hidden", F.lit(0)))
    return both.withColumn("answer", F.when(F.col("n_hidden") == 0, F.col("answer")))


def revision_diff(before: DataFrame, after: DataFrame, key: str = "claim_ids") -> DataFrame:
    """Ids added and removed between two states (run_id, ids)."""
    a, b = before.select("run_id", F.col(key).alias("a")), after.select("run_id", F.col(key).alias("b"))
    return a.join(b, "run_id").select("run_id", F.array_except("b", "a").alias("added"), F.array_except("a", "b").alias("removed"))
