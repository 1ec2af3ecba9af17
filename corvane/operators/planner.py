"""The default way from questions to documents: each question takes one of several branches, and each branch is one plan for all of its questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metadata import snippet
from ..functions.text import is_meaningful_query, term_relevance
from ..storage import stored
from . import correction, retrieval

#: From questions (query_id, query) and a number to (query_id, doc_id, score, rank).
Search = Callable[[DataFrame, int], DataFrame]


def branch(query: Column | str, corrected: Column, needs_expansion: Column, rewritten: Column) -> Column:
    """none (not a meaningful question), corrected, expanded, standalone (there are rewritten forms) or plain."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(~yes(is_meaningful_query(query)), "none").when(yes(corrected), "corrected").when(yes(needs_expansion), "expanded").when(yes(F.size(rewritten) > 0), "standalone").otherwise("plain")


def retrieve_documents(
    queries: DataFrame, docs: DataFrame, search: Search, k: int = 5, rewrite: Callable[[DataFrame], DataFrame] | None = None, rounds: int = 3,
    knowledge: DataFrame | None = None, knowledge_k: int = 2, most: int = 4, score=term_relevance,
) -> DataFrame:
    """(query_id, doc_id, rank, score, branch) for questions (query_id, query, parts, rewritten, needs_expansion, corrected, project_id).

    * plain: three times as many candidates, reordered by ``score``;
    * standalone: the question and its ``rewritten`` forms, fused by ranks;
    * expanded: the question, rewritten forms and ``parts``, up to ``most`` different texts with three results each, fused;
    * corrected: ``rounds`` of grading and ``rewrite``;
    * none: no results.

    ``docs`` (doc_id, text) are what may be read. ``knowledge`` (see
    ``retrieval.project_knowledge``) of the question's project comes after, within ``k`` in all.
    """
    none = F.array().cast("array<string>")
    asked = queries.withColumns({c: F.coalesce(F.col(c), none) for c in ("parts", "rewritten")})
    asked = stored(asked.withColumn("branch", branch("query", F.col("corrected"), F.col("needs_expansion"), F.col("rewritten"))), "planner-questions")
    of = lambda name: asked.where(F.col("branch") == name)
    texts = docs.select("doc_id", "text")
    columns = ("query_id", "doc_id", "score", "rank")

    candidates = retrieval.with_texts(search(of("plain").select("query_id", "query"), 3 * k).join(asked.select("query_id", "query"), "query_id"), texts)
    plain = retrieval.rerank(candidates, "query", "text", k, score=score).select(*columns)

    forms = of("standalone").select("query_id", F.posexplode(F.array_distinct(F.concat(F.array("query"), "rewritten"))).alias("part", "query"))
    forms = stored(forms.withColumn("form", F.to_json(F.struct("query_id", "part"))), "planner-forms")
    lists = search(forms.select(F.col("form").alias("query_id"), "query"), k).withColumnRenamed("query_id", "form").join(forms.select("form", "query_id", F.col("part").cast("string").alias("list")), "form")
    standalone = retrieval.top_k(retrieval.rrf(lists.select("query_id", "doc_id", "list", "rank")), k).select(*columns)

    wider = of("expanded").select("query_id", "query", F.concat("rewritten", "parts").alias("parts"))
    expanded = retrieval.decomposed(wider, lambda q: search(q, 3), k, most=most, each=3).select(*columns)

    def graded(q: DataFrame) -> DataFrame:
        return retrieval.with_texts(search(q, k).join(q.select("query_id", "query"), "query_id"), texts)

    good = correction.corrective_retrieval(of("corrected").select("query_id", "query"), graded, rewrite or (lambda q: q.limit(0)), rounds)
    corrected = retrieval.top_k(good.select("query_id", "doc_id", "score"), k).select(*columns)

    every = (df.withColumn("branch", F.lit(name)) for name, df in (("plain", plain), ("standalone", standalone), ("expanded", expanded), ("corrected", corrected)))
    found = next(every)
    for df in every:
        found = found.unionByName(df)
    if knowledge is None:
        return found
    extra = retrieval.project_knowledge(asked.where("branch != 'none' and project_id is not null and trim(project_id) != ''").select("query_id", "project_id", "query"), knowledge, knowledge_k)
    found = stored(found, "planner-found")
    merged = retrieval.merge_knowledge(found, extra, k)
    return merged.join(asked.select("query_id", "branch"), "query_id").select(*columns, "branch")


def reauthorised(results: DataFrame, docs: DataFrame, may_read: Column) -> DataFrame:
    """``results`` of documents that may be read now, whatever gave them: ``may_read`` is a rule over the columns of ``docs``. Ranks stay as they are."""
    return results.join(docs.where(F.coalesce(may_read, F.lit(False))).select("doc_id"), "doc_id", "left_semi")


def service_search(queries: DataFrame, docs: DataFrame, search: Callable[[DataFrame], Search], k: int = 5, condition: Column | None = None, may_read: Column | None = None, reranked: bool = True, score=term_relevance) -> DataFrame:
    """One row for each question (query_id, query) that found anything: ``n``, and ``results``, an array of (rank, doc_id, score, snippet) in order.

    ``condition`` (a compiled filter) and ``may_read`` come before any cut; ``search`` makes a search of the documents that
    are left. Reranked, three times as many candidates are reordered by ``score``. At the end the rule is applied once more.
    """
    rule = F.lit(True) if may_read is None else may_read
    allowed = docs.where((F.lit(True) if condition is None else condition) & rule)
    texts = allowed.select("doc_id", "text")
    found = retrieval.with_texts(search(texts)(queries.select("query_id", "query"), 3 * k if reranked else k), texts)
    if reranked:
        found = retrieval.rerank(found.join(queries.select("query_id", "query"), "query_id"), "query", "text", k, score=score)
    final = reauthorised(found, docs, rule)
    row = F.struct("rank", "doc_id", F.round("score", 6).alias("score"), snippet("text").alias("snippet"))
    return final.groupBy("query_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(row)).alias("results"))
