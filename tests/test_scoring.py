"""Batches of queries scored where the documents are, against the joins of all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from corvane.functions.text import term_relevance, terms
from corvane.operators import registry, retrieval, scoring


def _ranked(df):
    return sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 9)) for r in df.collect())


def _texts(n, seed, ids):
    pick = random.Random(seed)
    return [(ids(i), None if i % 17 == 5 else " ".join(pick.choice("a b c d e f g hh ii jj kk".split()) for _ in range(pick.randrange(40)))) for i in range(n)]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("variant", ["lucene", "okapi"])
@pytest.mark.parametrize("parts", [1 << 20, 7])
def test_bm25_keeps_pairs_within_tasks(spark, monkeypatch, variant, parts):
    monkeypatch.setattr(scoring, "TILE_PARTS", parts)
    docs = spark.createDataFrame(_texts(300, 1, str), "doc_id string, text string").repartition(5)
    asked = spark.createDataFrame(_texts(20, 2, int) + [(90, "absent"), (91, "")], "q long, text string")
    some = docs.where("doc_id % 3 != 0")
    for options in ({}, {"searched": some}):
        found = retrieval.bm25(docs, asked, "q", "text", 4, variant=variant, **options)
        assert "Aggregate [query_id" not in _plan(found)
        every = retrieval.bm25_scores(docs, asked, "q", "text", variant=variant, **options)
        assert _ranked(found) == _ranked(retrieval.top_k(every.where("score > 0"), 4))


def test_bm25_of_large_batches_and_repeated_ids(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b"), (1, "a c"), (2, "a a d"), (None, "d")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "a d")], "q long, text string")
    want = _ranked(retrieval.top_k(retrieval.bm25_scores(docs, asked, "q", "text").where("score > 0"), 9))
    assert _ranked(retrieval.bm25(docs, asked, "q", "text", 9)) == want
    docs = docs.where("text != 'a c'")
    few = retrieval.bm25(docs, asked, "q", "text", 9).collect()
    monkeypatch.setattr(scoring, "BATCH_ROWS", 1)
    many = retrieval.bm25(docs, asked, "q", "text", 9).collect()
    assert [(r.doc_id, r["rank"], round(r.score, 9)) for r in few] == [(r.doc_id, r["rank"], round(r.score, 9)) for r in many]


def test_copies_keep_the_first_ids(spark):
    docs = spark.createDataFrame([(i, "x y") for i in range(500)], "doc_id long, text string").repartition(4)
    asked = spark.createDataFrame([(1, "x"), (2, "y z")], "q long, text string")
    assert [(r.query_id, r.doc_id) for r in retrieval.bm25(docs, asked, "q", "text", 3).orderBy("query_id", "rank").collect()] == [(q, d) for q in (1, 2) for d in range(3)]


def test_project_knowledge_scores_no_pairs(spark):
    rows = [(i, i % 3, text, "active", "x", ["s"]) for i, text in _texts(120, 3, int)]
    records = spark.createDataFrame(rows, "id long, project_id long, statement string, status string, origin string, source_ids array<string>")
    asked = spark.createDataFrame([(i, i % 4, t) for i, t in _texts(12, 4, int)], "query_id long, project_id long, query string")
    found = retrieval.project_knowledge(asked, records, 3)
    assert "Join" not in _plan(found)
    pairs = asked.join(records.select(F.col("id").alias("doc_id"), "project_id", "statement"), "project_id").select("query_id", "doc_id", term_relevance("query", "statement").alias("score"))
    assert _ranked(found) == _ranked(retrieval.top_k(pairs.where("score > 0"), 3))


def test_overlap_search_of_large_batches(spark, monkeypatch):
    docs = spark.createDataFrame(_texts(60, 5, int), "doc_id long, text string").select("doc_id", terms("text").alias("words"))
    asked = spark.createDataFrame(_texts(9, 6, int), "query_id long, text string").select("query_id", terms("text").alias("words"))
    want = _ranked(retrieval.overlap_search(docs, asked, 2))
    monkeypatch.setattr(scoring, "BATCH_ROWS", 1)
    assert want and _ranked(retrieval.overlap_search(docs, asked, 2)) == want


def test_overlap_is_for_every_query_and_in_a_batch_of_any_size(spark, monkeypatch):
    docs = spark.createDataFrame(_texts(80, 7, int) + [(900, "xaay Abhh"), (901, None)], "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([(1, "a hh"), (2, "aay h"), (3, "zzz"), (4, "")], "q long, text string")
    held = {(r.doc_id, (r.text or "").lower()) for r in docs.collect()}
    want = []
    for q, ask in ((1, ["a", "hh"]), (2, ["aay", "h"])):
        shares = sorted((-sum(t in text for t in ask) / len(ask), d) for d, text in held)
        want += [(q, n, d, -s) for n, (s, d) in enumerate(shares[:5], 1) if s < 0]
    assert _ranked(retrieval.overlap(docs, asked, "q", "text", 5)) == want
    monkeypatch.setattr(scoring, "BATCH_ROWS", 1)
    assert _ranked(retrieval.overlap(docs, asked, "q", "text", 5)) == want


def test_replacements_do_not_make_pairs(spark):
    pick = random.Random(9)
    row = lambda i: (pick.choice([1, 2, None]), i, pick.choice(["v1", "v2", "v10", None]), pick.choice(["active", "draft", "archived"]), pick.choice(["2026-01-01", "2026-01-02", None]))
    schema = "doc_id long, version_id long, version string, status string, effective_date string"
    versions = spark.createDataFrame([row(i) for i in range(60)] + [(3, 1, "v1", "active", None), (3, 2, "v2", "active", None)], schema)
    arriving = spark.createDataFrame([row(i) for i in range(40, 90)] + [(3, 1, "v2", "active", None), (3, 2, "v1", "active", None)], schema).withColumns({"asked_doc_id": F.col("doc_id"), "asked_version_id": F.col("version_id")})
    want = {}
    for r in registry.version_conflicts(versions, arriving).collect():
        want.setdefault(r.version_id, set()).add(r.conflict)
    got = registry.replacements(versions, arriving)
    joined = got._jdf.queryExecution().optimizedPlan().toString()
    assert "live_id" not in joined
    for r in got.collect():
        kinds = want.get(r.version_id, set())
        assert (r.problem, r.warnings) == ("older" if "older_conflict" in kinds else None, sorted(kinds - {"older_conflict"})) or (r.doc_id is None and r.problem is None)
