"""Final assembly, reviews, replaced versions, served searches, jobs that are forgotten."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corvane.operators import answers, planner, registry, retrieval, stats
from corvane.streaming import jobs, windows


def test_assembled_answers(spark):
    schema = "claims string, draft string, n int, premise string, false boolean, conflicts array<string>, question string, decision string, revisions int"
    rows = [
        ("[S1] 结论", "草稿", 2, "not_applicable", False, [], "问题", "PASS", 0),
        ("", " 草稿 ", 1, "not_applicable", True, ["甲与乙不同"], "问题", "PASS", 1),
        (None, None, 0, "insufficient", None, None, "新旧版本的差异", "REVISE", 1),
        ("有冲突", None, 1, "supported", False, ["丙"], "是否矛盾", None, None),
    ]
    got = [r.a for r in spark.createDataFrame(rows, schema).select(answers.assembled(*map(F.col, ("claims", "draft", "n", "premise", "false", "conflicts", "question", "decision", "revisions"))).alias("a")).collect()]
    texts = answers.PREMISE_TEXTS
    assert got[0] == "[S1] 结论"
    assert got[1] == f"{texts['unsupported']}\n\n草稿\n\n{answers.CONFLICTS}甲与乙不同"
    assert got[2] == f"{texts['insufficient']}\n\n{answers.NO_EVIDENCE}\n\n{answers.NO_CONFLICT}\n\n{answers.REVISED}"
    assert got[3] == f"{texts['supported']}\n\n有冲突"


def test_reviews_after_rules(spark):
    schema = "run_id int, decision string, premise string, false_premise boolean, n_issues int, has_premise_item boolean, premise_task boolean"
    rows = [(1, "PASS", "supported", False, 0, False, True), (2, "PASS", "not_applicable", True, 0, False, True), (3, "PASS", "not_applicable", None, None, True, True), (4, "PASS", "not_applicable", False, 2, None, False), (5, "REVISE", "insufficient", False, 0, False, True), (6, "PASS", "unsupported", True, 0, False, None)]
    got = {r.run_id: (r.decision, r.premise, r.false_premise, r.adds_item) for r in answers.reviewed(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: ("PASS", "supported", False, False), 2: ("REVISE", "unsupported", True, True), 3: ("REVISE", "insufficient", False, False), 4: ("REVISE", "not_applicable", False, False), 5: ("REVISE", "insufficient", False, True), 6: ("PASS", "unsupported", True, False)}
    items = spark.createDataFrame([(1, "C1"), (1, "a text"), (2, "C1"), (1, None)], "run_id int, claim string")
    claims = spark.createDataFrame([(1, "C1", "the claim"), (1, "C1", "the claim")], "run_id int, claim_id string, text string")
    assert sorted((r.run_id, r.claim or "") for r in answers.resolved_items(items, claims).collect()) == [(1, ""), (1, "a text"), (1, "the claim"), (2, "C1")]


def test_packages_keep_their_order(spark):
    evidence = "array<struct<source_id: string, title: string, source: string, excerpt: string>>"
    rows = spark.createDataFrame([(1, [("S2", "t2", "b", "x"), ("S1", "t1", "a", None)]), (2, []), (3, None)], f"run_id int, evidences {evidence}")
    assert [tuple(r) for r in answers.package_documents(rows).orderBy("place").collect()] == [(1, 1, "S2", "t2", "b", "x"), (1, 2, "S1", "t1", "a", None)]


def test_replaced_versions(spark):
    day = lambda k: datetime(2026, 1, k).date()
    versions = spark.createDataFrame([("d", "v1", "v1.0", "active", day(5), datetime(2026, 1, 1), None), ("e", "w1", "v2.0", "active", day(5), datetime(2026, 1, 1), None)], "doc_id string, version_id string, version string, status string, effective_date date, created_at timestamp, superseded_by string")
    asked = [("d", "v2", "d", "v2", "v1.1", day(9)), ("d", "v3", "d", "v3", "v0.9", day(9)), ("e", "w2", "d", "w2", "v9.0", day(1)), ("e", "w3", "e", "w3", "v3.0", day(1)), ("new", "n1", "new", "n1", "v1", day(1))]
    arriving = spark.createDataFrame(asked, "asked_doc_id string, asked_version_id string, doc_id string, version_id string, version string, effective_date date")
    got = {r.version_id: (r.problem, r.warnings) for r in registry.replacements(versions, arriving).collect()}
    assert got == {"v2": (None, ["newer_override"]), "v3": ("older", []), "w2": ("identity", ["date_conflict"]), "w3": (None, ["date_conflict"]), "n1": (None, [])}
    after = {r.version_id: (r.status, r.superseded_by) for r in registry.archived_and_replaced(versions, arriving).collect()}
    assert after == {"v1": ("superseded", "v2"), "w1": ("superseded", "w3"), "v2": ("active", None), "w3": ("active", None), "n1": ("active", None)}


def test_served_searches(spark):
    docs = spark.createDataFrame([(1, "red apple", "en", True), (2, "red pear apple", "en", False), (3, "red apple", "de", True), (4, "red sky", "en", None)], "doc_id long, text string, lang string, open boolean")
    queries = spark.createDataFrame([(1, "red apple"), (2, "blue"), (3, None)], "query_id long, query string")
    search = lambda d: lambda q, k: retrieval.bm25(d, q, "query_id", "query", k)
    got = planner.service_search(queries, docs, search, 2, F.col("lang") == "en", F.col("open")).collect()
    assert [(r.query_id, r.n, [(x["rank"], x.doc_id) for x in r.results]) for r in got] == [(1, 1, [(1, 1)])]
    every = planner.service_search(queries, docs, search, 2, reranked=False).first()
    assert every.n == 2 and every.results[0].snippet.startswith("red")
    found = retrieval.bm25(docs, queries, "query_id", "query", 4)
    assert {r.doc_id for r in planner.reauthorised(found, docs, F.col("open")).collect()} == {1, 3}


def test_departments_with_repeated_ids_are_refused(spark):
    rows = spark.createDataFrame([(1, None, "a"), (1, 2, "b"), (2, 1, "c")], "id long, parent_id long, name string")
    with pytest.raises(ValueError, match="department 1 stands in 2 rows"):
        registry.department_paths(rows)


def test_profiles_count_distinct_values_where_wanted(spark):
    rows = spark.createDataFrame([("1", "a"), ("2", None)], "x string, y string")
    assert {r.column: r.distinct for r in stats.profile(rows, ["x"]).collect()} == {"x": 2, "y": None}
    assert {r.column: r.distinct for r in stats.profile(rows, []).collect()} == {"x": None, "y": None}


def test_jobs_are_retried_once_stale_and_then_forgotten(spark, tmp_path):
    t0, schema = datetime(2026, 1, 1), "job_id string, at timestamp, event string"
    batches = [[("a", 0, "running"), ("b", 1, "completed")], [("c", 5000, "pending"), ("a", -50, "failed")], [("c", 200_000, "running")], [("d", 400_000, "pending")], [("d", 400_001, "running"), ("b", 400_002, "failed")]]
    for batch in batches:
        spark.createDataFrame([(j, t0 + timedelta(seconds=s), e) for j, s, e in batch], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("at", "100 days")
    changes = jobs.job_changes(stream, stale_seconds=900, grace_seconds=86_400)
    windows.run_to_end(changes, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = sorted((r.job_id, r.state) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("a", "running"), ("b", "completed"), ("c", "pending"), ("c", "running"), ("d", "pending"), ("d", "running")]  # the older failure of a, and that of b after its end, change nothing
    short = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("at", "1 hour")
    windows.run_to_end(jobs.job_changes(short, stale_seconds=900, grace_seconds=86_400), str(tmp_path / "out2"), str(tmp_path / "cp2"))
    got = [(r.job_id, r.state) for r in spark.read.parquet(str(tmp_path / "out2")).orderBy("at").collect()]
    assert ("a", "retrying") in got and ("b", "retrying") in got  # b's state was gone, so its failure is a job of its own
