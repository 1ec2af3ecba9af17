"""Operators on small tables with results worked out by hand or by plain loops."""

import math
from collections import deque
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corvane.operators import chunking, conversations, correction, evidence, ingest, metrics, registry, retrieval, stats
from corvane.sources import files
from corvane.streaming import ingestion, ratelimit


def test_bm25_variants_by_hand(spark):
    docs = spark.createDataFrame([(1, "cat sat mat"), (2, "cat cat dog"), (3, "bird")], "doc_id long, text string")
    ask = spark.createDataFrame([(9, "cat")], "q long, text string")
    mean = 7 / 3
    part = lambda tf, dl: tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))
    got = {r.doc_id: r.score for r in retrieval.bm25_scores(docs, ask, "q", "text").collect()}
    idf = math.log(1 + (3 - 2 + 0.5) / 2.5)
    assert got == pytest.approx({1: idf * part(1, 3), 2: idf * part(2, 3)})
    raw = {1: math.log(2.5 / 1.5), 2: math.log(1.5 / 2.5)}
    okapi = 0.25 * (4 * raw[1] + raw[2]) / 5
    got = {r.doc_id: r.score for r in retrieval.bm25_scores(docs, ask, "q", "text", variant="okapi").collect()}
    assert got == pytest.approx({1: okapi * part(1, 3), 2: okapi * part(2, 3)})


def test_fallback_for_queries_without_a_term(spark):
    docs = spark.createDataFrame([(1, "catalogue"), (2, "dog")], "doc_id long, text string")
    got = retrieval.overlap_fallback(docs, spark.createDataFrame([(1, "cat log"), (2, "zebra")], "q long, text string"), "q", "text").collect()
    assert [(r.query_id, r.doc_id, r.score) for r in got] == [(1, 1, 1.0)]


def test_fusion(spark):
    lists = spark.createDataFrame([(1, 10, "a", 1), (1, 11, "a", 2), (1, 10, "b", 2), (1, 10, "b", 1)], "query_id long, doc_id long, list string, rank long")
    got = {r.doc_id: (round(r.score, 9), r.source) for r in retrieval.rrf(lists).collect()}
    assert got == {10: (round(2 / 61, 9), "a+b"), 11: (round(1 / 62, 9), "a")}


def test_vector_search_in_blocks(spark, monkeypatch):
    rows = spark.createDataFrame([(k, [float(k % 3), float(k % 5), 1.0]) for k in range(40)] + [(40, [0.0, 0.0, 0.0]), (41, None)], "vec_id long, embedding array<float>")
    ask = rows.where("vec_id < 7").select(F.col("vec_id").alias("query_id"), "embedding")
    plain = sorted(tuple(r) for r in retrieval.vector_search(rows, ask, 4).select("query_id", "vec_id", "rank").collect())
    monkeypatch.setattr(retrieval, "VECTOR_BLOCK_BYTES", 50)
    assert plain == sorted(tuple(r) for r in retrieval.vector_search(rows, ask, 4).select("query_id", "vec_id", "rank").collect())
    assert len(plain) == 28


def test_decisions(spark):
    rows = spark.createDataFrame([(1, "high", 0.9), (1, "low", 0.0), (2, "low", 0.1), (3, "medium", 0.3), (3, "low", 0.1), (4, "medium", 0.12), (4, "low", 0.1)], "query_id long, grade string, relevance double")
    ask = spark.createDataFrame([(k,) for k in range(1, 6)], "query_id long")
    assert {r.query_id: r.decision for r in correction.decisions(rows, ask).collect()} == {1: "high", 2: "no_results", 3: "medium", 4: "low", 5: "no_results"}


def test_metric_conventions(spark):
    results = spark.createDataFrame([(1, 7, 1), (1, 7, 2), (1, 8, 3), (2, 9, 1)], "query_id long, doc_id long, rank long")
    gold = spark.createDataFrame([(1, 7), (1, 8), (3, 5)], "query_id long, doc_id long")
    first = {r.query_id: r for r in metrics.ir_metrics(results, gold, (3,)).collect()}
    assert (first[1].recall_3, first[1].precision_3, first[1].mrr) == (1.0, 2 / 3, 1.0)
    assert first[1].ap == pytest.approx((1 + 2 / 3) / 2)
    assert (first[2].recall_3, first[2].ap, first[2].mrr, first[3].recall_3) == (1.0, 1.0, 0.0, 0.0)
    again = {r.query_id: r for r in metrics.ir_metrics(results, gold, (3,), empty="null", duplicates="as_is").collect()}
    assert again[1].ap == pytest.approx((1 + 1 + 1) / 2) and again[2].recall_3 is None


def test_percentiles(spark):
    rows = spark.createDataFrame([(float(k),) for k in range(1, 11)], "v double")
    got = {rule: metrics.percentile(rows, "v", 0.95, rule).first()[0] for rule in ("floor", "ceil", "int")}
    assert got == {"floor": 9.0, "ceil": 10.0, "int": 10.0}
    grouped = rows.withColumn("g", F.col("v") > 5)
    assert {r.g: r.percentile for r in metrics.percentile(grouped, "v", 0.5, by="g").collect()} == {False: 3.0, True: 8.0}


def test_kappa_without_disagreement(spark):
    assert metrics.kappa(spark.createDataFrame([(1, 1), (1, 1)], "a int, b int"), "a", "b").first()["kappa"] == 1.0


def test_chunks_cover_their_text(spark):
    text = "\n\n".join(f"Paragraph {k} " + "word " * (k % 7) * 5 for k in range(30))
    assert all(len(c) <= 100 for c in chunking.split_text(text, 100, 20))
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "x" * 250)], "doc_id long, text string")
    fixed = chunking.fixed_chunks(docs, 100, 20).where("doc_id = 4").orderBy("chunk_index").collect()
    assert [(r.chunk_start, len(r.chunk_text)) for r in fixed] == [(0, 100), (80, 100), (160, 90)]
    assert {r.doc_id for r in chunking.recursive_chunks(docs, 100, 20).collect()} == {1, 4}
    assert chunking.chunks(docs, "budget", budget=20).count() > 0
    with pytest.raises(ValueError):
        chunking.chunks(docs, "unheard")


def test_outline_leaves_code_out(spark):
    docs = spark.createDataFrame([(1, "# One\n```\n# not\n```\n## Two ##\ntext")], "doc_id long, text string")
    assert [(r.level, r.title) for r in chunking.outline(docs).orderBy("line_no").collect()] == [(1, "One"), (2, "Two")]
    assert [r.title for r in chunking.header_chunks(docs).orderBy("section").collect()] == ["One", "Two"]


def test_publish_waits_for_all_chunks(spark):
    rows = spark.createDataFrame([("a", 1, "v1", "active"), ("a", 2, "v2", "staging"), ("b", 3, "v1", "active"), ("b", 4, "v2", "staging")], "source string, chunk_id long, version string, state string")
    staged = spark.createDataFrame([("a", 2), ("b", 4), ("b", 5)], "source string, chunk_id long")
    assert {r.chunk_id: r.state for r in ingest.publish(rows, staged, "v2").collect()} == {1: "retired", 2: "active", 3: "active", 4: "staging"}


def test_digest_ignores_order_and_sees_changes(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "k long, v string")
    digest = lambda d: d.first()["digest"]
    assert digest(ingest.table_digest(a)) == digest(ingest.table_digest(a.orderBy(F.desc("k")).select("v", "k")))
    assert digest(ingest.table_digest(a)) != digest(ingest.table_digest(a.fillna("")))


def test_claims(spark):
    claims = spark.createDataFrame([(1, 1, ["S1"], "a"), (1, 2, [], "b"), (1, 3, ["S1", "S9"], "c"), (1, 4, ["S1"], "d")], "run_id long, claim_id long, source_ids array<string>, text string")
    found = spark.createDataFrame([(1, "S1")], "run_id long, source_id string")
    assert {r.claim_id: r.issue for r in evidence.claim_issues(claims, found).collect()} == {1: None, 2: "missing_citation", 3: "invalid_source", 4: None}
    rejected = spark.createDataFrame([(1, "d")], "run_id long, claim string")
    assert [r.claim_id for r in evidence.valid_claims(claims, found, rejected).collect()] == [1]
    assert evidence.rendered_claims(claims.where("claim_id < 3")).first()["answer"] == "- a [S1]\n- b"


def test_jobs(spark):
    at = lambda m: datetime(2026, 1, 1) + timedelta(minutes=m)
    log = spark.createDataFrame([(1, at(0), "pending", 0), (1, at(1), "running", 1), (2, at(2), "pending", 0), (3, at(0), "running", 3)], "job_id long, at timestamp, event string, attempt int")
    jobs = registry.recovered(registry.job_states(log), F.lit(at(20)))
    assert {r.job_id: r.event for r in jobs.collect()} == {1: "retrying", 2: "pending", 3: "failed"}
    assert [r.job_id for r in registry.next_jobs(jobs, 5).collect()] == [1, 2]


def test_budget_and_summary(spark):
    rows = spark.createDataFrame([(1, k, "user", "x" * 60) for k in range(4)], "conv_id long, turn long, role string, text string")
    assert [len(r.kept) for r in conversations.within_budget(rows, 180, "conv_id", "turn").orderBy("turn").collect()] == [60, 60, 56]
    assert conversations.to_summarise(rows, 3, 2).count() == 2


@pytest.mark.parametrize("expression,want", [("2 ^ 3 + 1", 9.0), ("1 / 0", None), ("9 ** 101", None), ("sqrt(16)", 4.0), ("open('x')", None), ("", None)])
def test_calculated(expression, want):
    assert stats.calculated(expression) == want


def test_sliding_log():
    log = deque()
    assert ratelimit.decide([0, 10, 20, 59, 61, 71], log, 2, 60) == [True, True, False, False, True, True]


def test_stream_of_limits_equals_a_loop(spark, tmp_path):
    import __spark_entry__

    got = {r.event_id: r.allowed for r in __spark_entry__.queries()["stream_rate_limit"](spark, "/root/testdata/sf0.001").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").orderBy("ts", "event_id").collect()
    logs = {}
    want = {r.event_id: ratelimit.decide([(r.ts - datetime(1970, 1, 1)).total_seconds()], logs.setdefault(r.user_id, deque()), 2, 3600)[0] for r in rows}
    assert got == want


def test_stream_of_files_becomes_chunks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.txt").write_text("The same text, long enough to count." if k < 2 else "Another text, long enough to count.")
    stream = spark.readStream.option("wholetext", "true").text(f"{tmp_path}/in").select(F.col("value").alias("text"))
    ingestion.ingest_stream(stream, f"{tmp_path}/table", f"{tmp_path}/checkpoint")
    assert spark.read.parquet(f"{tmp_path}/table").count() == 2
    (tmp_path / "in" / "3.txt").write_text("The same text, long enough to count.")
    ingestion.ingest_stream(stream, f"{tmp_path}/table", f"{tmp_path}/checkpoint")
    assert spark.read.parquet(f"{tmp_path}/table").count() == 2


def test_contents_without_text_arrive_once(spark, tmp_path):
    import __spark_entry__
    import duckdb

    texts = [None, "", "  ", " \n", "One text.", "one text."] * 4 + [None, "   ", "Another text."]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in __spark_entry__.queries()["ingest_arrivals"](spark, str(tmp_path)).collect()]
    with duckdb.connect() as db:
        db.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
        assert got == db.execute(__spark_entry__.oracle_sql()["ingest_arrivals"]).fetchall() == [(8,)]


def test_known_contents_without_text_stay_out(spark, tmp_path):
    batch = spark.createDataFrame([("a", None), ("b", None), ("c", " "), ("d", "Text.")], "source string, text string")
    first = ingestion.ingest_batch(batch, f"{tmp_path}/table", 0, strategy="fixed")
    assert sorted(r.state for r in first.collect()) == ["active", "empty", "empty"]
    assert ingestion.ingest_batch(batch, f"{tmp_path}/table", 1, first, strategy="fixed").isEmpty()


def test_sources(spark, tmp_path):
    (tmp_path / "03_lab rules.md").write_text("# Rules\n\nKeep it clean, please, all of you.\n\n- one\n- two")
    (tmp_path / "page.html").write_text("<p>Hi &amp; bye</p>")
    (tmp_path / "rows.csv").write_text("a,b\n1,x\n2,\n")
    docs = {r.file_name: r for r in files.text_files(spark, str(tmp_path), "*.{md,html}").collect()}
    assert docs["page.html"].text == "Hi & bye" and docs["03_lab rules.md"].title == "lab rules"
    assert sorted(r.text for r in files.csv_rows(spark, f"{tmp_path}/rows.csv").collect()) == ["a: 1\nb: x", "a: 2\nb: "]
    kinds = [r.kind for r in files.elements(files.text_files(spark, str(tmp_path), "*.md")).orderBy("element_no").collect()]
    assert kinds == ["Title", "NarrativeText", "ListItem"]
    assert files.synthetic_corpus(spark).count() == 240


def test_equal_vectors_are_ranked_by_id(spark):
    """Copies in many batches and out of order: the smallest ids win."""
    rows = spark.createDataFrame([((k * 37) % 1000, [1.0, 0.0] if k % 2 else [0.6, 0.8]) for k in range(1000)] + [(None, [1.0, 0.0])], "vec_id long, embedding array<float>").repartition(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = retrieval.vector_search(rows, spark.createDataFrame([(5000, [1.0, 0.0])], "query_id long, embedding array<float>"), 5).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"])] == sorted((k * 37) % 1000 for k in range(1, 1000, 2))[:5]


def test_calculations_are_bounded():
    for text in ("((((9^100)^100)^100)^100)", "9^100*9^100", "10^99*10*10", "2^1000", "__import__('os')", "1e101", "(-8)^0.5"):
        assert stats.calculated(text) is None
    assert stats.calculated("pow(2, 10) + log10(1000) - sin(0) + 2*pi/pi") == pytest.approx(1029)


def test_requests_of_a_key_stand_in_order(spark):
    """One key with rows in reverse order, in batches of ten."""
    start = datetime(2024, 1, 1)
    rows = [("a", k, int((start + timedelta(seconds=k)).timestamp() * 1_000_000)) for k in range(200)][::-1] + [("b", 1000, 5)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        log = spark.createDataFrame([("a", rows[-2][2] - 1_000_000), ("c", 7)], "key string, at long")
        found = ratelimit.limit_batch(spark.createDataFrame(rows, "key string, event_id long, at long"), log, 3, 60).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    times = deque([-1])
    want = {k: ratelimit.decide([k], times, 3, 60)[0] for k in range(200)}
    assert {r.event_id: r.allowed for r in found if not r.logged} == want | {1000: True}
    assert sorted((r.key, r.at) for r in found if r.logged) == sorted([("b", 5), ("c", 7), *(("a", int((start + timedelta(seconds=k)).timestamp() * 1_000_000)) for k in times)])


def test_paths_of_any_depth_and_cycles(spark):
    rows = [(0, None, "r")] + [(k, k - 1, f"d{k}") for k in range(1, 25)] + [(100, 101, "x"), (101, 100, "y"), (200, 999, "lost")]
    got = {r.id: r.path for r in registry.department_paths(spark.createDataFrame(rows, "id long, parent_id long, name string")).collect()}
    assert got[24] == "/r/" + "/".join(f"d{k}" for k in range(1, 25)) and len(got) == len(rows)
    assert got[100] is None and got[101] is None and got[200] is None


def test_totals_over_ranges(spark):
    from corvane.operators import ordered

    rows = spark.createDataFrame([(g, k, k % 7) for g in ("a", "b", None) for k in range(100)], "g string, k long, w long").repartition(5)
    got = {(r.g, r.k): (r.n, r.t) for r in ordered.running_total(ordered.numbered(rows, ["g"], ["k"], "n"), ["g"], ["k"], "t", "w").collect()}
    assert got == {(g, k): (k + 1, sum(j % 7 for j in range(k + 1))) for g in ("a", "b", None) for k in range(100)}
    following = {(r.g, r.k): r.next_w for r in ordered.with_next(rows, ["g"], ["k"], ["w"]).collect()}
    assert following == {(g, k): (k + 1) % 7 if k < 99 else None for g in ("a", "b", None) for k in range(100)}


def test_code_and_hybrid_chunks(spark):
    source = "import os\n\n\n@cached\ndef one():\n    return 1\n\n\nclass Two:\n    x = 2\n\n\ndef three():\n    return " + "3" * 60 + "\n"
    rows = chunking.chunks(spark.createDataFrame([(1, source), (2, None)], "doc_id long, text string"), "code", size=60, overlap=0).orderBy("chunk_index").collect()
    assert [r.chunk_text.split("\n")[0] for r in rows][:2] == ["import os", "class Two:"] and "".join(r.chunk_text for r in rows).replace("\n", "").count("3") == 60
    sentences = spark.createDataFrame([(1, k, f"sentence number {k} here", [1.0, 0.0] if k < 5 else [0.0, 1.0]) for k in range(10)], "doc_id long, position long, text string, embedding array<double>")
    parts = chunking.chunks(sentences, "hybrid", coarse_tokens=1000, max_tokens=1000, min_tokens=3).orderBy("chunk_index").collect()
    assert [(r.chunk_index, r.n_sentences) for r in parts] == [(0, 5), (1, 5)]
    assert sum(r.n_sentences for r in chunking.hybrid_chunks(sentences, coarse_tokens=20, min_tokens=4).collect()) == 10


def test_budget_chunks_take_neighbours_along(spark):
    text = " ".join(f"This is sentence {k:02d} of it." for k in range(12))
    rows = chunking.budget_chunks(spark.createDataFrame([(1, text)], "doc_id long, text string"), budget=30, carried=1).orderBy("chunk_index").collect()
    assert len(rows) > 2 and all(f"sentence {k:02d}" in " ".join(r.chunk_text for r in rows) for k in range(12))
    first = [r.chunk_text.count("sentence") for r in rows]
    assert first[1] > first[0] - 1 and rows[1].chunk_text.startswith(rows[0].chunk_text.split(". ")[-1].split(" of")[0][:10])


def test_decomposed_queries_are_fused(spark):
    docs = spark.createDataFrame([(1, "red apple"), (2, "green pear"), (3, "blue sky")], "doc_id long, text string")
    ask = spark.createDataFrame([(7, "red pear", ["red", "pear", "red"]), (8, "sky", None)], "query_id long, query string, parts array<string>")
    got = retrieval.decomposed(ask, lambda q: retrieval.bm25(docs, q, "query_id", "query", 3), k=2).collect()
    assert {(r.query_id, r.doc_id) for r in got} == {(7, 1), (7, 2), (8, 3)}


def test_profiles(spark):
    rows = spark.createDataFrame([("1", "a"), ("2", "a"), ("2", " "), (None, "b")], "x string, y string")
    got = {r.column: tuple(r)[1:] for r in stats.profile(rows).collect()}
    assert got == {"x": (1, 3, 2, "number", 1.0, 2.0, pytest.approx(5 / 3)), "y": (1, 3, 2, "text", None, None, None)}
    assert {r.column: r.filled for r in stats.profile(rows.limit(0)).collect()} == {"x": 0, "y": 0}


def test_stored_tables_can_be_removed(spark):
    from corvane import storage

    kept = storage.stored(spark.range(3), "test")
    assert kept.count() == 3 and storage.clear(spark) >= 1 and not storage._made
