"""Embedding tables, memories, retrieval branches, the element source, claims and sentences."""

import random

import pytest
from pyspark.sql import functions as F

from corvane.functions import research, text
from corvane.operators import embedding, memory, ordered, planner, retrieval
from corvane.sources import element_source, files
from corvane.streaming import windows


def test_texts_are_encoded_once(spark, tmp_path):
    path, embedder = str(tmp_path / "v"), embedding.feature_hashing(8)
    docs = spark.createDataFrame([(1, "one two", "x"), (2, "one two", "y"), (3, None, "z"), (4, "", "z"), (5, "three", None)], "id long, text string, vector_of string")
    assert embedding.encoded(spark, path, docs.where("id < 4"), embedder, "m") == 1
    rows = {r.id: r for r in embedding.with_vectors(spark, path, docs, embedder, "m").collect()}
    assert [rows[k].commit for k in (1, 2, 3, 4, 5)] == [0, 0, None, 1, 1]
    assert rows[1].vector == rows[2].vector == embedder(["one two"])[0] and rows[4].vector == [0.0] * 8 and rows[3].vector is None
    assert embedding.encoded(spark, path, docs, embedder, "m") == 0
    assert embedding.encoded(spark, path, docs, embedder, "other model") == 3


@pytest.mark.parametrize("bad", [lambda ts: [[1.0]] * (len(ts) - 1), lambda ts: [[float("nan")]] * len(ts), lambda ts: [[]] * len(ts)])
def test_bad_vectors_are_not_kept(spark, tmp_path, bad):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "id long, text string")
    with pytest.raises(Exception, match="not finite"):
        embedding.encoded(spark, str(tmp_path), docs, bad, "m")
    assert embedding.known(spark, str(tmp_path)).count() == 0
    assert embedding.encoded(spark, str(tmp_path), docs, embedding.feature_hashing(2), "m", batch=1) == 2


def test_last_known_equals_a_loop(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), k, rng.choice([None, rng.randrange(9)])) for k in range(300)]
    want, last = {}, {}
    for key, k, v in rows:
        last[key] = v if v is not None else last.get(key)
        want[k] = last[key]
    got = ordered.last_known(spark.createDataFrame(rows, "key string, k long, v long").repartition(5), ["key"], ["k"], "v")
    assert {r.k: r.last_v for r in got.collect()} == want


EVENTS = [("m1", "u", 10, 1, "add", "first"), ("m1", "u", 20, 2, "update", "second"), ("m1", "u", 20, 3, "update", "third"), ("m1", "u", 30, 4, "delete", None), ("m2", "v", 5, 1, "add", "other")]
HISTORY = "memory_id string, user_id string, at long, seq long, event string, content string"


def test_memories_at_a_time(spark):
    events = spark.createDataFrame(EVENTS, HISTORY)
    asked = [(1, "m1", "u", 9), (2, "m1", "u", 10), (3, "m1", "u", 25), (4, "m1", "u", 30), (5, "m1", "v", 25), (6, "m9", "u", 25), (7, "m2", "v", 99), (8, "m1", None, 25), (9, "m1", "u", 20)]
    got = {r.request_id: (r.state, r.content) for r in memory.as_of(events, spark.createDataFrame(asked, "request_id long, memory_id string, user_id string, at long")).collect()}
    assert got == {1: ("absent", None), 2: ("present", "first"), 3: ("present", "third"), 4: ("absent", None), 5: ("denied", None), 6: ("denied", None), 7: ("present", "other"), 8: ("denied", None), 9: ("present", "third")}
    assert {(r.memory_id, r.seq): r.valid_to for r in memory.history(events).collect()} == {("m1", 1): 20, ("m1", 2): 20, ("m1", 3): 30, ("m1", 4): None, ("m2", 1): None}


def test_changes_and_search_of_own_memories(spark):
    events = spark.createDataFrame([*EVENTS, ("m3", "v", 6, 1, "add", "apples and pears"), ("m4", "u", 6, 1, "add", "apples")], HISTORY)
    asked = spark.createDataFrame([("m2", "v", 50, 1, "update", "x"), ("m2", "u", 50, 2, "delete", None), ("m1", "u", 50, 3, "update", "gone"), ("m9", "u", 50, 4, "add", "new"), ("m1", "u", 50, 5, "add", "again"), ("m9", None, 50, 6, "delete", None)], HISTORY)
    assert {r.seq: r.accepted for r in memory.changes(events, asked).collect()} == {1: True, 2: False, 3: False, 4: True, 5: False, 6: False}
    queries = spark.createDataFrame([(1, "v", "apples"), (2, "u", "apples"), (3, "w", "apples")], "query_id long, user_id string, query string")
    assert [(r.query_id, r.doc_id) for r in memory.search(events, queries).orderBy("query_id").collect()] == [(1, "m3"), (2, "m4")]


def test_recall_gate_needs_every_mark(spark):
    schema = "id int, memory_type string, scope string, project_id string, run_id string, claim_id string, source_ids array<string>, review_decision string, user_confirmed boolean, verified boolean"
    good = ["confirmed_research_fact", "research", "p", "r", "c", ["S1", "S2"], "PASS", True, True]
    changes = [{}, {0: "note"}, {1: None}, {2: None}, {3: " "}, {4: None}, {5: []}, {5: None}, {6: "REVISE"}, {7: None}, {8: False}, {2: "q"}, {5: ["S1"]}, {5: ["S2", "S1", "S1"]}, {3: "r2"}, {4: "hidden"}, {0: "note", 1: "user"}, {0: None, 1: None}]
    rows = [(k, *(change.get(i, v) for i, v in enumerate(good))) for k, change in enumerate(changes)]
    claims = spark.createDataFrame([("r", "c", "p", ["S2", "S1"], True), ("r", "hidden", "p", ["S2", "S1"], False)], "run_id string, claim_id string, project_id string, source_ids array<string>, readable boolean")
    gated = memory.recall_gate(spark.createDataFrame(rows, schema), claims, F.lit(True))
    want = ["verified", *["invalid_metadata"] * 10, *["acl_filtered"] * 5, "plain", "plain"]
    assert [r.verdict for r in gated.orderBy("id").collect()] == want
    assert tuple(memory.recall_counts(gated).first()) == (18, 3, 5, 10, 1)
    assert memory.recall_gate(spark.createDataFrame(rows[:1], schema), claims, F.lit(False)).first().verdict == "invalid_metadata"


def test_branches_and_project_knowledge(spark):
    docs = spark.createDataFrame([(k, f"common word{k} {'rare' if k == 3 else ''} extra{k % 2}") for k in range(8)], "doc_id long, text string")
    schema = "query_id long, query string, parts array<string>, rewritten array<string>, needs_expansion boolean, corrected boolean, project_id string"
    asked = spark.createDataFrame([(1, "rare common", None, None, None, None, "p"), (2, "word1", [], ["rare"], False, False, ""), (3, "word1", ["word2", "rare"], ["word5"], True, False, None), (4, "rare common", None, None, True, True, "q"), (5, "?!", None, ["rare"], True, True, "p"), (6, None, None, None, None, None, None)], schema)
    records = spark.createDataFrame([(100, "p", "rare common facts", "active", "confirmed", ["S"]), (101, "p", "rare", "retired", "confirmed", ["S"])], "id long, project_id string, statement string, status string, origin string, source_ids array<string>")
    found = planner.retrieve_documents(asked, docs, lambda q, k: retrieval.bm25(docs, q, "query_id", "query", k), 3, knowledge=records, rounds=1)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault((r.query_id, r.branch), []).append(r.doc_id)
    assert set(got) == {(1, "plain"), (2, "standalone"), (3, "expanded"), (4, "corrected")}
    assert got[1, "plain"][0] == 3 and len(got[1, "plain"]) == 3 and got[2, "standalone"] == [1, 3] and set(got[3, "expanded"]) == {1, 2, 3} and got[4, "corrected"][0] == 3
    few = planner.retrieve_documents(asked.where("query_id = 1"), docs.where("doc_id = 3"), lambda q, k: retrieval.bm25(docs.where("doc_id = 3"), q, "query_id", "query", k), 3, knowledge=records)
    assert [r.doc_id for r in few.orderBy("rank").collect()] == [3, 100]


def test_elements_of_files_in_ranges_and_streams(spark, tmp_path):
    element_source.register(spark)
    bodies = {"a.md": "# Head\n\nA paragraph of two\nlines, which ends.\n \n\t\n| a | b |\n|---|---|\n\n- item\n\n\nShort one\n", "b.txt": "", "c.txt": "\n\nonly one, with no end é" + " long" * 40 + ".", ".hidden": "no", "d.csv": "not,read"}
    (tmp_path / "in" / "sub").mkdir(parents=True)
    for name, body in bodies.items():
        (tmp_path / "in" / ("sub" if name == "c.txt" else "") / name).write_text(body)
    for split in (1, 7, 1 << 20):
        read = spark.read.format("corvane_elements").option("split_bytes", split).option("glob", "*.[mt]*").load(str(tmp_path / "in"))
        got = sorted((r.source.rsplit("/")[-1], r.position, r.kind, r.text) for r in read.collect())
        assert [g[2] for g in got] == ["Title", "NarrativeText", "Table", "ListItem", "Title", "NarrativeText"]
        for name, position, _, body in got:
            raw = bodies[name].encode()
            assert raw[position:].decode("utf-8", "ignore").strip().startswith(body.split("\n")[0])
    whole = files.elements(spark.createDataFrame([("a.md", bodies["a.md"].strip())], "source string, text string"))
    assert sorted((r.kind, r.text) for r in whole.collect()) == sorted(g[2:] for g in got if g[0] == "a.md")
    titles = read.where("kind in ('Title', 'Table')")
    assert titles.count() == 3
    assert read.where((F.col("kind") == "Title") & F.col("source").endswith("a.md")).count() == 2
    assert spark.read.format("corvane_elements").option("max_chars", 4).load(str(tmp_path / "in" / "a.md")).agg(F.max(F.length("text"))).first()[0] == 4
    (tmp_path / "none").mkdir()
    assert spark.read.format("corvane_elements").load(str(tmp_path / "none")).count() == 0
    stream = lambda: spark.readStream.format("corvane_elements").option("glob", "*.txt").load(str(tmp_path / "in"))
    windows.run_to_end(stream(), str(tmp_path / "out"), str(tmp_path / "cp"))
    (tmp_path / "in" / "e.txt").write_text("later\n\nand more")
    windows.run_to_end(stream(), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(r.text[:5] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["and m", "later", "only "]


def test_claims_and_their_kinds(spark):
    known = F.array(F.lit("S1"), F.lit("S2"))
    draft = "1. 结果显示方法甲更好[S1][S1][S9]。建议补做消融实验[S2]；太短[S1]\n没有任何引用的句子在这里。可能存在偏差 [S2][S1]"
    rows = spark.createDataFrame([(draft,), (None,), ("",)], "d string").select(research.draft_claims("d", known).alias("c"), research.uncovered(known, research.draft_claims("d", known)).alias("u")).collect()
    assert [(c.claim_id, c.text, c.claim_type, c.source_ids) for c in rows[0].c] == [("C1", "结果显示方法甲更好", "fact", ["S1"]), ("C2", "建议补做消融实验", "recommendation", ["S2"]), ("C3", "可能存在偏差", "inference", ["S2", "S1"])]
    assert (rows[0].u, rows[1].c, rows[2].u) == ([], [], ["S1", "S2"])
    kinds = spark.createDataFrame([("fact", "建议如此"), ("fact", "据此认为"), ("fact", "就是"), ("comparison", "建议")], "k string, t string").select(research.claim_kind("k", "t").alias("x"))
    assert [r.x for r in kinds.collect()] == ["recommendation", "inference", "fact", "comparison"]


def test_list_items_stay_whole(spark):
    texts = ["One. Two! - not a list. x,y, z", "Intro:\n1. First. Still first; yes\n  - deep, nested. item\nAfter. End", "  \n ", None, "①甲.乙\n二、丙.丁"]
    got = [r.s for r in spark.createDataFrame([(t,) for t in texts], "t string").select(text.chunk_sentences("t").alias("s")).collect()]
    assert got[0] == ["One.", "Two!", "- not a list.", "x,", "y, z"]
    assert got[1] == ["Intro:\n1. First. Still first; yes\n  - deep, nested. item\nAfter.", "End"]
    assert got[2] == got[3] == [] and got[4] == ["①甲.乙\n二、丙.丁"]
