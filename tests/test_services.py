"""Stored indexes, bounded search, and what is composed of them."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import index, retrieval

WORDS = [a + b for a in ("ka", "mo", "ri", "ten", "sul", "var") for b in ("bel", "dor", "nim", "pas", "qua", "zet")]


def _texts(seed: int, n: int, least: int = 0, most: int = 60) -> list[str]:
    rng = random.Random(seed)
    return [" ".join(rng.choices(WORDS, weights=range(len(WORDS), 0, -1), k=rng.randint(least, most))) for _ in range(n)]


def _ranked(df):
    return sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 6)) for r in df.collect())


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(index, "BLOCK", 4)
    monkeypatch.setattr(index, "BUCKETS", 3)


def test_index_follows_its_corpus(spark, tmp_path, small_blocks):
    """After each change the index answers as a search over the corpus does, and reads fewer blocks than there are."""
    rows = {f"d{k}": t for k, t in enumerate(_texts(1, 120))}
    queries = spark.createDataFrame(list(enumerate([*_texts(2, 6, 2, 5), "", None, "unknown words", "kabel kabel vardor"])), "q long, text string")

    def docs(of):
        return spark.createDataFrame([*of.items(), *([(None, "no id")] if of else [])], "doc_id string, text string")

    def check(revision):
        own = docs(rows).where("doc_id is not null") if rows else docs(rows)
        assert (revision.n_docs, revision.corpus) == (len(rows), revision.corpus)
        assert _ranked(index.search(spark, revision, queries, "q", "text", 5)) == _ranked(retrieval.bm25(own, queries, "q", "text", 5))

    assert index.current(spark, str(tmp_path / "i")) is None
    first = index.ensured(spark, str(tmp_path / "i"), docs(rows), "a")
    check(first)
    short = spark.createDataFrame([(1, "kabel"), (2, "modor"), (3, "kabel varzet")], "q long, text string")
    blocks = index.needed_blocks(spark, first, index.weighted_terms(spark, first, short, "q", "text"), 2)
    n, needed = blocks.agg(F.count("*"), F.count_if("needed")).first()
    assert 0 < needed < 0.6 * n
    assert _ranked(index.search(spark, first, short, "q", "text", 2)) == _ranked(retrieval.bm25(docs(rows).where("doc_id is not null"), short, "q", "text", 2))
    assert index.ensured(spark, str(tmp_path / "i"), docs(rows), "a") == first == index.current(spark, str(tmp_path / "i"))
    new = {f"d{k}": t for k, t in zip((3, 7, 200, 201), _texts(3, 4, 5), strict=True)}
    rows |= new | {"d9": None, "d10": ""}
    for k in (3, 4, 5):
        rows.pop(f"d{k}")
    second = index.changed(spark, first, "b", docs({k: t for k, t in rows.items() if k in new or k in ("d9", "d10")}), spark.createDataFrame([("d3",), ("d4",), ("d5",), ("absent",), (None,)], "doc_id string"))
    check(second)
    rows |= {"d4": "kabel mobel", "d7": rows["d7"] + " kabel"}
    del rows["d8"]
    third = index.ensured(spark, str(tmp_path / "i"), docs(rows), "c")
    assert [s for s, _ in third.segments] == [0, 1, 2]
    check(third)
    check(index.merged(spark, third))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        index.changed(spark, third, "d", deletes=spark.createDataFrame([("d1",)], "doc_id string"))


def test_index_of_nothing(spark, tmp_path):
    empty = index.built(spark, str(tmp_path), spark.createDataFrame([], "doc_id long, text string"), "none")
    queries = spark.createDataFrame([(1, "kabel")], "q long, text string")
    assert index.search(spark, empty, queries, "q", "text").count() == 0
    full = index.ensured(spark, str(tmp_path), spark.createDataFrame([(1, "kabel mobel")], "doc_id long, text string"), "one")
    assert [r.doc_id for r in index.search(spark, full, queries, "q", "text").collect()] == [1]


def test_overlap_is_for_queries_without_a_term(spark):
    docs = spark.createDataFrame([(1, "A catalogue of Zebras"), (2, "dogs; catalogue"), (3, None), (4, "cat")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "log ras"), (2, "cat log"), (3, "xyz"), (4, ""), (5, None), (6, "og")], "q long, text string")
    got = [(r.query_id, r.doc_id, r.score, r["rank"], r.method) for r in retrieval.bm25_or_overlap(docs, queries, "q", "text", 2).orderBy("query_id", "rank").collect()]
    assert [(g[0], g[1], g[3], g[4]) for g in got] == [(1, 1, 1, "overlap"), (1, 2, 2, "overlap"), (2, 4, 1, "bm25"), (6, 1, 1, "overlap"), (6, 2, 2, "overlap")]
    assert [g[2] for g in got if g[4] == "overlap"] == [1.0, 0.5, 1.0, 1.0]


def test_vectors_with_nulls_and_odd_lengths(spark):
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.6, 0.8]), ("c", None), (None, [1.0, 1.0]), ("d", [1.0, float("nan")]), ("e", [0.0, 0.0])], "vec_id string, embedding array<double>")
    asked = spark.createDataFrame([("a", [2.0, 0.0]), ("n", None), (None, [1.0, 0.0])], "query_id string, embedding array<double>")
    assert [(r.query_id, r.vec_id) for r in retrieval.vector_search(vectors, asked, 2).orderBy("rank").collect()] == [("a", "b"), ("a", "e")]
    assert retrieval.vector_search(vectors, asked.where("query_id = 'n'"), 2).count() == 0
    odd = asked.union(spark.createDataFrame([("odd", [1.0])], asked.schema))
    with pytest.raises(ValueError, match="1 to 2 numbers"):
        retrieval.vector_search(vectors, odd, 2)
    with pytest.raises(Exception, match="not 2 numbers: z"):
        retrieval.vector_search(vectors.union(spark.createDataFrame([("z", [1.0])], vectors.schema)), asked, 2).collect()


def test_very_many_query_vectors(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "VECTOR_BLOCK_BYTES", 1 << 20)
    rng = np.random.default_rng(1)
    vectors = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rng.normal(size=(40, 4)))], "vec_id long, embedding array<double>")
    asked = spark.range(100_000).select(F.col("id").alias("query_id"), F.array(*(F.cos(F.col("id") * k) for k in range(4))).alias("embedding"))
    found = retrieval.vector_search(vectors, asked, 1, exclude_self=False)
    assert found.count() == 100_000
    own = vectors.toPandas()
    units = np.stack(own["embedding"]) / np.linalg.norm(np.stack(own["embedding"]), axis=1, keepdims=True)
    for r in found.where("query_id % 9973 = 0").collect():
        scores = units @ np.cos(r.query_id * np.arange(4))
        assert r.vec_id == scores.argmax()
