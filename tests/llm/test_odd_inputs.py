"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import public_tokenizers
import pytest

import corpus_pipeline
from corvane.llm import decontaminate, licenses, pieces, quality, sharding, simhash, tokenfiles, toxicity, urlfilter, warc

from .conftest import odd_rows, prose

PIECES, TOKENS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
N = len(odd_rows())
PAGES = "page_id long, url string, html string, host string, path string, rule string, verdict string, payload string, original string, digest string"


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1, 1), (1, 1, 1), (6, 0, 0), (7, 1, 0), (8, 1, None), (None, 0, 1), (10, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, prose(2, 12)), (2, prose(4, 40)), (3, None), (4, ""), (5, "one two"), (None, prose(4, 40))], "item_id long, text string")


def _ops(items, labels):
    return {
        "pieces": lambda d: pieces.op2_sentencepiece(d, PIECES),
        "shards": sharding.op4_shards,
        "quality": quality.op5_quality,
        "toxicity": lambda d: toxicity.op6_toxicity(d, labels),
        "simhash": simhash.op7_simhash,
        "tokens": lambda d: tokenfiles.op8_token_files(d, TOKENS),
        "licenses": licenses.op9_licenses,
    }


@pytest.mark.parametrize("name", ["pieces", "shards", "quality", "toxicity", "simhash", "tokens", "licenses"])
def test_one_row_out_for_each_row_in(name, odd_docs, no_docs, items, labels):
    op = _ops(items, labels)[name]
    assert op(odd_docs).count() == N
    assert op(no_docs).count() == 0


def test_decontamination(odd_docs, no_docs, items):
    found = {(r.doc_id, r.item_id) for r in decontaminate.op3_decontaminate(odd_docs, items).collect()}
    assert found == {(6, 1), (10, 2), (10, None)}
    assert decontaminate.op3_decontaminate(no_docs, items).count() == 0
    assert decontaminate.op3_decontaminate(odd_docs, items.limit(0)).count() == 0


def test_stages_keep_columns_and_survive(spark, tmp_path, odd_docs, no_docs, items, labels):
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            kept = out.collect()
            assert len(kept) <= docs.count(), name
            assert out.columns[: len(docs.columns)] == docs.columns, name


def test_each_stage_decides_odd_rows_as_stated(spark, tmp_path, odd_docs, items, labels):
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted((r.doc_id is None, r.doc_id or 0) for r in df.select("doc_id").collect())
    # rows that repeat stay or go together where single rows are judged
    toxic = ids(stages["toxicity"](spark, odd_docs, str(tmp_path)))
    assert {toxic.count((False, 3)), toxic.count((False, 0))} <= {0, 2}
    assert toxic.count((False, 3)) == 2 * toxic.count((False, 4))  # empty and null texts have one score
    clean = ids(stages["quality rules"](spark, odd_docs, str(tmp_path)))
    assert not {3, 4, 6, 7} & {i for none, i in clean if not none} and clean.count((False, 0)) in (0, 2)  # as its host is closed or not
    left = ids(stages["benchmark decontamination"](spark, odd_docs, str(tmp_path)))
    assert {(False, 6), (False, 10)}.isdisjoint(left) and left.count((False, 3)) == 2


def test_last_stage_replaces_columns_of_its_names(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Some words.", 7, "own", "x"), (2, None, 8, "own", "x")], "doc_id long, text string, n_pieces long, pieces string, Place string")
    out = dict(corpus_pipeline.STAGES)["sentencepiece encoding"](spark, docs, str(tmp_path))
    rows = {r.doc_id: r for r in out.collect()}
    assert sorted(out.columns) == sorted(docs.columns) and rows[1].n_pieces == len(rows[1].pieces) > 0 and rows[2].n_pieces == 0


def test_session_keeps_its_batch_size(spark, tmp_path):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "777")
    try:
        for table, schema, rows in (("documents", "doc_id long, text string, lang string, source string, n_chars long", []), ("labels", "doc_id long, quality int, toxic int", []), ("benchmark", "item_id long, text string", [])):
            spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{table}.parquet")
        assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
        assert spark.conf.get(name) == "777"
    finally:
        spark.conf.set(name, before)


def test_near_copies_keep_one_row_of_each_group(odd_docs):
    kept = simhash.keep_one_of_each(odd_docs).collect()
    texts = [r.text or "" for r in kept if (r.text or "").split()]
    assert len(texts) == len(set(texts))
    assert sum(1 for r in kept if not (r.text or "").split()) == 1
    assert {r.doc_id for r in kept} >= {0, 3, 6, 7, 8}


PAGE_ROWS = [
    (1, "http://a.example.com/en/x?q#f", "<p>one</p>"), (2, "HTTPS://WWW.Example.COM/en/y", "<p>one</p>"), (3, None, None), (4, "no scheme", ""),
    (5, "x://", "<p>two</p>"), (5, "x://", "<p>two</p>"), (None, "http://shop.net/es/", "<p>one</p>"), (None, None, None), (6, "http://spam-farm.example.org", "é" * 70_000),
    (7, "http://b.net/fr/ \r\nInjected: 1", "<p>three</p>"), (8, "http://casino-win.example.com.evil.org/en/", "<p>one</p>"), (9, "http://[::1]:80/?/en/", "a\r\n\r\nb"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, *["x"] * 7) for r in PAGE_ROWS], PAGES)


def test_urls(pages, spark):
    got = sorted(((r.page_id or 0, r.host, r.path, r.rule or "", r.verdict) for r in urlfilter.op1_url_filter(pages).collect()))
    assert got == sorted([
        (1, "a.example.com", "/en/x", "example.com/en/", "block"), (2, "www.example.com", "/en/y", "www.example.com/en/", "allow"), (3, "", "", "", "allow"), (4, "", "", "", "allow"),
        (5, "", "", "", "allow"), (5, "", "", "", "allow"), (0, "shop.net", "/es/", "net/es/", "block"), (0, "", "", "", "allow"), (6, "spam-farm.example.org", "", "", "block"),
        (7, "b.net", "/fr/ \r\nInjected: 1", "net/fr/", "block"), (8, "casino-win.example.com.evil.org", "/en/", "", "allow"), (9, "[::1]:80", "/", "", "allow"),
    ])
    assert urlfilter.op1_url_filter(spark.createDataFrame([], PAGES)).count() == 0


def test_archives(pages, spark):
    rows = warc.op10_warc(pages).collect()
    got = sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to or 0) for r in rows)
    assert got == sorted([
        (1, 10, "revisit", 8), (2, 10, "revisit", 8), (3, 0, "revisit", 4), (4, 0, "response", 0), (5, 10, "response", 0), (5, 10, "response", 0), (0, 10, "revisit", 8),
        (0, 0, "revisit", 4), (6, 140_000, "response", 0), (7, 12, "response", 0), (8, 10, "response", 0), (9, 6, "response", 0),
    ])
    assert {r.payload_digest for r in rows if r.page_id == 9} == {warc.digest_of(b"a\r\n\r\nb")}
    assert warc.op10_warc(spark.createDataFrame([], PAGES)).count() == 0


LARGE = [(2**53 + 1, "one text", "<p>same</p>"), (2**53 + 3, "one text", "<p>same</p>"), (None, "another", "<p>other</p>"), (-(2**62) - 1, "third", None)]


def test_ids_of_64_bits_are_exact(spark, items):
    """Beside nulls too, where pandas would make them floats."""
    docs = spark.createDataFrame([(i, t) for i, t, _ in LARGE], "doc_id long, text string")
    ids = sorted((i for i, *_ in LARGE if i is not None))
    assert sorted(r.doc_id for r in tokenfiles.op8_token_files(docs, TOKENS).collect() if r.doc_id is not None) == ids
    held = spark.createDataFrame([(i, prose(2, 12)) for i in (*ids, None)], "doc_id long, text string")
    assert {r.doc_id for r in decontaminate.op3_decontaminate(held, items).collect()} == {*ids, None}
    rows = warc.op10_warc(spark.createDataFrame([(i, "http://a.b/", h) for i, _, h in LARGE], "page_id long, url string, html string")).collect()
    assert {(r.page_id, r.refers_to) for r in rows} == {(2**53 + 1, 2**53 + 3), (2**53 + 3, None), (None, None), (-(2**62) - 1, None)}
    named = warc.op10_warc(spark.createDataFrame([("a\n b:é", "u", "x"), ("b", "u", "x")], "page_id string, url string, html string")).collect()
    assert {(r.page_id, r.refers_to) for r in named} == {("a\n b:é", "b"), ("b", None)}


def test_popular_payloads_are_dealt_out(spark, monkeypatch):
    from corvane.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 5)
    monkeypatch.setattr(common, "HOT_SHARE", 4)
    pages = spark.createDataFrame([(k, None, "same" if k % 2 else ("two" if k % 3 else f"own{k}")) for k in range(60)], "page_id long, url string, html string")
    rows = warc.op10_warc(pages).collect()
    want = {k: (59 if k % 2 else 58 if k % 3 else k) for k in range(60)}
    assert {r.page_id: r.refers_to for r in rows} == {k: None if v == k else v for k, v in want.items()}


def test_other_tokenizers_get_whole_texts():
    import numpy as np
    from tokenizers import Tokenizer

    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
        data = f.read()
    own = tokenfiles.tokenizer(data)
    text = "Some  Words, it's\n<|endoftext|> and é more"
    assert not own.by_word
    assert np.frombuffer(own.encode(text), dtype="<u4").tolist() == Tokenizer.from_buffer(data).encode(text, add_special_tokens=False).ids
