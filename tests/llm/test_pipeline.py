"""The pipeline against a plain version of its stages."""

import public_tokenizers

import corpus_pipeline
from corvane.llm import decontaminate, quality, simhash, toxicity

SF = "/root/testdata/sf0.001"


def _near_copies(rows: dict[int, str]) -> set[int]:
    """Documents that stay: the smallest id of each group."""
    fps = {i: simhash.fingerprint(t, words=5) for i, t in rows.items()}
    sets = {i: simhash.shingle_set(t) for i, t in rows.items()}
    parent = {i: i for i in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in fps:
        for j in fps:
            near = i < j and ((fps[i] ^ fps[j]).bit_count() <= 3 or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) > 0)
            if near and root(i) != root(j):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return {i for i in fps if root(i) == i}


def _contaminated(text: str, items: list[list[str]]) -> bool:
    import numpy as np

    words = decontaminate.words_of(text)
    numbers = {w: k for k, w in enumerate({*words, *(w for item in items for w in item)})}
    doc = np.array([numbers[w] for w in words])
    for item in items:
        wanted = decontaminate.least_score(len(item), 0.6)
        if len(item) >= 3 and len(set(item) & set(words)) >= 0.5 * len(set(item)) and decontaminate.smith_waterman(doc, np.array([numbers[w] for w in item]))[0] >= wanted:
            return True
    return False


def test_pipeline_equals_plain_stages(spark):
    import sentencepiece

    documents, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    items = [decontaminate.words_of(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = {r.doc_id: r.text for r in documents.collect()}
    toxic = {r.doc_id for r in toxicity.op6_toxicity(documents, labels).collect() if r.predicted}
    rows = {i: t for i, t in rows.items() if i not in toxic}
    stats = {i: quality.text_stats(t) for i, t in rows.items()}
    rows = {i: t for i, t in rows.items() if stats[i][0] >= 20 and 100 * stats[i][4] <= 30 * stats[i][0]}
    rows = {i: rows[i] for i in _near_copies(rows)}
    rows = {i: t for i, t in rows.items() if not _contaminated(t, items)}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == set(rows) and len(rows) < documents.count()
    assert all(got[i].pieces == library.encode(t) and got[i].n_pieces == len(got[i].pieces) and got[i].text == t for i, t in rows.items())
