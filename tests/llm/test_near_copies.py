"""Edited copies: keep_one_of_each against all pairs."""

import random

from pyspark.sql import functions as F

from corvane.llm import components, decontaminate, simhash
from corvane.llm.common import stored

from .conftest import prose


def _edited(text: str, share: float, seed: int) -> str:
    """``text`` with a share of its words replaced."""
    rng, words = random.Random(seed), text.split()
    for k in rng.sample(range(len(words)), round(share * len(words))):
        words[k] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def _smallest_of_each(rows: dict[int, str], radius: int = 3, similarity: float = 0.8) -> set[int]:
    sets, fps, parent = {i: simhash.shingle_set(t) for i, t in rows.items()}, {i: simhash.fingerprint(t, words=5) for i, t in rows.items()}, {i: i for i in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in rows:
        for j in rows:
            if i < j and ((fps[i] ^ fps[j]).bit_count() <= radius or len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) > 0):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return {i for i in rows if root(i) == i}


def test_edited_copies_go(spark):
    texts = []
    for k in range(40):
        base = prose(k, 150)
        texts += [base, _edited(base, 0.007, k), _edited(base, 0.02, k + 100), _edited(base, 0.1, k + 200)]
    rows = dict(enumerate(texts))
    got = {r.doc_id for r in simhash.keep_one_of_each(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect()}
    assert got == _smallest_of_each(rows) and len(got) < 90


def test_crowded_keys_lose_no_pair(spark):
    """Two groups that share most keys, but in which few pairs are similar."""
    base = prose(1, 120)
    texts = [_edited(base, 0.03, k) for k in range(60)] + [_edited(base, 0.005, k) for k in range(6)] + [prose(2, 40)]
    rows = dict(enumerate(texts))
    got = {r.doc_id for r in simhash.keep_one_of_each(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect()}
    assert got == _smallest_of_each(rows)


def _unasked(df) -> int:
    """Joins in a plan that broadcast a side by Spark's own estimate of its size."""
    plans = df._jdf.queryExecution()
    made = plans.executedPlan().toString()
    return made.count("BroadcastHashJoin") + made.count("BroadcastNestedLoopJoin") - plans.optimizedPlan().toString().count("strategy=broadcast")


def test_nothing_is_broadcast_by_an_estimate(spark, monkeypatch):
    """Files say too little about exploded rows and repeated arrays: a broadcast that Spark took for less than 10 MB had 134."""
    found = {}

    def spied(df, label):
        found[label] = max(found.get(label, 0), _unasked(df))
        return stored(df, label)

    for module in (simhash, components, decontaminate):
        monkeypatch.setattr(module, "stored", spied)
    texts = [_edited(prose(k % 4, 120), 0.03 * (k % 3), k) for k in range(90)]
    docs = spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts)], "doc_id long, text string, source string")
    found["kept"] = _unasked(simhash.keep_one_of_each(docs))
    simhash.op7_simhash(docs)
    found["crowded"] = _unasked(simhash.similar_fingerprints(spark.range(40).select(F.col("id").alias("fp")), 2, bucket=8))
    found["passages"] = _unasked(decontaminate.contaminated(docs, docs.where("doc_id < 3").withColumnRenamed("doc_id", "item_id")).select("doc_id", "text_key"))
    assert len(found) > 12 and not {label: n for label, n in found.items() if n}
