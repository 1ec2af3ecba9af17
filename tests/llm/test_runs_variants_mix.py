"""Runs of words, spelling variants and mixing, against plain versions of themselves."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import mixing, periodic, variants

from .conftest import prose

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def plain_runs(words, least=6, exponent=4):
    """For every period the longest stretches that have it, without those that have a smaller one."""
    found = {}
    numbers = {w: k for k, w in enumerate(set(words))}
    ids = np.array([numbers[w] for w in words], dtype=np.int64)
    for q in range(1, len(words) // exponent + 1):
        same = np.concatenate([[False], ids[q:] == ids[:-q], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b + q - a >= max(least, exponent * q):
                found.setdefault((a, b + q), q)
    return sorted((a, b - a, q) for (a, b), q in found.items())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.lists(st.integers(0, 2), min_size=1, max_size=5), st.integers(0, 12), st.sampled_from([(6, 4), (3, 2), (4, 3), (9, 2)]))
def test_runs_of_any_sequence(words, block, times, bounds):
    words = [f"w{w}" for w in words[:20] + block * times + words[20:]]
    assert periodic.find_runs(words, *bounds) == sorted(plain_runs(words, *bounds), key=lambda r: (r[0], r[2]))


def test_long_runs_and_their_limits():
    words = ["a"] * 30_000 + list("xyzzy") * 4_000 + ["end"]
    assert periodic.find_runs(words) == [(0, 30_000, 1), (30_000, 20_000, 5)]
    assert periodic.find_runs(list("abababa")) == []
    assert periodic.find_runs(list("abababab")) == [(0, 8, 2)]
    assert periodic.find_runs([]) == periodic.find_runs(["a"] * 5) == []
    with pytest.raises(ValueError):
        periodic.find_runs(["a"], least=2)


def plain_periodic(doc_id, text):
    words = WORD.findall(text or "")
    h, n = (zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = sorted(plain_runs(words), key=lambda r: (r[0], r[2]))
    gone = {k for a, length, q in runs for k in range(a + q, a + length)}
    best = min(((-length, a, q) for a, length, q in runs), default=None)
    sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
    top = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
    return (doc_id, len(runs), *top, sha("".join(f"{a},{length},{q}\n" for a, length, q in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))


def test_periodic_documents_equal_plain_search(spark, documents):
    got = sorted(map(tuple, periodic.op11_periodic(documents).collect()))
    assert got == sorted(plain_periodic(r.doc_id, r.text) for r in documents.collect())
    assert sum(r[1] > 0 for r in got) >= 5


def test_periodic_odd_documents(spark, odd_docs, no_docs):
    key = lambda r: tuple((x is None, x or 0) for x in r[:2]) + r[6:]
    got = sorted(map(tuple, periodic.op11_periodic(odd_docs).collect()), key=key)
    assert got == sorted((plain_periodic(r.doc_id, r.text) for r in odd_docs.collect()), key=key)
    assert periodic.op11_periodic(no_docs).count() == 0
    kept = periodic.with_runs(odd_docs.where("doc_id = 7")).select("runs", "collapsed", "text").first()
    assert [tuple(r) for r in kept.runs] == [(0, 200, 1)] and kept.collapsed == "a"


def within_one(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def plain_variants(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode()) if doc_id is not None else 1
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= 5}
    near = {w: sorted((x for x in n if within_one(w, x)), key=lambda x: (-n[x], x)) for w in n}
    form = {w: near[w][0] if near[w] and n[near[w][0]] >= 5 * n[w] else None for w in n}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n.get(form[w], 0)) for w in n)


def _variants(docs):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in variants.op12_variants(docs).collect())


def test_variants_equal_plain_comparison(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = _variants(documents)
    assert got == plain_variants(rows)
    assert any(r[1] for r in got)


def test_variants_of_chains_ties_and_odd_documents(spark, odd_docs, no_docs):
    chain = {"colourings": 700, "colouring": 140, "colourin": 28, "colouriin": 5, "abcdef": 50, "abcdeg": 50, "abcdeh": 10, "aaaaaa": 40, "aaaaaaa": 8, "élèves": 60, "élèvés": 12, "Élèves": 7, "×÷×÷×÷": 5, "x" * 3000: 25, "x" * 2999 + "y": 5, "kurzes": 4}
    rows = [(k, " ".join([w] * c)) for k, (w, c) in enumerate(chain.items())] + [(None, "nothing " * 30), (None, None), (5, ""), (6, "SHOUTED shouted ShOuTeD. shouted-shouted")] * 2
    docs = spark.createDataFrame([(i, t, "n", 7) for i, t in rows], "doc_id long, text string, word string, n int")
    assert _variants(docs) == plain_variants(rows)
    assert {r[:3] for r in _variants(docs)} >= {("colourin", "colouring", "colourings"), ("abcdeh", "abcdef", "abcdef"), ("élèvés", "élèves", "élèves")}
    assert _variants(odd_docs) == plain_variants([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert _variants(no_docs) == []


@settings(max_examples=200, deadline=None)
@given(st.text("abé", min_size=1, max_size=8), st.text("abé", min_size=1, max_size=8))
def test_words_one_edit_apart_share_a_key(a, b):
    shared = set(variants.deletion_keys(a).tolist()) & set(variants.deletion_keys(b).tolist())
    assert shared or not within_one(a, b)


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    """The excess is shared again until no source is above its most."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    capped, budget = set(), sum(sizes.values())
    while True:
        left = [s for s in order if s not in capped]
        share = (budget - sum(most * sizes[s] for s in capped)) / max(1, sum(weight[s] for s in left))
        above = {s for s in left if weight[s] * share > most * sizes[s]}
        if not above:
            return {s: most * sizes[s] if s in capped else weight[s] * share for s in order}
        capped |= above


def check_mix(rows, docs):
    """The contract on the rows of a mix."""
    size = lambda t: len(WORD.findall(t or ""))
    assert Counter((r.doc_id, r["size"]) for r in rows) == Counter((d.doc_id, size(d.text)) for d in docs)
    sizes = Counter()
    for d in docs:
        sizes[d.source] += size(d.text)
    want, took = plain_targets(sizes), Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) <= 1e-6 * max(1, r.target)
        assert 0 <= r.taken <= 3 * r["size"]
        took[r.source] += r.taken
    assert sum(took.values()) == sum(sizes.values())
    longest = max((size(d.text) for d in docs), default=0)
    assert all(abs(took[s] - want[s]) <= longest * (len(sizes) + 1) for s in sizes)


def test_mix_meets_its_targets(spark, documents):
    rows = mixing.op13_mix(documents).collect()
    check_mix(rows, documents.collect())
    assert sorted(rows) == sorted(mixing.op13_mix(documents.repartition(7)).collect())


def test_mix_of_odd_and_lopsided_sources(spark, odd_docs, no_docs):
    check_mix(mixing.op13_mix(odd_docs).collect(), odd_docs.collect())
    assert mixing.op13_mix(no_docs).count() == 0
    rng = np.random.default_rng(3)
    rows = [(k, prose(k, int(n)), s) for k, (n, s) in enumerate(zip(rng.integers(0, 40, 300), rng.choice(["a", "b", "c", "d", "", None, "none"], 300, p=[0.9, 0.04, 0.02, 0.01, 0.01, 0.01, 0.01]), strict=True))]
    rows += [(1000, None, "empty"), (1001, "", "empty"), (7, "same words", "b"), (7, "same words", "b"), (None, "no id", "c")]
    docs = spark.createDataFrame([(i, t, s, 1, 2) for i, t, s in rows], "doc_id long, text string, source string, size int, place int")
    mix = mixing.op13_mix(docs).collect()
    check_mix(mix, docs.collect())
    assert any(r.taken > 2 * r["size"] > 0 for r in mix)
    blank = docs.where("source = 'empty'")
    assert {(r["size"], r.taken) for r in mixing.op13_mix(blank).collect()} == {(0, 0)}
