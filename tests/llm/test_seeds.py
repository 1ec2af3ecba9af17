"""Seeds of decontamination: few, rare, and without loss."""

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import decontaminate

from .conftest import prose


@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), min_size=2, max_size=8), st.integers(1, 8))
@settings(max_examples=80, deadline=None)
def test_the_cheapest_seeds(counts, wanted):
    two, three = np.array([a for a, _ in counts]), np.array([b for _, b in counts[:-1]])
    wanted = min(wanted, len(two))
    every = [(k, 2) for k in range(len(two))] + [(k, 3) for k in range(len(three))]
    pairs = lambda seed: set(range(seed[0], seed[0] + seed[1] - 1))
    apart = lambda seeds: len(set().union(*map(pairs, seeds))) == sum(len(pairs(s)) for s in seeds)
    total = lambda seeds: sum(int((two if n == 2 else three)[k]) for k, n in seeds)
    got = decontaminate.cheapest_seeds(two, three, wanted)
    assert len(set(got)) == wanted and set(got) <= set(every) and apart(got)
    assert total(got) == min(total(s) for s in itertools.combinations(every, wanted) if apart(s))


@pytest.mark.parametrize("m", [3, 8, 12, 20, 30, 50])
def test_a_seed_for_each_lost_point_and_one_more(m):
    loss = m - decontaminate.least_score(m, 0.6)
    got = decontaminate.cheapest_seeds(np.full(m - 1, 2), np.full(m - 2, 1), loss + 1)
    assert len(got) == loss + 1 and {n for _, n in got} == {3}  # 9 of 20 words, all of them trigrams
    assert m != 20 or len(got) == 9


def _edited(rng: random.Random, words: list[str]) -> list[str]:
    """Words with insertions, omissions and changes, as many as there are of these at random."""
    out = []
    rate = rng.choice((0.1, 0.25, 0.4, 0.5))
    for word in words:
        edit = rng.choice(("insert", "omit", "change")) if rng.random() < rate else ""
        out += {"insert": [word, f"n{rng.randrange(10**6)}"], "omit": [], "change": [f"c{rng.randrange(10**6)}"], "": [word]}[edit]
    return out


def test_edited_copies_of_items_of_any_length(spark):
    """Against alignments of all pairs; the words are few, so that items share n-grams, and copies lose up to all their points."""
    rng = random.Random(8)
    few = [f"w{k}" for k in range(40)]
    lengths = (3, 5, 8, 9, 12, 15, 20, 33, 50, 51, 59, 75, 140)
    items = {f"item {m}": rng.choices(few, k=m) for m in lengths}
    docs = [prose(k, 10).split() + _edited(rng, items[name][rng.choice((0, 0, 5)) :]) + rng.choices(few, k=20) for k in range(12) for name in items]
    numbers = {w: k for k, w in enumerate(few, 1)}
    want = {}
    for k, doc in enumerate(docs):
        coded = np.array([numbers.get(w, 0) for w in doc])
        for name, item in items.items():
            score = decontaminate.smith_waterman(coded, np.array([numbers[w] for w in item]))[0]
            if score >= decontaminate.least_score(len(item), 0.6):
                want[k, name] = round(score / len(item), 9)
    rows = spark.createDataFrame([(k, " ".join(d)) for k, d in enumerate(docs)], "doc_id long, text string")
    tests = spark.createDataFrame([(name, " ".join(item)) for name, item in items.items()], "item_id string, text string")
    got = decontaminate.contaminated(rows, tests)
    assert dict(got.dtypes)["item_id"] == "string"
    assert {(r.doc_id, r.item_id): round(r.score, 9) for r in got.collect()} == want and len(want) > 50


def test_an_excerpt_with_a_new_word_after_every_two(spark):
    """30 points of 62 words in 31 runs: no trigram is kept, and more is lost than a third."""
    item = prose(7, 200).split()
    copy = [w for k, word in enumerate(item[50:112]) for w in ((word, f"new{k}") if k % 2 else (word,))]
    docs = spark.createDataFrame([(1, " ".join(copy)), (2, " ".join(copy[:60]))], "doc_id long, text string")
    got = decontaminate.op3_decontaminate(docs, spark.createDataFrame([(5, " ".join(item))], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(1, 5)] and got[0].score >= 30 / 200


def test_items_of_one_and_two_words(spark):
    docs = spark.createDataFrame([(1, "so Einstein said"), (2, "the answer: forty two!"), (3, "forty or two"), (4, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "einstein"), (2, "forty two"), (3, ""), (4, None)], "item_id int, text string")
    found = lambda least: {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items, least_words=least).collect()}
    assert found(1) == {(1, 1), (2, 2)} and found(2) == {(2, 2)} and found(3) == set()
