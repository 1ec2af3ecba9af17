"""Excerpts of long items, and items in scripts without spaces."""

import random

from corvane.llm import decontaminate

from .conftest import prose


def test_excerpts_and_scripts_without_spaces(spark):
    rng = random.Random(3)
    han = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(n))
    items = [(0, prose(100, 59)), (1, prose(101, 200)), (2, han(20) + "。" + han(15)), (3, prose(102, 200))]
    word = lambda k, a, b: " ".join(items[k][1].split()[a:b])
    changed = items[3][1].split()[40:110]
    for k in range(5, 70, 7):
        changed[k] = f"new{k}"
    texts = [word(0, 20, 54), word(1, 50, 165), word(1, 50, 80), "长" + items[2][1] + "文", " ".join(changed), word(0, 0, 25), word(3, 0, 29), items[2][1][:10]]
    docs = [(k, f"{prose(k, 50)} {text} {prose(k + 20, 50)}") for k, text in enumerate(texts)]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    rows = {(r.doc_id, r.item_id): r.score for r in got.collect()}
    assert set(rows) == {(0, 0), (1, 1), (2, 1), (3, 2), (4, 3)}
    assert rows[(3, 2)] == 1 and rows[(1, 1)] >= 115 / 200
