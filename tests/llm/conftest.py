import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, place int, text_key string, fp long, stats string, kept string, toxicity string"
SYLLABLES = ("ka", "mo", "ri", "ten", "sul", "var", "bel", "dor")


def prose(seed: int, n: int) -> str:
    """Invented words, the same for the same seed."""
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


def odd_rows() -> list[tuple]:
    """Documents with nulls in any column, empty, blank and very long texts, repeated rows and ids, columns with clashing names."""
    base, clash = prose(1, 60), (7, "k", 3, "s", "k", "t")
    texts = [base, base, base + " extra", "", None, "   \n\t", prose(2, 12), "a " * 200, prose(3, 60_000), "éß 中文 \u0000 🙂 ▁ <|endoftext|>", prose(4, 40) + "\n" + prose(4, 40), "One line.\n\nUnder the MIT License, and so on."]
    rows = [(k, t, "en", f"s{k % 3}", None, *clash) for k, t in enumerate(texts)]
    return [*rows, rows[0], rows[3], (None, base, None, None, None, *clash), (None, None, None, None, None, *[None] * 6), (5, prose(5, 30), "de", None, 1, *clash)]


@pytest.fixture(scope="session")
def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
