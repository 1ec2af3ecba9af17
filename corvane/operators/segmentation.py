"""Words of unspaced text by a dictionary: the most probable path through the lattice of its words.

A dictionary is a table of words with counts. A word costs its negative log probability in
millionths, as a whole number, so that equal paths are equal on every machine; of these
the one whose first word is longer wins. Characters that no word covers stand alone, at the cost
of a word seen once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import CJK
from ..storage import stored

#: Runs of characters without spaces between words.
UNSPACED = f"[{CJK}]+"
#: Words, and characters in all, of a dictionary that goes to the tasks whole.
BROADCAST_WORDS, BROADCAST_CHARS = 500_000, 16_000_000


def dictionary(words: DataFrame, user: DataFrame | None = None) -> DataFrame:
    """(word, cost), stored, of words (word, n); of repeated words the counts add up, and those of ``user`` (word, n) take the place of others."""
    own = words.where("word != '' and n > 0").groupBy("word").agg(F.sum("n").alias("n"))
    if user is not None:
        added = user.where("word != '' and n > 0").groupBy("word").agg(F.sum("n").alias("n"))
        own = own.join(added, "word", "left_anti").unionByName(added)
    own = stored(own, "dictionary-counts")
    total = own.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return stored(own.select("word", F.round(1_000_000 * F.log(F.lit(float(max(total, 1))) / F.col("n"))).cast("long").alias("cost"), F.lit(total).cast("long").alias("total")), "dictionary")


def _unknown(words: DataFrame) -> int:
    """What a character costs that no word covers."""
    total = words.agg(F.max("total")).first()[0] or 1
    return round(1_000_000 * math.log(total))


def shortest(n: int, costs: Callable[[int], list[tuple[int, int]]], unknown: int) -> list[int]:
    """Lengths of the words of the cheapest path over ``n`` characters; ``costs(i)`` gives (length, cost) of the words that begin at i."""
    best, step = [0] * (n + 1), [1] * n
    for i in range(n - 1, -1, -1):
        choices = costs(i)
        if not any(length == 1 for length, _ in choices):
            choices = [*choices, (1, unknown)]
        best[i], minus = min((cost + best[i + length], -length) for length, cost in choices)
        step[i] = -minus
    found, at = [], 0
    while at < n:
        found.append(step[at])
        at += step[at]
    return found


def segmenter(words: DataFrame, runs: str = UNSPACED) -> Callable[[Column | str], Column]:
    """A tokenizer as ``retrieval.postings`` and ``query_terms`` take one: lower-case words of the dictionary in ``runs``, and [a-z0-9]+ of the rest.

    The dictionary goes to every task, so it must be within BROADCAST_WORDS and BROADCAST_CHARS;
    for a larger one use ``segmented``. Null texts have no words. Words come run by run, in the order of the text.
    """
    n, chars = words.agg(F.count("*"), F.coalesce(F.sum(F.length("word")), F.lit(0))).first()
    if n > BROADCAST_WORDS or chars > BROADCAST_CHARS:
        raise ValueError(f"a dictionary of {n} words and {chars} characters is too large for every task: use segmented()")
    costs = {r.word.lower(): r.cost for r in words.select("word", "cost").toLocalIterator()}
    prefixes = {w[:k] for w in costs for k in range(1, len(w))} - costs.keys()
    shared = words.sparkSession.sparkContext.broadcast(costs | dict.fromkeys(prefixes))
    unknown = _unknown(words)

    @F.pandas_udf("array<string>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = shared.value

        def begin(run: str) -> Callable[[int], list[tuple[int, int]]]:
            def at(i: int) -> list[tuple[int, int]]:
                found = []
                for k in range(i + 1, len(run) + 1):
                    piece = run[i:k]
                    if piece not in known:  # nor does any word begin so
                        break
                    if known[piece] is not None:
                        found.append((k - i, known[piece]))
                return found

            return at

        def words_of(run: str) -> list[str]:
            out, at = [], 0
            for length in shortest(len(run), begin(run), unknown):
                out.append(run[at : at + length])
                at += length
            return out

        for batch in batches:
            yield pd.Series([[w for run in row for w in words_of(run)] for row in batch])

    def tokenizer(text: Column | str) -> Column:
        lowered = F.lower(F.col(text) if isinstance(text, str) else text)
        spaced = F.regexp_extract_all(F.regexp_replace(lowered, runs, " "), F.lit("[a-z0-9]+"), F.lit(0))
        return F.concat(cut(F.coalesce(F.regexp_extract_all(lowered, F.lit(runs), F.lit(0)), F.array().cast("array<string>"))), spaced)

    return tokenizer


def segmented(texts: DataFrame, words: DataFrame, key: str, text: str = "text", runs: str = UNSPACED) -> DataFrame:
    """(key, run_no, words) of each run of ``texts``, for dictionaries of any size: the lattice is a join of the runs' pieces with the words.

    Each different run is worked on once, however many texts have it.
    """
    own = texts.select(F.col(key), F.posexplode(F.regexp_extract_all(F.lower(text), F.lit(runs), F.lit(0))).alias("run_no", "run"))
    longest = words.agg(F.coalesce(F.max(F.length("word")), F.lit(1))).first()[0]
    distinct = own.select("run").distinct()
    starts = distinct.select("run", F.explode(F.sequence(F.lit(1), F.length("run"))).alias("start"))
    width = F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("run") - F.col("start") + 1))).alias("width")
    pieces = starts.select("run", "start", width).withColumn("piece", F.substring(F.col("run"), F.col("start"), F.col("width")))
    lower = words.groupBy(F.lower("word").alias("piece")).agg(F.min("cost").alias("cost"))
    edges = pieces.join(lower, "piece").groupBy("run").agg(F.collect_list(F.struct("start", "width", "cost")).alias("edges"))
    unknown = _unknown(words)

    @F.pandas_udf("array<string>")
    def path(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for run_batch, edge_batch in batches:
            out = []
            for run, found in zip(run_batch, edge_batch, strict=True):
                at: dict[int, list[tuple[int, int]]] = {}
                for e in found if found is not None else ():
                    at.setdefault(e["start"] - 1, []).append((e["width"], e["cost"]))
                words, place = [], 0
                for length in shortest(len(run), lambda i, at=at: at.get(i, []), unknown):
                    words.append(run[place : place + length])
                    place += length
                out.append(words)
            yield pd.Series(out)

    cut = distinct.join(edges, "run", "left").select("run", path("run", "edges").alias("words"))
    return own.join(cut, "run").select(key, "run_no", "words")
