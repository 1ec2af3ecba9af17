"""Runs of repeated words, found by a suffix automaton.

A run is a stretch of words with smallest period q, at least ``exponent`` * q and
``least`` words long, that no neighbouring word extends. The automaton's states are
sets of positions at which the same words end. From the longest states to the
shortest, each state's ordered set of end positions goes into that of its suffix
link, the smaller set's positions into the larger set. Wherever two positions become
neighbours at a distance d that is at most the words they have in common (the length of
the state), these words stand twice within d of each other: a square, whose run begins
where the common words begin. Of the pairs within a run only the last one is
extended, as it cannot grow to the right.

The automaton sees only stretches that can hold a run: within one, every three
words in a row recur at least exponent - 1 times (a lossless rule, applied until
nothing more goes), so ordinary prose is left out before.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, give_back

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def _automaton(words: list[int]) -> tuple[array, array, array]:
    """Suffix link, length and own end position (-1 for copies) of each state; state 0 is the root.

    Most states have one way on, which two arrays hold; only those with more have a dict.
    """
    most = 2 * len(words) + 1
    link, length, end, only_word, only_next = (array("i", bytes(4 * most)) for _ in range(5))
    more: dict[int, dict[int, int]] = {}
    link[0], end[0], only_word[0] = -1, -1, -1

    def follow(state: int, word: int) -> int:
        """The next state, or -1."""
        if only_word[state] == word:
            return only_next[state]
        return more[state].get(word, -1) if state in more else -1

    def lead(state: int, word: int, to: int) -> None:
        if only_word[state] in (-1, word):
            only_word[state], only_next[state] = word, to
        else:
            more.setdefault(state, {})[word] = to

    last, n = 0, 1
    for at, word in enumerate(words):
        new, n = n, n + 1
        length[new], end[new], only_word[new] = length[last] + 1, at, -1
        state, to = last, -1
        while state >= 0 and (to := follow(state, word)) < 0:
            lead(state, word, new)
            state = link[state]
        if state < 0:
            link[new] = 0
        elif length[to] == length[state] + 1:
            link[new] = to
        else:
            copy, n = n, n + 1
            length[copy], end[copy], link[copy] = length[state] + 1, -1, link[to]
            only_word[copy], only_next[copy] = only_word[to], only_next[to]
            if to in more:
                more[copy] = dict(more[to])
            while state >= 0 and follow(state, word) == to:
                lead(state, word, copy)
                state = link[state]
            link[to] = link[new] = copy
        last = new
    return link[:n], length[:n], end[:n]


def _neighbours(large: list[int], small: list[int]) -> Iterator[tuple[int, int]]:
    """Moves the ordered set ``small`` into ``large``, and gives what come to be neighbours."""
    if 8 * len(small) < len(large):
        for x in small:
            k = bisect_left(large, x)
            if k:
                yield large[k - 1], x
            if k < len(large):
                yield x, large[k]
            large.insert(k, x)
        return
    own = set(small)
    large.extend(small)
    large.sort()  # two sorted stretches are merged
    for a, b in zip(large, large[1:], strict=False):
        if (a in own) != (b in own):
            yield a, b


def _runs_of(words: list[int], least: int, exponent: int) -> dict[tuple[int, int], int]:
    """The smallest period of each run, by its first and last position."""
    link, length, end = _automaton(words)
    last = len(words) - 1
    # positions are kept as last - position: a state's own is then its largest, which makes insertion at the end
    ends: list[list[int] | None] = [[last - e] if e >= 0 else [] for e in end]
    found: dict[tuple[int, int], int] = {}
    for state in np.argsort(np.frombuffer(length, dtype=np.int32), kind="stable")[:0:-1].tolist():
        parent = link[state]
        own, ends[state] = ends[state], None
        if parent <= 0:
            continue  # at the root nothing is in common
        into, common = ends[parent], length[parent]
        if len(into) < len(own):
            into, own = own, into
        ends[parent] = into
        for a, b in _neighbours(into, own):
            period, stop = b - a, last - a
            if period > common or common + period < max(least, exponent * period):
                continue
            if stop < last and words[stop + 1] == words[stop + 1 - period]:
                continue  # a later pair of the same run goes further
            place = (stop - period - common + 1, stop)
            found[place] = min(period, found.get(place, period))
    return found


def _stretches(words: np.ndarray, times: int) -> Iterator[tuple[int, int]]:
    """Stretches (from, to) in which every three words in a row occur ``times`` or more, as wide as can be."""
    waiting = [(0, len(words))]
    while waiting:
        low, high = waiting.pop()
        if high - low < 3:
            continue
        own = words[low:high]
        _, own = np.unique(own, return_inverse=True) if low or high < len(words) else (None, own)
        width = np.int64(own.max() + 1)
        if width < 1 << 21:
            triples = (own[:-2] * width + own[1:-1]) * width + own[2:]
        else:
            _, pairs = np.unique(own[:-1] * width + own[1:], return_inverse=True)
            triples = pairs[:-1] * width + own[2:]
        _, where, counts = np.unique(triples, return_inverse=True, return_counts=True)
        often = np.concatenate([[False], counts[where] >= times, [False]])
        if often[1:-1].all():
            yield low, high
            continue
        edges = np.flatnonzero(often[1:] != often[:-1])
        waiting += [(low + a, low + b + 2) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]


def find_runs(words: list, least: int = 6, exponent: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence of words, by start, then period."""
    if least < 3 or exponent < 2:
        raise ValueError("runs need at least 3 words and an exponent of 2")
    if len(words) < least:
        return []
    numbers: dict = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=len(words))
    if len(words) - len(numbers) < exponent - 1:
        return []
    found = []
    for low, high in _stretches(ids, max(1, min(exponent - 1, max(least, exponent) - 2))):
        if high - low >= max(least, exponent):
            found += [(low + a, b - a + 1, p) for (a, b), p in _runs_of(ids[low:high].tolist(), least, exponent).items()]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that some run contains after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]


def with_runs(docs: DataFrame, text_col: str = "text", least: int = 6, exponent: int = 4, runs: str = "runs", text_out: str = "collapsed") -> DataFrame:
    """``docs`` with columns ``runs`` (start and length in words, period) and ``collapsed`` (kept words with one space between).

    Words are split at ASCII space. Null and empty texts have no runs and an empty text.
    A task holds one document's automaton at a time, some 150 bytes for each word of a stretch that may hold a run.
    """

    @F.pandas_udf(f"runs {RUNS}, collapsed string")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:
                words = (text or "").encode("utf-8", "surrogatepass").split()
                own = find_runs(words, least, exponent)
                kept = b" ".join(collapsed(words, own)).decode("utf-8", "surrogatepass")
                rows.append(([{"start": a, "length": n, "period": p} for a, n, p in own], kept))
            yield pd.DataFrame(rows, columns=["runs", "collapsed"])
        give_back()

    return docs.withColumn(runs, find(F.col(text_col))).withColumns({text_out: F.col(f"{runs}.collapsed"), runs: F.col(f"{runs}.runs")})


def op11_periodic(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (start, length, period, exponent_milli), runs_sha256, collapsed_sha256 of each row.

    A tenth of the documents, by a checksum of the doc_id, is made periodic from some word
    on before the search, as the query's contract fixes. A null doc_id leaves the text as it is.
    Null, empty and blank texts: no runs, nulls, and digests of nothing. Texts of any length
    count whole; of equally long runs the first counts. Repeated rows come out as often as
    they went in, an empty table gives no rows, other columns are ignored.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(f"[^{ASCII_SPACE}]+"), F.lit(0))
    chosen = docs.select("doc_id", "text", h.alias("h")).withColumn("words", F.when((F.col("h") % 10 == 0) & F.col("text").isNotNull(), words))
    g, n = F.floor(F.col("h") / 10), F.size("words")
    parts = chosen.withColumn("a", F.when(n > 0, g % n)).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + g % 8)))
    again = F.expr("array_join(transform(words, (w, i) -> if(i < a, w, words[int(a + (i - a) % p)])), ' ')")
    found = with_runs(parts.select("doc_id", F.when(F.col("a").isNotNull(), again).otherwise(F.col("text")).alias("text")))
    longest = F.expr("array_min(transform(runs, r -> struct(-r.length, r.start, r.period)))")
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("best"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    start, length, period = F.col("best.start"), -F.col("best.col1"), F.col("best.period")
    return found.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
