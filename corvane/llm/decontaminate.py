"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

A document holds a copy of a test item of m words if a local alignment of their
words (match +1, mismatch -1, gap -1) scores at least S: ``min_score * m``, and at least 8
or, of shorter items, m; or, of an item however long, EXCERPT. Of the item's m points such
an alignment loses at most U = m - S.

Seeds are bigrams and trigrams of the item of which no two hold the same two neighbouring
words. Then a lost point destroys at most one seed: an inserted word parts one pair of
neighbours, a word before or after the alignment takes one away, a changed or missing word
two for two points. So of any U + 1 such seeds a copy has kept one, and the item's seeds
are the U + 1 whose counts in the corpus have the least sum (dynamic programming along the
item): the search is without loss, for excerpts of long items too. A copy also keeps at
least S - 1 pairs of neighbours: passages with fewer are not aligned, again without loss.
Letters of scripts without spaces are words of their own.

Spark jobs: count the items' n-grams over all documents; cut out passages around
seeds; join passages to items on seeds; align each pair. The benchmark is worked
through in parts of at most about ``part_words`` words, which bounds what is
broadcast however large the benchmark is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrow_name, shuffled, small_side, stored

#: Score below which an alignment of a few words is no copy.
LEAST = 8
#: Score that suffices for a copy of any longer item.
EXCERPT = 30
#: Han, kana, Thai, Lao, Myanmar, Khmer: no spaces between words.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
_JAVA_UNSPACED = UNSPACED.replace("\U00020000-\U0003ffff", r"\x{20000}-\x{3ffff}")
WORD = re.compile(rf"(?:(?![{UNSPACED}])\w)+|(?=\w)[{UNSPACED}]")
PLAIN = re.compile(r"\w+")
ANY_UNSPACED = re.compile(f"[{UNSPACED}]")
#: Above all numbers of words and bigrams of a part: two numbers fit a long.
BASE = 1 << 31


def words_of(text: str | None) -> list[str]:
    text = (text or "").lower()
    return (WORD if ANY_UNSPACED.search(text) else PLAIN).findall(text)


def numbers_of(text: str | None, vocabulary: dict[str, int]) -> np.ndarray:
    """The words' numbers; 0 for words that the vocabulary lacks."""
    words = words_of(text)
    return np.fromiter(map(vocabulary.get, words, repeat(0)), dtype=np.int64, count=len(words))


def least_score(m: int, min_score: float) -> int:
    """Score that a copy of an item of ``m`` words needs: its share, and at least LEAST or all of a shorter item; EXCERPT is enough."""
    return min(max(int(np.ceil(min_score * m - 1e-9)), min(m, LEAST)), EXCERPT)


def _among(codes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in the sorted ``codes``, and which of them are really there."""
    if not len(codes):
        return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
    at = np.minimum(np.searchsorted(codes, wanted), len(codes) - 1)
    return at, codes[at] == wanted


def grams_in(ids: np.ndarray, pairs: np.ndarray, triples: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where the part's bigrams start in ``ids`` and their numbers, and the same of its trigrams, numbered after the bigrams.

    A trigram's code is its first bigram's number and its last word: it is looked for only where two known bigrams meet.
    """
    known = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
    at, real = _among(pairs, ids[known] * BASE + ids[known + 1])
    two, first = known[real], at[real]
    meet = np.flatnonzero(np.diff(two) == 1)
    at, real = _among(triples, first[meet] * BASE + ids[two[meet] + 2])
    return two, first, two[meet][real], at[real] + len(pairs)


def smith_waterman(doc: np.ndarray, item: np.ndarray) -> tuple[int, int, int]:
    """Best local score of ``item`` in ``doc`` and where it starts and ends in ``doc`` (inclusive). 0 equals nothing."""
    along = np.arange(len(doc) + 1)
    row, best, at = np.zeros(len(doc) + 1, dtype=np.int64), 0, (0, 0)
    for i, word in enumerate(item):
        reached = np.zeros_like(row)
        reached[1:] = np.maximum(row[:-1] + np.where(doc == word, 1, -1), row[1:] - 1)
        np.maximum(reached, 0, out=reached)
        row = np.maximum.accumulate(reached + along) - along
        if (top := int(row.max())) > best:
            best, at = top, (i, int(row.argmax()) - 1)
    if not best:
        return 0, -1, -1
    # backwards from the end, anchored there, until the same score is reached
    doc, item = doc[: at[1] + 1][::-1], item[: at[0] + 1][::-1]
    along = np.arange(len(doc) + 1)
    row = -along
    for i, word in enumerate(item):
        reached = np.full_like(row, -i - 1)
        reached[1:] = np.maximum(row[:-1] + np.where(doc == word, 1, -1), row[1:] - 1)
        row = np.maximum.accumulate(reached + along) - along
        if (hit := np.flatnonzero(row == best)).size:
            return best, at[1] + 1 - int(hit[0]), at[1]
    raise AssertionError("the alignment has no start")


def _part(items: list, min_score: float, least_words: int) -> dict | None:
    """Vocabulary, word numbers and n-grams of some (key, text) rows; None if no item has ``least_words`` words."""
    vocabulary: dict[str, int] = {}
    numbered = []
    for key, text in items:
        words = words_of(text)
        if len(words) >= max(least_words, 1):
            numbered.append((key, np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words], dtype=np.int64)))
    if not numbered:
        return None
    pairs = np.unique(np.concatenate([ids[:-1] * BASE + ids[1:] for _, ids in numbered]))
    triples = np.unique(np.concatenate([np.searchsorted(pairs, ids[:-2] * BASE + ids[1:-1]) * BASE + ids[2:] for _, ids in numbered]))
    return {"vocabulary": vocabulary, "items": numbered, "pairs": pairs, "triples": triples, "min_score": min_score}


def _gram_counts(docs: DataFrame, part: dict) -> np.ndarray:
    """How often each n-gram of the part occurs in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast((part["vocabulary"], part["pairs"], part["triples"]))
    size = len(part["pairs"]) + len(part["triples"])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary, pairs, triples = shared.value
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for text in batch["text"]:
                _, first, _, second = grams_in(numbers_of(text, vocabulary), pairs, triples)
                np.add.at(total, first, 1)
                np.add.at(total, second, 1)
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"at": seen, "n": total[seen]})

    rows = docs.select("text").mapInPandas(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(size, dtype=np.int64)
    total[rows["at"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.int64)
    return total


def cheapest_seeds(two: np.ndarray, three: np.ndarray, wanted: int) -> list[tuple[int, int]]:
    """``wanted`` n-grams (place, length) of an item, none sharing two neighbouring words, with the least sum of counts.

    ``two`` and ``three`` are the counts of its bigrams and trigrams by place. Of the item's pairs of
    neighbours a trigram takes one more than a bigram does, and others may stay free; how many such
    spare pairs the first pairs have used is all that the search along the item has to keep.
    """
    n = len(two)
    spare = n - wanted
    never = np.iinfo(np.int64).max // 2
    before, last = np.full(spare + 1, never), np.full(spare + 1, never)  # least sums up to the last pair but one, and to the last
    last[0] = 0
    taken = np.zeros((n + 1, spare + 1), dtype=np.int8)  # 0: free, 1: a bigram, 2: a trigram ends here
    for k in range(1, n + 1):
        ways = np.full((3, spare + 1), never, dtype=np.int64)
        ways[0, 1:] = last[:-1]
        ways[1] = last + two[k - 1]
        if k > 1:
            ways[2, 1:] = before[:-1] + three[k - 2]
        taken[k] = 2 - np.argmin(ways[::-1], axis=0)  # of equal ways the longest n-gram
        before, last = last, np.minimum(ways.min(axis=0), never)
    found, k = [], n
    while k:
        way = int(taken[k, spare])
        if way:
            found.append((k - way, way + 1))
        spare -= way != 1
        k -= max(way, 1)
    return found[::-1]


def _seeds(part: dict, counts: np.ndarray) -> tuple[dict[str, np.ndarray], list[tuple[int, int]]]:
    """Each n-gram's reach to the left and right and least number of bigrams nearby, -1 if it is no seed; and (gram, item) rows.

    Words of items that are one word are numbered after the n-grams.
    """
    size = len(counts) + (len(part["vocabulary"]) + 1 if any(len(ids) == 1 for _, ids in part["items"]) else 0)
    left, right = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
    least = np.full(size, -1, dtype=np.int64)
    rows = set()
    for number, (_, ids) in enumerate(part["items"]):
        need = least_score(len(ids), part["min_score"])
        loss = len(ids) - need
        _, first, _, second = grams_in(ids, part["pairs"], part["triples"])
        if len(ids) == 1:
            chosen = [(0, len(counts) + int(ids[0]))]
        else:
            chosen = [(place, int((first if n == 2 else second)[place])) for place, n in cheapest_seeds(counts[first], counts[second], loss + 1)]
        for place, gram in chosen:
            left[gram] = max(left[gram], place + loss)
            right[gram] = max(right[gram], len(ids) - place + loss)
            least[gram] = need - 1 if least[gram] < 0 else min(least[gram], need - 1)
            rows.add((gram, number))
    return {"left": left, "right": right, "least": least}, sorted(rows)


def _passages(docs: DataFrame, part: dict, seeds: dict[str, np.ndarray]) -> DataFrame:
    """Passages around seeds: doc_id, text_key, start (word), ids (numbers of words), grams (seeds in it)."""
    shared = docs.sparkSession.sparkContext.broadcast((part["vocabulary"], part["pairs"], part["triples"], seeds))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary, pairs, triples, seed = shared.value
        grams = len(pairs) + len(triples)
        for batch in batches:
            out = []
            for doc_id, key, text in zip(batch["doc_id"], batch["text_key"], batch["text"], strict=True):
                ids = numbers_of(text, vocabulary)
                two, first, three, second = grams_in(ids, pairs, triples)
                one = np.flatnonzero(ids) if len(seed["least"]) > grams else ids[:0]
                places, at = np.concatenate([two, three, one]), np.concatenate([first, second, ids[one] + grams])
                use = np.flatnonzero(seed["least"][at] >= 0)
                begins, ends = places[use] - seed["left"][at[use]], places[use] + seed["right"][at[use]]
                near = np.searchsorted(two, ends) - np.searchsorted(two, begins) >= seed["least"][at[use]]
                use, begins, ends = use[near], begins[near], ends[near]
                if not use.size:
                    continue
                order = np.argsort(begins, kind="stable")
                open_at, reach, found = 0, -1, []
                for k in order.tolist():  # overlapping stretches become one passage
                    if found and begins[k] <= reach:
                        reach = max(reach, int(ends[k]))
                    else:
                        if found:
                            out.append((doc_id, key, open_at, ids[open_at:reach], np.unique(found)))
                        open_at, reach, found = max(0, int(begins[k])), int(ends[k]), []
                    found.append(at[use[k]])
                if found:
                    out.append((doc_id, key, open_at, ids[open_at:reach], np.unique(found)))
            yield pd.DataFrame(out, columns=["doc_id", "text_key", "start", "ids", "grams"])

    # ids to Python as text: a null beside them would make pandas round large numbers
    columns = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.md5("text").alias("text_key"), "text")
    found = columns.mapInPandas(cut, "doc_id string, text_key string, start long, ids array<long>, grams array<long>")
    return found.withColumn("doc_id", F.col("doc_id").cast(dict(docs.dtypes)["doc_id"]))


def _align(ids: pd.Series, item: pd.Series, least: pd.Series) -> pd.DataFrame:
    """Alignments of passages that hold enough of the item's own bigrams; (0, -1, -1) of others."""
    rows = []
    for a, b, score in zip(ids, item, least, strict=True):
        a, b = np.asarray(a), np.asarray(b)
        held = np.isin(a[:-1] * BASE + a[1:], b[:-1] * BASE + b[1:]).sum()
        rows.append(smith_waterman(a, b) if held >= score - 1 else (0, -1, -1))
    return pd.DataFrame(rows, columns=["score", "first", "last"])


def _find_part(docs: DataFrame, items: list, min_score: float, least_words: int) -> DataFrame | None:
    spark = docs.sparkSession
    if (part := _part(items, min_score, least_words)) is None:
        return None
    reach, rows = _seeds(part, _gram_counts(docs, part))
    passages = stored(_passages(docs, part, reach), "decontaminate")
    # both have at most one row for each word of the part: broadcast, so that no passage waits for a seed of many items
    seeds = F.broadcast(spark.createDataFrame(rows, "gram long, number int"))
    tests = F.broadcast(spark.createDataFrame([(k, i, ids.tolist(), least_score(len(ids), min_score)) for k, (i, ids) in enumerate(part["items"])], "number int, item_key string, item array<long>, least int"))
    once = passages.groupBy("text_key", "start").agg(F.first("ids").alias("ids"), F.first("grams").alias("grams"))
    pairs = once.select("text_key", "start", F.explode("grams").alias("gram")).join(seeds, "gram").select("text_key", "start", "number").distinct()
    aligned = pairs.join(shuffled(once.select("text_key", "start", "ids")), ["text_key", "start"]).join(tests, "number")
    align = F.pandas_udf(_align, "score int, first long, last long")
    aligned = aligned.withColumn("found", align("ids", "item", "least")).where(F.col("found.score") >= F.col("least"))
    hits = aligned.select(
        "text_key", "item_key", (F.col("found.score") / F.size("item")).alias("score"),
        (F.col("start") + F.col("found.first")).alias("first_word"), (F.col("start") + F.col("found.last")).alias("last_word"),
    )
    best = hits.groupBy("text_key", "item_key").agg(F.max(F.struct("score", -F.col("first_word"), "last_word")).alias("b"))
    best = best.select("text_key", "item_key", "b.score", (-F.col("b.col2")).alias("first_word"), "b.last_word")
    return passages.select("doc_id", "text_key").distinct().join(shuffled(best), "text_key")


def contaminated(docs: DataFrame, benchmark: DataFrame, min_score: float = 0.6, part_words: int = 500_000, least_words: int = 3) -> DataFrame:
    """Rows (doc_id, text_key, item_id, score, first_word, last_word): documents that hold a copy of an item.

    One row for each doc_id, text and item: the best alignment, as a share of the
    item's words, and the words that it covers in the document. text_key is the
    text's md5. Items of fewer than ``least_words`` words match nothing, as a word or
    two are no test; at 1 or 2 they match exactly. Null and empty texts match nothing
    either; repeated documents count once; repeated items each count. item_id keeps its type.
    """
    if not 0.5 < min_score <= 1:
        raise ValueError("min_score must be above 0.5 and at most 1")
    spark = docs.sparkSession
    tests = benchmark.select("item_id", "text").where("text is not null")
    # each text once, however many items repeat it; parts by a hash of the text have about part_words words, or one text
    texts = stored(tests.groupBy(F.md5("text").alias("item_key")).agg(F.first("text").alias("text")), "benchmark-texts")
    words = texts.agg(F.sum(F.regexp_count("text", F.lit(rf"(?U)[{_JAVA_UNSPACED}]|\w+")))).first()[0] or 0
    parts = -(-words // part_words)
    found = []
    for k in range(parts):
        own = texts.where(F.pmod(F.xxhash64("item_key"), F.lit(parts)) == k) if parts > 1 else texts
        found.append(_find_part(docs, [tuple(r) for r in own.collect()], min_score, least_words))
    found = [x for x in found if x is not None]
    columns = ["doc_id", "text_key", "item_id", "score", "first_word", "last_word"]
    if not found:
        return docs.select("doc_id", F.md5("text").alias("text_key")).where("false").select("doc_id", "text_key", *(F.lit(None).cast(kind).alias(c) for c, kind in zip(columns[2:], (dict(benchmark.dtypes)["item_id"], "double", "long", "long"), strict=True)))
    keys = tests.select("item_id", F.md5("text").alias("item_key"))
    return reduce(DataFrame.union, found).join(shuffled(keys), "item_key").select(columns)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, min_score: float = 0.6) -> DataFrame:
    """``docs`` without those whose text holds a copy of a test item; all columns stay as they are.

    If there are too many such texts for a broadcast, the join is a shuffled one by
    text, in which Spark splits the documents of a text that many share.
    """
    key = narrow_name(docs, "text_key")
    bad = stored(contaminated(docs, benchmark, min_score).select(F.col("text_key").alias(key)).distinct(), "contaminated")
    return docs.withColumn(key, F.md5("text")).join(small_side(bad), key, "left_anti").select(docs.columns)


def op3_decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Columns doc_id, item_id, score, first_word, last_word; see contaminated().

    Documents without a copy have no row. Of alignments with the same score (ties) the
    earliest start counts, then the longest. Texts of any length are searched whole;
    an empty table on either side gives no rows; columns of other names are ignored.
    """
    return contaminated(docs, benchmark).select("doc_id", "item_id", "score", "first_word", "last_word")
