"""Spelling variants of the words of a corpus, by a symmetric-delete join.

Every frequent word emits the hash of itself and of each of its distinct single deletions.
Two words that differ by one inserted, deleted or replaced character share such a
key, so an equi-join finds all of them, and the exact distance then decides. A key's
words all have its characters and at most one more, so however large the corpus is, no key
gathers more than about 90 words for each place of the key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, give_back, stored

LETTERS = "[A-Za-zÀ-ÿ]+"
#: An odd multiplier for hashes of words: sums of characters times its powers, modulo 2^64.
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def deletion_keys(word: str) -> np.ndarray:
    """Hashes of the word and of each different word that lacks one of its characters, in linear time."""
    codes = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
    n = len(codes)
    if not n:
        return np.zeros(1, dtype=np.uint64)
    powers = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(n, FACTOR))])
    before = np.concatenate([[np.uint64(0)], np.add.accumulate(codes * powers[:n])])
    after = np.concatenate([[np.uint64(0)], np.add.accumulate(codes[1:] * powers[: n - 1])])
    # the same characters in a row: deleting any of them gives the same word
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    shorter = before[first] + (after[-1] - after[first])
    return np.concatenate([before[-1:], np.unique(shorter)])


def corpus_words(docs: DataFrame, least_length: int = 6, least_count: int = 5, altered=None) -> DataFrame:
    """(word, n): the corpus's words of enough characters and occurrences.

    ``altered`` maps the column of a run of letters (lower-cased in A-Z) to that of
    the word it counts as. Counts are combined in each task before they are shuffled.
    """
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(LETTERS), F.lit(0))).alias("run")).where(F.length("run") >= least_length)
    runs = runs.select("doc_id", ascii_lower(F.col("run")).alias("run"))
    words = runs.select((F.col("run") if altered is None else altered(F.col("run"))).alias("word"))
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def near_words(words: DataFrame) -> DataFrame:
    """(a, na, b, nb): every two of the stored ``words`` (id, word, n) that one edit makes equal, once in each order."""

    @F.pandas_udf("array<bigint>")
    def keys(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([deletion_keys(w).view(np.int64) for w in batch])
        give_back()

    # ids travel with the keys, not words: a word of a million letters has as many keys
    emitted = stored(words.select("id", F.explode(keys("word")).alias("key")), "variants-keys")
    left, right = emitted.select("key", F.col("id").alias("x")), emitted.select("key", F.col("id").alias("y"))
    pairs = left.join(right, "key").where("x < y").select("x", "y").distinct()
    side = lambda i, w, n: words.select(F.col("id").alias(i), F.col("word").alias(w), F.col("n").alias(n))
    spelled = pairs.join(side("x", "a", "na"), "x").join(side("y", "b", "nb"), "y")
    found = spelled.where(F.levenshtein("a", "b", 1) == 1).select("a", "na", "b", "nb")
    both = F.explode(F.array(F.struct("a", "na", "b", "nb"), F.struct(F.col("b").alias("a"), F.col("nb").alias("na"), F.col("a").alias("b"), F.col("na").alias("nb"))))
    return found.select(both.alias("p")).select("p.*")


def variant_forms(words: DataFrame, times: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of words (word, n).

    A word's form is its near word of largest count, of equals the first by code
    points, if that counts ``times`` as much; its root is what forms lead to in the end. As counts
    rise from form to form there is no circle, and few steps: each round of the join doubles them.
    """
    words = stored(words.select("word", "n").withColumn("id", F.monotonically_increasing_id()), "variants-words")
    best = F.min(F.struct((-F.col("nb")).alias("minus"), F.col("b").alias("form"))).alias("best")
    near = near_words(words).groupBy("a").agg(F.count("*").alias("n_near"), F.max("na").alias("na"), best)
    near = near.withColumn("form_n", F.when(-F.col("best.minus") >= times * F.col("na"), -F.col("best.minus")))
    near = stored(near.select("a", "n_near", F.when(F.col("form_n").isNotNull(), F.col("best.form")).alias("form"), "form_n"), "variants-near")
    roots = stored(near.where("form is not null").select(F.col("a").alias("own"), F.col("form").alias("root")), "variants-roots")
    while True:
        further = roots.select(F.col("own").alias("root"), F.col("root").alias("further"))
        roots = stored(roots.join(further, "root", "left").select("own", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "variants-roots")
        if roots.where("moved").isEmpty():
            break
        roots = roots.drop("moved")
    joined = words.join(near, words.word == near.a, "left").join(roots, F.col("word") == F.col("own"), "left")
    return joined.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


def op12_variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the frequent words of ``docs``, one row each.

    One run of letters in 199, by a checksum of doc_id and run, loses a character before it is
    counted, as the query's contract fixes; where the doc_id is null, none does. Null and empty texts
    have no words; texts and words of any length count whole; repeated rows count as
    often as they stand. An empty table gives no rows; other columns are ignored.
    """

    def altered(run):
        h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), run).cast("binary"))
        at = (h % F.length(run)).cast("int")
        return F.when(h % 199 == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)

    return variant_forms(corpus_words(docs, altered=altered))


#: Letters beyond ASCII, and an ASCII character for each: DuckDB's levenshtein counts bytes.
_LATIN, _ASCII = "".join(chr(c) for c in range(0xC0, 0x100)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 !#$%&()*+,-./:;<=>?@[]^_{|}"

#: The checksum is worked out byte by byte, with the table of its polynomial.
OP12_SQL = f"""with recursive t as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: case when c % 2 = 1 then xor(3988292384, c // 2) else c // 2 end)) as t),
runs as (select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents),
own as (select doc_id, run, count(*) as n from runs where length(run) >= 6 group by all),
bytes as (select *, flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda x: case when ord(x) < 128 then [ord(x)] else [192 + ord(x) // 64, 128 + ord(x) % 64] end)) as b from own),
sums as (select run, n, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(b, lambda x: x::bigint)), lambda c, x: xor(t[xor(c % 256, x) + 1], c // 256)), 4294967295::bigint) as h from bytes, t),
words as (select case when h % 199 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, n from sums),
w as (select word, sum(n)::bigint as n, translate(word, '{_LATIN}', '{_ASCII}') as plain from words group by word having length(word) >= 6 and sum(n) >= 5),
near as (select a.word, a.n, b.word as other, b.n as other_n from w a join w b on length(b.word) between length(a.word) - 1 and length(a.word) + 1 and a.word != b.word where levenshtein(a.plain, b.plain) = 1),
best as (select word, count(*) as n_near, first(other order by other_n desc, other) as other, max(other_n) as other_n from near group by word),
f as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when other_n >= 5 * w.n then other end as form, case when other_n >= 5 * w.n then other_n end as form_n from w left join best using (word)),
r as (select word, word as root, form as following from f union all select r.word, f.word, f.form from r join f on f.word = r.following)
select f.word, f.form, r.root, f.n, f.n_near, f.form_n from f join r on r.word = f.word where r.following is null"""
