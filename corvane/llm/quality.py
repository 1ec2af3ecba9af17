"""Quality rules per document and per host.

Each document is held against five rules on its words and lines. Two of them are
firm: a document that fails one is rejected. Failures of each rule are counted by
host, and each host's failure rate is drawn towards that of all hosts by a beta
prior fitted to their spread (method of moments of the beta-binomial), one for each
rule. Two verdicts on hosts follow and are joined back to their documents:

* closed: documents of a host whose rate of firm failures stays above a limit all go;
* watched: a host whose rate for some rule is above that of the corpus with near
  certainty (posterior mean less ``doubt`` standard deviations) gets no benefit of the
  doubt: its documents go if they fail that rule, be it firm or not.

So a document that fails no rule goes only with a closed host.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, narrow_name, stored

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Rejected hosts up to which their names are broadcast, and tasks over which a host's rows are dealt beyond it.
BROADCAST_HOSTS, SALTS = 200_000, 32
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: The rules, the firm ones first.
FIRM, RULES = ("few_words", "repeats"), ("few_words", "repeats", "odd_words", "symbols", "dup_lines")
#: Odd multipliers, one for each place in a window.
_ODD = np.random.default_rng(8).integers(1, 1 << 62, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that stand in a window of ``window`` words found twice or more, its first occurrence included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.uint64, count=len(words))
    if len(numbers) == len(words):
        return 0
    ids = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    ids ^= ids >> np.uint64(29)
    keys = np.zeros(n, dtype=np.uint64)
    for k in range(window):
        keys += ids[k : k + n] * _ODD[k]
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(covered, np.flatnonzero(twice), 1)
    np.add.at(covered, np.flatnonzero(twice) + window, -1)
    return int((np.cumsum(covered) > 0).sum())


def text_stats(text: str | None) -> tuple[int, int, int, int, int]:
    """The STATS of one text; words are separated by ASCII white space only."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    seen: set[bytes] = set()
    repeats = 0
    for line in raw.split(b"\n"):
        if line in seen:
            repeats += 1
        elif line.strip(SPACES):
            seen.add(line)
    spaces = len(raw) - len(raw.translate(None, SPACES))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    return len(words), len(text or "") - spaces, symbols, repeats, repeated_words(words)


def _stats(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        yield pd.DataFrame([text_stats(t) for t in texts], columns=list(STATS), dtype="int64")
    give_back()


def stats_of(text):
    """Struct of the STATS of a text column."""
    return F.pandas_udf(_stats, ", ".join(f"{s} long" for s in STATS))(text)


@dataclass(frozen=True)
class Rules:
    """Limits for one document (see failures()), and for the rates of a host's failures."""

    min_words: int = 20
    max_repeat_percent: int = 30
    #: Characters in a word, on average.
    word_length: tuple[float, float] = (3.0, 10.0)
    max_symbol_percent: int = 10
    max_dup_line_percent: int = 10
    max_host_rate: float = 0.5
    doubt: float = 2.0

    def failures(self, stats) -> dict:
        """A boolean column for each of RULES; texts without words fail the first alone."""
        words, some = stats["n_words"], stats["n_words"] > 0
        low, high = self.word_length
        return {
            "few_words": words < self.min_words,
            "repeats": 100 * stats["n_repeat_words"] > self.max_repeat_percent * words,
            "odd_words": some & ((stats["word_chars"] < low * words) | (stats["word_chars"] > high * words)),
            "symbols": 100 * stats["n_symbols"] > self.max_symbol_percent * words,
            "dup_lines": 100 * stats["n_dup_lines"] > self.max_dup_line_percent * words,
        }


def host_verdicts(failed: DataFrame, host: str, rules: Rules) -> DataFrame:
    """Rows (host, closed, watched): verdicts on hosts that have one; ``watched`` is a struct of booleans by rule.

    ``failed`` has ``host`` and a boolean for each of RULES and for ``firm`` (any firm rule).
    Null hosts get none. One row of sums is collected.
    """
    every = [*RULES, "firm"]
    hosts = failed.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host"))
    hosts = stored(hosts.agg(F.count("*").alias("n"), *(F.sum(F.col(r).cast("long")).alias(r) for r in every)), "hosts")
    n = F.col("n").cast("double")
    sums = [F.count("*").alias("hosts"), F.sum(n).alias("n"), F.sum(n * n).alias("n2")]
    sums += [f(F.col(r)).alias(f"{r}_{k}") for r in every for k, f in (("sum", F.sum), ("square", lambda c: F.sum(c * c / n)))]
    total = hosts.agg(*sums).first()
    if not total["hosts"]:
        return hosts.select("host", F.lit(False).alias("closed"), F.struct(*(F.lit(False).alias(r) for r in RULES)).alias("watched"))
    rate, spread, mean = {}, {}, {}
    for r in every:
        mean[r], weight = _prior(total["hosts"], total["n"], total["n2"], total[f"{r}_sum"], total[f"{r}_square"])
        rate[r] = (F.col(r) + mean[r] * weight) / (n + weight)
        spread[r] = F.sqrt(rate[r] * (1 - rate[r]) / (n + weight + 1))
    watched = F.struct(*((rate[r] - rules.doubt * spread[r] > mean[r]).alias(r) for r in RULES))
    verdicts = hosts.select("host", (rate["firm"] > rules.max_host_rate).alias("closed"), watched.alias("watched"))
    return verdicts.where(reduce(or_, [F.col("closed"), *(F.col(f"watched.{r}") for r in RULES)]))


def _prior(hosts: int, n: float, n2: float, failures: float, squares: float) -> tuple[float, float]:
    """Mean and weight (in documents) of the beta prior: what spread of the hosts' rates goes beyond chance.

    ``squares`` is the sum of failures * failures / n over hosts, so the sum of
    n * (failures / n - mean) ** 2 is squares - mean * failures.
    """
    mean, extra = failures / n, hosts - 1
    noise = mean * (1 - mean)
    room = noise * (n - n2 / n - extra)
    likeness = (squares - mean * failures - noise * extra) / room if room > 0 else 0.0
    return mean, 1 / min(max(likeness, 1e-6), 0.999) - 1


def judged(rows: DataFrame, rules: Rules, host: str, stats: str, failed: str, kept: str) -> DataFrame:
    """``rows``, which hold a struct ``stats`` from stats_of(), with the booleans ``failed`` (a firm rule) and ``kept``."""
    own, key = narrow_name(rows, "broken"), narrow_name(rows, "judged_host")
    failures = rules.failures(F.col(stats))
    firm = reduce(or_, (failures[r] for r in FIRM))
    rows = rows.withColumn(own, F.struct(*(c.alias(r) for r, c in failures.items()), firm.alias("firm")))
    found = host_verdicts(rows.select(host, f"{own}.*") if host not in (*RULES, "firm") else rows.select(F.col(host).alias(key), f"{own}.*"), host if host not in (*RULES, "firm") else key, rules)
    bad = stored(found.select(F.col("host").alias(key), F.struct("closed", "watched").alias(key + "_verdict")), "judged-hosts")
    if bad.count() <= BROADCAST_HOSTS:
        joined = rows.join(F.broadcast(bad), rows[host] == bad[key], "left")
    else:  # a host may hold a third of all rows: its rows go to SALTS tasks
        salt = narrow_name(rows, "salt")
        bad = bad.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn(salt, F.pmod(F.xxhash64("doc_id", "text" if "text" in rows.columns else stats), F.lit(SALTS)))
        joined = rows.join(bad, (rows[host] == bad[key]) & (rows[salt] == bad[salt]), "left").drop(rows[salt], bad[salt])
    verdict = lambda x: F.coalesce(F.col(f"{key}_verdict.{x}"), F.lit(False))
    caught = reduce(or_, (F.col(f"{own}.{r}") & verdict(f"watched.{r}") for r in RULES))
    out = joined.withColumn(failed, F.col(f"{own}.firm"))
    return out.withColumn(kept, ~F.col(failed) & ~verdict("closed") & ~caught).drop(key, f"{key}_verdict", own)


def without_failures(docs: DataFrame, rules: Rules = Rules(), host: str = "source") -> DataFrame:
    """``docs`` without those that fail a firm rule or that their host's verdict rejects; all columns stay as they are.

    The texts are read twice, for the hosts and for the documents: to read
    them once, whole texts would have to be stored in between.
    """
    stats, failed, kept = (narrow_name(docs, n) for n in ("stats", "failed", "kept"))
    return judged(docs.withColumn(stats, stats_of("text")), rules, host, stats, failed, kept).where(kept).select(docs.columns)


def op5_quality(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Columns doc_id, the STATS, base_failed and kept for every row; ``source`` is the host.

    Null and empty texts have no words and fail. Texts of any length count whole.
    Documents without a source are judged on their own. Repeated rows come out as
    often as they went in, and count as often for their host. Rates that equal a limit
    (ties) are within it. An empty table gives no rows; columns of other names are ignored.
    """
    narrow = stored(docs.select("doc_id", "source", stats_of("text").alias("stats")), "quality")
    rows = judged(narrow, rules, "source", "stats", "base_failed", "kept")
    return rows.select("doc_id", *(F.col(f"stats.{s}").alias(s) for s in STATS), "base_failed", "kept")


def _rate_sql(r: str) -> str:
    """Posterior mean and standard deviation of a host's rate for one rule, from the sums of ``total``."""
    noise = f"({r}_sum / n_sum * (1 - {r}_sum / n_sum))"
    room = f"({noise} * (n_sum - n2_sum / n_sum - (hosts - 1)))"
    likeness = f"(case when {room} > 0 then ({r}_square - {r}_sum / n_sum * {r}_sum - {noise} * (hosts - 1)) / {room} else 0 end)"
    weight = f"(1 / least(greatest({likeness}, 1e-6), 0.999) - 1)"
    return f"({r} + {r}_sum / n_sum * {weight}) / (n + {weight}) as {r}_rate, n + {weight} + 1 as {r}_size"


_EVERY = (*RULES, "firm")
OP5_SQL = rf"""
with texts as (
  select row_number() over () as place, doc_id, source, coalesce(text, '') as t from documents
), cut as (
  select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from texts
), spots as (
  select place, unnest(w) as word, generate_subscripts(w, 1) as k from cut
), eights as (
  select place, k, word || {" || ".join(f"' ' || lead(word, {x}) over next" for x in range(1, WINDOW))} as eight from spots window next as (partition by place order by k)
), windows as (
  select place, k, count(*) over (partition by place, eight) as times from eights where eight is not null
), covered as (
  select place, count(distinct k + x) as n from windows, range(0, {WINDOW}) o(x) where times > 1 group by place
), stats as (
  select place, doc_id, source, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
    cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, coalesce(n, 0) as n_repeat_words
  from cut left join covered using (place)
), broken as (
  select *, n_words < 20 as few_words, 100 * n_repeat_words > 30 * n_words as repeats,
    n_words > 0 and (word_chars < 3.0 * n_words or word_chars > 10.0 * n_words) as odd_words,
    100 * n_symbols > 10 * n_words as symbols, 100 * n_dup_lines > 10 * n_words as dup_lines,
    n_words < 20 or 100 * n_repeat_words > 30 * n_words as firm
  from stats
), hosts as (
  select source, cast(count(*) as double) as n, {", ".join(f"cast(count(*) filter ({r}) as double) as {r}" for r in _EVERY)} from broken where source is not null group by source
), total as (
  select cast(count(*) as double) as hosts, sum(n) as n_sum, sum(n * n) as n2_sum, {", ".join(f"sum({r}) as {r}_sum, sum({r} * {r} / n) as {r}_square" for r in _EVERY)} from hosts
), rates as (
  select hosts.source, {", ".join(_rate_sql(r) for r in _EVERY)}, {", ".join(f"{r}_sum / n_sum as {r}_mean" for r in _EVERY)} from hosts, total
), verdicts as (
  select source, firm_rate > 0.5 as closed, {", ".join(f"{r}_rate - 2.0 * sqrt({r}_rate * (1 - {r}_rate) / {r}_size) > {r}_mean as {r}_watched" for r in RULES)} from rates
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, firm as base_failed,
  not firm and not coalesce(closed, false) {" ".join(f"and not ({r} and coalesce({r}_watched, false))" for r in RULES)} as kept
from broken left join verdicts using (source)"""
