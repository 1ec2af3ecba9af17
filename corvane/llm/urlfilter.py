"""URL filters by a Bloom filter cascade.

Lists hold keys: a host with a path that ends in a slash (a rule), or a host alone.
Every url has a few keys that could be listed: the suffixes of its host, and these
with the prefixes of its path that end in a slash. All of them, over all urls, are
the universe of keys. The first filter encodes the listed keys; the second those
other keys of the universe that pass the first; the third the listed keys that pass
the second; and so on until nothing passes wrongly. Each url's keys are looked up in
these filters alone: the answer is exact, and no url is joined to a list.

The size of all filters follows from the number of listed keys (about 1.5 bits times
log2(universe / listed) + 3 for each), is checked against ``MAX_BYTES``, and is what
is broadcast. A larger list is split by a hash of its keys into parts of that size,
which are worked through one after the other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, narrow_name, stored

#: Limit on the size of one part's first filter (the others together are smaller).
MAX_BYTES = 64 << 20
#: Bits of a page of a filter: what Spark's bitmap functions gather in one row.
PAGE_BITS = 8 * 4096
MAX_LEVELS = 64
ALLOW, BLOCK, HOSTS = "allow", "block", "hosts"


@dataclass
class Bloom:
    """One level: a bit array with ``k`` probes; the level number salts its hashes."""

    level: int
    size: int
    k: int
    bits: np.ndarray

    @classmethod
    def places(cls, h1: np.ndarray, h2: np.ndarray, level: int, size: int, k: int) -> np.ndarray:
        a = (h1.astype(np.uint64) ^ np.uint64(level * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xFF51AFD7ED558CCD)
        a ^= a >> np.uint64(33)
        b = h2.astype(np.uint64) | np.uint64(1)
        return (a[:, None] + b[:, None] * np.arange(k, dtype=np.uint64)[None, :]) % np.uint64(size)

    def holds(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        at = self.places(h1, h2, self.level, self.size, self.k)
        return ((self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


@dataclass
class Cascade:
    """Filters by level; keys that pass all of them are listed if the number of levels is odd."""

    levels: list[Bloom]

    def holds(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        listed = np.zeros(len(h1), dtype=bool)
        left = np.arange(len(h1))
        for bloom in self.levels:
            left = left[bloom.holds(h1[left], h2[left])]
            if not left.size:
                break
            listed[left] = bloom.level % 2 == 1
            # those that fall out at an even level stay as the odd level before has set them
        return listed

    def bytes(self) -> int:
        return sum(b.bits.nbytes for b in self.levels)


def _probes(rate: float) -> int:
    return max(1, round(math.log2(1 / rate)))


def _bits(n: int, k: int) -> int:
    return max(64, math.ceil(n * k / math.log(2)))


def _bloom_of(keys: DataFrame, n: int, level: int, rate: float) -> Bloom:
    """A filter of the ``n`` rows (h1, h2): tasks gather its pages, and the driver gets each once."""
    k = _probes(rate)
    size = _bits(n, k)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = np.unique(Bloom.places(batch["h1"].to_numpy(), batch["h2"].to_numpy(), level, size, k))
            yield pd.DataFrame({"at": at.astype(np.int64) + 1})  # Spark's pages count from 1

    found = keys.select("h1", "h2").mapInPandas(find, "at long").groupBy(F.bitmap_bucket_number("at").alias("page"))
    bits = np.zeros(-(-size // PAGE_BITS) * PAGE_BITS // 8, dtype=np.uint8)
    for page, data in found.agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("data")).toLocalIterator():
        bits[(page - 1) * PAGE_BITS // 8 : page * PAGE_BITS // 8] = np.frombuffer(data, dtype=np.uint8)
    return Bloom(level, size, k, bits)


def _passing(keys: DataFrame, bloom: Bloom) -> DataFrame:
    shared = keys.sparkSession.sparkContext.broadcast(bloom)

    @F.pandas_udf("boolean")
    def holds(h1: pd.Series, h2: pd.Series) -> pd.Series:
        return pd.Series(shared.value.holds(h1.to_numpy(), h2.to_numpy()))

    return keys.where(holds("h1", "h2"))


def _rate(listed: int, every: int) -> float:
    """False positives of the first filter, given the numbers of listed keys and of all keys."""
    return min(0.5, max(1e-9, listed * math.sqrt(0.5) / max(every - listed, 1)))


def build_cascade(universe: DataFrame, listed: DataFrame, every: int) -> Cascade:
    """From the hashes (h1, h2) of all keys, ``every`` at most and repeats allowed, and of the listed ones."""
    inside = stored(listed.select("h1", "h2").distinct(), "cascade")
    n = inside.count()
    if not n:
        return Cascade([])
    levels = [_bloom_of(inside, n, 1, _rate(n, every))]
    outside = stored(_passing(universe.select("h1", "h2"), levels[0]).distinct().join(inside, ["h1", "h2"], "left_anti"), "cascade")
    while n := outside.count():
        if len(levels) == MAX_LEVELS:
            raise RuntimeError("two different keys have the same hashes")
        levels.append(_bloom_of(outside, n, len(levels) + 1, 0.5))
        inside, outside = outside, stored(_passing(inside, levels[-1]), "cascade")
    return Cascade(levels)


def url_parts(url: str):
    """Host (after the first ://, A-Z lower-cased) and path (up to ? or #) of the url column; both empty without ://."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def _hashes(kind, key) -> tuple:
    return F.xxhash64(kind, key), F.xxhash64(key, kind, F.lit(1))


def candidates(host, path, labels: int, depth: int):
    """Array of (kind, host, path) that could be listed: host suffixes of up to ``labels`` labels, path prefixes of up to ``depth`` slashes."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    suffixes = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(labels))), lambda k: F.array_join(F.slice(parts, n - k + 1, k), "."))
    pieces = F.split(path, "/")
    slashes = F.least(F.size(pieces) - 1, F.lit(depth))
    prefixes = F.when(slashes > 0, F.transform(F.sequence(F.lit(1), F.greatest(slashes, F.lit(1))), lambda k: F.concat(F.array_join(F.slice(pieces, 1, k), "/"), F.lit("/")))).otherwise(F.array().cast("array<string>"))
    one = lambda kind, h, p: F.struct(F.lit(kind).alias("kind"), h.alias("host"), p.alias("path"))
    ruled = F.flatten(F.transform(suffixes, lambda h: F.flatten(F.transform(prefixes, lambda p: F.array(one(ALLOW, h, p), one(BLOCK, h, p))))))
    return F.concat(ruled, F.transform(suffixes, lambda h: one(HOSTS, h, F.lit(""))))


def _keys(spark: SparkSession, rules, blocked_hosts) -> DataFrame:
    """Rows (kind, host, path) of both lists; an error if one is no rule."""
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(rules, "kind string, rule string")
    if not isinstance(blocked_hosts, DataFrame):
        blocked_hosts = spark.createDataFrame([(h,) for h in blocked_hosts], "host string")
    bad = rules.where(~F.coalesce(F.col("kind").isin(ALLOW, BLOCK) & F.col("rule").rlike("(?s)^[^/]+/(.*/)?$"), F.lit(False))).first()
    if bad:
        raise ValueError(f"a rule allows or blocks a host with a path that ends in a slash: {tuple(bad)!r}")
    host = F.substring_index("rule", "/", 1)
    cut = rules.select("kind", F.lower(host).alias("host"), F.expr("substring(rule, length(substring_index(rule, '/', 1)) + 1)").alias("path"))
    return stored(cut.union(blocked_hosts.where("host is not null").select(F.lit(HOSTS), F.lower("host"), F.lit(""))).distinct(), "url-keys")


def judge(pages: DataFrame, rules, blocked_hosts, url_col: str = "url", out: str = "judged") -> DataFrame:
    """``pages`` with a struct ``out`` of host, path, rule and verdict; a column of that name is replaced.

    ``rules``: rows (kind: allow or block, rule); ``blocked_hosts``: rows (host); each a
    DataFrame or a list. A rule fits its host and all its subdomains if
    the url's path starts with the rule's; the longest wins, then the one with the
    longer host, then block. Without a rule, a url is blocked if its host or a parent
    of it is in ``blocked_hosts``. Both lists are looked up in one cascade over the
    keys of all urls. Null urls and urls without :// have empty host and path, fit no
    rule and are allowed.
    """
    spark = pages.sparkSession
    keys = _keys(spark, rules, blocked_hosts)
    size = keys.agg(F.count("*"), F.max(F.size(F.split("host", r"\."))), F.max(F.size(F.split("path", "/")) - 1)).first()
    n, labels, depth = size[0], size[1] or 1, size[2] or 0
    host, path = url_parts(url_col)
    names = {x: narrow_name(pages, x) for x in ("keys", "held", "found", "place")}
    rows = pages.withColumn(out, F.struct(host.alias("host"), path.alias("path"))).withColumn(names["keys"], candidates(F.col(f"{out}.host"), F.col(f"{out}.path"), labels, depth))
    every = rows.agg(F.sum(F.size(names["keys"]))).first()[0] or 0
    parts = -(-_bits(n, _probes(_rate(n, every))) // (8 * MAX_BYTES)) if n else 1
    if parts > 1:
        rows = stored(rows.drop(names["keys"]).withColumn(names["place"], F.monotonically_increasing_id()), "url-rows")
        rows = rows.withColumn(names["keys"], candidates(F.col(f"{out}.host"), F.col(f"{out}.path"), labels, depth))
    universe, listed = _hashed(rows.select(F.explode(names["keys"]).alias("c")).select("c.*")), _hashed(keys)
    found = F.col(names["found"])
    if parts == 1:
        rows = _looked_up(rows, build_cascade(universe, listed, every), 0, 1, names)
    else:
        hits = []
        for k in range(parts):
            own = lambda df, k=k: df.where(F.pmod("h1", F.lit(parts)) == k)
            part = _looked_up(rows.select(names["place"], names["keys"]), build_cascade(own(universe), own(listed), every // parts), k, parts, names)
            hits.append(stored(part.select(names["place"], names["found"]), "url-hits").where(found["host"] | found["rule"].isNotNull()))
        best = F.struct(F.max(found["rule"]).alias("rule"), F.max(found["host"]).alias("host")).alias(names["found"])
        rows = rows.join(reduce(DataFrame.union, hits).groupBy(names["place"]).agg(best), names["place"], "left")
    default = F.when(F.coalesce(found["host"], F.lit(False)), BLOCK).otherwise(ALLOW)
    verdict = F.struct(F.col(f"{out}.host").alias("host"), F.col(f"{out}.path").alias("path"), found["rule"]["rule"].alias("rule"), F.coalesce(found["rule"]["kind"], default).alias("verdict"))
    return rows.withColumn(out, verdict).drop(*names.values())


def _hashed(keys: DataFrame) -> DataFrame:
    h1, h2 = _hashes(F.col("kind"), F.concat("host", F.lit("\n"), "path"))
    return keys.select(h1.alias("h1"), h2.alias("h2"))


def _looked_up(rows: DataFrame, cascade: Cascade, part: int, parts: int, names: dict) -> DataFrame:
    """``rows`` with found: the best rule and whether a host is listed, of the keys of one part."""
    shared = rows.sparkSession.sparkContext.broadcast(cascade)

    @F.pandas_udf("array<boolean>")
    def listed(h1: pd.Series, h2: pd.Series) -> pd.Series:
        sizes = h1.map(len).to_numpy()
        if not sizes.sum():
            return pd.Series([[]] * len(h1))
        first = np.concatenate(h1.to_list())
        held = shared.value.holds(first, np.concatenate(h2.to_list()))
        if parts > 1:
            held &= first % parts == part
        return pd.Series(np.split(held, np.cumsum(sizes)[:-1]))

    of = lambda n: F.transform(names["keys"], lambda c: _hashes(c["kind"], F.concat(c["host"], F.lit("\n"), c["path"]))[n])
    rows = rows.withColumn(names["held"], listed(of(0), of(1)))
    hits = F.transform(F.filter(F.arrays_zip(names["keys"], names["held"]), lambda z: z[names["held"]]), lambda z: z[names["keys"]])
    ruled = F.transform(F.filter(hits, lambda c: c["kind"] != HOSTS), lambda c: F.struct((F.length(c["host"]) + F.length(c["path"])).alias("length"), F.length(c["host"]).alias("host_length"), c["kind"].alias("kind"), F.concat(c["host"], c["path"]).alias("rule")))
    return rows.withColumn(names["found"], F.struct(F.array_max(ruled).alias("rule"), F.exists(hits, lambda c: c["kind"] == HOSTS).alias("host")))


# The rules of the contract.
RULES = [(ALLOW, "com/"), (BLOCK, "example.com/en/"), (ALLOW, "www.example.com/en/"), (BLOCK, "net/es/"), (BLOCK, "net/fr/")]
#: Hosts of junk and advertising in the pages; with all subdomains.
BLOCKED_HOSTS = [
    f"{name}.example.{top}" for name in ("casino-win", "cheap-pills", "spam-farm", "free-bets", "ads-track", "adult-x") for top in ("com", "net", "org")
]


def op1_url_filter(pages: DataFrame) -> DataFrame:
    """Columns page_id, host, path, rule, verdict for every row.

    Null urls and urls without :// have empty host and path, and are allowed; urls of
    any length are judged whole; ties between rules are settled as judge() says.
    Repeated rows come out as often as they went in; an empty table gives no rows;
    other columns are ignored.
    """
    return judge(pages.select("page_id", "url"), RULES, BLOCKED_HOSTS).select("page_id", *(F.col(f"judged.{c}").alias(c) for c in ("host", "path", "rule", "verdict")))


_HOST = "coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
OP1_SQL = f"""
with cut as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages
), parts as (
  select page_id, {_HOST} as host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from cut
), rules(kind, rule) as (values {", ".join(f"('{k}', '{r}')" for k, r in RULES)}),
split as (select kind, rule, split_part(rule, '/', 1) as own, substr(rule, instr(rule, '/')) as prefix from rules)
select page_id, host, path,
  (select rule from split where (host = own or ends_with(host, '.' || own)) and starts_with(path, prefix) order by length(rule) desc, length(own) desc limit 1) as rule,
  coalesce(
    (select kind from split where (host = own or ends_with(host, '.' || own)) and starts_with(path, prefix) order by length(rule) desc, length(own) desc limit 1),
    case when {" or ".join(f"host = '{h}' or ends_with(host, '.{h}')" for h in BLOCKED_HOSTS)} then 'block' else 'allow' end) as verdict
from parts"""
